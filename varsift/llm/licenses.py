"""License scans with built-in functions only (operator 10).

Base rules are phrases whose words stand consecutively. The method is an exact set-similarity join between text blocks
and license templates: a block matches a template if at least CONTAINMENT of the template's distinct words are in it.
Template words are put in the order of their document frequency over the whole corpus, rarest first. Of a template with
n words of which a must be found, any matching block holds one of the first n - a + 1: the first of the template's words
that a block holds, at place i, leaves n - i at most (prefix and positional filter). These prefixes are an index by
word, to which the words of the texts are joined; the pairs of template and block that come out are verified by joining
the block's other words, and counting the distinct ones. Texts of fewer than a words are left out before (length
filter). The filters only skip blocks that cannot match.

Blocks are runs of consecutive words of the whole text, whatever lines they stand on, so that a wrapped notice counts as
a whole. For a template of L words (repeats included) they hold 2 L words and begin at every L-th, so any L consecutive
words stand in one of them. A block must also hold those words of the template that tell its license from others
(MARKS).

Templates are the small side: they go in passes of at most PASS_WORDS words, which are broadcast. Equal texts have equal
results, so blocks go by a digest of the text's words, and what copies have in common is merged before it is shuffled.
Only texts that hold a prefix word are split into words for the join.

Defined cases: a null text is an empty one, without words or places; a null doc_id is carried; repeated rows give
repeated results; a text is read whole, however long; an empty table gives an empty result; extra columns are kept by
scan(), but for those that have the name of a result, whose place the result takes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.llm import common

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Words of the templates that one pass joins.
PASS_WORDS = 5_000

#: The phrases of the base rules.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by which licenses are commonly declared.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]

#: Words that tell a license from others; a block holds all those that a template has if it matches.
MARKS = {"gpl": ["gnu"], "apache": ["apache"], "mit": ["mit"], "cc-by": ["cc", "creative", "commons"], "mpl": ["mozilla"]}


RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def plain(rows: DataFrame, text: str, *columns: str) -> DataFrame:
    """Columns of rows, and plain: the words of a text, A-Z in lower case, each with a blank before and behind, ' a b c ';
    a wordless text is ' '."""
    # lower() is many times faster than replacing A-Z. It changes non-ASCII letters as well, but of those two alone turn
    # into ASCII ones, and no phrase or template word has any other.
    whole = F.coalesce(F.col(text), F.lit(""))
    lower = F.when(whole.contains("\u212a") | whole.contains("\u0130"), common.lower_az(whole)).otherwise(F.lower(whole))
    words = F.trim(F.regexp_replace(lower, NOT_WORD, " "))
    # behind a generator they stand once: else every filter on what follows from them would work them out anew
    once = rows.select(*columns, F.explode(F.array(words)).alias("words"))
    return once.select(*columns, F.when(F.col("words") == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), "words", F.lit(" "))).alias("plain"))


def _blanks(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, " ", ""))).cast("long")


def plain_words(text: str) -> list[str]:
    """Words of a template."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def template_words(text: str) -> list[str]:
    """Distinct words of a template."""
    return list(dict.fromkeys(plain_words(text)))


def frequencies(plains: DataFrame, words: list[str]) -> dict[str, int]:
    """Document frequency of each template word over all rows of `plain`; as many rows reach the driver as there are words."""
    wanted = F.array(*map(F.lit, words))
    held = plains.where(_holds(words)).select(F.explode(F.array_intersect(F.split("plain", " "), wanted)).alias("word"))
    return {r["word"]: r["count"] for r in held.groupBy("word").count().collect()}


def ordered_templates(templates: list[tuple[str, str]], seen: dict[str, int], threshold: float) -> list[tuple]:
    """Label, words from rare to frequent, the number of words a match must share, and the length of each template."""
    out = []
    for label, text in templates:
        words = sorted(template_words(text), key=lambda w: (seen.get(w, 0), w))
        if words:
            out.append((label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), len(plain_words(text))))
    return out


def _passes(templates: list[tuple]) -> Iterator[list[tuple]]:
    held, words = [], 0
    for t in templates:
        if held and words + len(t[1]) > PASS_WORDS:
            yield held
            held, words = [], 0
        held.append(t)
        words += len(t[1])
    if held:
        yield held


def _holds(words: list[str]) -> Column:
    """Whether a text holds one of the words."""
    return F.col("plain").rlike(" (?:" + "|".join(map(re.escape, words)) + ") ")


def _matches(plains: DataFrame, templates: list[tuple]) -> DataFrame:
    """digest, label and share of every block of `plain` (n_words) that matches one of the templates."""
    spark = plains.sparkSession
    rows = [(k, label, w, i <= len(ws) - least, w in MARKS.get(label, ())) for k, (label, ws, least, _) in enumerate(templates) for i, w in enumerate(ws)]
    index = F.broadcast(spark.createDataFrame(rows, "template int, label string, word string, prefix boolean, mark boolean").select("template", "word", "prefix", "mark"))
    facts = [(k, label, len(ws), least, n, sum(w in MARKS.get(label, ()) for w in ws)) for k, (label, ws, least, n) in enumerate(templates)]
    known = F.broadcast(spark.createDataFrame(facts, "template int, label string, words int, least int, length int, marks int"))
    first = sorted({w for _, ws, least, _ in templates for w in ws[: len(ws) - least + 1]})
    texts = plains.where(F.col("n_words") >= min(t[2] for t in templates)).where(_holds(first))
    words = texts.select(F.md5("plain").alias("digest"), "n_words", F.posexplode(F.split(F.trim("plain"), " ")).alias("at", "word"))
    held = words.join(index, "word").join(known.select("template", "length", "least"), "template").where("n_words >= least")
    # the blocks that a word stands in begin at its place or up to two lengths before it; the last block ends the text
    own = F.floor(F.col("at") / F.col("length")).cast("int")
    last = F.greatest(F.lit(0), F.ceil(F.col("n_words") / F.col("length")).cast("int") - 2)
    blocks = F.array_distinct(F.array(F.greatest(F.lit(0), F.least(own - 1, last)), F.least(own, last)))
    found = held.select("digest", "template", "word", "prefix", "mark", F.explode(blocks).alias("block")).distinct()
    tallied = found.groupBy("digest", "template", "block").agg(F.count("*").alias("shared"), F.max("prefix").alias("proposed"), F.sum(F.col("mark").cast("int")).alias("marked"))
    return tallied.where("proposed").join(known, "template").where("shared >= least and marked = marks").select("digest", "label", (F.col("shared") / F.col("words")).alias("share"))


def scan(docs: DataFrame, phrases: dict[str, str], templates: list[tuple[str, str]], threshold: float = CONTAINMENT, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels and labels (arrays) and score.

    labels holds the labels of the base rules and of the templates that some block of the text matches.
    """
    # the columns of docs go by in one struct, so that their names can't clash with those made here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in common.others(docs, RESULTS))).alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = plain(rows, "text", "row")
    vocabulary = list(dict.fromkeys(w for _, t in templates for w in template_words(t)))
    order = ordered_templates(templates, frequencies(rows.select("plain"), vocabulary) if vocabulary else {}, threshold)

    words = F.when(F.col("plain") == " ", F.lit(0).cast("long")).otherwise(_blanks(F.col("plain")) - 1)
    rows = rows.withColumn("n_words", words)
    cut = {}
    for i, phrase in enumerate(phrases):
        at = rf"(?<= )(?={re.escape(phrase).replace(chr(92) + ' ', ' ')} )"
        cut[f"cut{i}"] = F.when(F.col("plain").contains(f" {phrase} "), F.split("plain", at, -1))
    counts, firsts, lasts, base = [], [], [], []
    for i, label in enumerate(phrases.values()):
        pieces = F.col(f"cut{i}")
        counts.append(F.when(pieces.isNull(), F.lit(0).cast("long")).otherwise(F.size(pieces).cast("long") - 1))
        firsts.append(_blanks(F.get(pieces, F.lit(0))) - 1)
        lasts.append(F.col("n_words") - _blanks(F.element_at(pieces, -1)))
        base.append(F.when(pieces.isNotNull(), F.lit(label)))
    none = F.lit(None).cast("long")
    judged = rows.withColumns(cut).select(
        "row",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts, none).alias("first_word"),
        F.greatest(*lasts, none).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))).alias("base_labels"),
        F.md5("plain").alias("digest"),
    )
    matches = [_matches(rows, some) for some in _passes(order)]
    own = ["row.*", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    based = F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)
    if not matches:
        return judged.select(*own, F.col("base_labels").alias("labels"), based.alias("score"))
    every = reduce(DataFrame.union, matches).groupBy("digest").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    return judged.join(every, "digest", "left").select(*own, labels.alias("labels"), F.greatest(based, F.coalesce("share", F.lit(0.0))).alias("score"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASES, TEMPLATES)
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score"
    )


def _list(words: list[str]) -> str:
    return "cast([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "] as varchar[])"


def _sql() -> str:
    """The query in SQL: every block of every text against every template."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrases = ", ".join(f"('{label}', {_list(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(
        f"('{label}', {_list(ws)}, {_list([w for w in MARKS.get(label, []) if w in ws])}, {length}, {least})" for label, ws, least, length in ordered_templates(TEMPLATES, {}, CONTAINMENT)
    )
    return f"""with docs as (
  select row_number() over () as r, doc_id, {words} as w from documents
), phrases as (select * from (values {phrases}) as t(label, p)
), templates as (select * from (values {templates}) as t(label, words, marks, length, least)
), placed as (
  select r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda a: w[a + 1 : a + len(p)] = p)) as a from docs cross join phrases
), based as (
  select r, count(*) as n_base, min(a) as first_word, max(a) as last_word, list(distinct label) as base from placed group by r
), tried as (
  select r, label, least, len(words) as n, list_max(list_transform(range(0, greatest(1, cast(ceil(len(w) / length) as bigint) - 1)), lambda i:
    case when list_has_all(w[i * length + 1 : (i + 2) * length], marks) then len(list_intersect(words, list_distinct(w[i * length + 1 : (i + 2) * length]))) else 0 end)) as shared
  from docs cross join templates
), matched as (
  select r, list(distinct label) as more, max(shared / n) as share from tried where shared >= least group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') as labels,
       greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(share, 0)) as score
from docs left join based using (r) left join matched using (r)"""


SQL = _sql()
