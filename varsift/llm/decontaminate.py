"""Benchmark decontamination by a generalised suffix automaton (operator 5).

The words of all benchmark items, joined by separators that no document has, form one suffix automaton. A document's
words stream through it, and the automaton's state gives the longest run of words ending there that stands in one
item. Where that length reaches the window, the words of the run are hit; the state's suffix-link ancestor of window
length tells which items hold the window. Items shorter than a window count as one window each, found as ancestors.

Streaming every word through a Python automaton would be slow, so vectorised filters first find the stretches that
can hold a window: all words known to the benchmark, all adjacent pairs among its pairs (a hashed bitmap; it has no
false negatives), and long enough. Only those stretches are streamed. Elsewhere no window can end, so nothing is lost.

The automaton is sent to the executors, so its size is bounded: items are cut into chunks of CHUNK_WORDS words, and
the documents pass through one automaton after the other, without a shuffle, carrying their hits along. An item longer
than a chunk is cut into pieces that overlap by a window less one word, so every window stands whole in some piece.

Defined cases: a null or wordless text has no words, no hits and is not contaminated; items that are null or without
words take no part; equal items count by their own ids; a null item_id takes no part; repeated rows give repeated
results; an empty benchmark hits nothing; an empty documents table gives an empty result; extra columns are kept, but
for those that have the name of a result; a text is read whole, however long, and takes some ten times its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common

WINDOW = 13
#: Words of benchmark items in one automaton; it bounds what the driver builds and every executor holds.
CHUNK_WORDS = 200_000
#: Automata that one plan passes documents through before its result is written to the shared folder. Each stands in a
#: Python worker of its own, at some 850 bytes a word.
PASSES_A_PLAN = 2

#: Upper case becomes lower case, what is neither a digit, a letter nor a byte of a non-ASCII character a blank.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PAIR_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after lower-casing A-Z."""
    return text.translate(_CLEAN).split()


def _pair_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _PAIR_BITS)


class Automaton:
    """Suffix automaton over the words of items; items with the same words share their states."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.length, self.link, self.next = [0], [-1], [{}]
        #: items whose text passes through the state's end position; the items of a state are those of its subtree
        self.owners: list[list[int]] = [[]]
        last, separator = 0, -1
        short: list[tuple[int, int, int]] = []
        for item, words in items:
            for w in words:
                last = self._extend(last, self.vocabulary[w])
                self.owners[last].append(item)
            if len(words) < window:
                short.append((item, len(words), last))
            last = self._extend(last, separator)
            separator -= 1
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.children: list[list[int]] = [[] for _ in self.length]
        for s in order:
            self.children[self.link[s]].append(s)
        #: the nearest state, itself included, that ends a short item, and those items by length
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, n, state in short:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            self.short.setdefault(state, []).append((n, item))
        self.short_above = [-1] * len(self.length)
        for s in order:
            self.short_above[s] = s if s in self.short else self.short_above[self.link[s]]
        self.least = min([window, *(n for _, n, _ in short)])
        self.found: dict[int, frozenset[int]] = {}
        pairs = [(self.vocabulary[a], self.vocabulary[b]) for _, words in items for a, b in zip(words, words[1:])]
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        if pairs:
            at = np.array(pairs)
            self.pairs[_pair_slots(at[:, 0], at[:, 1]).astype(np.int64)] = True

    def _new(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.owners.append([])
        return len(self.length) - 1

    def _extend(self, last: int, symbol: int) -> int:
        state = self._new(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at < 0:
            return state
        met = self.next[at][symbol]
        if self.length[met] == self.length[at] + 1:
            self.link[state] = met
            return state
        copy = self._new(self.length[at] + 1, self.link[met], dict(self.next[met]))
        while at >= 0 and self.next[at].get(symbol) == met:
            self.next[at][symbol] = copy
            at = self.link[at]
        self.link[met] = self.link[state] = copy
        return state

    def items_at(self, state: int) -> frozenset[int]:
        """Items that hold the window for which this is the shortest state of at least a window's length."""
        if state not in self.found:
            held, todo = set(), [state]
            while todo:
                s = todo.pop()
                held.update(self.owners[s])
                todo += self.children[s]
            self.found[state] = frozenset(held)
        return self.found[state]

    def stream(self, symbols: list[int], base: int, hits: list[tuple[int, int]], items: set[int]) -> None:
        """Run a stretch of symbols; add the hit spans [start, end) and the items of the windows that occur."""
        length, link, follow, window = self.length, self.link, self.next, self.window
        state = matched = 0
        for i, symbol in enumerate(symbols):
            while state and symbol not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            if matched < self.least:
                continue
            if matched >= window:
                start, end = base + i + 1 - matched, base + i + 1
                if hits and hits[-1][0] == start:
                    hits[-1] = (start, end)
                else:
                    hits.append((start, end))
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                items |= self.items_at(at)
            at = self.short_above[state]
            while at > 0:
                for n, item in self.short[at]:
                    if n <= matched:
                        items.add(item)
                        hits.append((base + i + 1 - n, base + i + 1))
                at = self.short_above[link[at]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def match(texts: list[bytes], automaton: Automaton) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
    """For each text: its number of words, merged hit spans in words, items."""
    known = automaton.vocabulary.get
    lists = [words_of(t) for t in texts]
    counts = [len(x) for x in lists]
    flat = np.full(sum(counts) + len(lists) + 1, -1, np.int64)
    starts = np.cumsum([0, *(n + 1 for n in counts)])
    for at, words in zip(starts.tolist(), lists):
        flat[at : at + len(words)] = [known(w, -1) for w in words]
    out: list[tuple[int, list[tuple[int, int]], set[int]]] = [(n, [], set()) for n in counts]
    inside = flat >= 0
    joined = np.zeros(len(flat), bool)  # this word and the next one may stand side by side in an item
    at = np.flatnonzero(inside[:-1] & inside[1:])
    joined[at] = automaton.pairs[_pair_slots(flat[at], flat[at + 1]).astype(np.int64)]
    # stretches: maximal runs of words joined to the next; a lone known word is a stretch of one
    heads = inside & ~np.r_[False, joined[:-1]]
    tails = inside & ~joined
    first, last = np.flatnonzero(heads), np.flatnonzero(tails)
    long = last - first + 1 >= automaton.least
    for a, b in zip(first[long].tolist(), last[long].tolist()):
        d = int(np.searchsorted(starts, a, "right")) - 1
        automaton.stream(flat[a : b + 1].tolist(), a - int(starts[d]), out[d][1], out[d][2])
    return [(n, _merged(spans), items) for n, spans, items in out]


SCHEMA = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.IntegerType(), False)),
        T.StructField("items", T.ArrayType(T.LongType(), False)),
    ]
)


def _chunks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in chunks of at most CHUNK_WORDS words (and a longer item's pieces), streamed from partition to partition."""
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).dropna()
    for item, text in rows.toLocalIterator():
        words = words_of(text.encode())
        step = CHUNK_WORDS - window + 1
        for a in range(0, max(1, len(words) - window + 1), step) if words else ():
            piece = words[a : a + CHUNK_WORDS]
            if held and size + len(piece) > CHUNK_WORDS:
                yield held
                held, size = [], 0
            held.append((item, piece))
            size += len(piece)
    if held:
        yield held


@lru_cache(2)
def _built(key: str, window: int, holder: _Chunk) -> Automaton:
    return Automaton(holder.items, window)


class _Chunk:
    """A chunk of items with a key of its own, so that a worker builds its automaton once."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = items
        self.key = hashlib.sha256(repr(items).encode()).hexdigest()

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other) -> bool:
        return self.key == other.key

    def automaton(self, window: int) -> Automaton:
        return _built(self.key, window, self)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, cut: int | None = None) -> DataFrame:
    """All columns of docs and n_words, hits (start and end word of each hit span, flat), items (distinct ids).

    A column of docs that has the name of a result gives place to it.

    cut: spans of so many words or more are cut out of the text by the pass over the last chunk, when all are known.
    """
    kept = common.others(docs, SCHEMA.fieldNames())
    docs = docs.select(*(F.col(f"`{c}`") for c in kept))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    carried = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)])
    schema = T.StructType([*carried.fields, *SCHEMA.fields])
    to = common.arrow_schema(schema)
    found = docs.toDF(*names).select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<bigint>").alias("items"))

    def passed(rows: DataFrame, chunk: _Chunk, last: bool) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(chunk)

        def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
            automaton = sent.value.automaton(window)
            *old, _, hits, items = rows.columns
            texts = common.text_bytes(rows.column(at))
            new = match(texts, automaton)
            merged = [_merged([*spans, *zip(h[::2], h[1::2])]) if h else spans for (_, spans, _), h in zip(new, hits.to_pylist())]
            if last and cut is not None and any(merged):
                known = old[at].is_valid().to_pylist()
                old[at] = pa.array([_without(t, [x for s in m for x in s], cut).decode("utf-8", "replace") if k else None for t, m, k in zip(texts, merged, known)], pa.string())
            columns = [
                *old,
                pa.array([n for n, _, _ in new], pa.int64()),
                pa.array([[x for span in spans for x in span] for spans in merged], to.field("hits").type),
                pa.array([sorted({*got, *before}) for (_, _, got), before in zip(new, items.to_pylist())], to.field("items").type),
            ]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to)], schema=to)

        return common.map_texts(rows, names[at], batch, schema)

    chunks = _chunks(benchmark, item_id, item_text, window)
    chunk, passes, between = next(chunks, []), 0, None
    while chunk is not None:
        following = next(chunks, None)
        if passes and passes % PASSES_A_PLAN == 0:
            found = between = common.stored(found, "overlaps", between)
        found = passed(found, _Chunk(chunk), following is None)
        chunk, passes = following, passes + 1
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), *SCHEMA.fieldNames())


def hit_words(hits) -> F.Column:
    """Number of words within flat spans."""
    signs = F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_words, n_hit) -> F.Column:
    """A twentieth of the words or more stand in windows of the benchmark."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that are contaminated; the columns stay as they were."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    found = find_overlaps(docs.toDF(*names), benchmark, names[docs.columns.index(text_col)])
    return found.where(~contaminated(F.col("n_words"), hit_words("hits"))).select(*names).toDF(*docs.columns)


def _without(text: bytes, spans: list[int], least: int) -> bytes:
    """The text without the spans of `least` words or more, from a first word's first byte to a last word's last."""
    long = [(a, b) for a, b in zip(spans[::2], spans[1::2]) if b - a >= least]
    if not long:
        return text
    inside = np.frombuffer(text.translate(_CLEAN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    heads, tails = edges[::2], edges[1::2]
    out, done = [], 0
    for a, b in long:
        out.append(text[done : heads[a]])
        done = tails[b - 1]
    return b"".join([*out, text[done:]])


def strip_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = 1, drop_contaminated: bool = False) -> DataFrame:
    """docs whose hit spans of `least` words or more are cut out of the text, and on request without the documents that
    are contaminated; the other columns stay as they were, and a null text stays null."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    found = find_overlaps(docs.toDF(*names), benchmark, names[docs.columns.index(text_col)], cut=least)
    if drop_contaminated:
        found = found.where(~contaminated(F.col("n_words"), hit_words("hits")))
    return found.select(*names).toDF(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_overlaps(docs, common.table(spark, sf_dir, "benchmark")).withColumn("n_hit", hit_words("hits"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same by a join on the windows themselves, for each length of window that there is.
SQL = f"""with items as (
  select item_id, {_WORDS_SQL} as w from benchmark where item_id is not null and text is not null
), windows as (
  select distinct item_id, size, array_to_string(w[a : a + size - 1], ' ') as win
  from (select *, least(len(w), {WINDOW}) as size, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) as a from items where len(w) > 0)
), docs as (
  select row_number() over () as r, doc_id, {_WORDS_SQL} as w from documents
), placed as (
  select r, size, a, array_to_string(w[a : a + size - 1], ' ') as win
  from (select r, w, size, unnest(range(1, len(w) - size + 2)) as a from docs cross join (select distinct size from windows))
), met as (
  select r, a, item_id, p.size from placed p join windows using (size, win)
), hit as (
  select r, count(distinct word) as n_hit from (select r, unnest(range(a, a + size)) as word from (select distinct r, a, size from met)) group by r
), found as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, cast(item_id as varchar) as item from met) group by r
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (r) left join found using (r)"""
