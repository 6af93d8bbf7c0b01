"""Sequence functions: known values, and both forms of annotation against a brute-force one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from varsift.functions import sequence as sq


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    return [tuple(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def test_hamming(spark):
    assert values(spark, ["aaaa", "aaat", "aatt", "attt", "aaa", None], sq.hamming("s", "aaaa")) == [(0,), (1,), (2,), (3,), (None,), (None,)]


def test_constant_regions(spark):
    got = values(spark, ["agta", "acta", "agtt"], sq.constant_matches("s", "aGTa"), sq.strip_constant("s", "aGTa"))
    assert got == [(True, "gt"), (True, "ct"), (False, "gt")]


def test_stops(spark):
    got = values(spark, ["IGK", "I*K", "IGK*", "IGKL", "*"], sq.premature_stop("s"), sq.stop_readthrough("s", True))
    assert got == [(False, True), (True, True), (False, False), (False, True), (False, False)]


def test_mutated_codons(spark):
    assert values(spark, ["atggct", "atggcc", "ttggcc"], sq.mutated_codons("s", "atggct")) == [(0,), (1,), (2,)]


def test_permitted(spark):
    assert values(spark, ["acgt", "gcgt", "tcgt"], sq.permitted("s", "RNNN")) == [(True,), (True,), (False,)]


def test_reverse_complement(spark):
    assert values(spark, ["AAAC", "acgt"], sq.reverse_complement("s")) == [("GTTT",), ("acgt",)]


def test_translate_edges(spark):
    got = values(spark, ["", "at", "atgn", "atgnnn", "ATGTAA", None], sq.translate("s"))
    assert got == [("",), ("",), ("M",), ("MX",), ("M*",), (None,)]


def test_phred(spark):
    got = values(spark, ["I#", "", None], sq.phred("s"), sq.expected_errors("s"))
    assert got[0][0] == [40, 2] and got[0][1] == pytest.approx(1e-4 + 10**-0.2)
    assert got[1] == ([], 0.0) and got[2] == (None, None)


def test_largest_int(spark):
    assert values(spark, ["Pairs written: 7,900 (79.0%)", "none", ",,"], sq.largest_int("s")) == [(7900,), (0,), (0,)]


def test_hgvs(spark):
    df = spark.createDataFrame([("G", 1, "S"), ("W", 7, "*")], "w string, p int, m string")
    assert [r[0] for r in df.select(sq.hgvs_protein(F.col("w"), F.col("p"), F.col("m"))).collect()] == ["p.Gly1Ser", "p.Trp7Ter"]
    assert df.select(sq.hgvs_nucleotide(F.lit("a"), F.lit(5), F.lit("g"))).first()[0] == "n.5A>G"


def brute(seq: str, wt: str) -> tuple:
    amino, ref = sq.translate_text(seq), sq.translate_text(wt)
    return (
        amino,
        sum(a != b for a, b in zip(seq, wt)),
        sum(a != b for a, b in zip(amino, ref)),
        sum(seq[i : i + 3] != wt[i : i + 3] for i in range(0, len(wt), 3)),
        "*" in amino[:-1],
        ref.endswith("*") and not amino.endswith("*"),
    )


@pytest.mark.parametrize("wt", ["atggctgatgaagtt", "atgggttaa"])
def test_annotation_forms_agree(spark, wt):
    from varsift.operators.variants import _native

    rng = random.Random(4)
    seqs = ["".join(rng.choice("acgt") if rng.random() < 0.3 else c for c in wt) for _ in range(200)] + [wt]
    df = spark.createDataFrame([(s,) for s in seqs], "nt_seq string")
    fast = [tuple(r[0]) for r in df.select(sq.annotate(wt, True)("nt_seq")).collect()]
    native = [tuple(r[0]) for r in df.select(_native(wt, True)).collect()]
    assert fast == native == [brute(s, wt) for s in seqs]


def test_positions(spark):
    wt = "acgtacgt"
    assert values(spark, ["acgtacgt", "ccgtacga"], sq.mutated_positions("s", wt)) == [([],), ([1, 8],)]
