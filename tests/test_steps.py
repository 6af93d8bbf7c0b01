"""Steps on small tables with known results."""

from __future__ import annotations

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import plain_reads
from varsift.functions import estimates
from varsift.operators import counts, enrichment, fitness, growth, mutations, reads, variants
from varsift.plans import report
from varsift.plans.config import RunConfig
from varsift.sources.design import ExperimentDesign

WT = "atggct"


def config(**options):
    return RunConfig(experiment_design_path=__file__, **({"wildtype_sequence": WT.upper()} | options))


def table(spark, rows, reps=(1,)):
    names = ", ".join(f"count_e{e}_s{s} bigint" for e in reps for s in (0, 1))
    return spark.createDataFrame(rows, f"nt_seq string, {names}")


def one(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pivot_and_sums(spark):
    long = spark.createDataFrame([("acgt", 100, "a"), ("tttt", 50, "a"), ("gcgc", 20, "a"), ("acgt", 200, "b"), ("tttt", 30, "b")], "nt_seq string, count bigint, sample_id string")
    assert one(counts.pivot(long, ["a", "b"]), "nt_seq", "a", "b") == [("acgt", 100, 200), ("gcgc", 20, 0), ("tttt", 50, 30)]
    design = ExperimentDesign([{"sample_name": "in_t", "experiment": 1, "selection_id": 0, "technical_replicate": t, "biological_replicate": None} for t in (1, 2)] + [{"sample_name": "out", "experiment": 1, "selection_id": 1, "biological_replicate": b, "technical_replicate": t} for b in (1, 2) for t in (1, 2)])
    rows = [("acgt", 100, "in_t_e1_s0_bNA_t1"), ("acgt", 50, "in_t_e1_s0_bNA_t2"), ("tttt", 25, "in_t_e1_s0_bNA_t2")] + [("acgt", 1, f"out_e1_s1_b{b}_t{t}") for b in (1, 2) for t in (1, 2)]
    wide = counts.wide_counts(spark.createDataFrame(rows, "nt_seq string, count bigint, sample_id string"), design)
    assert one(wide, "*") == [("acgt", 150, 4), ("tttt", 25, 0)]


def test_only_first_input_counts(spark):
    design = ExperimentDesign([{"sample_name": s, "experiment": 1, "selection_id": i, "biological_replicate": 1} for s, i in (("a", 0), ("b", 0), ("c", 1))])
    df = spark.createDataFrame([("acgt", 1, 2, 4)], "nt_seq string, a_e1_s0_b1_tNA_count bigint, b_e1_s0_b1_tNA_count bigint, c_e1_s1_b1_tNA_count bigint")
    assert one(counts.cells_from_columns(df, design), "*") == [("acgt", 1, 4)]


def test_debarcode(spark):
    barcodes = spark.createDataFrame([("aaaa", "cccc"), ("tttt", "cccc")], "barcode string, variant string")
    known, unknown = counts.debarcode(table(spark, [("aaaa", 10, 20), ("tttt", 5, 8), ("gggg", 1, 1)]), barcodes, ["count_e1_s0", "count_e1_s1"])
    assert one(known, "*") == [("cccc", 15, 28)] and one(unknown, "nt_seq") == [("gggg",)]
    lines = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "barcode string, variant string, line int")
    assert one(counts.last_by_line(lines, "line"), "*") == [("a", "y")]


def test_guard(spark):
    rows = [("atggct", 9, 9), ("atggcc", 5, 5), ("atggca", 4, 4)]
    variants.process(table(spark, rows), config())
    with pytest.raises(RuntimeError, match="wildtype"):
        variants.process(table(spark, rows[1:]), config())
    with pytest.raises(RuntimeError, match="two"):
        variants.process(table(spark, rows[:2]), config())
    with pytest.raises(RuntimeError, match="indel"):
        variants.process(table(spark, [("atg", 1, 1)]), config())
    with pytest.raises(RuntimeError, match="permitted"):
        variants.process(table(spark, rows), config(permitted_sequences="TNNNNN"))


@pytest.mark.parametrize("native", [True, False])
def test_parts_conserve_reads(spark, native):
    rows = [("atggct", 9, 1), ("atggcc", 5, 1), ("ttggct", 4, 1), ("ttagct", 3, 1), ("ttaaaa", 2, 1), ("atggc", 7, 1), ("atggctt", 8, 1)]
    done = variants.process(table(spark, rows), config(max_substitutions=1, indels="7"), native=native)
    assert one(done.indel, "nt_seq") == [("atggc",)]
    assert [r[0] for r in one(done.retained, "nt_seq")] == ["atggcc", "atggct", "atggctt", "ttagct", "ttggct"]
    assert one(done.rejected, "nt_seq", "too_many_substitutions") == [("ttaaaa", True)]
    indel = done.retained.where("indel").first()
    assert indel.WT is None and indel.Nham_nt is None and indel.STOP is False
    total = done.stats.where("sample = 'count_e1_s0' and category in ('indel', 'retained', 'too_many_substitutions')").agg(F.sum("reads")).first()[0]
    assert total == sum(r[1] for r in rows)


def test_constant_region(spark):
    c = config(wildtype_sequence="atgGCTgaa")
    done = variants.process(table(spark, [("atggctgaa", 9, 1), ("atggccgaa", 5, 1), ("atggaagaa", 5, 1), ("ttggctgaa", 4, 1)]), c)
    assert one(done.retained, "nt_seq", "aa_seq", "Nham_aa", "WT") == [("gaa", "E", 1, False), ("gcc", "A", 0, False), ("gct", "A", 0, True)]
    assert one(done.rejected, "nt_seq", "constant_region", "aa_seq") == [("ttggctgaa", False, "LAE")]


def test_reverse_complement_and_mixed(spark):
    done = variants.process(table(spark, [("agccat", 9, 1), ("ggccat", 4, 1), ("tgccat", 3, 1), ("ggccaa", 2, 1)]), config(reverse_complement=True))
    assert one(done.retained, "nt_seq") == [("atggca",), ("atggcc",), ("atggct",)]
    assert one(done.rejected, "nt_seq", "mixed_substitutions") == [("ttggcc", True)]


def test_low_counts(spark):
    df = table(spark, [("a", 5, 9, 1, 9), ("b", 20, 9, 30, 9), ("c", 5, 9, 6, 9)], (1, 2)).withColumn("Nham_nt", F.when(F.col("nt_seq") == "c", F.lit(None)).otherwise(1).cast("int"))
    run = lambda **o: [r[0] for r in one(fitness.filter_low_counts(df, config(**o), [1, 2]), "nt_seq")]
    assert run(fitness_min_input_count_all="6") == ["b"]
    assert run(fitness_min_input_count_any="6") == ["b", "c"]
    assert run(fitness_min_input_count_all="2:99") == ["a", "b"]
    assert run(fitness_min_input_count_all="1:2") == ["b"]
    got = fitness.filter_low_counts(df, config(fitness_min_input_count_any="6"), [1, 2]).where("nt_seq = 'c'").first()
    assert got.count_e1_s0 is None and got.count_e2_s0 == 6


def test_merge_and_sigma(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0, 1.0), (1.0, None, 2.0, 1.0), (None, None, None, None)], "fitness1 double, sigma1 double, fitness2 double, sigma2 double")
    f, s = estimates.merge_replicates(["fitness1", "fitness2"], ["sigma1", "sigma2"])
    rows = [tuple(r) for r in df.select(f, s).collect()]
    assert rows[0] == (pytest.approx((4 + 2) / 5), pytest.approx(5**-0.5)) and rows[1] == (2.0, 1.0) and rows[2] == (None, None)


def test_row_variance(spark):
    assert spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double").select(estimates.row_variance([F.col(c) for c in "abc"])).first()[0] == pytest.approx(7.0)


def _library(spark, rows, strategy="none", reps=(1,), **options):
    c = config(enrichment_mode=True, enrichment_normalise=strategy, wildtype_sequence="", **options)
    df = enrichment.calculate(enrichment.annotate(table(spark, rows, reps), c), c, list(reps))
    return {r.nt_seq: r for r in df.collect()}


def test_enrichment(spark):
    got = _library(spark, [("aa", 10, 20), ("cc", 100, 25), ("gg", 0, 5)])
    assert set(got) == {"aa", "cc"}
    assert got["aa"].enrichment1_uncorr == pytest.approx(math.log(2)) and got["cc"].enrichment1_uncorr == pytest.approx(math.log(0.25))
    assert got["aa"].sigma1_uncorr == pytest.approx(math.sqrt(1 / 20 + 1 / 10))
    got = _library(spark, [("aa", 10, 40), ("cc", 10, 20)], "total")
    assert got["aa"].enrichment1_uncorr == pytest.approx(math.log(4 / 3)) and got["cc"].enrichment1_uncorr == pytest.approx(math.log(2 / 3))
    got = _library(spark, [("aa", 10, 20), ("cc", 10, 20), ("gg", 10, 40)], "spikein", enrichment_spikein_ids="CC, GG")
    assert got["aa"].enrichment1_uncorr == pytest.approx(math.log(2) - (math.log(2) + math.log(4)) / 2)
    got = _library(spark, [("aa", 10, 20), ("cc", 10, 40)], "reference", enrichment_reference_id="CC")
    assert got["aa"].enrichment1_uncorr == pytest.approx(-math.log(2)) and got["cc"].is_reference
    assert _library(spark, [("aa", 10, 20)], "reference", enrichment_reference_id="TT")["aa"].enrichment1_uncorr == pytest.approx(math.log(2))


def test_library_translation(spark):
    c = config(enrichment_mode=True, sequence_type="coding", wildtype_sequence="")
    assert enrichment.annotate(table(spark, [("atggct", 1, 1)]), c).first().aa_seq == "MA"
    assert "aa_seq" not in enrichment.annotate(table(spark, [("atggct", 1, 1), ("at", 1, 1)]), c).columns
    with pytest.raises(ValueError):
        enrichment.annotate(table(spark, []), config())


def test_growth(spark):
    design = ExperimentDesign([{"sample_name": f"s{s}{e}", "experiment": e, "selection_id": s, "cell_density": 100.0 * (1 + s), "selection_time": 4.0 if s else None, "generations": None} for e in (1, 2) for s in (0, 1)])
    assert design.has_growth_data() and design.mean("cell_density", 1) == {1: 200.0, 2: 200.0}
    rows = [("x%02d" % i, 100 + i, 100 + 7 * i, 90 + i, 100 + 6 * i) for i in range(30)]
    df = table(spark, rows, (1, 2)).withColumns({"error_model": F.lit(True), **{f"fitness{e}_uncorr": estimates.log_ratio(e) for e in (1, 2)}, **{f"sigma{e}_uncorr": estimates.poisson_error(e) for e in (1, 2)}})
    got = growth.infer(fitness.merge(df, [1, 2]), design, [1, 2]).collect()
    assert all(math.isfinite(r.growthrate) and r.growthrate_sigma >= 0 for r in got)
    # with one replicate's times missing, the other alone decides
    for r in design.rows:
        if r["experiment"] == 2:
            r["selection_time"] = None
    got = growth.infer(fitness.merge(df, [1, 2]), design, [1, 2]).collect()
    assert all(r.growthrate2 is None and math.isfinite(r.growthrate) for r in got)


def test_singles_and_doubles(spark):
    df = spark.createDataFrame([("atggcc", "atggcc", "MA", 0, 1, 5.0), ("k", "MS", "MS", 1, 1, 5.0), ("k2", "LA", "LA", 1, 1, 7.0), ("k3", "LS", "LS", 2, 2, 9.0)], "nt_seq string, merge_seq string, aa_seq string, Nham_aa int, Nham_nt int, mean_count double")
    single = mutations.singles(df, "MA", True)
    assert one(single, "Pos", "Mut", "WT_AA") == [(1, "L", "M"), (2, "S", "A")]
    assert one(mutations.doubles(df, single, "MA", True), "Pos1", "Mut1", "Pos2", "Mut2", "s1_mean_count", "s2_mean_count") == [(1, "L", 2, "S", 7.0, 5.0)]
    assert mutations.doubles(df, None, "MA", True).first().s1_mean_count is None


def test_aggregate_counts_keeps_indels_apart(spark):
    df = spark.createDataFrame([("atggct", "MA", 0, True, False, 1, 2), ("atggcc", "MA", 0, False, False, 3, 4), ("atgtct", "MS", 1, False, False, 5, 6), ("atgtcc", "MS", 1, False, False, 7, 8), ("at", None, None, None, True, 9, 9), ("atg", None, None, None, True, 2, 2)], "nt_seq string, aa_seq string, Nham_aa int, WT boolean, indel boolean, count_e1_s0 bigint, count_e1_s1 bigint").withColumns({"Nham_nt": F.lit(1), "Nmut_codons": F.lit(1), "STOP": F.lit(False), "STOP_readthrough": F.lit(False), "error_model": F.lit(True)})
    got = one(fitness.aggregate_counts(df, [1], ["ATGTCA"]), "merge_seq", "error_model", "count_e1_s0")
    assert got == [("MA", True, 4), ("MS", True, 12), ("at", True, 9), ("atg", True, 2), ("atggcc", False, 3), ("atggct", False, 1), ("atgtcc", False, 7), ("atgtct", False, 5)]


# --- reads --------------------------------------------------------------------------------------------------------


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "read_id int, seq1 string, qual1 string, seq2 string, qual2 string")


def test_quality_filter(spark):
    df = spark.createDataFrame([("????",), ("????",), ("#???",), ("",)], "qual string")
    assert reads.quality_filter(df, 30).count() == 3


def test_concatenation(spark):
    c = lambda **o: config(**({"trans_library": True, "cutadapt_min_length": 4, "vsearch_min_qual": 2, "vsearch_max_ee": 1.0} | o))
    got = reads.concatenate(pairs(spark, [("ACGT", "IIII", "AAAC", "ABCD")]), c(trans_library_reverse_complement=True)).first()
    assert (got.seq, got.qual, got.fail_reason) == ("ACGTGTTT", "IIIIDCBA", None)
    assert reads.concatenate(pairs(spark, [("ACGT", "IIII", "TTTT", "IIII")]), c()).first().seq == "ACGTTTTT"
    rows = [("ACGT", "++++", "ACGT", "++++"), ("ACGT", "$$$$", "ACGT", "++++"), ("ACG", "III", "ACGT", "IIII"), ("ACGT", "I!II", "ACGT", "IIII")]
    assert [r.fail_reason for r in reads.concatenate(pairs(spark, rows), c()).orderBy("read_id").collect()] == [None, "Exp.errs._too_high", "Too_short", "Min_Q_too_low"]


def test_length_quantiles(spark):
    df = spark.createDataFrame([("s", "A" * n) for n in (1, 2, 2, 3, 5, 8, 9)], "sample_id string, seq string")
    lengths = sorted((1, 2, 2, 3, 5, 8, 9))
    assert tuple(reads.length_quantiles(df).first())[1:] == (1, lengths[7 // 4], lengths[7 // 2], lengths[21 // 4], 9)


def test_demultiplex(spark):
    rows = [{"new_pair_prefix": "x", "barcode1": "ACGT", "barcode2": "TTTT"}, {"new_pair_prefix": "y", "barcode1": "AGGT", "barcode2": "CCCC"}]
    q = "IIIIIIII"
    df = pairs(spark, [("ACGTGGGG", q, "TTTTAAAA", q), ("AGGTGGGG", q, "CCCCAAAA", q), ("ACGTGGGG", q, "GGGGAAAA", q), ("AAGTGGGG", q, "TTTAAAAA", q)])
    got = reads.demultiplex(df, rows, 0.25).orderBy("read_id").collect()
    assert [r.sample_id for r in got] == ["x", "y", None, "x"]
    assert (got[0].seq1, got[0].seq2, got[0].qual1) == ("GGGG", "AAAA", "IIII") and got[2].seq1 == "ACGTGGGG"


@pytest.mark.parametrize(
    "five, three, read, left",
    [("ACG", None, "TTACGCC", "CC"), ("AACG", None, "CGTTTT", "TTTT"), (None, "GGG", "ACTGGGTT", "ACT"), (None, "GGGG", "ACTTGG", "ACTT"), (None, "CCC;required...GGG;optional", "CCCATATGGGA", "ATAT"), (None, "CCC;required...GGG;optional", "CCCATAT", "ATAT")],
)
def test_trim_span(five, three, read, left):
    a, b, found = reads.trim_spans(pd.Series([read]), reads.Adapter.of(five, three), 0.0, 2).iloc[0]
    assert (read[a:b], found) == (left, True)


def test_trim_options():
    row = {"cutadapt5First": "A" * 10, "cutadapt3First": "T" * 10, "pair1_length": 100}
    linked = reads.link_adapters(row, config(wildtype_sequence="ATGGCTGAAGTT"))
    assert linked["cutadapt3First"] == "A" * 10 + ";required..." + "T" * 10 + ";optional" and linked["cutadapt5First"] is None
    assert reads.link_adapters(row | {"pair1_length": 15}, config())["cutadapt5First"] == "A" * 10
    assert reads.needs_trimming(row) and not reads.needs_trimming({})
    assert reads.trim_options({}, config(cutadapt_cut_5_first=3))["cutadaptCut5First"] == 3


def test_trim_pairs(spark):
    df = pairs(spark, [("GGACGTTTT", "IIIIIIIII", "CCCCC", "IIIII"), ("TTTTTTTT", "IIIIIIII", "CCCCC", "IIIII")])
    got = reads.trim_pairs(df, {"cutadapt5First": "ACG", "cutadaptCut5Second": 1}, config(paired=True, cutadapt_min_length=3)).collect()
    assert [(r.seq1, r.qual1, r.seq2) for r in got] == [("TTTT", "IIII", "CCCC")]
    assert reads.trim_pairs(df, {}, config()).count() == 2


def merged(seq1, qual1, seq2, qual2, *options):
    return next(zip(*reads.merge_batch([seq1], [qual1], [seq2], [qual2], *options)))


def test_merge_pair():
    seq = "ACGTTGCAACGGTACCATTGA"
    rc = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert merged(seq[:15], "I" * 15, rc[:15], "I" * 15, 5, 5, 1.0, 5, 41)[0] == seq
    whole = merged(seq, "I" * 21, rc, "I" * 21, 5, 5, 1.0, 5, 41)
    assert whole[0] == seq and set(whole[1]) == {"J"}
    assert merged("AAAAAAAA", "I" * 8, "AAAAAAAA", "I" * 8, 5, 5, 1.0, 5, 41)[2] == "No_alignment_found"
    assert merged("AAA", "III", "TTT", "III", 5, 5, 1.0, 1, 41)[2] == "Overlap_too_short"
    assert merged("AAA", "III", "TTT", "III", 1, 5, 1.0, 5, 41)[2] == "Too_short"
    # of two bases that differ, the one of better quality stays
    differ = merged("ACGTTGCAAC", "IIII#IIIII", "GTTGCAACGT"[:10], "I" * 10, 8, 5, 9.0, 5, 41)
    assert differ[0] == "ACGTTGCAAC"


def _bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_trimming_by_batches():
    rng = random.Random(1)
    for _ in range(120):
        linked = f"{_bases(rng, 4)};required...{_bases(rng, 4)};optional"
        adapter = reads.Adapter.of(rng.choice([None, _bases(rng, rng.randint(1, 8))]), rng.choice([None, linked, _bases(rng, rng.randint(1, 8))]))
        if not adapter.five and not adapter.three:
            continue
        seqs = [_bases(rng, rng.randint(0, 5)) + rng.choice([adapter.five or "", ""]) + _bases(rng, rng.randint(0, 20)) + (adapter.three or "") + _bases(rng, rng.randint(0, 4)) for _ in range(20)]
        rate, overlap = rng.choice([0, 0.1, 0.3]), rng.randint(1, 5)
        got = reads.trim_spans(pd.Series([*seqs, None, ""]), adapter, rate, overlap)
        assert [tuple(r) for r in got.itertuples(index=False)] == [plain_reads.trim_span(s, adapter, rate, overlap) for s in [*seqs, None, ""]]


def test_merging_by_batches():
    rng = random.Random(2)
    complement = str.maketrans("ACGT", "TGCA")
    for _ in range(100):
        rows = []
        for _ in range(15):
            x = _bases(rng, rng.randint(5, 40))
            a, b = x[: rng.randint(0, len(x))], x[rng.randint(0, len(x)) :].translate(complement)[::-1]
            a, b = ("".join(rng.choice("ACGT") if rng.random() < 0.05 else c for c in s) for s in (a, b))
            rows.append((a, "".join(chr(33 + rng.randint(0, 41)) for _ in a), b, "".join(chr(33 + rng.randint(0, 41)) for _ in b)))
        options = (rng.randint(1, 10), rng.randint(0, 10), rng.choice([0.5, 5.0, 50.0]), rng.randint(0, 12), 41)
        assert list(zip(*reads.merge_batch(*map(list, zip(*rows)), *options))) == [plain_reads.merge_pair(*r, *options) for r in rows]


def test_orient(spark):
    df = pairs(spark, [("ACGTACAAAA", "I" * 10, "GGCCGGTTTT", "J" * 10), ("GGCCGGTTTT", "J" * 10, "ACGTACAAAA", "I" * 10)])
    got = reads.orient(df, "ACGTAC", "GGCCGG", 0.0, 3).orderBy("read_id").collect()
    assert [(r.seq1, r.qual2, r.swapped) for r in got] == [("ACGTACAAAA", "J" * 10, False), ("ACGTACAAAA", "J" * 10, True)]


def test_report_tables(spark):
    rows = [("nuc_subst", 0, "count_e1_s0", 5), ("nuc_subst", 3, "count_e1_s0", 2), ("nuc_subst", 4, "count_e1_s0", 1), ("indel", None, "count_e1_s0", 0), ("nobarcode", None, "count_e1_s0", 9)]
    got = report.stats_table(spark.createDataFrame(rows, "category string, nham int, sample string, reads bigint"), ["count_e1_s0"])
    assert [tuple(r) for r in got.collect()] == [("0 substitutions", 5), ("3+ substitutions", 3), ("Invalid barcode", 9)] and got.columns[1] == "e1_in"
    trimmed = spark.createDataFrame([(10, 7), (5, 9)], "total_reads bigint, pairs_written bigint")
    assert [r.filtered for r in report.trim_shares(trimmed).collect()] == [3, 0]
    assert spark.createDataFrame([(0.5,)], "p double").select(report.normal_quantile("p")).first()[0] == 0.0


# A published wildtype row of four replicates.
GOLDEN_WT = "ggtaatagcagagggggtggagctggtttgggaaacaatcaaggtagtaatatgggtggtgggatgaactttggtgcgttcagcattaatccagccatgatggctgccgcccaggcagcactacag"
GOLDEN_AMINO = "GNSRGGGAGLGNNQGSNMGGGMNFGAFSINPAMMAAAQAALQ"
GOLDEN_INPUTS, GOLDEN_OUTPUTS = [20949, 22510, 22864, 23326], [14710, 16376, 15623, 17857]
GOLDEN_FITNESS = [-0.00998775986426852, -0.153016504755251, 0.0874479986847711, 0.0755562659347483]
GOLDEN_SIGMA = [0.0154627087574389, 0.131005474782979, 0.159796930352447, 0.0140363562816411]
GOLDEN_MERGED = (0.0359395343629076, 0.0103387105874816)


def test_published_wildtype_row(spark):
    """Annotation, mean count and merged fitness of the row come out as published."""
    reps = [1, 2, 3, 4]
    names = estimates.count_names(reps)
    counted = spark.createDataFrame([(GOLDEN_WT, *[x for pair in zip(GOLDEN_INPUTS, GOLDEN_OUTPUTS) for x in pair])], "nt_seq string, " + ", ".join(f"{n} bigint" for n in names))
    r = variants.process(counted, config(wildtype_sequence=GOLDEN_WT.upper()), checked=False).retained.first()
    assert (r.aa_seq, r.Nham_nt, r.Nham_aa, r.Nmut_codons, r.WT, r.indel, r.STOP, r.STOP_readthrough) == (GOLDEN_AMINO, 0, 0, 0, True, False, False, False)
    row = (*GOLDEN_FITNESS, *GOLDEN_SIGMA, *GOLDEN_INPUTS)
    frame = spark.createDataFrame([row], ", ".join([f"fitness{e}_uncorr double" for e in reps] + [f"sigma{e}_uncorr double" for e in reps] + [f"count_e{e}_s0 bigint" for e in reps]))
    merged = fitness.merge(frame, reps).withColumn("mean_count", estimates.row_mean([F.col(f"count_e{e}_s0") for e in reps])).first()
    assert (merged.fitness, merged.sigma) == pytest.approx(GOLDEN_MERGED, abs=1e-12) and merged.mean_count == 22412.25
