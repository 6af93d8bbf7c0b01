"""Whole runs: from a count file, from reads, of a library, resumed, and streamed."""

from __future__ import annotations

import gzip
import math
import random

import pytest

from varsift.functions import sequence
from varsift.plans import pipeline
from varsift.plans.config import RunConfig
from varsift.sources import fastq
from varsift.streaming.tally import latest, start

WT = "ATGGCTGATGAAGTTCTGACC"


def design(path, extra=""):
    lines = ["sample_name\texperiment\tselection_id\tbiological_replicate\tgenerations\tcell_density\tselection_time"]
    for e in (1, 2, 3):
        lines += [f"input{e}\t{e}\t0\tNA\tNA\t100\tNA", f"output{e}\t{e}\t1\t1\t{4 + e}\t400\t4"]
    path.write_bytes("\r".join(lines).encode())
    return path


def count_file(path, n=150):
    rng = random.Random(8)
    seqs = {WT}
    while len(seqs) < n:
        s = list(WT)
        for _ in range(rng.choice([1, 1, 2, 3])):
            i = rng.randrange(len(s))
            s[i] = rng.choice("ACGT")
        seqs.add("".join(s))
    seqs = sorted(seqs)
    lines = ["nt_seq\t" + "\t".join(f"{k}put{e}" for e in (1, 2, 3) for k in ("in", "out"))]
    for s in seqs:
        change = math.exp(-0.3 * sum(a != b for a, b in zip(s, WT)) + rng.gauss(0, 0.3))
        size = 40_000 if s == WT else rng.randint(300, 2000)
        cells = []
        for e in (1, 2, 3):
            cells += [max(1, round(rng.gauss(size, size**0.5))), max(1, round(rng.gauss(size * change, (size * change) ** 0.5 * 1.5)))]
        lines.append("\t".join([s, *map(str, cells)]))
    path.write_text("\n".join(lines) + "\n")
    return path


def test_count_run(spark, tmp_path):
    options = {"experiment_design_path": design(tmp_path / "d.txt"), "count_path": count_file(tmp_path / "c.txt"), "wildtype_sequence": WT, "output_path": tmp_path, "project_name": "p"}
    tables = pipeline.run(spark, RunConfig(**options))
    top = tmp_path / "p"
    names = {"fitness_wildtype.txt", "fitness_singles.txt", "fitness_doubles.txt", "fitness_synonymous.txt", "fitness_singles_MaveDB.csv", "report.html", "p_variant_data_merge.tsv", "p_indel_variant_data_merge.tsv", "p_rejected_variant_data_merge.tsv"}
    assert names <= {f.name for f in top.iterdir()}
    assert {f.name for f in (top / "tmp").glob("*.txt")} == {"errormodel.txt", "normalisationmodel.txt"}
    assert {f.name for f in (top / "p_fitness_replicates").iterdir()} == {"all_variants.parquet", "wildtype.parquet", "singles.parquet", "doubles.parquet", "synonymous.parquet"}
    wild = tables["wildtype"].collect()
    assert len(wild) == 1 and abs(wild[0].fitness) < 0.05 and wild[0].growthrate is not None
    # of a wildtype at 0 the replicates' mean is 0 after normalisation
    assert sum(wild[0][f"fitness{e}_uncorr"] * (4 + e) for e in (1, 2, 3)) == pytest.approx(0, abs=1e-6)
    every = tables["all_variants"].collect()
    assert all(r.sigma > 0 and math.isfinite(r.fitness) for r in every)
    assert all(r.nt_seq is None for r in every if r.Nham_aa > 0)
    singles = tables["singles"].collect()
    assert len({(r.Pos, r.Mut) for r in singles}) == len(singles) and all(sequence.translate_text(WT)[r.Pos - 1] == r.WT_AA for r in singles)
    again = pipeline.run(spark, RunConfig(**options, start_stage=5))
    assert again["all_variants"].count() == len(every)
    assert pipeline.run(spark, RunConfig(**options, stop_stage=4)) == {}


@pytest.mark.parametrize("options", [{"sequence_type": "noncoding"}, {"mixed_substitutions": True}, {"fitness_error_model": False, "fitness_dropout_pseudocount": 0.5}, {"retained_replicates": "1"}, {"indels": "all"}])
def test_count_run_options(spark, tmp_path, options):
    tables = pipeline.run(spark, RunConfig(design(tmp_path / "d.txt"), WT, tmp_path, "p", count_file(tmp_path / "c.txt"), **options))
    assert tables["wildtype"].count() >= 1 and tables["all_variants"].count() > 50


def test_library_run(spark, tmp_path):
    (tmp_path / "c.txt").write_text("nt_seq\t" + "\t".join(f"{k}put{e}" for e in (1, 2, 3) for k in ("in", "out")) + "\nACGT\t10\t20\t11\t22\t9\t18\nACGTACG\t50\t50\t60\t50\t40\t50\nTT\t30\t10\t30\t12\t30\t9\n")
    tables = pipeline.run(spark, RunConfig(design(tmp_path / "d.txt"), "", tmp_path, "p", tmp_path / "c.txt", enrichment_mode=True))
    rows = {r.nt_seq: r for r in tables["variants"].collect()}
    assert set(rows) == {"acgt", "acgtacg", "tt"} and rows["acgt"].length == 4 and rows["acgt"].fitness > rows["tt"].fitness
    assert not list((tmp_path / "p").glob("fitness_*")) and (tmp_path / "p" / "enrichment_variant_data.txt").exists()


def write_reads(path, rows):
    with gzip.open(path, "wt") as out:
        for i, (s, q) in enumerate(rows):
            out.write(f"@r{i}\n{s}\n+\n{q}\n")
        out.write("@cut\nACGT\n")  # a truncated record ends the file


def test_fastq_source(spark, tmp_path):
    write_reads(tmp_path / "a.fastq.gz", [("ACGT", "IIII"), ("GGGG", "JJJJ")])
    (tmp_path / "b.fastq").write_text("@x\nTTTT\n+\nKKKK\n@y\nCC\n+\nLL\n")
    one = fastq.read_fastq(spark, [str(tmp_path / "a.fastq.gz"), str(tmp_path / "b.fastq")])
    assert sorted((r.read_id, r.seq, r.qual) for r in one.collect()) == [(0, "ACGT", "IIII"), (0, "TTTT", "KKKK"), (1, "CC", "LL"), (1, "GGGG", "JJJJ")]
    both = fastq.read_fastq(spark, [str(tmp_path / "a.fastq.gz")], [str(tmp_path / "b.fastq")])
    assert [(r.seq1, r.seq2) for r in both.orderBy("read_id").collect()] == [("ACGT", "TTTT"), ("GGGG", "CC")]
    fastq.write_fastq(one.select("header", "seq", "qual"), f"file://{tmp_path}/out")
    assert fastq.read_fastq(spark, sorted(map(str, (tmp_path / "out").glob("part-*.gz")))).count() == 4


def test_read_run(spark, tmp_path):
    rng = random.Random(2)
    turn = str.maketrans("ACGT", "TGCA")
    lines = ["sample_name\texperiment\tselection_id\tbiological_replicate\tpair_directory\tpair1\tpair2\tcutadapt5First\tcutadapt5Second"]
    for s, name in ((0, "input"), (1, "output")):
        rows = []
        for _ in range(400):
            seq = list(WT)
            if rng.random() < 0.6:
                i = rng.choice([2, 5, 8])
                seq[i] = rng.choice("ACGT")
            rows.append("".join(seq))
        write_reads(tmp_path / f"{name}1.fastq.gz", [("GGCC" + r, "I" * (len(r) + 4)) for r in rows])
        write_reads(tmp_path / f"{name}2.fastq.gz", [("TTCC" + r.translate(turn)[::-1], "I" * (len(r) + 4)) for r in rows])
        lines.append(f"{name}\t1\t{s}\t1\t{tmp_path}\t{name}1.fastq.gz\t{name}2.fastq.gz\tGGCC\tTTCC")
    (tmp_path / "d.txt").write_text("\n".join(lines) + "\n")
    options = {"experiment_design_path": tmp_path / "d.txt", "wildtype_sequence": WT, "output_path": tmp_path, "project_name": "p", "cutadapt_min_length": 10}
    tables = pipeline.run(spark, RunConfig(**options))
    assert len(list((tmp_path / "p" / "4_align").glob("*.report"))) == 2 and tables["all_variants"].count() == 3
    total = spark.read.parquet(str(tmp_path / "p" / "5_tally")).groupBy().sum("count").first()[0]
    assert total == 800
    assert pipeline.run(spark, RunConfig(**options, start_stage=4))["all_variants"].count() == tables["all_variants"].count()
    assert pipeline.run(spark, RunConfig(**options, stop_stage=3)) == {}


def test_streaming_tally(spark, tmp_path):
    for i, rows in enumerate(([("a", "acgt"), ("a", "acgt")], [("a", "acgt"), ("b", "tttt")])):
        spark.createDataFrame(rows, "sample_id string, seq string").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("sample_id string, seq string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in latest(spark, str(tmp_path / "out")).collect()) == [("a", "acgt", 3), ("b", "tttt", 1)]
