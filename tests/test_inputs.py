"""Configuration, designs, count files, side files, reports and the command line."""

from __future__ import annotations

import pytest

from varsift.plans import cli, config, outputs
from varsift.sources import counts, design, reports

DESIGN = "sample_name\texperiment\tselection_id\tbiological_replicate\tpair1\tpair2\ninput1\t1\t0\tNA\ta1.fastq\ta2.fastq\noutput1A\t1\t1\t1\tb1.fastq\tb2.fastq\n"


@pytest.fixture
def design_path(tmp_path):
    path = tmp_path / "design.txt"
    path.write_text(DESIGN)
    return path


def run_config(path, **options):
    return config.RunConfig(experiment_design_path=path, **({"wildtype_sequence": "ATGGCT"} | options))


def test_thresholds():
    assert config.parse_threshold("10") == 10
    assert config.parse_threshold("0:5,1:10,2:30") == {0: 5, 1: 10, 2: 30}
    assert config.threshold_for({1: 4}, 1) == 4 and config.threshold_for({1: 4}, 2) is None and config.threshold_for(3, 9) == 3
    with pytest.raises(ValueError):
        config.parse_threshold("1:2:3")


@pytest.mark.parametrize("wt, kind", [("ATGGCT", "coding"), ("ATGTAAGCT", "noncoding"), ("ATGTAA", "coding"), ("ATGGC", "noncoding")])
def test_sequence_type(design_path, wt, kind):
    assert run_config(design_path, wildtype_sequence=wt).sequence_type_resolved == kind


@pytest.mark.parametrize(
    "bad",
    [{"wildtype_sequence": "AXG"}, {"wildtype_sequence": ""}, {"permitted_sequences": "NN"}, {"permitted_sequences": "NNNNNZ"}, {"indels": "a,b"}, {"max_substitutions": 0}, {"trans_library": True, "paired": False},
     {"barcode_error_rate": 2}, {"num_cores": 0}, {"mutagenesis_type": "x"}, {"sequence_type": "x"}, {"enrichment_mode": True, "enrichment_normalise": "x"}, {"enrichment_mode": True, "enrichment_normalise": "reference"}],
)
def test_bad_options(design_path, bad):
    with pytest.raises(ValueError):
        run_config(design_path, **bad)


def test_missing_design(tmp_path):
    with pytest.raises(FileNotFoundError):
        run_config(tmp_path / "none.txt")


def test_derived(design_path):
    c = run_config(design_path, wildtype_sequence="acGTa", sequence_type="noncoding", indels="5,6")
    assert (c.wt_variable_seq, c.has_constant_region, c.permitted, c.indel_lengths, c.retain_indels) == ("GT", True, "NN", [5, 6], True)
    assert run_config(design_path).indel_lengths is None and run_config(design_path, indels="all").indel_lengths == []


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_design(tmp_path, end):
    path = tmp_path / "d.txt"
    path.write_bytes(DESIGN.replace("\n", end).encode())
    d = design.ExperimentDesign.read(path)
    assert d.replicates == [1] and d.input_sample(1) == "input1" and d.output_samples(1) == ["output1A"]
    assert d.internal_name("input1") == "input1_e1_s0_bNA_tNA_count" and d.internal_name("output1A") == "output1A_e1_s1_b1_tNA_count"
    assert d.rows[0]["generations"] is None and not d.has_growth_data() and d.sample_code(d.rows[1]) == "output1A_e1_s1_b1_tNA"
    assert design.ExperimentDesign.read(path, fastq_file_dir="/x").rows[0]["pair_directory"] == "/x"
    assert design.ExperimentDesign.read(path, count_path="c").rows[0]["pair1"] is None


def test_design_faults(tmp_path):
    for text in ("sample_name\nx\n", "sample_name\texperiment\tselection_id\nx\t1\t2\n", DESIGN + "again\t1\t1\t2\tb1.fastq\tb2.fastq\n"):
        path = tmp_path / "d.txt"
        path.write_text(text)
        with pytest.raises(ValueError):
            design.ExperimentDesign.read(path)
    design.ExperimentDesign.read(path, allow_pair_duplicates=True)


def test_single_end_design_isnt_duplicate(tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("sample_name\texperiment\tselection_id\tpair1\tpair2\na\t1\t0\tx\t\nb\t1\t1\ty\t\n")
    assert design.ExperimentDesign.read(path).sample_names == ["a", "b"]


def test_side_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"barcode\tvariant\r\nAAAA\tCCCC\r\nTTTT\tCCCC\r\nAAAA\tGGGG\r\n")
    assert sorted(map(tuple, counts.read_barcodes(spark, tmp_path / "b.txt").collect())) == [("aaaa", "gggg"), ("tttt", "cccc")]
    for i, text in enumerate(("barcode\tx\nA\tC\n", "barcode\tvariant\nAN\tC\n")):
        (tmp_path / f"b{i}.txt").write_text(text)
        with pytest.raises(ValueError):
            counts.read_barcodes(spark, tmp_path / f"b{i}.txt")
    (tmp_path / "s.txt").write_text(" ACGT \n\nttt\n")
    assert design.read_synonyms(tmp_path / "s.txt") == ["acgt", "ttt"]
    (tmp_path / "d.txt").write_text("pair1\tpair2\tpair_directory\tbarcode\tnew_pair_prefix\na\tb\t/x\tACG\tp\n")
    assert design.read_barcode_design(tmp_path / "d.txt")[0]["barcode2"] == "ACG"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_count_file(spark, tmp_path, design_path, end):
    path = tmp_path / "c.txt"
    path.write_bytes(end.join(["nt_seq\tinput1\toutput1A\textra", "ACGT\t1\tNA\tx", "TTTT\t2.7\t5\ty", ""]).encode())
    rows = counts.read_count_file(spark, path, design.ExperimentDesign.read(design_path)).collect()
    assert sorted(tuple(r) for r in rows) == [("acgt", 1, 0), ("tttt", 2, 5)]


@pytest.mark.parametrize("body, message", [("ACGN\t1\t1", "ACGT"), ("ACGT\t1\tx", "integers"), ("ACGT\t1\t-2", "negative"), ("ACGT\t1\t1\nacgt\t1\t1", "repeated")])
def test_count_file_faults(spark, tmp_path, design_path, body, message):
    path = tmp_path / "c.txt"
    path.write_text(f"nt_seq\tinput1\toutput1A\n{body}\n")
    with pytest.raises(ValueError, match=message):
        counts.read_count_file(spark, path, design.ExperimentDesign.read(design_path))


def test_count_file_columns(spark, design_path):
    d = design.ExperimentDesign.read(design_path)
    for columns in ("x string, input1 int, output1A int", "nt_seq string, input1 int"):
        with pytest.raises(ValueError):
            counts.count_table(spark.createDataFrame([], columns), d)


def test_reports(spark, tmp_path):
    folder = tmp_path / "4_align"
    folder.mkdir()
    stats = {"Pairs": 10, "Merged": 6, "Too_short": 1, "Overlap_too_short": 2, "Min_Q_too_low": 1, "Merged_length_min": 5}
    reports.write_report(folder / "b.report", stats)
    reports.write_report(folder / "a.report", {"Pairs": 3})
    (folder / "c.report.prefilter").write_text("")
    assert reports.parse_report(folder / "b.report") | stats == reports.parse_report(folder / "b.report") | {"Merged_length_min": 5}
    found = reports.collect_reports(spark, tmp_path).collect()
    assert [(r.sample_name, r.Pairs, r.Overlap_too_short) for r in found] == [("a", 3, 0), ("b", 10, 2)]
    (folder / "m").write_text("  100  Pairs\n   90  Merged (90.0%)\n 3 too few kmers found on same diagonal\n 2  multiple potential alignments\n 4 reads too short (after truncation)\n 1 overlap too short\n")
    merged = reports.parse_merge_report(folder / "m")
    assert (merged["Pairs"], merged["Merged"], merged["No_alignment_found"], merged["Too_short"], merged["Overlap_too_short"]) == (100, 90, 5, 4, 1)
    assert reports.parse_report(tmp_path / "none")["Pairs"] == 0


def test_trim_reports(spark, tmp_path):
    (tmp_path / "3_trim").mkdir()
    assert reports.collect_trim_stats(spark, tmp_path).count() == 0
    (tmp_path / "3_trim" / "s1.fastq.cutadapt.gz.stdout").write_text("Total read pairs processed:   10,000\n  Read 1 with adapter:  9,000 (90.0%)\nPairs written (passing filters): 7,900 (79.0%)\n")
    r = reports.collect_trim_stats(spark, tmp_path).first()
    assert (r.sample_name, r.total_reads, r.read1_with_adapter, r.read2_with_adapter, r.pairs_written) == ("s1.fastq", 10000, 9000, 0, 7900)


def test_cli(design_path):
    c, verbose = cli.config_of(["--experimentDesignPath", str(design_path), "--wildtypeSequence", "ATGGCT", "--max_substitutions", "3", "--no_gzipped", "--fitnessDropoutPseudocount", "0.5", "--no-fitness_normalise", "-v"])
    assert (c.max_substitutions, c.gzipped, c.fitness_dropout_pseudocount, c.fitness_normalise, verbose) == (3, False, 0.5, False, True)
    with pytest.raises(SystemExit):
        cli.config_of([])


def test_text_output(spark, tmp_path):
    outputs.write_text(spark.createDataFrame([("a", None), ("b", 1)], "x string, y int"), tmp_path / "t.tsv")
    assert sorted((tmp_path / "t.tsv").read_text().splitlines()) == ["a\tNA", "b\t1", "x\ty"]
    outputs.write_text(spark.createDataFrame([], "x string"), tmp_path / "e.tsv")
    assert (tmp_path / "e.tsv").read_bytes() == b""
    written = outputs.write_bundle({"full": spark.range(2).toDF("i"), "none": spark.range(0).toDF("i")}, tmp_path / "b.parquet")
    assert written == ["full"] and spark.read.parquet(str(tmp_path / "b" / "full.parquet")).count() == 2
