"""Registered queries that write files of each kind and read them back, with the same tables in SQL."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.operators import counts, reads
from varsift.plans import fixture, outputs
from varsift.plans.catalogue import _MAP, ERRORS, NORM, config, design, query
from varsift.plans.config import parse_threshold, threshold_for
from varsift.plans.fixture import COUNTS, EVENTS_SQL, READS_SQL, VARIANTS_SQL
from varsift.sources import counts as count_source
from varsift.sources import design as design_source
from varsift.sources import fastq, files, reports


def side_file(text: str, name: str = "side.txt") -> Path:
    """A small file on the driver, as designs and the like are."""
    path = Path(tempfile.mkdtemp(prefix="varsift-")) / name
    path.write_text(text)
    return path


def values(rows: list[tuple], columns: list[str]) -> str:
    show = lambda v: "null" if v is None else "'" + v + "'" if isinstance(v, str) else str(v).lower()
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as t({', '.join(columns)})"


# --- counts ---------------------------------------------------------------------------------------------------------


@query(f"with {VARIANTS_SQL} select * from variants")
def src_count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count table with a column for each sample."""
    rows = fixture.variants(spark, sf_dir)
    names = {c: design().samples(int(c[7]), int(c[-1]))[0] for c in COUNTS}
    folder = files.scratch(spark, "counts")
    rows.select(F.upper("nt_seq").alias("nt_seq"), *[F.when(F.col(c) > 0, F.col(c)).alias(n) for c, n in names.items()]).write.option("sep", "\t").option("header", True).option("nullValue", "NA").csv(folder)
    return counts.cells_from_columns(count_source.read_count_file(spark, folder, design()), design())


@query(f"with {READS_SQL} select nt_seq, cast(sum(quantity) as bigint) as count, concat('count_e', e, '_s', s) as sample_id from reads group by nt_seq, e, s")
def src_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless tallies, a file (here a folder) for each sample; one that is missing is left out."""
    long = fixture.long_counts(spark, sf_dir).groupBy("sample_id", "nt_seq").agg(F.sum("count").alias("count"))
    folder = files.scratch(spark, "tally")
    long.select("sample_id", "nt_seq", "count").write.partitionBy("sample_id").option("sep", "\t").csv(folder)
    return count_source.read_tally(spark, {c: f"{folder}/sample_id={c}" for c in [*COUNTS, "count_e9_s0"]})


@query(f"with {VARIANTS_SQL} select * from variants")
def src_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that an earlier stage wrote."""
    path = files.scratch(spark, "stored")
    fixture.variants(spark, sf_dir).write.parquet(path)
    return count_source.read_stored(spark, path)


@query(f"with {READS_SQL}, tallied as (select concat('count_e', e, '_s', s) as sample_id, nt_seq, count(*) as count from reads group by 1, 2) select sample_id, nt_seq, count, row_number() over (order by sample_id, count desc, nt_seq) as place from tallied")
def src_sorted_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a tally: by sample, from the most frequent sequence on, ties by sequence."""
    from pyspark.sql import Window

    rows = counts.tally(fixture.long_counts(spark, sf_dir), seq="nt_seq")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*counts.tally_order())).cast("bigint"))


# --- designs and side files -----------------------------------------------------------------------------------------

_DESIGN = """sample_name\texperiment\tselection_id\tbiological_replicate\ttechnical_replicate\tgenerations\tpair1\tpair2
in1\t1\t0\tNA\t1\tNA\ta.fastq\tb.fastq
out1A\t1\t1\t1\t1\t4\tc.fastq\td.fastq
out1B\t1\t1\t2\tNA\t6.5\te.fastq\tf.fastq
in2\t2\t0\t\t1\t\tg.fastq\th.fastq
out2A\t2\t1\t1.0\t1\t5\ti.fastq\tj.fastq
"""


@query(
    values(
        [
            ("in1", 1, 0, "in1_e1_s0_bNA_tNA_count", "in1_e1_s0_bNA_t1", None, "/data", "count_e1_s0"),
            ("out1A", 1, 1, "out1A_e1_s1_b1_tNA_count", "out1A_e1_s1_b1_t1", 5.25, "/data", "count_e1_s1"),
            ("out1B", 1, 1, "out1B_e1_s1_b2_tNA_count", "out1B_e1_s1_b2_tNA", 5.25, "/data", "count_e1_s1"),
            ("in2", 2, 0, "in2_e2_s0_bNA_tNA_count", "in2_e2_s0_bNA_t1", None, "/data", "count_e2_s0"),
            ("out2A", 2, 1, "out2A_e2_s1_b1_tNA_count", "out2A_e2_s1_b1_t1", 5.0, "/data", "count_e2_s1"),
        ],
        ["sample_name", "experiment", "selection_id", "internal_name", "code", "generations", "folder", "cell"],
    ).replace("5.25", "cast(5.25 as double)").replace(" 5.0,", " cast(5.0 as double),")
)
def src_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design file: names, codes, mean generations of a replicate's outputs, cells."""
    d = design_source.ExperimentDesign.read(side_file(_DESIGN), fastq_file_dir="/data")
    generations, cell = d.mean("generations", 1), counts.cells(d, d.retained("all"))
    rows = [(r["sample_name"], r["experiment"], r["selection_id"], d.internal_name(r["sample_name"]), d.sample_code(r), generations[r["experiment"]] if r["selection_id"] else None, r["pair_directory"], cell[d.sample_code(r)]) for r in d.rows]
    return spark.createDataFrame(rows, "sample_name string, experiment int, selection_id int, internal_name string, code string, generations double, folder string, cell string")


@query(values([(1, "in1", "out1A,out1B"), (2, "in2", "out2A")], ["replicate", "input", "outputs"]))
def src_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs of the replicates that a run retains, listed in any order."""
    d = design_source.ExperimentDesign.read(side_file(_DESIGN))
    rows = [(e, d.input_sample(e), ",".join(d.output_samples(e))) for e in d.retained("2,1,7")]
    return spark.createDataFrame(rows, "replicate int, input string, outputs string")


@query(f"with {_MAP} select barcode, variant from barcodes")
def src_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A barcode map with line numbers, in which earlier lines for the same barcodes are overruled."""
    known = fixture.variants(spark, sf_dir).where(F.length(F.replace("nt_seq", F.lit("a"), F.lit(""))) % 5 != 0)
    pairs = known.select(F.upper("nt_seq").alias("barcode"), F.concat(F.substring("nt_seq", 1, 15), F.lit(fixture.WT[15:])).alias("variant"))
    folder = files.scratch(spark, "barcodes")
    pairs.select("barcode", F.lit("acgt").alias("variant")).union(pairs).coalesce(1).write.option("sep", "\t").option("header", True).csv(folder)
    return count_source.read_barcodes(spark, folder)


@query(values([("p1", "ACG", "TTT", "x"), ("p2", "GGC", "GGC", "y")], ["prefix", "barcode1", "barcode2", "pair1"]))
def src_barcode_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "pair1\tpair2\tpair_directory\tbarcode\tbarcode1\tbarcode2\tnew_pair_prefix\r\nx\tx2\t/d\tNA\tACG\tTTT\tp1\r\ny\ty2\t/d\tGGC\t\t\tp2\r\n"
    rows = design_source.read_barcode_design(side_file(text))
    return spark.createDataFrame([(r["new_pair_prefix"], r["barcode1"], r["barcode2"], r["pair1"]) for r in rows], "prefix string, barcode1 string, barcode2 string, pair1 string")


@query(values([("generations", True), ("growth", True), ("no growth without times", False), ("no generations", False), ("retained", True)], ["fact", "holds"]))
def src_design_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a design says about generations and growth, and which replicates a list retains."""
    whole = design()
    without = lambda name: design_source.ExperimentDesign([r | {name: None} for r in whole.rows])
    facts = [
        ("generations", whole.has_generations()),
        ("growth", whole.has_growth_data()),
        ("no growth without times", without("selection_time").has_growth_data()),
        ("no generations", without("generations").has_generations()),
        ("retained", whole.retained("3,1") == [1, 3] and whole.retained("all") == [1, 2, 3]),
    ]
    return spark.createDataFrame(facts, "fact string, holds boolean")


_OPTIONS = [
    ("coding", {}, "coding", "N" * 30, None, 2),
    ("a stop inside", {"wildtype_sequence": "ATGTAAGCT"}, "noncoding", "N" * 9, None, 2),
    ("constant parts", {"wildtype_sequence": "atgGCTgat", "permitted_sequences": "NRy"}, "coding", "NRY", None, 2),
    ("indels", {"indels": "3, 33", "max_substitutions": 1}, "coding", "N" * 30, "3,33", 1),
    ("all indels", {"indels": "all", "sequence_type": "noncoding"}, "noncoding", "N" * 30, "", 2),
]


@query(values([(name, kind, permitted, indels, most) for name, _, kind, permitted, indels, most in _OPTIONS], ["name", "kind", "permitted", "indels", "most"]))
def resolved_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from options that are given or left out."""
    rows = []
    for name, options, *_ in _OPTIONS:
        c = config(**options)
        rows.append((name, c.sequence_type_resolved, c.permitted, None if c.indel_lengths is None else ",".join(map(str, c.indel_lengths)), c.max_substitutions))
    return spark.createDataFrame(rows, "name string, kind string, permitted string, indels string, most int")


_BAD = {"wildtype_sequence": "ATGNNN", "permitted_sequences": "NN", "indels": "some", "mutagenesis_type": "odd", "barcode_error_rate": 2, "max_substitutions": 0, "num_cores": 0, "fitness_min_input_count_any": "1:2:3", "sequence_type": "x"}


@query(values([(name,) for name in _BAD], ["option"]))
def refused_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that are out of their ranges are named."""
    rows = []
    for name, value in _BAD.items():
        try:
            config(**{name: value})
        except ValueError as e:
            rows.append((str(e).split()[0],))
    return spark.createDataFrame(rows, "option string")


@query(values([(0, 5, 3), (1, 3, 3), (2, None, 3), (9, None, 3)], ["distance", "listed", "flat"]))
def thresholds_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by distance and flat ones."""
    listed, flat = parse_threshold("0:5, 1:3"), parse_threshold("3")
    rows = [(d, threshold_for(listed, d), threshold_for(flat, d)) for d in (0, 1, 2, 9)]
    return spark.createDataFrame(rows, "distance int, listed int, flat int")


@query(values([("linked", None, "AAAAAAAAAA;required...TTTTTTTTTT;optional", True), ("short", "AAAAAAAAAA", "TTTTTTTTTT", True), ("cut only", None, None, True), ("nothing", None, None, False)], ["name", "five", "three", "trimmed"]))
def adapters_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapters of a row: linked where a read is long enough, and whether anything is to be trimmed."""
    both = {"cutadapt5First": "A" * 10, "cutadapt3First": "T" * 10}
    given = {"linked": both | {"pair1_length": 100}, "short": both | {"pair1_length": 40}, "cut only": {"cutadaptCut5First": 3}, "nothing": {"pair1_length": 100}}
    rows = []
    for name, row in given.items():
        asked = reads.link_adapters(row, config())
        rows.append((name, asked.get("cutadapt5First"), asked.get("cutadapt3First"), reads.needs_trimming(asked)))
    return spark.createDataFrame(rows, "name string, five string, three string, trimmed boolean")


@query(values([("acgt",), ("ttt",)], ["sequence"]))
def src_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s in design_source.read_synonyms(side_file(" ACGT \n\nttt\n"))], "sequence string")


# --- sinks ------------------------------------------------------------------------------------------------------------


@query(f"with {VARIANTS_SQL} select nt_seq, nullif(count_e1_s0, 0) as count_e1_s0, count_e1_s1 from variants")
def snk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file with nulls as NA, joined from the parts of all tasks and read again."""
    path = f"{files.scratch(spark, 'text')}/counts.tsv"
    outputs.write_text(fixture.variants(spark, sf_dir).repartition(3).select("nt_seq", F.nullif("count_e1_s0", F.lit(0)).alias("count_e1_s0"), "count_e1_s1"), path)
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").schema("nt_seq string, count_e1_s0 bigint, count_e1_s1 bigint").csv(path)


@query(f"with {VARIANTS_SQL} select 'full' as name, count(*) as n from variants")
def snk_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of Parquet tables, without those that are empty."""
    path = f"{files.scratch(spark, 'bundle')}/all.parquet"
    rows = fixture.variants(spark, sf_dir)
    written = outputs.write_bundle({"full": rows, "none": rows.limit(0)}, path)
    return spark.createDataFrame([(n, spark.read.parquet(f"{path.removesuffix('.parquet')}/{n}.parquet").count()) for n in written], "name string, n bigint")


@query(values([("errormodel.txt", "input", 1.1), ("errormodel.txt", "output", 1.3), ("normalisationmodel.txt", "scale_2", 1.1)], ["file", "name", "value"]).replace("1.1)", "cast(1.1 as double))").replace("1.3)", "cast(1.3 as double))"))
def snk_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model tables as text."""
    folder = files.locate(files.scratch(spark, "models"))
    outputs.write_models(folder, ERRORS, NORM)
    read = lambda name: spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(files.uri(folder / name))
    errors = read("errormodel.txt").where("rep = 1 and parameter <> 'reperror'").select(F.lit("errormodel.txt").alias("file"), F.col("parameter").alias("name"), F.col("mean_value").cast("double").alias("value"))
    norm = read("normalisationmodel.txt").select(F.lit("normalisationmodel.txt").alias("file"), F.lit("scale_2").alias("name"), F.col("scale_2").cast("double").alias("value"))
    return errors.union(norm)


# --- reads ----------------------------------------------------------------------------------------------------------

_QUAL1 = "case when i % 13 = 0 then '#' || repeat('I', cast(length(seq1) - 1 as int)) else repeat(chr(cast(33 + event_quality as int)), cast(length(seq1) as int)) end"


@query(f"with {EVENTS_SQL} select 'r' || read_id as header, seq1 as seq, {_QUAL1} as qual from quality")
def src_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip FASTQ, a file for each task, written and read."""
    folder = files.scratch(spark, "fastq")
    rows = fixture.event_pairs(spark, sf_dir).withColumn("header", F.concat(F.lit("@r"), F.col("read_id").cast("string")))
    fastq.write_fastq(rows.coalesce(4), folder, seq="seq1", qual="qual1")
    found = fastq.read_fastq(spark, files.files_below(folder))
    return found.select(F.substring("header", 2, 99).alias("header"), "seq", "qual")


@query(f"with {EVENTS_SQL} select 'r' || read_id as header, seq1, seq2 from quality where read_id < 2000")
def src_fastq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates in two files, read in lockstep."""
    rows = fixture.event_pairs(spark, sf_dir).where("read_id < 2000").withColumn("header", F.concat(F.lit("@r"), F.col("read_id").cast("string"))).coalesce(1).sortWithinPartitions("read_id")
    paths = []
    for mate in "12":
        folder = files.scratch(spark, f"fastq{mate}")
        fastq.write_fastq(rows, folder, seq=f"seq{mate}", qual=f"qual{mate}")
        paths.append(files.files_below(folder))
    return fastq.read_fastq(spark, *paths).select(F.substring("header", 2, 99).alias("header"), "seq1", "seq2")


_REASONS = ["Too_short", "No_alignment_found", "Too_many_diffs", "Overlap_too_short", "Min_Q_too_low"]


@query(values([("a", 3, 0, 0, 0, 0, 0, 0), ("b", 10, 6, 1, 0, 0, 2, 1)], ["sample_name", "Pairs", "Merged", *_REASONS]))
def src_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter reports, written and collected by sample."""
    folder = side_file("", "x").parent / "4_align"
    folder.mkdir()
    reports.write_report(folder / "b.report", {"Pairs": 10, "Merged": 6, "Too_short": 1, "Overlap_too_short": 2, "Min_Q_too_low": 1, "Merged_length_min": 5})
    reports.write_report(folder / "a.report", {"Pairs": 3})
    (folder / "c.prefilter.report").write_text("")
    return reports.collect_reports(spark, folder.parent).select("sample_name", "Pairs", "Merged", *_REASONS)


@query(values([(100, 90, 5, 4, 1, 2, 3)], ["Pairs", "Merged", "No_alignment_found", "Too_short", "Overlap_too_short", "Too_many_diffs", "high_errors"]))
def src_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge tool's report, of which several reasons are failed alignments."""
    text = "  100  Pairs\n   90  Merged (90.0%)\n   10  Not merged (10.0%)\n 3 too few kmers found on same diagonal\n 2  multiple potential alignments\n 4 reads too short (after truncation)\n 1 overlap too short\n 2 too many differences\n 3 expected error too high\n"
    found = reports.parse_merge_report(side_file(text))
    columns = ["Pairs", "Merged", "No_alignment_found", "Too_short", "Overlap_too_short", "Too_many_diffs", "Exp.errs._too_high"]
    return spark.createDataFrame([tuple(found[c] for c in columns)], ", ".join(f"{c} int" for c in [*columns[:-1], "high_errors"]))


@query(values([("s1.fastq", 10000, 9000, 0, 7900), ("s2.fastq", 50000, 20000, 30000, 40000)], ["sample_name", "total_reads", "read1_with_adapter", "read2_with_adapter", "pairs_written"]))
def src_trim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of the trimming tool."""
    folder = side_file("", "x").parent / "3_trim"
    folder.mkdir()
    (folder / "s1.fastq.cutadapt.gz.stdout").write_text("Total read pairs processed:   10,000\n  Read 1 with adapter:  9,000 (90.0%)\nPairs written (passing filters): 7,900 (79.0%)\n")
    (folder / "s2.fastq.cutadapt.gz.stdout").write_text("Total read pairs processed:   50,000\n  Read 1 with adapter:  20,000 (40.0%)\n  Read 2 with adapter:  30,000 (60.0%)\nPairs written (passing filters): 40,000 (80.0%)\n")
    return reports.collect_trim_stats(spark, folder.parent)
