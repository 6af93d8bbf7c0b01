"""Reports of read processing: writing the filter report, and reading those of this and other tools."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.functions.sequence import largest_int
from varsift.sources import files

# Counters of a filter report and their labels in the file.
COUNTERS = {
    "Pairs": "Pairs", "Merged": "Merged", "Too_short": "Too short", "No_alignment_found": "No alignment found", "Too_many_diffs": "Too many diffs",
    "Overlap_too_short": "Overlap too short", "Exp.errs._too_high": "Exp.errs. too high", "Min_Q_too_low": "Min Q too low",
}
LENGTHS = {"min": "Min", "low": "Low quartile", "median": "Median", "high": "High quartile", "max": "Max"}


def write_report(path: Path | str, stats: dict) -> None:
    lines = ["Merged length distribution:", *(f"\t {stats.get(f'Merged_length_{k}', 'NA')}  {v}" for k, v in LENGTHS.items())]
    lines += ["", "Totals:", *(f"\t {stats.get(k, 0)}  {v}" for k, v in COUNTERS.items())]
    files.locate(path).write_text("\n".join(lines) + "\n")


# How the external merge tool words its counters; reasons without a counter of their own are failed alignments.
MERGE_TOOL = {
    "pairs": "Pairs",
    "merged": "Merged",
    "no alignment": "No_alignment_found",
    "too few kmers": "No_alignment_found",
    "multiple potential": "No_alignment_found",
    "overlap too short": "Overlap_too_short",
    "too short": "Too_short",
    "reads too short": "Too_short",
    "too many diff": "Too_many_diffs",
    "expected error": "Exp.errs._too_high",
}


def _counted(path: Path | str, names: dict[str, str]) -> dict[str, int]:
    """Sums of a report's "number  label" lines by counter; a line's counter is that of the longest name it begins with."""
    stats = dict.fromkeys(COUNTERS, 0)
    path = files.locate(path)
    lines = path.read_text().splitlines() if path.exists() else []
    known = sorted(names, key=len, reverse=True)
    for number, _, label in (line.strip().partition(" ") for line in lines):
        name = next((n for n in known if label.strip().lower().startswith(n)), None)
        if number.isdigit() and name:
            stats[names[name]] += int(number)
    return stats


def parse_report(path: Path | str) -> dict[str, int]:
    """Counters of a filter report of our own."""
    return _counted(path, {label.lower(): name for name, label in COUNTERS.items()})


def parse_merge_report(path: Path | str) -> dict[str, int]:
    """Counters of the merge tool's report."""
    return _counted(path, MERGE_TOOL)


def collect_reports(spark: SparkSession, project: Path | str) -> DataFrame:
    """A row of counters for each sample's report, sorted by sample; prefilter reports are left out."""
    paths = sorted(p for p in (files.locate(project) / "4_align").glob("*.report") if "prefilter" not in p.name)
    rows = [(p.stem, *parse_report(p).values()) for p in paths]
    names = [k.replace(".", "") for k in COUNTERS]
    return spark.createDataFrame(rows, "sample_name string, " + ", ".join(f"`{n}` long" for n in names))


def trim_stats(lines: DataFrame, group: str = "sample_name") -> DataFrame:
    """Totals of adapter-trimming outputs, from rows of (group, value): reads, reads with adapter, pairs written."""
    text, number = F.lower(F.trim("value")), largest_int("value")
    is_total = text.contains("total read") & text.contains("processed")
    r1, r2 = text.contains("read 1 with adapter"), text.contains("read 2 with adapter")
    written = (text.contains("pairs written") | text.contains("reads written")) & text.contains("passing")
    last = lambda c: F.coalesce(F.max(F.when(c, number)), F.lit(0).cast("bigint"))
    return lines.groupBy(group).agg(last(is_total).alias("total_reads"), last(r1).alias("read1_with_adapter"), last(r2).alias("read2_with_adapter"), last(written).alias("pairs_written"))


def collect_trim_stats(spark: SparkSession, project: Path | str) -> DataFrame:
    """trim_stats of every *.stdout of the trimming stage, sorted by sample."""
    folder = files.locate(project) / "3_trim"
    if not list(folder.glob("*.stdout")):
        return spark.createDataFrame([], "sample_name string, total_reads long, read1_with_adapter long, read2_with_adapter long, pairs_written long")
    lines = spark.read.text(files.uri(folder) + "/*.stdout").select("value", F.col("_metadata.file_name").alias("name"))
    return trim_stats(lines.select("value", F.split("name", r"\.cutadapt")[0].alias("sample_name"))).orderBy("sample_name")
