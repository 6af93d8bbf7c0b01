"""Variant count tables: the count-file scan and tallies of reads."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.operators.counts import last_by_line
from varsift.sources import files
from varsift.sources.design import ExperimentDesign

WHOLE = ("tinyint", "smallint", "int", "bigint")
LOG = logging.getLogger(__name__)


def _text_table(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """A tab-separated file with a header, all columns strings, and more columns. Files with bare carriage returns are
    one line to Spark's reader, so the header says which line end to use."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", "NA").option("emptyValue", "").option("quote", "")
    first = files.head(path)
    if b"\r" in first.split(b"\n")[0].rstrip(b"\r"):
        reader = reader.option("lineSep", "\r")
    df = reader.csv(path)
    clean = {c.rstrip("\r"): F.nullif(F.regexp_replace(F.col(f"`{c}`"), "\r$", ""), F.lit("")) for c in df.columns}
    return df.select(*[F.when(x != "NA", x).alias(c) for c, x in clean.items()], *more)


def read_count_file(spark: SparkSession, path: Path | str, design: ExperimentDesign, validate: bool = True) -> DataFrame:
    """nt_seq (lower case) and a bigint column for each sample, under its internal name."""
    df = _text_table(spark, files.uri(path))
    return count_table(df, design, validate)


def count_table(df: DataFrame, design: ExperimentDesign, validate: bool = True) -> DataFrame:
    """Check and normalise a count table: one aggregate pass finds every fault."""
    if "nt_seq" not in df.columns:
        raise ValueError("the count file has no column nt_seq")
    samples = design.sample_names if len(set(design.sample_names)) == len(design.sample_names) else list(dict.fromkeys(design.sample_names))
    if missing := [s for s in samples if s not in df.columns]:
        raise ValueError(f"samples missing from the count file: {missing}")
    kinds = dict(df.dtypes)
    # fractions are cut off; what isn't a number stays null and is found below
    number = lambda c: F.col(f"`{c}`") if kinds[c] in WHOLE else F.col(f"`{c}`").try_cast("double").try_cast("bigint")
    rows = df.select(F.lower("nt_seq").alias("nt_seq"), *[number(s).cast("bigint").alias(s) for s in samples], *[(F.col(f"`{s}`").isNotNull() & number(s).isNull()).alias(f"bad_{s}") for s in samples])
    if validate:
        faults = validation(rows, samples).first().asDict()
        if faults["n_invalid"]:
            raise ValueError(f"{faults['n_invalid']} values of nt_seq hold other characters than ACGT")
        for s in samples:
            if faults[f"bad_{s}"]:
                raise ValueError(f"count column {s!r} holds values that aren't integers")
            if faults[f"least_{s}"] is not None and faults[f"least_{s}"] < 0:
                raise ValueError(f"count column {s!r} holds negative values")
        if faults["n_repeated"]:
            raise ValueError(f"{faults['n_repeated']} repeated values of nt_seq")
    return rows.select("nt_seq", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("bigint").alias(design.internal_name(s)) for s in samples])


def validation(rows: DataFrame, samples: list[str]) -> DataFrame:
    """One row of fault counts."""
    bad = [F.count_if(F.col(f"bad_{s}")).alias(f"bad_{s}") for s in samples if f"bad_{s}" in rows.columns]
    return rows.agg(
        F.count_if(F.col("nt_seq").rlike("[^acgt]")).alias("n_invalid"),
        (F.count("nt_seq") - F.count_distinct("nt_seq")).alias("n_repeated"),
        *bad,
        *[F.min(F.col(f"`{s}`")).alias(f"least_{s}") for s in samples],
    )


def read_tally(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """nt_seq, count, sample_id of headerless tallies; sample_id by file, missing files are left out."""
    found = None
    for sample, path in paths.items():
        try:
            one = spark.read.option("sep", "\t").schema("nt_seq string, count bigint").csv(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            LOG.warning("no tally for %s: %s", sample, path)
            continue
        one = one.select(F.lower("nt_seq").alias("nt_seq"), "count", F.lit(sample).alias("sample_id"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "nt_seq string, count bigint, sample_id string")
    return found


def read_barcodes(spark: SparkSession, path: Path | str) -> DataFrame:
    """barcode and variant in lower case, of any number of rows; of equal barcodes the last line counts."""
    # lines of a file follow each other by the place of their split and within it
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    rows = _text_table(spark, files.uri(path), line.alias("line"))
    if missing := [c for c in ("barcode", "variant") if c not in rows.columns]:
        raise ValueError(f"columns missing from the barcode file: {missing}")
    rows = rows.select(*[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("barcode", "variant")], "line")
    odd = rows.where(F.concat("barcode", "variant").rlike("[^acgt]")).select("barcode", "variant").first()
    if odd:
        raise ValueError(f"the barcode file holds other characters than ACGT: {tuple(odd)}")
    return last_by_line(rows, "line")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table written by an earlier stage."""
    return spark.read.parquet(path)
