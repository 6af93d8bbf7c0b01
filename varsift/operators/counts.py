"""From long counts to the wide table: tallies, pivot, replicate sums, debarcoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsift.sources.design import ExperimentDesign

#: Barcode maps up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def tally(reads: DataFrame, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    """Exact unique-sequence counts of each sample. Partial sums before the shuffle take the weight off hot sequences."""
    return reads.groupBy(F.col(sample).alias("sample_id"), F.col(seq).alias("nt_seq")).agg(F.count("*").alias("count"))


def tally_order() -> list[Column]:
    """By sample, from the most frequent sequence on, ties by sequence."""
    return [F.col("sample_id"), F.desc("count"), F.col("nt_seq")]


def sorted_tally(reads: DataFrame, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    return tally(reads, sample, seq).orderBy(*tally_order())


def pivot(long: DataFrame, samples: list[str]) -> DataFrame:
    """nt_seq and a column of summed counts for each sample, 0 where it wasn't seen."""
    return long.groupBy("nt_seq").pivot("sample_id", samples).agg(F.sum("count")).na.fill(0, samples)


def cells(design: ExperimentDesign, replicates: list[int]) -> dict[str, str]:
    """Sample code of each design row that counts -> its cell e{E}_s{S}. Technical replicates share a cell, as do all
    output replicates; of the inputs only the first sample counts."""
    out = {}
    for row in design.rows:
        e, s = row["experiment"], row["selection_id"]
        if e in replicates and (s == 1 or row["sample_name"] == design.input_sample(e)):
            out[design.sample_code(row)] = f"count_e{e}_s{s}"
    return out


def wide_counts(long: DataFrame, design: ExperimentDesign, replicates: list[int] | None = None) -> DataFrame:
    """count_e{E}_s{S} from (nt_seq, count, sample_id): samples become cells first, so one pivot does all sums."""
    replicates = design.replicates if replicates is None else replicates
    cell = cells(design, replicates)
    names = [f"count_e{e}_s{s}" for e in replicates for s in (0, 1)]
    mapping = F.create_map(*[F.lit(x) for kv in cell.items() for x in kv])
    rows = long.withColumn("sample_id", F.element_at(mapping, F.col("sample_id"))).where("sample_id is not null")
    return pivot(rows, names).select("nt_seq", *names)


def cells_from_columns(df: DataFrame, design: ExperimentDesign, replicates: list[int] | None = None) -> DataFrame:
    """The same from one column a sample: a projection."""
    out = []
    for e in design.replicates if replicates is None else replicates:
        outputs = [F.coalesce(F.col(f"`{design.internal_name(s)}`"), F.lit(0)) for s in design.output_samples(e)]
        out.append(F.coalesce(F.col(f"`{design.internal_name(design.input_sample(e))}`"), F.lit(0)).cast("bigint").alias(f"count_e{e}_s0"))
        out.append(sum(outputs, F.lit(0)).cast("bigint").alias(f"count_e{e}_s1"))
    return df.select("nt_seq", *out)


def debarcode(df: DataFrame, barcodes: DataFrame, counts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts by mapped variant, and the rows whose barcode is unknown. barcodes: unique (barcode, variant)."""
    small = barcodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = barcodes.select("barcode", "variant")
    joined = df.join(F.broadcast(side) if small else side, df["nt_seq"] == side["barcode"], "left")
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in counts]
    known = joined.where("variant is not null").groupBy(F.col("variant").alias("nt_seq")).agg(*sums)
    return known, joined.where("variant is null").select("nt_seq", *counts)


def last_by_line(barcodes: DataFrame, line: str) -> DataFrame:
    """Of equal barcodes the last line counts."""
    return barcodes.groupBy("barcode").agg(F.max_by("variant", line).alias("variant"))
