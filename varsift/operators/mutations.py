"""Single and double mutants, and the tables they are reported in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsift.functions import sequence
from varsift.operators import fitness

#: Singles are broadcast to the doubles up to this many rows. There are at most 21 a position, one for each other
#: letter, so the length of the reference bounds them before anything is counted.
BROADCAST_SINGLES = 500_000
LETTERS = 21


def drop_uncorr(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.removesuffix("_uncorr") for c in df.columns if c.endswith("_uncorr")})


def _level(coding: bool) -> tuple[str, str]:
    return ("Nham_aa", "aa_seq") if coding else ("Nham_nt", "merge_seq")


def _at(df: DataFrame, seq: str, ref: str, n: int) -> DataFrame:
    df = df.withColumn("_p", sequence.mutated_positions(seq, ref))
    for i in range(n):
        tag = "" if n == 1 else str(i + 1)
        place = F.get(F.col("_p"), F.lit(i))
        df = df.withColumns({f"Pos{tag}": place.cast("int"), f"Mut{tag}": F.substring(F.col(seq), place, F.lit(1)), f"WT_AA{tag}": F.substring(F.lit(ref), place, F.lit(1))})
    return df.drop("_p")


def singles(df: DataFrame, ref: str, coding: bool) -> DataFrame:
    """Rows one change away from ref, with Pos, Mut, WT_AA and without the suffix _uncorr."""
    distance, seq = _level(coding)
    return drop_uncorr(_at(df.where(F.col(distance) == 1), seq, ref, 1))


def lookup(doubles: DataFrame, singles_df: DataFrame, payload: dict[str, str], length: int) -> DataFrame:
    """Columns of the singles at both positions of the doubles; payload: column -> name pattern with {} for 1 and 2."""
    side = singles_df.select("Pos", "Mut", *payload)
    small = LETTERS * length <= BROADCAST_SINGLES
    for i in (1, 2):
        one = side.select(F.col("Pos").alias(f"Pos{i}"), F.col("Mut").alias(f"Mut{i}"), *[F.col(c).alias(name.format(i)) for c, name in payload.items()])
        doubles = doubles.join(F.broadcast(one) if small else one, [f"Pos{i}", f"Mut{i}"], "left")
    return doubles


def doubles(df: DataFrame, singles_df: DataFrame | None, ref: str, coding: bool) -> DataFrame:
    """Rows two changes away from ref, with both places and the singles' mean counts."""
    distance, seq = _level(coding)
    found = _at(df.where(F.col(distance) == 2), seq, ref, 2)
    if singles_df is None or "mean_count" not in singles_df.columns:
        return found.withColumns({f"s{i}_mean_count": F.lit(None).cast("double") for i in (1, 2)})
    return lookup(found, singles_df, {"mean_count": "s{}_mean_count"}, len(ref))


# Columns of the reports, in order.
SINGLE = ["Pos", "WT_AA", "Mut", "nt_seq", "aa_seq", "Nham_nt", "Nham_aa", "Nmut_codons", "STOP", "STOP_readthrough", "mean_count", "fitness", "sigma"]
DOUBLE = [
    "Pos1", "Pos2", "WT_AA1", "WT_AA2", "Mut1", "Mut2", "nt_seq", "aa_seq", "Nham_nt", "Nham_aa", "Nmut_codons", "STOP", "STOP_readthrough", "mean_count",
    "fitness1", "sigma1", "fitness2", "sigma2", "fitness_uncorr", "sigma_uncorr",
]
CODING_ONLY = {"aa_seq", "Nham_aa", "Nmut_codons", "STOP", "STOP_readthrough"}


def _shaped(df: DataFrame, columns: list[str], coding: bool) -> DataFrame:
    kept = [c for c in columns if c in df.columns and (coding or c not in CODING_ONLY)]
    out = df.select(*kept)
    return out if coding else out.withColumnsRenamed({c: c.replace("WT_AA", "WT_nt") for c in kept})


def finalise_singles(df: DataFrame, coding: bool) -> tuple[DataFrame, DataFrame]:
    """The singles' report, and the variant-database table (hgvs_pro or hgvs_nt, score, se)."""
    out = _shaped(df.where("Nham_aa = 1") if coding else df, SINGLE, coding)
    if coding:
        name = sequence.hgvs_protein(F.col("WT_AA"), F.col("Pos"), F.col("Mut")).alias("hgvs_pro")
    else:
        name = sequence.hgvs_nucleotide(F.col("WT_nt"), F.col("Pos"), F.col("Mut")).alias("hgvs_nt")
    return out, out.select(name, F.col("fitness").alias("score"), F.col("sigma").alias("se"))


def finalise_doubles(df: DataFrame, coding: bool) -> DataFrame:
    return _shaped(df, DOUBLE, coding)


def _by_merge_seq(df: DataFrame) -> DataFrame:
    return df.drop("nt_seq").withColumnRenamed("merge_seq", "nt_seq") if "merge_seq" in df.columns else df


def merged_tables(everything: DataFrame, singles_df: DataFrame, doubles_df: DataFrame, reps: Sequence[int], coding: bool, length: int) -> dict[str, DataFrame]:
    """All result tables: fitness merged over replicates, nucleotides blanked where they aren't one variant's."""
    every = _by_merge_seq(fitness.merge(everything, reps))
    single = _by_merge_seq(fitness.merge(singles_df, reps, suffix=""))
    double = _by_merge_seq(fitness.merge(doubles_df, reps, fitness="fitness_uncorr", sigma="sigma_uncorr"))
    changed, indel = F.coalesce("Nham_aa", F.lit(0)) > 0, F.coalesce("indel", F.lit(False))
    if coding:
        every = every.withColumn("nt_seq", F.when(~(F.coalesce("error_model", F.lit(False)) & (changed | indel)), F.col("nt_seq")))
        single = single.withColumn("nt_seq", F.when(~changed, F.col("nt_seq")))
        double = double.withColumn("nt_seq", F.lit(None).cast("string"))
    synonymous, every = every.where("not error_model"), every.where("error_model")
    wildtype = every.where(F.coalesce("WT", F.lit(False)))
    if coding:
        every = every.where(F.coalesce("WT", F.lit(False)) | changed | indel)
    double = double.drop(*[f"{k}{i}" for k in ("fitness", "sigma") for i in (1, 2)])
    double = lookup(double, single, {"fitness": "fitness{}", "sigma": "sigma{}"}, length)
    out, database = finalise_singles(single, coding)
    tables = {"all_variants": every, "wildtype": wildtype, "singles": out, "doubles": finalise_doubles(double, coding), "database": database}
    return tables | ({"synonymous": synonymous} if coding else {})
