"""Stage 5: count filters, pseudocounts, fitness and errors, amino-acid level aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsift.functions import estimates
from varsift.functions.estimates import s0, s1
from varsift.functions.sequence import translate_text
from varsift.plans.config import RunConfig, Threshold


@dataclass
class NormModel:
    """Scale and shift of each replicate, rounded to four places."""

    scale: dict[int, float]
    shift: dict[int, float]

    @classmethod
    def identity(cls, reps: Sequence[int]) -> NormModel:
        return cls(dict.fromkeys(reps, 1.0), dict.fromkeys(reps, 0.0))

    def row(self) -> dict[str, float]:
        return {f"scale_{e}": v for e, v in self.scale.items()} | {f"shift_{e}": v for e, v in self.shift.items()}


@dataclass
class ErrorModel:
    """Rows of parameter (input, output, reperror), rep, mean_value, CI90_lower, CI90_upper, ensemble."""

    rows: list[dict] = field(default_factory=list)

    def value(self, parameter: str, rep: int) -> float:
        return next(r["mean_value"] for r in self.rows if r["parameter"] == parameter and r["rep"] == rep)


def _least(threshold: Threshold) -> Column:
    """The threshold of a row, by its distance; null where none is set."""
    if not isinstance(threshold, dict):
        return F.lit(threshold)
    return reduce(lambda c, kv: c.when(F.col("Nham_nt") == kv[0], kv[1]), threshold.items(), F.when(F.lit(False), F.lit(None).cast("int")))


def passes(columns: list[str], threshold: Threshold, every: bool) -> Column:
    """Every (or any) count reaches the threshold. By distance: unlisted distances pass, unknown ones don't."""
    at_least = [F.coalesce(F.col(c), F.lit(0)) >= _least(threshold) for c in columns]
    met = reduce(and_ if every else or_, at_least)
    return met if not isinstance(threshold, dict) else F.col("Nham_nt").isNotNull() & F.coalesce(met, F.lit(True))


def null_below(columns: list[str], threshold: Threshold) -> dict[str, Column]:
    """Counts below the threshold become null."""
    return {c: F.when(F.coalesce(F.coalesce(F.col(c), F.lit(0)) < _least(threshold), F.lit(False)), F.lit(None)).otherwise(F.col(c)) for c in columns}


def filter_low_counts(df: DataFrame, config: RunConfig, reps: Sequence[int]) -> DataFrame:
    """Keep rows by the any- and all-thresholds of inputs and outputs, then null single counts below the any-thresholds."""
    columns = {"input": [f"count_e{e}_s0" for e in reps], "output": [f"count_e{e}_s1" for e in reps]}
    for kind in ("any", "all"):
        for side, names in columns.items():
            threshold = config.thresholds[side, kind]
            if threshold:
                df = df.where(passes(names, threshold, kind == "all"))
    for side, names in columns.items():
        if config.thresholds[side, "any"]:
            df = df.withColumns(null_below(names, config.thresholds[side, "any"]))
    return df


def add_dropout_pseudocount(df: DataFrame, pseudocount: float, reps: Sequence[int]) -> DataFrame:
    """Add to outputs that dropped to zero from a seen input."""
    if not pseudocount:
        return df
    number = F.lit(int(pseudocount)) if float(pseudocount).is_integer() else F.lit(float(pseudocount))
    return df.withColumns({f"count_e{e}_s1": F.when((F.col(f"count_e{e}_s1") == 0) & (F.col(f"count_e{e}_s0") > 0), F.col(f"count_e{e}_s1") + number).otherwise(F.col(f"count_e{e}_s1")) for e in reps})


def wildtype_counts(df: DataFrame, reps: Sequence[int]) -> dict[str, float]:
    """Counts of the wildtype row, all in one action."""
    names = estimates.count_names(reps)
    own = F.col("WT") & (F.col("error_model") if "error_model" in df.columns else F.lit(True))
    found = df.where(own).agg(*[F.first(c, ignorenulls=True).cast("double").alias(c) for c in names]).first().asDict()
    if missing := [c for c, v in found.items() if not v]:
        raise RuntimeError(f"the wildtype has no count in {missing}")
    return found


def raw_fitness(df: DataFrame, wt: dict[str, float], reps: Sequence[int]) -> DataFrame:
    """fitness{E}_uncorr: log ratio less the wildtype's."""
    import math

    return df.withColumns({f"fitness{e}_uncorr": estimates.log_ratio(e) - F.lit(math.log(wt[f"count_e{e}_s1"] / wt[f"count_e{e}_s0"])) for e in reps})


def normalise(df: DataFrame, model: NormModel, reps: Sequence[int]) -> DataFrame:
    """(f + shift) scale, less the mean that gives for a wildtype at 0, which its raw fitness is by definition."""
    centre = sum(model.shift[e] * model.scale[e] for e in reps) / len(reps)
    return df.withColumns({f"fitness{e}_uncorr": (F.col(f"fitness{e}_uncorr") + F.lit(model.shift[e])) * F.lit(model.scale[e]) - F.lit(centre) for e in reps})


def add_sigma(df: DataFrame, wt: dict[str, float], reps: Sequence[int], errors: ErrorModel | None, scale: dict[int, float] | None) -> DataFrame:
    """sigma{E}_uncorr from the error model, or from counts alone."""

    def one(e: int) -> Column:
        if errors is None:
            return estimates.poisson_error(e, wt[f"count_e{e}_s0"], wt[f"count_e{e}_s1"])
        return estimates.model_error(e, *(errors.value(p, e) for p in ("input", "output", "reperror")), (scale or {}).get(e, 1.0))

    return df.withColumns({f"sigma{e}_uncorr": F.when(F.col(f"fitness{e}_uncorr").isNotNull(), one(e)) for e in reps})


def calculate_fitness(df: DataFrame, config: RunConfig, reps: Sequence[int], errors: ErrorModel | None = None, norm: NormModel | None = None) -> DataFrame:
    """fitness{E}_uncorr, sigma{E}_uncorr and mean_count of rows with an estimate in any replicate."""
    wt = wildtype_counts(df, reps)
    df = raw_fitness(df, wt, reps)
    applied = norm if config.fitness_normalise else None
    if applied is not None:
        df = normalise(df, applied, reps)
    df = add_sigma(df, wt, reps, errors if config.fitness_error_model else None, applied.scale if applied else None)
    return df.where(estimates.any_known([f"fitness{e}_uncorr" for e in reps])).withColumn("mean_count", estimates.row_mean([F.col(f"count_e{e}_s0") for e in reps]))


def by_generations(df: DataFrame, generations: dict[int, float], reps: Sequence[int], suffix: str = "_uncorr") -> DataFrame:
    """Fitness and sigma per generation, in units of doublings."""
    import math

    names = [(f"{kind}{e}{suffix}", generations[e]) for e in reps if e in generations for kind in ("fitness", "sigma")]
    return df.withColumns({n: F.col(n) / F.lit(g * math.log(2)) for n, g in names if n in df.columns})


def merge(df: DataFrame, reps: Sequence[int], suffix: str = "_uncorr", fitness: str = "fitness", sigma: str = "sigma") -> DataFrame:
    """Inverse-variance mean over replicates."""
    f, s = estimates.merge_replicates([f"fitness{e}{suffix}" for e in reps], [f"sigma{e}{suffix}" for e in reps])
    return df.withColumns({fitness: f, sigma: s})


def _sum(c: str) -> Column:
    return F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)


def aggregate_counts(df: DataFrame, reps: Sequence[int], synonyms: Sequence[str] = ()) -> DataFrame:
    """Counts summed for each amino-acid sequence, united with the single rows of sequences synonymous to the wildtype
    or to a given synonym (error_model false, merged by nucleotides). Indels have no amino acids and stay apart."""
    names = [c for c in estimates.count_names(reps) if c in df.columns]
    known = [F.lit(translate_text(s)) for s in synonyms]
    wt = df.where("WT").select("aa_seq").limit(1).collect()
    refs = known + [F.lit(r.aa_seq) for r in wt]
    single = df.where(F.col("aa_seq").isin(*refs) if refs else F.lit(False)).withColumns({"merge_seq": F.col("nt_seq"), "error_model": F.lit(False)})
    meta = [c for c in ("aa_seq", "Nham_aa", "WT", "indel", "STOP", "STOP_readthrough", "error_model") if c in df.columns]
    keyed = df.withColumn("merge_seq", F.coalesce("aa_seq", "nt_seq"))
    summed = keyed.groupBy("merge_seq").agg(F.min_by(F.struct(*meta), "nt_seq").alias("m"), *[_sum(c) for c in names])
    whole = summed.select("merge_seq", "m.*", *names).withColumns(
        {"WT": F.when(F.col("Nham_aa") == 0, True).otherwise(F.col("WT")), "Nham_nt": F.lit(None).cast("int"), "Nmut_codons": F.lit(None).cast("int"), "nt_seq": F.lit(None).cast("string")}
    )
    return single.unionByName(whole, allowMissingColumns=True)


def aggregate_fitness(df: DataFrame, reps: Sequence[int]) -> DataFrame:
    """Fitness merged by inverse variance over the nucleotide variants of one amino-acid change; counts are summed.

    Variants without a change keep their nucleotides and come twice: as they are, and with error_model false.
    """
    names = [c for c in estimates.count_names(reps) if c in df.columns]
    indel, changed = F.coalesce("indel", F.lit(False)), F.coalesce("Nham_aa", F.lit(0)) > 0
    df = df.withColumn("merge_seq", F.when(F.coalesce("error_model", F.lit(False)) & changed & ~indel, F.col("aa_seq")).otherwise(F.col("nt_seq")))
    same = df.where(~changed & ~indel)
    meta = [c for c in df.columns if c not in names and c != "merge_seq" and c != "mean_count" and not c.endswith("_uncorr")]
    sums = []
    for e in reps:
        f, s = F.col(f"fitness{e}_uncorr"), F.col(f"sigma{e}_uncorr")
        sums += [F.sum(F.when(f.isNotNull() & s.isNotNull(), f / (s * s))).alias(f"_f{e}"), F.sum(F.when(s.isNotNull(), 1 / (s * s))).alias(f"_w{e}")]
    grouped = df.where(changed | indel).groupBy("merge_seq").agg(F.min_by(F.struct(*meta), "nt_seq").alias("m"), *[_sum(c) for c in names], *sums)
    out = grouped.select("merge_seq", "m.*", *names, *[F.when(F.col(f"_w{e}") > 0, F.col(f"_f{e}") / F.col(f"_w{e}")).alias(f"fitness{e}_uncorr") for e in reps], *[F.when(F.col(f"_w{e}") > 0, 1 / F.sqrt(f"_w{e}")).alias(f"sigma{e}_uncorr") for e in reps])
    out = out.withColumn("mean_count", estimates.row_mean([F.col(c) for c in names if c.endswith("_s0")]))
    out = out.withColumns({c: F.when(F.coalesce("Nham_aa", F.lit(0)) == 0, F.col(c)) for c in ("Nham_nt", "Nmut_codons")})
    return same.withColumn("error_model", F.lit(False)).unionByName(same).unionByName(out, allowMissingColumns=True)


__all__ = ["ErrorModel", "NormModel", "s0", "s1"]
