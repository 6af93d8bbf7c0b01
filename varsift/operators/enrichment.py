"""Library mode: enrichment of sequences without a wildtype."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsift.functions import estimates, sequence
from varsift.operators import fitness
from varsift.operators.fitness import NormModel
from varsift.plans.config import RunConfig


def annotate(df: DataFrame, config: RunConfig) -> DataFrame:
    """length, is_reference, is_spikein and, for coding libraries of whole codons, aa_seq. Ids match in any case."""
    if not config.enrichment_mode:
        raise ValueError("library annotation belongs to enrichment mode")
    spikes = [s.strip().lower() for s in (config.enrichment_spikein_ids or "").split(",") if s.strip()]
    out = df.withColumns(
        {
            "length": F.length("nt_seq"),
            "merge_seq": F.col("nt_seq"),
            "WT": F.lit(False),
            "error_model": F.lit(True),
            "Nham_nt": F.lit(0),
            "is_reference": F.col("nt_seq") == F.lit((config.enrichment_reference_id or "").lower()),
            "is_spikein": F.col("nt_seq").isin(spikes) if spikes else F.lit(False),
        }
    )
    if config.coding and df.agg(F.bool_and(F.length("nt_seq") % 3 == 0)).first()[0]:
        out = out.withColumn("aa_seq", sequence.translate("nt_seq"))
    return out


def offsets(df: DataFrame, strategy: str, reps: Sequence[int], norm: NormModel) -> dict[int, float]:
    """What is subtracted in each replicate; one action for all. 0 where a strategy finds nothing to go by."""
    if strategy == "none":
        return dict.fromkeys(reps, 0.0)

    def one(e: int):
        value = F.col(f"enrichment{e}_uncorr")
        if strategy == "median":
            return F.median(value)
        if strategy == "reference":
            return F.max(F.when(F.col("is_reference"), value))
        if strategy == "spikein":
            return F.avg(F.when(F.col("is_spikein"), value))
        totals = [F.sum(F.coalesce(F.col(f"count_e{e}_s{s}"), F.lit(0)).cast("double")) for s in (0, 1)]
        return F.when((totals[0] > 0) & (totals[1] > 0), F.ln(totals[1] / totals[0]))

    found = df.agg(*[one(e).alias(f"o{e}") for e in reps]).first()
    out = {e: found[f"o{e}"] for e in reps}
    if strategy == "total":
        out = {e: None if v is None else (v + norm.shift[e]) * norm.scale[e] for e, v in out.items()}
    return {e: 0.0 if v is None or math.isnan(v) else v for e, v in out.items()}


def calculate(df: DataFrame, config: RunConfig, reps: Sequence[int], norm: NormModel | None = None) -> DataFrame:
    """enrichment{E}_uncorr, sigma{E}_uncorr and mean_count of rows with an estimate in any replicate."""
    norm = norm or NormModel.identity(reps)
    df = df.withColumns({f"enrichment{e}_uncorr": (estimates.log_ratio(e) + F.lit(norm.shift[e])) * F.lit(norm.scale[e]) for e in reps})
    middle = offsets(df, config.enrichment_normalise, reps, norm)
    df = df.withColumns({f"enrichment{e}_uncorr": F.col(f"enrichment{e}_uncorr") - F.lit(middle[e]) for e in reps})
    df = df.withColumns({f"sigma{e}_uncorr": estimates.poisson_error(e, scale=norm.scale[e]) for e in reps})
    return df.where(estimates.any_known([f"enrichment{e}_uncorr" for e in reps])).withColumn("mean_count", estimates.row_mean([F.col(f"count_e{e}_s0") for e in reps]))


def by_generations(df: DataFrame, generations: dict[int, float], reps: Sequence[int]) -> DataFrame:
    there = {f"enrichment{e}_uncorr": f"fitness{e}_uncorr" for e in reps}
    done = fitness.by_generations(df.withColumnsRenamed(there), generations, reps)
    return done.withColumnsRenamed({v: k for k, v in there.items()})


def report(df: DataFrame, reps: Sequence[int]) -> DataFrame:
    """The enrichment table: sequence, counts, replicates, and their merge as fitness and sigma."""
    f, s = estimates.merge_replicates([f"enrichment{e}_uncorr" for e in reps], [f"sigma{e}_uncorr" for e in reps])
    cells = [F.col(f"{k}{e}_uncorr").alias(f"{k}{e}") for e in reps for k in ("enrichment", "sigma")]
    amino = ["aa_seq"] if "aa_seq" in df.columns else []
    return df.select("nt_seq", *amino, "length", "mean_count", *cells, f.alias("fitness"), s.alias("sigma"))
