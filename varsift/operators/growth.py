"""Growth rates from fitness, by regression on rates that cell densities imply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varsift.functions import estimates
from varsift.sources.design import ExperimentDesign

EPSILON = 1e-30
LEAST_POINTS = 3


def _line(x, y, own):
    """Slope, intercept and number of points of y on x over known, finite pairs of the own rows."""
    good = own & x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    a, b = F.when(good, y), F.when(good, x)
    return F.struct(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_count(a, b).alias("n"))


def raw_rates(df: DataFrame, totals: dict[str, float], time: dict[int, float], cells_in: dict[int, float], cells_out: dict[int, float], reps: Sequence[int]) -> DataFrame:
    """growthrate{E}_raw: log growth of a variant's share of the cells, over the time."""
    columns = {}
    for e in reps:
        top = estimates.s1(e) / F.lit(totals[f"count_e{e}_s1"]) * F.lit(cells_out[e])
        bottom = estimates.s0(e) / F.lit(totals[f"count_e{e}_s0"]) * F.lit(cells_in[e]) + F.lit(EPSILON)
        columns[f"growthrate{e}_raw"] = F.when(estimates.has_counts(e), F.ln(top / bottom) / F.lit(time[e]))
    return df.withColumns(columns)


def infer(df: DataFrame, design: ExperimentDesign, reps: Sequence[int]) -> DataFrame:
    """growthrate and growthrate_sigma, and those of each replicate. df has fitness and sigma merged already.

    A replicate without times or densities has no rates of its own and takes no part in the merge.
    """
    time, cells_out, cells_in = design.mean("selection_time", 1), design.mean("cell_density", 1), design.mean("cell_density", 0)
    own = F.coalesce("error_model", F.lit(False))
    known = [e for e in reps if time.get(e, 0) > 0 and e in cells_out and e in cells_in]
    names = estimates.count_names(known)
    totals = df.agg(*[F.sum(F.when(own, F.col(c))).cast("double").alias(c) for c in names], F.count("*").alias("n")).first().asDict()
    known = [e for e in known if (totals[f"count_e{e}_s0"] or 0) > 0 and (totals[f"count_e{e}_s1"] or 0) > 0]
    if not known:
        return df.withColumns({c: F.lit(None).cast("double") for c in ("growthrate", "growthrate_sigma")})
    raw = raw_rates(df, totals, time, cells_in, cells_out, known)
    lines = raw.agg(*[_line(F.col(f"fitness{e}_uncorr"), F.col(f"growthrate{e}_raw"), own).alias(f"l{e}") for e in known]).first()
    fitted = [e for e in known if lines[f"l{e}"]["n"] >= LEAST_POINTS and lines[f"l{e}"]["slope"] is not None]
    columns = {}
    for e in reps:
        if e in fitted:
            line = lines[f"l{e}"]
            columns |= {f"growthrate{e}": F.col(f"fitness{e}_uncorr") * F.lit(line["slope"]) + F.lit(line["intercept"]), f"growthrate{e}_sigma": F.col(f"sigma{e}_uncorr") * F.lit(abs(line["slope"]))}
        else:
            columns |= {f"growthrate{e}": F.lit(None).cast("double"), f"growthrate{e}_sigma": F.lit(None).cast("double")}
    out = df.withColumns(columns)
    merged, _ = estimates.merge_replicates([f"growthrate{e}" for e in reps], [f"growthrate{e}_sigma" for e in reps])
    out = out.withColumn("_merged", merged)
    last = out.agg(_line(F.col("fitness"), F.col("_merged"), own).alias("l")).first()["l"]
    if last["n"] >= LEAST_POINTS and last["slope"] is not None:
        out = out.withColumns({"growthrate": F.col("fitness") * F.lit(last["slope"]) + F.lit(last["intercept"]), "growthrate_sigma": F.col("sigma") * F.lit(abs(last["slope"]))})
    else:
        out = out.withColumns({"growthrate": F.col("_merged"), "growthrate_sigma": F.lit(None).cast("double")})
    return out.drop("_merged")
