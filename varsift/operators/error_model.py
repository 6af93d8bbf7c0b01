"""Replicate normalisation and the error model.

Thresholds, wildtype scalars and weights come from a few aggregates. The normalisation's objective is a sum over rows:
up to FIT_ROWS rows it is evaluated on the driver, beyond that each evaluation is one distributed aggregate. The error
model is linear in its parameters, so a bootstrap needs only its normal equations, and each solves a small convex
problem. Every bootstrap draws its rows (max_n at most) from the whole table, in one order: up to POOL_ROWS rows from a
broadcast copy, beyond that by joining the numbers that were drawn to the numbered rows. Both ways draw the same rows.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from varsift.functions import estimates
from varsift.operators.fitness import ErrorModel, NormModel
from varsift.operators.solvers import bounded_least_squares, minimise
from varsift.shipping import ship

#: Rows up to which the normalisation is fitted on the driver (a double for each row and replicate).
FIT_ROWS = 1_000_000
#: Rows up to which bootstraps draw from a broadcast copy of the table.
POOL_ROWS = 200_000
MOST_SUBSETS = 500
LOG = logging.getLogger(__name__)


def input_threshold(df: DataFrame, reps: Sequence[int]) -> DataFrame:
    """One row: exp of minus the first percentile of all raw log ratios, over rows with reads everywhere."""
    ratios = df.where(estimates.all_reads(reps)).select(F.explode(F.array(*[estimates.log_ratio(e) for e in reps])).alias("f"))
    return ratios.agg(F.exp(-F.percentile("f", F.lit(0.01))).alias("input_threshold"))


def _values(columns: Sequence[Column], df: DataFrame) -> np.ndarray:
    names = [f"c{i}" for i in range(len(columns))]
    table = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names)]).toArrow()
    return np.stack([table.column(n).to_numpy() for n in names], 1) if table.num_rows else np.empty((0, len(names)))


def deviation(p: np.ndarray, fits: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over rows of |(F + shift) scale - mean(F + shift)|, and its gradient."""
    k = fits.shape[1]
    scale, shift = p[:k], p[k:]
    moved = fits + shift
    gap = moved * scale - moved.mean(1, keepdims=True)
    size = np.sqrt((gap**2).sum(1) + 1e-24)
    unit = gap / size[:, None]
    return float(size.sum()), np.r_[(unit * moved).sum(0), (unit * scale).sum(0) - unit.sum() / k]


def _distributed_deviation(df: DataFrame, names: list[str]):
    """The same as one aggregate for each evaluation."""
    k = len(names)

    def run(p: np.ndarray) -> tuple[float, np.ndarray]:
        moved = [F.col(n) + F.lit(float(p[k + i])) for i, n in enumerate(names)]
        mean = sum(moved[1:], moved[0]) / k
        gaps = [m * F.lit(float(p[i])) - mean for i, m in enumerate(moved)]
        size = F.sqrt(sum((g * g for g in gaps), F.lit(1e-24)))
        units = [g / size for g in gaps]
        both = sum(units[1:], units[0]) / k
        found = df.agg(F.sum(size), *[F.sum(u * m) for u, m in zip(units, moved)], *[F.sum(u * F.lit(float(p[i])) - both) for i, u in enumerate(units)]).first()
        return float(found[0]), np.array([float(x) for x in found[1:]])

    return run


def fit_normalisation(df: DataFrame, reps: Sequence[int], prefix: str = "fitness") -> NormModel:
    """Scale and shift for rows of {prefix}{E}; the first scale is 1."""
    names = [f"{prefix}{e}" for e in reps]
    k = len(names)
    if df.limit(FIT_ROWS + 1).count() <= FIT_ROWS:
        fits = _values([F.col(n) for n in names], df)
        objective = lambda p: deviation(p, fits)
    else:
        objective = _distributed_deviation(df, names)
    p = minimise(objective, np.r_[np.ones(k), np.zeros(k)])
    scale = p[:k] / p[0]
    if (scale < 0).any():
        LOG.warning("some scales are negative: are input and output samples exchanged in the design?")
    return NormModel({e: round(float(v), 4) for e, v in zip(reps, scale)}, {e: round(float(v), 4) for e, v in zip(reps, p[k:])})


def diversity_weight(df: DataFrame, by: str = "Nham_nt") -> DataFrame:
    """error_model_weighting: the root of the group's size, at least the fourth root of all rows."""
    sizes = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    rows = df.join(F.broadcast(sizes), by, "left").join(F.broadcast(total))  # one row of one number, and one for each distance
    n, everything = F.col("_n").cast("double"), F.col("_all").cast("double")
    return rows.withColumn("error_model_weighting", F.when(n > F.sqrt(everything), F.sqrt(n)).otherwise(F.sqrt(F.sqrt(everything)))).drop("_n", "_all")


def subsets(n: int) -> list[tuple[int, ...]]:
    """All subsets of two replicates or more, largest first."""
    return [s for k in range(n, 1, -1) for s in combinations(range(n), k)][:MOST_SUBSETS]


def normal_equations(fits: np.ndarray, cin: np.ndarray, cout: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy of V = sum over a subset of (p_in cin + p_out cout + p_rep) / size, stacked over subsets."""
    k = fits.shape[1]
    gram, target = np.zeros((3 * k, 3 * k)), np.zeros(3 * k)
    columns = np.concatenate([cin, cout, np.ones_like(cin)], 1)
    for some in subsets(k):
        at = [j + part * k for part in range(3) for j in some]
        x = columns[:, at] / len(some)
        seen = fits[:, some].var(1, ddof=1)
        good = np.isfinite(seen) & np.isfinite(weight)
        xw = x[good] * weight[good, None]
        gram[np.ix_(at, at)] += xw.T @ x[good]
        target[at] += xw.T @ seen[good]
    return gram, target


def drawn(n: int, seed: int, most: int) -> np.ndarray:
    """Numbers of the rows of one resample."""
    return np.random.default_rng(seed).choice(n, size=min(n, most), replace=True)


def solve(rows: np.ndarray, k: int, lower_rep: float) -> np.ndarray:
    """Parameters of one resample. rows: fits, 1/in, 1/out (scaled), weight."""
    if len(rows) * len(subsets(k)) < 3 * k + 1:
        return np.full(3 * k, np.nan)
    gram, target = normal_equations(rows[:, :k], rows[:, k : 2 * k], rows[:, 2 * k : 3 * k], rows[:, 3 * k])
    return bounded_least_squares(gram, target, np.r_[np.ones(2 * k), np.full(k, lower_rep)])


def fit(df: DataFrame, reps: Sequence[int], fitness_normalise: bool, fitness_error_model: bool, n_bootstraps: int = 100, max_n: int = 10_000, lower_rep: float = 1e-4, seed: int = 1234567) -> tuple[ErrorModel | None, NormModel | None]:
    """Both models, or neither if the error model is off. df: counts, WT, and Nham_nt or Nham_aa."""
    if not fitness_error_model:
        return None, None
    spark = df.sparkSession
    k = len(reps)
    by = "Nham_nt" if "Nham_nt" in df.columns else "Nham_aa"
    names = estimates.count_names(reps)
    work = df.select("nt_seq", "merge_seq", by, F.coalesce("WT", F.lit(False)).alias("WT"), *names) if "merge_seq" in df.columns else df.select("nt_seq", F.col("nt_seq").alias("merge_seq"), by, F.coalesce("WT", F.lit(False)).alias("WT"), *names)
    work = work.withColumn("all_reads", F.coalesce(estimates.all_reads(reps), F.lit(False)))
    least = input_threshold(df, reps).first()[0]
    wt = work.where("WT and all_reads").agg(*[F.first(c).cast("double").alias(c) for c in names]).first().asDict()
    if least is None or any(v is None for v in wt.values()):
        raise RuntimeError("the wildtype has no reads in some input or output replicate; the error model needs them")
    centre = {e: math.log(wt[f"count_e{e}_s1"] / wt[f"count_e{e}_s0"]) for e in reps}
    work = work.withColumns({f"fitness{e}": estimates.log_ratio(e) - F.lit(centre[e]) for e in reps})
    usable = F.col("all_reads") & estimates.inputs_above(reps, least)
    n_usable = work.where(usable & ~F.col("WT")).count()
    if n_usable < 30 * k:
        raise RuntimeError(f"too few variants to fit the error model: {n_usable} of {30 * k}")
    norm = fit_normalisation(work.where(usable), reps)
    scale = norm.scale if fitness_normalise else dict.fromkeys(reps, 1.0)
    # the wildtype's fitness is 0 in every replicate, so its normalised mean is that of shift and scale alone
    middle = sum(norm.shift[e] * norm.scale[e] for e in reps) / k if fitness_normalise else 0.0
    fits = [(F.col(f"fitness{e}") + F.lit(norm.shift[e])) * F.lit(norm.scale[e]) - F.lit(middle) if fitness_normalise else F.col(f"fitness{e}") for e in reps]
    errors = [estimates.poisson_error(e, wt[f"count_e{e}_s0"], wt[f"count_e{e}_s1"], scale[e]) for e in reps]
    rows = diversity_weight(work, by).where(usable & ~F.col("WT"))
    mean_error = estimates.row_mean(errors)
    weight = 1 / (mean_error * mean_error * F.col("error_model_weighting"))
    columns = [*fits, *(F.lit(scale[e]) / estimates.s0(e) for e in reps), *(F.lit(scale[e]) / estimates.s1(e) for e in reps), weight]
    seeds = np.random.default_rng(seed).integers(0, 2**31, size=n_bootstraps).tolist()
    ship(spark)
    if n_usable <= POOL_ROWS:
        pool = spark.sparkContext.broadcast(_values(columns, rows.orderBy("merge_seq", "nt_seq")))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"p": [solve(pool.value[drawn(n_usable, s, max_n)], k, lower_rep).tolist() for s in batch["seed"]]})

        tasks = max(1, min(n_bootstraps, spark.sparkContext.defaultParallelism))
        found = spark.createDataFrame([(int(s),) for s in seeds], "seed long").repartition(tasks).mapInPandas(run, "p array<double>").collect()
    else:
        found = resampled(rows.select("merge_seq", "nt_seq", F.array(*[c.cast("double") for c in columns]).alias("row")), n_usable, seeds, k, max_n, lower_rep)
    return ErrorModel(summarise(np.array([r.p for r in found], float), reps)), norm


def resampled(rows: DataFrame, n: int, seeds: list[int], k: int, most: int, lower_rep: float) -> list[Row]:
    """p: the parameters of each resample of a large table of (merge_seq, nt_seq, row)."""
    spark = rows.sparkSession

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch["seed"]:
                numbers = drawn(n, int(s), most)
                yield pd.DataFrame({"seed": s, "number": numbers, "place": np.arange(len(numbers))})

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p": [solve(np.stack(rows.sort_values("place")["row"].to_numpy()), k, lower_rep).tolist()]})

    # rows are numbered in their order: within sorted partitions, and from where each partition begins
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "merge_seq", "nt_seq").sortWithinPartitions("merge_seq", "nt_seq")
    placed = ordered.withColumns({"part": F.spark_partition_id(), "within": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).persist(StorageLevel.DISK_ONLY)
    begins = placed.groupBy("part").agg(F.count("*").alias("c")).withColumn("first", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = placed.join(F.broadcast(begins), "part").select("row", (F.coalesce("first", F.lit(0)) + F.col("within")).alias("number"))
    wanted = spark.createDataFrame([(int(s),) for s in seeds], "seed long").repartition(len(seeds)).mapInPandas(draw, "seed long, number long, place long")
    found = wanted.join(numbered, "number").groupBy("seed").applyInPandas(fitted, "p array<double>").collect()
    placed.unpersist()
    return found


def summarise(params: np.ndarray, reps: Sequence[int]) -> list[dict]:
    """Mean and the tenth and ninetieth percentile of each parameter over bootstraps."""
    k = len(reps)
    good = int((~np.isnan(params[:, 0])).sum())
    out = []
    for i in range(3 * k):
        column = params[:, i][~np.isnan(params[:, i])]
        low, high = np.percentile(column, [10, 90]) if len(column) else (np.nan, np.nan)
        out.append({"parameter": ("input", "output", "reperror")[i // k], "rep": reps[i % k], "mean_value": float(column.mean()) if len(column) else np.nan, "CI90_lower": float(low), "CI90_upper": float(high), "ensemble": good})
    return out
