"""Report data as DataFrames, and a self-contained HTML page of tables and bars."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence
from datetime import date
from pathlib import Path
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.functions import estimates
from varsift.plans.config import RunConfig

# Rows of the statistics table, in order.
ROWS = ["0 substitutions", "1 substitution", "2 substitutions", "3+ substitutions", "Indels (discarded)", "Mixed codon", "Too many subs", "Not permitted", "Constant region", "Invalid barcode"]
FATES = {"indel": ROWS[4], "mixed_substitutions": ROWS[5], "too_many_substitutions": ROWS[6], "permitted": ROWS[7], "constant_region": ROWS[8], "nobarcode": ROWS[9]}


def short_name(column: str) -> str:
    """count_e1_s0 -> e1_in."""
    return column.replace("count_", "").replace("_s0", "_in").replace("_s1", "_out")


def stats_table(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """category and reads of each sample; categories without reads are left out, three changes and more are one."""
    nham = F.col("nham")
    subst = F.when(nham == 0, ROWS[0]).when(nham == 1, ROWS[1]).when(nham == 2, ROWS[2]).otherwise(ROWS[3])
    fate = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in FATES.items()])
    rows = stats.withColumn("row", F.when((F.col("category") == "nuc_subst") & nham.isNotNull(), subst).otherwise(fate)).where("row is not null")
    wide = rows.groupBy("row").pivot("sample", list(columns)).agg(F.sum("reads")).na.fill(0)
    place = F.array_position(F.array(*map(F.lit, ROWS)), F.col("row"))
    return wide.where(sum((F.col(c) for c in columns), F.lit(0)) > 0).orderBy(place).withColumnsRenamed({c: short_name(c) for c in columns})


def processing_shares(stats: DataFrame) -> DataFrame:
    """Reads and share of each category within each sample."""
    rows = stats.where("category not in ('aa_subst', 'retained')").groupBy("sample", "category", "nham").agg(F.sum("reads").cast("bigint").alias("reads"))
    total = F.sum("reads").over(Window.partitionBy("sample"))
    return rows.withColumn("share", F.when(total > 0, F.col("reads") / total))


def count_histogram(df: DataFrame, column: str, bins: int = 40, top: float = 8.0) -> DataFrame:
    """Density of log10(count + 1) by number of changes (three and more as three)."""
    value = F.log10(F.coalesce(F.col(column), F.lit(0)) + 1.0)
    rows = df.where("Nham_nt is not null").select(F.least(F.col("Nham_nt"), F.lit(3)).alias("nham"), F.width_bucket(value, F.lit(0.0), F.lit(top), F.lit(bins)).alias("bin"))
    counted = rows.groupBy("nham", "bin").agg(F.count("*").alias("n"))
    return counted.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy("nham")) / F.lit(top / bins))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """Points on a grid between the least and largest values, which one pass finds beforehand."""
    good = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    b = good.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if b[0] is None:
        return good.groupBy(F.lit(0).alias("bin_x"), F.lit(0).alias("bin_y")).agg(F.count("*").alias("n"))
    cell = lambda c, lo, hi: F.width_bucket(F.col(c).cast("double"), F.lit(float(lo)), F.lit(float(hi if hi > lo else lo + 1)), F.lit(bins))
    return good.groupBy(cell(x, b[0], b[1]).alias("bin_x"), cell(y, b[2], b[3]).alias("bin_y")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, all in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("p")).select("p.*")


def z_scores(df: DataFrame, reps: Sequence[int]) -> DataFrame:
    """Long leave-one-out z-scores of all replicates."""
    cells = F.array(*[F.struct(F.lit(e).alias("rep"), estimates.leave_one_out(reps, e).alias("z")) for e in reps])
    return df.select("nt_seq", F.explode(cells).alias("c")).select("nt_seq", "c.rep", "c.z").where("z is not null")


def qq_points(df: DataFrame, reps: Sequence[int], points: int = 400) -> DataFrame:
    """Quantiles of the z-scores, clipped to ten, against those of the normal distribution, at evenly spaced places."""
    shares = [(i - 0.5) / points for i in range(1, points + 1)]
    cut = F.least(F.greatest(F.col("z"), F.lit(-10.0)), F.lit(10.0))
    by = z_scores(df, reps).groupBy("rep").agg(F.percentile(cut, F.array(*map(F.lit, shares))).alias("q"))
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in shares])
    return by.select("rep", F.posexplode("q").alias("i", "z"), normal.alias("normal")).select("rep", F.get("normal", F.col("i")).alias("expected"), "z")


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: inverse(x) if 0 < x < 1 else None)


def trim_shares(stats: DataFrame) -> DataFrame:
    return stats.withColumn("filtered", F.greatest(F.col("total_reads") - F.col("pairs_written"), F.lit(0)))


def _table(df: DataFrame, title: str) -> str:
    """All rows of a table that has a row for each sample, category or bin."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    cell = lambda v: f"{v:,}" if isinstance(v, int) else f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(cell(v))}</td>" for v in r) + "</tr>" for r in df.collect())
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def _scatter(df: DataFrame, x: str, y: str, title: str) -> str:
    rows = [(float(r[x]), float(r[y])) for r in df.select(x, y).collect()]
    if not rows:
        return ""
    lo, hi = min(min(r) for r in rows), max(max(r) for r in rows)
    at = lambda v: 10 + 280 * (v - lo) / ((hi - lo) or 1)
    dots = "".join(f'<circle cx="{at(a):.1f}" cy="{300 - at(b):.1f}" r="1.5"/>' for a, b in rows)
    return f'<h3>{html.escape(title)}</h3><svg width="300" height="300"><line x1="10" y1="290" x2="290" y2="10" stroke="#999"/>{dots}</svg>'


WIDTH, HEIGHT = 460, 220
COLOURS = ["#4878a8", "#e08a3c", "#5a9e6f", "#c25450", "#8a6fb0", "#8c6d5b", "#cf86b8", "#7f7f7f", "#b5b03a", "#3fa9b5"]


def _figure(title: str, body: str, names: Sequence[str] = ()) -> str:
    """An SVG with a title and a line of names in their colours."""
    keys = "".join(f'<tspan fill="{COLOURS[i % len(COLOURS)]}" dx="8">{html.escape(str(n))}</tspan>' for i, n in enumerate(names))
    return f'<h3>{html.escape(title)}</h3><svg width="{WIDTH}" height="{HEIGHT + 30}"><text x="4" y="{HEIGHT + 22}" font-size="11">{keys}</text>{body}</svg>'


def stacked_bars(cells: Sequence[tuple[str, str, float]], title: str) -> str:
    """A bar for each group of (group, part, value), its parts on top of each other."""
    groups, parts = list(dict.fromkeys(c[0] for c in cells)), list(dict.fromkeys(c[1] for c in cells))
    top = max((sum(v for g, _, v in cells if g == group) for group in groups), default=0) or 1
    wide = WIDTH / max(1, len(groups))
    body = ""
    for i, group in enumerate(groups):
        at = HEIGHT - 14.0
        for g, part, value in cells:
            if g == group:
                tall = (HEIGHT - 20) * value / top
                at -= tall
                body += f'<rect x="{i * wide + 2:.1f}" y="{at:.1f}" width="{wide - 4:.1f}" height="{tall:.1f}" fill="{COLOURS[parts.index(part) % len(COLOURS)]}"/>'
        body += f'<text x="{i * wide + 3:.1f}" y="{HEIGHT - 2}" font-size="9">{html.escape(group)}</text>'
    return _figure(title, body, parts)


def step_lines(points: Sequence[tuple[str, float, float]], title: str) -> str:
    """A line for each name of (name, x, y)."""
    names = list(dict.fromkeys(p[0] for p in points))
    most_x, most_y = (max((p[k] for p in points), default=1) or 1 for k in (1, 2))
    body = ""
    for i, name in enumerate(names):
        dots = " ".join(f"{WIDTH * x / most_x:.1f},{HEIGHT - 14 - (HEIGHT - 20) * y / most_y:.1f}" for n, x, y in points if n == name)
        body += f'<polyline points="{dots}" fill="none" stroke="{COLOURS[i % len(COLOURS)]}"/>'
    return _figure(title, body, names)


def heat_grid(cells: Sequence[tuple[int, int, int]], title: str, bins: int = 40) -> str:
    """Squares at (column, row, number), darker with the logarithm of the number."""
    most = math.log1p(max((n for *_, n in cells), default=1))
    size = (HEIGHT - 14) / (bins + 1)
    squares = (f'<rect x="{(x - 1) * size:.1f}" y="{HEIGHT - 14 - y * size:.1f}" width="{size:.1f}" height="{size:.1f}" fill="#1f4e79" fill-opacity="{math.log1p(n) / most:.2f}"/>' for x, y, n in cells)
    return _figure(title, "".join(squares))


def _long(rows: DataFrame, group: str, parts: Sequence[str]) -> list[tuple[str, str, float]]:
    return [(str(r[group]), p, float(r[p] or 0)) for r in rows.collect() for p in parts]


def write_report(path: Path, config: RunConfig, stats: DataFrame, variants: DataFrame, fitness: DataFrame, reps: Sequence[int], columns: Sequence[str], reads: DataFrame | None = None, trimmed: DataFrame | None = None) -> None:
    """One page: settings, processing, counts, replicates, model fit, and reads where there are any."""
    parts = [f"<h1>{html.escape(config.project_name)}</h1><p>{date.today().isoformat()}</p>"]
    parts.append("<h2>Settings</h2><table>" + "".join(f"<tr><td>{k}</td><td>{html.escape(v)}</td></tr>" for k, v in config.settings()) + "</table>")
    parts.append(_table(stats_table(stats, columns), "Variants by category (reads)"))
    shares = processing_shares(stats).orderBy("sample", "category", "nham")
    parts.append(_table(shares, "Shares by category"))
    kind = lambda r: r.category if r.nham is None else f"{r.category} {r.nham}"
    parts.append(stacked_bars([(short_name(r["sample"]), kind(r), r.share or 0.0) for r in shares.collect()], "Shares by category"))
    for c in columns:
        bins = count_histogram(variants, c).orderBy("nham", "bin")
        parts += [_table(bins, f"Counts of {short_name(c)}"), step_lines([(f"{r.nham} changes", float(r.bin), r.density) for r in bins.collect()], f"Density of log counts of {short_name(c)}")]
    parts.append(_table(correlations(variants, list(columns)), "Correlation of counts"))
    for a, b in zip(columns, columns[1:]):
        parts.append(heat_grid([tuple(r) for r in density_grid(variants, a, b).collect()], f"{short_name(a)} against {short_name(b)}"))
    names = [f"fitness{e}_uncorr" for e in reps]
    if len(reps) > 1:
        parts.append(_table(correlations(fitness, names), "Correlation of fitness"))
        for a, b in zip(names, names[1:]):
            parts.append(heat_grid([tuple(r) for r in density_grid(fitness, a, b).collect()], f"{a.removesuffix('_uncorr')} against {b.removesuffix('_uncorr')}"))
        points = qq_points(fitness, reps).persist()
        parts += [_scatter(points.where(F.col("rep") == e), "expected", "z", f"Replicate {e}: z-scores against the normal distribution") for e in reps]
        points.unpersist()
    parts += [_table(df, title) for df, title in ((reads, "Read filters"), (None if trimmed is None else trim_shares(trimmed), "Trimming")) if df is not None]
    if reads is not None:
        parts.append(stacked_bars(_long(reads, "sample_name", [c for c in reads.columns if c not in ("sample_name", "Pairs")]), "Fates of reads"))
    if trimmed is not None:
        parts.append(stacked_bars(_long(trim_shares(trimmed), "sample_name", ["pairs_written", "filtered"]), "Trimmed pairs"))
    style = "<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px}</style>"
    path.write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'>{style}</head><body>{''.join(parts)}</body></html>")
