"""Places of regular expressions in a text, with built-in functions alone.

split() and regexp_extract_all() scan alike, so the k-th match starts after the first k + 1 pieces and the first k
matches. Running sums over the matches are taken in two levels (chunks of CHUNK), which keeps the cost of growing
arrays far below the square of the number of matches in very long texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def find(df: DataFrame, text: str, out: str, pattern: str, kind: int, keep: Callable[[Column], Column]) -> DataFrame:
    """Add column `out`: spans (start, kind, end; code points, end exclusive) of the matches that keep() accepts.

    Matches are leftmost and don't overlap; those that keep() refuses still use up their text.
    """
    t = F.col(text)
    has = t.rlike(pattern)
    none = F.array().cast("array<struct<n:bigint,gap:bigint,ok:boolean>>")
    steps = F.zip_with(
        F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
        F.slice(F.split(t, pattern, -1), F.lit(2), F.lit(2**31 - 2)),
        lambda m, p: F.struct(F.length(m).cast("long").alias("n"), F.length(p).cast("long").alias("gap"), keep(m).alias("ok")),
    )
    df = df.withColumns({f"{out}_steps": F.when(has, steps).otherwise(none), f"{out}_head": F.when(has, F.length(F.get(F.split(t, pattern, 2), F.lit(0))).cast("long"))})
    steps, head = F.col(f"{out}_steps"), F.col(f"{out}_head")
    empty = F.array().cast(f"array<{SPAN}>")

    def one(state: Column, step: Column) -> Column:
        span = F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), (state["at"] + step["n"]).alias("end"))
        return F.struct((state["at"] + step["n"] + step["gap"]).alias("at"), F.when(step["ok"], F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def chunk(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("out")), one)
        length = F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["n"] + x["gap"])
        return F.struct((state["at"] + length).alias("at"), F.concat(state["out"], F.array(inner["out"])).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))
    found = F.flatten(F.aggregate(chunks, F.struct(head.alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), chunk)["out"])
    return df.withColumn(out, F.when(F.size(steps) > 0, found).otherwise(empty)).drop(f"{out}_steps", f"{out}_head")


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
