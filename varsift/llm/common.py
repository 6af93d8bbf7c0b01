"""Helpers shared by the corpus operators: the cluster's shared folder and Arrow batch plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.shipping import ship
from varsift.sources.files import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *done: DataFrame | None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor can reread it.

    done: stored tables that df was the last to need; they are removed.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    for table in done:
        discard(table)
    found = spark.read.schema(df.schema).parquet(path)
    _stored[found] = path
    return found


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write df to the shared folder in buckets by a column and read it back: joins by that column move the other side
    alone. There are as many buckets as shuffle partitions, so rows that a shuffle by the column brings are written as
    they come, a file for each bucket. The table is named in the session's catalog for a moment only."""
    spark = df.sparkSession
    table, path = f"varsift_{name}_{uuid.uuid4().hex}", scratch(spark, name)
    df.write.format("parquet").bucketBy(parts(spark), column).option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.columns  # resolved for good: the name goes, the files stay
    spark.sql(f"drop table {table}")
    _stored[found] = path
    return found


_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(table: DataFrame | None) -> None:
    """Remove the files of a stored table; anything else stays as it is."""
    path = _stored.pop(table, None) if table is not None else None
    if path:
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def on_disk(df: DataFrame) -> DataFrame:
    """df, kept on the executors' disks from its first use on. What a lost executor held is made anew from its lineage,
    so df must give the same rows each time. For small tables that are used again soon; the caller unpersists them."""
    return df.persist(StorageLevel.DISK_ONLY)


def parts(spark: SparkSession, share: int = 1) -> int:
    """The session's number of shuffle partitions, or for smaller tables a share of it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)


def others(df: DataFrame, results: list[str]) -> list[str]:
    """The columns of df whose names no result takes."""
    taken = {c.lower() for c in results}
    return [c for c in df.columns if c.lower() not in taken]


def lower_az(column):
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is an empty one."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text each, so that work arrays stay small."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """mapInArrow over bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield fn(part)

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with the package at hand. The session bounds the rows and the bytes of a batch; see small_batches().

    Workers live on between tasks, so each task gives back what it no longer needs.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return free memory to the system: Arrow's pool and, where the C library can, its heap."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the bytes of this session's Arrow batches, which both the executor and its Python workers hold: Spark's 64 MB
    a task are much where memory is scarce. For applications (the queries and the pipeline); the operators leave the
    session as it is."""
    spark.conf.set(BATCH_BYTES, most)


def give_back_heap(spark: SparkSession) -> None:
    """Have the executors' JVMs collect all garbage, after which they return free heap to the system. By themselves they
    keep whatever an earlier stage touched, and the Python workers of the next one need memory beside it.

    Tasks are dealt to idle executors in turn, so one for each core reaches all. For moments between steps that write whole
    tables; where explicit collections are turned off, nothing happens.
    """
    context = spark.sparkContext
    tasks = max(context.defaultParallelism, context._jsc.sc().getExecutorMemoryStatus().size())
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc')").collect()


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
