"""An extension: tallies over a stream of reads. A count table has no notion of late data, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varsift.sources import files


def streaming_tally(reads: DataFrame, sample: str = "sample_id", seq: str = "seq") -> DataFrame:
    return reads.groupBy(F.col(sample).alias("sample_id"), F.col(seq).alias("nt_seq")).agg(F.count("*").alias("count"))


def _versions(path: str) -> list[str]:
    """Folders of complete versions, the newest last."""
    found = sorted(str(p) for p in files.locate(path).glob("version=*"))
    return [p for p in found if (files.locate(p) / "_SUCCESS").exists()]


def start(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current tally below path. Each batch writes a version of its own, named by the batch, so a reader never
    meets half a table and a batch that is run again replaces its own attempt alone; only then older versions go, but
    for the one before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number:012d}")
        for old in _versions(path)[:-2]:
            files.remove(old)

    return streaming_tally(reads).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The tally of the last complete batch."""
    return spark.read.parquet(_versions(path)[-1])
