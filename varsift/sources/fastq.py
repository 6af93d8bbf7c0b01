"""FASTQ as a Python data source: plain or gzip, single files or pairs read in lockstep.

A file (or a pair) is one partition, as gzip can't be split and pairs go by position; repartition after reading. A
truncated last record ends the file; mates of unequal numbers of records are an error.

    spark.read.format("varsift_fastq").option("path", "a.fastq.gz").option("mate", "b.fastq.gz").load()

Several files: `path` and `mate` may hold comma-separated lists.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varsift.shipping import ship

SINGLE = "file string, read_id long, header string, seq string, qual string"
PAIR = "file string, read_id long, header string, seq1 string, qual1 string, header2 string, seq2 string, qual2 string"


class _File(InputPartition):
    def __init__(self, path: str, mate: str | None):
        self.path, self.mate = path, mate


def records(path: str) -> Iterator[tuple[str, str, str]]:
    """Header, sequence and quality of each whole record."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    with files.open_input_stream(name, compression=None) as raw:
        # line by line, whatever the size of the file
        whole = gzip.open(raw, "rt") if path.endswith(".gz") else io.TextIOWrapper(io.BufferedReader(raw, 1 << 20))
        lines = (line.rstrip("\r\n") for line in whole)
        while True:
            header, seq, plus, qual = (next(lines, None) for _ in range(4))
            if not header or qual is None:
                return
            yield header, seq, qual


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.mates = [p for p in options.get("mate", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        if self.mates and len(self.mates) != len(self.paths):
            raise ValueError(f"{len(self.paths)} files and {len(self.mates)} mates")
        return [_File(a, b) for a, b in zip_longest(self.paths, self.mates)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.mate is None:
            for i, record in enumerate(records(partition.path)):
                yield (partition.path, i, *record)
        else:
            for i, (a, b) in enumerate(zip_longest(records(partition.path), records(partition.mate))):
                if a is None or b is None:
                    raise ValueError(f"{partition.path} and {partition.mate} have unequal numbers of records: one ends after {i}")
                yield (partition.path, i, *a, *b)


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "varsift_fastq"

    def schema(self) -> str:
        return PAIR if self.options.get("mate") else SINGLE

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, paths: list[str], mates: list[str] | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Fastq)
    reader = spark.read.format("varsift_fastq").option("path", ",".join(paths))
    return (reader.option("mate", ",".join(mates)) if mates else reader).load()


def write_fastq(df: DataFrame, path: str, header: str = "header", seq: str = "seq", qual: str = "qual") -> None:
    """Gzip FASTQ: a folder with a file for each partition."""
    from pyspark.sql import functions as F

    df.select(F.concat_ws("\n", F.col(header), F.col(seq), F.lit("+"), F.col(qual)).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
