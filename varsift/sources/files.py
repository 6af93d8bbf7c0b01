"""Files in any file system that Spark reads: local paths by pathlib, others (s3a://, hdfs://) by the session's Hadoop.

Tables always go through Spark; this is for the small files beside them, and for listing and joining parts.
"""

from __future__ import annotations

import fnmatch
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):/(?!/)")


def locate(path: Path | Location | str) -> Path | Location:
    """A pathlib path for a local one, a Location for a URI."""
    if isinstance(path, Path | Location):
        return path
    text = _URI.sub(r"\1:///", str(path), count=1) if _URI.match(str(path)) else str(path)
    return Location(text) if "://" in text else Path(text)


def uri(path: Path | Location | str) -> str:
    """What Spark is to be given: plain paths belong to its default file system."""
    path = locate(path)
    return str(path) if isinstance(path, Location) else str(path.resolve())


def _hadoop(path: Path | Location | str):
    """The JVM's path and its file system."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active session to reach the file system by")
    at = spark._jvm.org.apache.hadoop.fs.Path(uri(path))
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def files_below(folder: Path | Location | str) -> list[str]:
    """Full paths of a folder's files by name, without those that begin with an underscore or a dot."""
    at, system = _hadoop(folder)
    found = [s.getPath() for s in system.listStatus(at) if s.isFile()]
    return sorted(p.toUri().getPath() if p.toUri().getScheme() == "file" else p.toString() for p in found if p.getName()[0] not in "_.")


def concatenate(folder: Path | Location | str, target: Path | Location | str, head: str) -> None:
    """Join a folder's files in the order of their names behind a head, byte by byte through bounded buffers, and remove
    the folder; files without any bytes give a target without a head."""
    at, system = _hadoop(folder)
    to, _ = _hadoop(target)
    spark = SparkSession.getActiveSession()
    parts = sorted((s.getPath() for s in system.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    out = system.create(to, True)
    if parts:
        out.write(bytearray(head.encode()))
    for part in parts:
        source = system.open(part)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, spark._jsc.hadoopConfiguration(), False)
        source.close()
    out.close()
    system.delete(at, True)


def head(path: Path | Location | str, most: int = 1 << 14) -> bytes:
    """The first bytes of a file, or of a folder's first file that has any."""
    at, system = _hadoop(path)
    if system.getFileStatus(at).isDirectory():
        found = [s.getPath() for s in system.listStatus(at) if s.getPath().getName()[0] not in "_." and s.getLen()]
        if not found:
            return b""
        at = min(found, key=lambda p: p.getName())
    source = system.open(at)
    try:
        return bytes(source.readNBytes(most))
    finally:
        source.close()


def remove(path: Path | Location | str) -> None:
    at, system = _hadoop(path)
    system.delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if driver and
    executors are one process, and else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and re.fullmatch(r"local(\[[^,\]]*\])?", spark.sparkContext.master):
        found = tempfile.mkdtemp(prefix="varsift-")
        spark.conf.set("spark.checkpoint.dir", found)
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/varsift/{name}-{uuid.uuid4().hex}"


class Location:
    """A URI with those methods of pathlib that runs use."""

    def __init__(self, text: str):
        self.text = str(text).rstrip("/")

    def __str__(self) -> str:
        return self.text

    __repr__ = __str__
    __fspath__ = None  # not for open()

    def __truediv__(self, name: str) -> Location:
        return Location(f"{self.text}/{name}")

    def __eq__(self, other) -> bool:
        return isinstance(other, Location) and other.text == self.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __lt__(self, other: Location) -> bool:
        return self.text < other.text

    @property
    def name(self) -> str:
        return self.text.rsplit("/", 1)[1]

    @property
    def stem(self) -> str:
        return self.name.rsplit(".", 1)[0]

    @property
    def parent(self) -> Location:
        return Location(self.text.rsplit("/", 1)[0])

    def with_suffix(self, suffix: str) -> Location:
        return self.parent / (self.stem + suffix)

    def exists(self) -> bool:
        at, system = _hadoop(self)
        return system.exists(at)

    def is_dir(self) -> bool:
        at, system = _hadoop(self)
        return system.exists(at) and system.getFileStatus(at).isDirectory()

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:
        at, system = _hadoop(self)
        system.mkdirs(at)

    def glob(self, pattern: str) -> list[Location]:
        at, system = _hadoop(self)
        if not system.exists(at):
            return []
        return [self / s.getPath().getName() for s in system.listStatus(at) if fnmatch.fnmatch(s.getPath().getName(), pattern)]

    def read_bytes(self) -> bytes:
        at, system = _hadoop(self)
        source = system.open(at)
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()

    def read_text(self) -> str:
        return self.read_bytes().decode()

    def write_text(self, text: str) -> None:
        at, system = _hadoop(self)
        out = system.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
