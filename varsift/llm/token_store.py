"""Token ids as binary shards with Elias-Fano document boundaries (operator 2).

A shard holds the ids of consecutive documents, one after the other, and the cumulative ends of the documents as an
Elias-Fano sequence: the low bits of each end are packed, the high bits are written in unary, and a sample of set-bit
positions lets select find the i-th end, or a run of ends, in a short scan. n ends below u take about
n * (2 + log2(u / n)) bits, with no table of 64-bit offsets; readers go by select too. The ascending doc_ids are a
second such sequence, and of null ones only the number is kept.

Documents are dealt out by ranges of (doc_id, hash of the text), so a doc_id that many rows share is spread as well.
Every task writes its shards under names of its own attempt and reports them; the manifest, a table in the shared
folder, lists only what successful attempts reported. A task that is run again after a lost executor therefore never
doubles or damages a shard.

Defined cases: a null text is an empty one and has the end id alone; null doc_ids come first; rows with equal doc_id
are in the order of their texts' hashes and texts; a text is encoded whole, however long; an empty table gives no shards and an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common, piece_cache, pretokens

#: New pieces that go to the library in one call.
JOINED = 4096
MAGIC = b"VSTOKEN2"
#: A select sample for so many ends.
SAMPLE = 256
#: A shard is closed at so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 22, 1 << 17
#: Documents that are read from a shard at once.
READ_DOCS = 1 << 12


class EliasFano:
    """A non-decreasing sequence of n integers up to `top`, in near-minimal space, with select."""

    def __init__(self, n: int, top: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low, self.high, self.samples = n, top, low, high, samples
        self.width = self.low_width(n, top)

    @staticmethod
    def low_width(n: int, top: int) -> int:
        return max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = cls.low_width(n, top)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = ((values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        high = np.zeros(n + (top >> width) + 1, np.uint8)
        high[ones] = 1
        return cls(n, top, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, a: int, b: int) -> np.ndarray:
        """Low bits of the values a to b."""
        if not self.width:
            return np.zeros(b - a, np.uint64)
        at = np.arange(a, b)[:, None] * self.width + np.arange(self.width)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, a: int, b: int | None = None) -> np.ndarray:
        """The values a to b (one, if no b is given), from the sample before them and a scan of the bits up to the
        sample behind them; no other value is touched."""
        b = a + 1 if b is None else b
        if a >= b:
            return np.empty(0, np.uint64)
        byte = int(self.samples[a // SAMPLE]) >> 3
        behind = (b - 1) // SAMPLE + 1
        last = (int(self.samples[behind]) >> 3) + 1 if behind < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:last], bitorder="little")) + byte * 8
        skip = int(np.searchsorted(ones, self.samples[a // SAMPLE])) + a % SAMPLE
        ones = ones[skip : skip + b - a]
        return ((ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.width)) | self._low(a, b)

    def parts(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]


def pack_shard(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    """Header, doc_ids and ends as Elias-Fano sequences, ids in 16 or 32 bits. doc_ids ascend, nulls first."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    first = known[:1].view(np.uint64)
    named, ends = EliasFano.encode(known.view(np.uint64) - (first if len(first) else np.uint64(0))), EliasFano.encode(ends)
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    parts = [*named.parts(), *ends.parts(), ids.astype("<u2" if wide == 2 else "<u4").tobytes()]
    header = np.array([len(doc_ids), len(known), int(first[0]) if len(first) else 0, named.top, ends.top, wide, *map(len, parts)], "<u8").tobytes()
    return MAGIC + header + b"".join(parts)


class Shard:
    """A shard read back."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n, known, self.first, top_id, top_end, wide, *sizes = np.frombuffer(data, "<u8", 13, 8).tolist()
        at, parts = 8 + 13 * 8, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        low, high, samples = (lambda p: np.frombuffer(p, np.uint8)), (lambda p: np.frombuffer(p, np.uint8)), (lambda p: np.frombuffer(p, "<u4"))
        self.nulls = self.n - known
        self.named = EliasFano(known, top_id, low(parts[0]), high(parts[1]), samples(parts[2]))
        self.ends = EliasFano(self.n, top_end, low(parts[3]), high(parts[4]), samples(parts[5]))
        self.ids = np.frombuffer(parts[6], "<u2" if wide == 2 else "<u4")

    def doc_ids(self, a: int, b: int) -> pa.Array:
        """doc_ids of the documents a to b."""
        none = max(0, min(b, self.nulls) - a)
        known = self.named.select(max(0, a - self.nulls), max(0, b - self.nulls)) + np.uint64(self.first)
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(known.view(np.int64), pa.int64())])

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where the documents a to b begin, and where the last of them ends."""
        found = self.ends.select(max(0, a - 1), b).astype(np.int64)
        return found if a else np.r_[0, found]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        a, b = self.bounds(i, i + 1)
        return self.ids[a:b]


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Library:
    """The tokenizers library behind a cache of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a line feed between two pieces without white space at their ends is a piece of its own
        self.line_feed = self.encode("\n")
        self.cache = piece_cache.PieceCache(self.resolve)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def resolve(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and the number of each one's: many to a call of the library, with line feeds between."""
        found: list[np.ndarray | None] = [None] * len(pieces)
        texts = [p.decode() for p in pieces]
        some = [i for i, t in enumerate(texts) if not t.isspace()] if len(self.line_feed) == 1 else []
        for a in range(0, len(some), JOINED):
            part = some[a : a + JOINED]
            ids = np.array(self.encode("\n".join(texts[i] for i in part)), np.uint32)
            ends = np.r_[np.flatnonzero(ids == self.line_feed[0]), len(ids)]
            if len(ends) != len(part):  # then each piece by itself
                continue
            for i, x, y in zip(part, np.r_[0, ends[:-1] + 1].tolist(), ends.tolist()):
                found[i] = ids[x:y]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        return np.concatenate([*found, np.empty(0, np.uint32)]), np.array([len(x) for x in found], np.int32)


@lru_cache(2)
def _library(path: str) -> Library:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Library(path)


def encode_texts(texts: list[bytes], path: str, ranges) -> list[np.ndarray]:
    """Ids of each text. A text with a special token's string goes to the library whole."""
    library = _library(path)
    ids, ends = pretokens.encode(texts, ranges, library.cache)
    out = [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
    for i, t in enumerate(texts):
        if any(special in t for special in library.special):
            out[i] = np.array(library.encode(t.decode("utf-8", "replace")), np.uint32)
    return out


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"
READ = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode and write all documents in ascending order of id; the path of the manifest."""
    spark = docs.sparkSession
    ranges = pretokens.rank_library_classes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        files, base = _files(folder)
        held: list[tuple[int | None, np.ndarray]] = []
        size = seq = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([y for _, x in held for y in (x, end)])
            ends = np.cumsum([len(x) + 1 for _, x in held])
            name = f"{base}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tokens"
            with files.open_output_stream(name) as out:
                out.write(pack_shard([i for i, _ in held], ends, ids))
            row = [part, seq, folder + name[len(base) :], len(held), len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "seq", "path", "n_docs", "n_tokens"])

        files.create_dir(base, recursive=True)
        for batch in batches:
            for rows in common.slices(batch, "text"):
                for i, ids in zip(rows.column(0).to_pylist(), encode_texts(common.text_bytes(rows.column(1)), tokenizer_path, ranges)):
                    held.append((i, ids))
                    size += len(ids) + 1
                    if size >= SHARD_IDS or len(held) >= SHARD_DOCS:
                        yield flush()
                        held.clear()
                        size, seq = 0, seq + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    manifest = f"{folder}/manifest"
    common.map_arrow(dealt, write, MANIFEST).write.parquet(manifest)
    return manifest


def read_tokens(spark: SparkSession, manifest: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, the crc32 of the ids as little-endian 32-bit integers,
    and on request the ids, of every document of a written store."""
    schema = T.StructType([*READ.fields, *[IDS] * ids])
    to = common.arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, name = _files(row["path"])
                with files.open_input_stream(name) as data:
                    shard = Shard(data.read())
                for a in range(0, shard.n, READ_DOCS):
                    b = min(a + READ_DOCS, shard.n)
                    bounds = shard.bounds(a, b)
                    part = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    own = bounds - bounds[0]
                    sums = [zlib.crc32(part[x:y]) for x, y in zip(own, own[1:])]
                    columns = [shard.doc_ids(a, b), pa.array(row["base"] + bounds[:-1]), pa.array(np.diff(own)), pa.array(sums, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(part.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, to)], schema=to)

    # running sums in two steps: within the parts, and over one row for each part
    shards = spark.read.parquet(manifest)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before("part")), F.lit(0)).alias("first"))
    placed = shards.join(parts, "part").select("path", (F.col("first") + F.coalesce(F.sum("n_tokens").over(before("part", "seq")), F.lit(0))).alias("base"))
    spread = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return common.map_arrow(spread, read, schema)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, read them back, and digest them."""
    import public_tokenizers

    manifest = write_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), common.scratch(spark, "tokens"), end_id=2)
    return read_tokens(spark, manifest, ids=False)
