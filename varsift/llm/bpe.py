"""Byte-level BPE encoding and decoding (operator 9).

Pieces come from the vectorised pre-tokeniser (see pretokens); each distinct piece is merged once per Python worker
and kept in a bounded cache. Ids keep the byte offsets of their tokens, so any run of ids decodes to its own place in
the text. Texts longer than a portion are split where a piece begins in any case, so work space stays bounded.

Defined cases: a null or empty text has no ids, no offsets and decodes to no bytes; a text is encoded whole, however long; repeated rows give repeated
results; a null doc_id is carried; extra columns are ignored; an empty table gives an empty result; bytes that are not
UTF-8 count as U+FFFD, as in the tokenizer library.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common, pretokens
from varsift.llm.piece_cache import PieceCache, runs


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always join the adjacent pair of lowest rank, the leftmost among equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    never = 1 << 62
    pair = [ranks.get(a + b, never) for a, b in zip(parts, parts[1:])]
    while pair and (best := min(pair)) < never:
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], never)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, by a heap over a linked list: n log n."""
    import heapq

    n = len(parts)
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or parts[i] != left or parts[j] != right:
            continue
        parts[i], alive[j], after[i] = left + right, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [ranks[p] for p, kept in zip(parts, alive) if kept]


def resolver(ranks: dict[bytes, int]):
    """The ids of a list of pieces as one array, and how many each has."""

    def resolve(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [merge(p, ranks) for p in pieces]
        return np.array([*chain.from_iterable(found)], np.uint32), np.array([*map(len, found)], np.int32)

    return resolve


class Decoder:
    """Bytes of id sequences, gathered from one table."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for word, i in ranks.items():
            words[i] = word
        self.widths = np.array([len(w) for w in words], np.int64)
        self.starts = np.r_[0, np.cumsum(self.widths)][:-1]
        self.table = np.frombuffer(b"".join(words), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.widths[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        parts = (ids[a : a + (1 << 18)] for a in range(0, len(ids), 1 << 18))
        return b"".join(self.table[runs(self.starts[x], self.widths[x])].tobytes() for x in parts)


@lru_cache(2)
def _worker(path: str) -> tuple[PieceCache, Decoder]:
    ranks = read_ranks(path)
    return PieceCache(resolver(ranks)), Decoder(ranks)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("offsets", T.ArrayType(T.IntegerType(), False)),
    ]
)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and for each id the byte offset in the text at which its token ends."""
    return _run(docs, ranks_path, id_col, text_col, False)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and, in the same pass, the bytes that decoding the ids gives."""
    return _run(docs, ranks_path, id_col, text_col, True)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    ranges = pretokens.rank_library_classes()
    schema = T.StructType(SCHEMA.fields + [T.StructField("decoded", T.BinaryType())] * decoded)
    to = common.arrow_schema(schema)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        cache, decoder = _worker(path)
        texts = common.text_bytes(rows.column(1))
        ids, ends = pretokens.encode(texts, ranges, cache)
        last = decoder.ends(ids)
        firsts = np.r_[0, last][ends]
        offsets = (last - np.repeat(firsts[:-1], np.diff(ends))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, offsets)]
        back = [pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(firsts.astype(np.int32)), pa.py_buffer(decoder.decode(ids))])] * decoded
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([rows.column(0), *lists, *back], to)], schema=to)

    return common.map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", batch, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes of its ids."""
    schema = T.StructType([SCHEMA["doc_id"], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for rows in batches:
            decoder = _worker(ranks_path)[1]
            back = [decoder.decode(np.array(x or [], np.int64)) for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    return common.map_arrow(encoded.select("doc_id", "ids"), run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the round trip of every document."""
    import public_tokenizers

    done = round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
