"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 8).

Fingerprints of 64 bits are eight positional bytes. Two of them that differ in at most three bits share at least five
positional bytes, and the three positions where they may differ lie in one block of the Steiner system S(3, 4, 8) (the
fourteen sets of four positions whose exclusive-or is zero). The block's complement is a block as well, and there the
two agree. So an index on (block, its four bytes) has every pair to be found in one of its posting lists, with fourteen
postings a distinct fingerprint instead of lists for single bytes, each of which would hold a 256th of everything.

Within a posting list the shared positional bytes of all pairs are tallied, pairs below the guaranteed minimum of five
are dropped, and the rest are verified bit by bit. A list returns no pairs but a star for each of its connected
parts, so a group of near copies costs rows in proportion to its members. Equal fingerprints are one node throughout.
Lists longer than LIST_LIMIT are never held: their postings are dealt out again by one more shared byte, which spreads a
list over up to 1024 others. Those agree in five bytes, so every pair in them has reached the minimum; what is still
longer than LIST_LIMIT (2^24 different fingerprints at most, in one task) is verified by looking up the fingerprints
that one to three flipped bits give, instead of pair by pair.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a null doc_id takes part in
linking, and a component of null doc_ids alone has a null component_id; repeated rows give repeated results; a text is
read whole, however long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common, graph

WORDS, DISTANCE, BYTES = 3, 3, 8
LEAST_SHARED = BYTES - DISTANCE
SEED = 42
#: The blocks of S(3, 4, 8).
BLOCKS = [b for b in combinations(range(BYTES), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: Members up to which a posting list is compared pair by pair.
LIST_LIMIT = 2048


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of every run of k words, repeats included; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    last = ends[k - 1 :] or ends[-1:]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last)], "<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprints of runs of hashes that begin at starts; no run is empty."""
    out = hashes[starts]
    sizes = np.diff(np.r_[starts, len(hashes)])
    several = np.flatnonzero(sizes > 1)
    if len(several):
        own = np.repeat(sizes > 1, sizes)
        bits = np.unpackbits(hashes[own].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sizes = sizes[several]
        counts = np.add.reduceat(bits, np.r_[0, np.cumsum(sizes)[:-1]], axis=0, dtype=np.uint32)
        out[several] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of every row. Words are runs of anything but ASCII white space, A-Z in lower case."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(shingle_hashes(t.lower().split(), words)) for t in common.text_bytes(rows.column(1))]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.int64())], names=FINGERPRINTS.fieldNames())

    return common.map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", batch, FINGERPRINTS)


def _byte(position: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(255)


def _key(block: tuple[int, ...]) -> F.Column:
    out = F.lit(0).cast("long")
    for p in block:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(p))
    return out


EDGES = "u long, v long, block int, key long, fp long"


def _stars(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the connected parts of a list, from its link matrix."""
    label = nodes
    while True:
        nearest = np.where(linked, label, np.int64(2**63 - 1)).min(1)
        if (nearest == label).all():
            break
        label = nearest
    far = label != nodes
    return nodes[far], label[far]


def _near(differ: np.ndarray) -> np.ndarray:
    """Of pairs, by their differing bits: those that share the guaranteed minimum of positional bytes, and are near."""
    shared = (np.ascontiguousarray(differ).view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(-1, dtype=np.uint8)
    near = shared >= LEAST_SHARED
    near[near] = np.bitwise_count(differ[near]) <= DISTANCE
    return near


def _tallied(fps: np.ndarray, nodes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of lists of two members or more, lists of one length together."""
    for n in np.unique(sizes).tolist():
        lists = starts[sizes == n][:, None] + np.arange(n)
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 20) // len(i))
        for some in (lists[a : a + step] for a in range(0, len(lists), step)):
            near = np.concatenate([_near(fps[some[:, i[k : k + (1 << 20)]]] ^ fps[some[:, j[k : k + (1 << 20)]]]) for k in range(0, len(i), 1 << 20)], 1)
            if n == 2:
                yield nodes[some[near[:, 0]]].max(1), nodes[some[near[:, 0]]].min(1)
                continue
            for row in np.flatnonzero(near.any(1)):
                linked = np.eye(n, dtype=bool)
                linked[i[near[row]], j[near[row]]] = linked[j[near[row]], i[near[row]]] = True
                yield _stars(nodes[some[row]], linked)


@lru_cache(64)
def _masks(free: tuple[int, ...]) -> tuple[int, ...]:
    """All ways to flip one to three bits of the free bytes."""
    bits = [8 * p + i for p in free for i in range(8)]
    return tuple(sum(1 << b for b in some) for k in range(1, DISTANCE + 1) for some in combinations(bits, k))


def _long_list(fps: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a list that agrees in five bytes, by looking every member's neighbours up; fps are sorted."""
    same = np.bitwise_or.reduce(fps ^ fps[0])
    free = tuple(p for p in range(BYTES) if (int(same) >> 8 * p) & 255)
    for mask in _masks(free):
        wanted = fps ^ np.uint64(mask)
        at = np.searchsorted(fps, wanted)
        at[at == len(fps)] = 0
        hit = (fps[at] == wanted) & (nodes[at] < nodes)
        if hit.any():
            yield nodes[hit], nodes[at[hit]]


def _edge_batch(u: np.ndarray, v: np.ndarray | None, *posting: np.ndarray) -> pa.RecordBatch:
    """Edges; or postings that are handed on, whose v is null."""
    types = (pa.int32(), pa.int64(), pa.int64())
    rest = [pa.array(x, t) for x, t in zip(posting, types)] or [pa.nulls(len(u), t) for t in types]
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()) if v is None else pa.array(v, pa.int64()), *rest], names=["u", "v", "block", "key", "fp"])


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Postings (block, key, fp, node) of a partition sorted by (block, key, fp), cut between lists; True marks postings
    of a list that goes on behind them, which then is longer than LIST_LIMIT."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(rows[0]):
            continue
        edges = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
        same = held and held[-1][0][-1] == rows[0][0] and held[-1][1][-1] == rows[1][0]
        if held and (not same or len(edges)):
            cut = int(edges[0]) if same else 0
            yield [np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows])], False
            held, rows = [], [x[cut:] for x in rows]
            edges = edges[edges > cut] - cut
        if len(edges):
            yield [x[: edges[-1]] for x in rows], False
            rows = [x[edges[-1] :] for x in rows]
        held.append(rows)
        if sum(len(x[0]) for x in held) > LIST_LIMIT:
            yield [np.concatenate(x) for x in zip(*held)], True
            held = [[x[-1:] for x in rows]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)], False


def _bounds(block: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.r_[0, np.flatnonzero((np.diff(block) != 0) | (np.diff(key) != 0)) + 1]
    return starts, np.diff(np.r_[starts, len(key)])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of short lists; the postings of longer ones are handed on (u is their node, v is null)."""
    going = None  # the long list of which postings were handed on, and the last of them, which comes again
    for (block, key, fp, node), more in _whole_lists(batches):
        starts, sizes = _bounds(block, key)
        long = sizes > LIST_LIMIT
        again = going is not None and going == (block[0], key[0], node[0])
        long[0] |= again or more
        own = np.repeat(long, sizes)
        own[0] &= not again
        if own.any():
            yield _edge_batch(node[own], None, block[own], key[own], fp[own])
        going = (block[-1], key[-1], node[-1]) if more else None
        some = ~long & (sizes > 1)
        found = list(_tallied(fp.view(np.uint64), node, starts[some], sizes[some]))
        if found:
            yield _edge_batch(*map(np.concatenate, zip(*found)))


def _long_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of lists that agree in five bytes, which is the guaranteed minimum; the longest are held whole."""
    parts: list[list[np.ndarray]] = []
    for rows, more in _whole_lists(batches):
        if parts:
            rows = [np.concatenate([*(p[i] for p in parts), rows[i][1:]]) for i in range(4)] if not more else rows
        if more:
            parts.append(rows if not parts else [x[1:] for x in rows])
            continue
        parts = []
        block, key, fp, node = rows
        starts, sizes = _bounds(block, key)
        some = (sizes > 1) & (sizes <= LIST_LIMIT)
        for u, v in _tallied(fp.view(np.uint64), node, starts[some], sizes[some]):
            yield _edge_batch(u, v)
        for a, n in zip(starts[sizes > LIST_LIMIT].tolist(), sizes[sizes > LIST_LIMIT].tolist()):
            for u, v in _long_list(fp[a : a + n].view(np.uint64), node[a : a + n]):
                yield _edge_batch(u, v)


def _dealt(postings: DataFrame) -> DataFrame:
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(parts, "block", "key").sortWithinPartitions("block", "key", F.expr("fp < 0"), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """Edges u, v between the nodes (fp, node) that connect exactly those within DISTANCE bits, by way of others or not."""
    index = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _key(b).alias("key")) for i, b in enumerate(BLOCKS))))
    postings = nodes.select("fp", "node", index.alias("posting")).select("posting.block", "posting.key", "fp", "node")
    first = common.stored(common.map_arrow(_dealt(postings), _lists, EDGES), "postings")
    rest = first.where("v is null")
    edges = first.where("v is not null").select("u", "v")
    if rest.isEmpty():
        return edges
    finer = [
        F.struct((F.lit(8 * i) + p).alias("block"), F.shiftleft("key", 8).bitwiseOR(_byte(p)).alias("key"))
        for i, b in enumerate(BLOCKS)
        for p in range(BYTES)
        if p not in b
    ]
    by_block = [F.when(F.col("block") == i, F.array(*finer[4 * i : 4 * i + 4])) for i in range(len(BLOCKS))]
    again = rest.select("fp", F.col("u").alias("node"), F.explode(F.coalesce(*by_block)).alias("posting")).select("posting.block", "posting.key", "fp", "node")
    return edges.union(common.map_arrow(_dealt(again), _long_lists, EDGES).select("u", "v"))


def groups(prints: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of (doc_id, fp)."""
    prints = common.stored(prints.select("doc_id", "fp"), "prints")
    nodes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = graph.components(links(nodes.select("fp", F.col("fp").alias("node"))))
    members = common.stored(roots.union(roots.select("root", "root").distinct()).toDF("fp", "root"), "members")
    least = members.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component"))
    linked = members.join(least, "root").select("fp", "component", F.lit(True).alias("linked"))
    labels = common.stored(nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component_id")), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    return groups(fingerprints(docs, words, id_col, text_col))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
