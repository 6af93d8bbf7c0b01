"""Exact top-k inner products by norm-bucketed retrieval (operator 3).

Vectors are sorted by length and dealt out by ranges of length, so equal lengths spread too; runs of BUCKET vectors of
a partition are buckets. A query's k-th best score so far is its threshold; divided by its own length and the longest
vector of a bucket it becomes the bucket's local cosine threshold. Above 1 no vector of the bucket can reach it and the
bucket is skipped. Where the cosine is low only length can prune, and the bucket's vectors, longest first, are cut where
they get too short. Where it is high, the query's largest coordinate prunes: a vector whose angle to that axis differs
from the query's by more than the threshold's angle cannot reach it. What is left is verified with the exact product.

First thresholds come from the SEEDS longest vectors. Queries go in blocks of BLOCK, the only thing that is broadcast;
each task returns at most k rows for a query, and those are merged. Pruning bounds carry a slack well above rounding,
and scores are integers below 2^53 in floating point, or else summed in 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
vec_id; vectors of different dimension don't meet; rows that share a query's vec_id are the query's own; repeated
query rows with the same vector answer once; equal scores go to the smaller vec_id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varsift.llm import common

BLOCK, BUCKET, SEEDS = 4096, 1024, 2048
#: From this local cosine threshold on, coordinates prune better than lengths.
COORDINATE_FROM = 0.5
SLACK = 1e-9
#: Blocks of queries that one plan answers before their answers are written to the shared folder.
BLOCKS_A_PLAN = 4


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """vec_id, v (components floor(scale * x)) and norm of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(fit, F.lit(False)))
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return whole.withColumn("norm", F.sqrt(squares))


@dataclass
class Queries:
    """A block of queries of one dimension; floor holds each one's k-th best score so far, -inf before that."""

    ids: np.ndarray
    keys: np.ndarray
    vectors: np.ndarray
    floor: np.ndarray

    def __post_init__(self):
        self.norms = np.sqrt((self.vectors.astype(float) ** 2).sum(1))
        unit = self.vectors / np.where(self.norms, self.norms, 1)[:, None]
        self.axis = np.abs(unit).argmax(1) if unit.shape[1] else np.zeros(len(unit), int)
        self.angle = np.arccos(np.clip(unit[np.arange(len(unit)), self.axis], -1, 1)) if unit.shape[1] else np.zeros(len(unit))


class Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.floor = queries.floor.copy()
        self.q = np.empty(0, np.int64)
        self.score, self.vec = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        q, score, vec = np.r_[self.q, q], np.r_[self.score, score], np.r_[self.vec, vec]
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        kept = place < self.k
        self.q, self.score, self.vec = q[kept], score[kept], vec[kept]
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])

    def take(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        """One bucket, longest vectors first."""
        asked = self.queries
        longest = norms[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = self.floor / (asked.norms * longest)
        # without a threshold everything counts; zero lengths have zero products
        zero = (asked.norms == 0) | (longest == 0)
        local = np.where(np.isneginf(self.floor), -2.0, np.where(zero, np.where(self.floor > 0, 2.0, -2.0), local))
        live = local <= 1 + SLACK
        by_length = np.flatnonzero(live & (local < COORDINATE_FROM))
        by_axis = np.flatnonzero(live & (local >= COORDINATE_FROM))
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = np.where(local[by_length] > 0, self.floor[by_length] / asked.norms[by_length], -1)
            reach = np.searchsorted(-norms, -(needed * (1 - SLACK)), "right")
            self._verify_block(by_length, reach, ids, vectors)
        if len(by_axis):
            self._verify_pairs(by_axis, local[by_axis], ids, vectors, norms)

    def _product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
        if most < 2**53:
            return (a.astype(float) @ b.astype(float).T).astype(np.int64)
        if most >= 2**63:
            raise OverflowError("vectors of which products may leave 64-bit integers")
        return a @ b.T

    def _keep(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        good = (score >= self.floor[q]) & (vec != self.queries.ids[q])
        if good.any():
            self.add(q[good], score[good], vec[good])

    def _verify_block(self, some: np.ndarray, reach: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        n = int(reach.max(initial=0))
        for a in range(0, len(some), 512):
            part = some[a : a + 512]
            scores = self._product(self.queries.vectors[part], vectors[:n])
            good = (scores >= self.floor[part][:, None]) & (np.arange(n) < reach[a : a + 512, None])
            i, j = np.nonzero(good)
            self._keep(part[i], scores[i, j], ids[j])

    def _verify_pairs(self, some: np.ndarray, local: np.ndarray, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        asked = self.queries
        unit = vectors / np.where(norms, norms, 1)[:, None]
        spread = np.arccos(np.clip(local - SLACK, -1, 1)) + 1e-7
        angle = asked.angle[some]
        low, high = np.cos(np.minimum(np.pi, angle + spread)) - SLACK, np.cos(np.maximum(0, angle - spread)) + SLACK
        for axis in np.unique(asked.axis[some]):
            on = np.flatnonzero(asked.axis[some] == axis)
            along = unit[:, axis]
            order = np.argsort(along, kind="stable")
            a, b = np.searchsorted(along[order], low[on], "left"), np.searchsorted(along[order], high[on], "right")
            for q, x, y in zip(some[on].tolist(), a.tolist(), b.tolist()):
                if x < y:
                    near = order[x:y]
                    score = self._product(asked.vectors[q : q + 1], vectors[near])[0]
                    self._keep(np.full(len(near), q), score, ids[near])


def _search(queries: dict[int, Queries], k: int):
    """A task: buckets against all queries of a block; at most k rows for each query come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(q, k) for d, q in queries.items()}
        for ids, vectors, norms in _buckets(batches):
            if vectors.shape[1] in best:
                best[vectors.shape[1]].take(ids, vectors, norms)
        for found in best.values():
            of = found.queries
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (of.ids[found.q], of.keys[found.q], found.vec, found.score)], names=["query_id", "query_key", "vec_id", "score"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        ids, norms = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        lists = batch.column(1)
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        dims = np.diff(at)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            vectors = flat[at[rows][:, None] + np.arange(d)]
            order = np.argsort(-norms[rows], kind="stable")
            for a in range(0, len(rows), BUCKET):
                some = order[a : a + BUCKET]
                yield ids[rows[some]], vectors[some], norms[rows[some]]


def _of_rows(rows: list, k: int) -> dict[int, Queries]:
    out = {}
    for d in {len(r.v) for r in rows}:
        own = [r for r in rows if len(r.v) == d]
        out[d] = Queries(np.array([r.vec_id for r in own]), np.array([r.key for r in own]), np.array([r.v for r in own], np.int64).reshape(len(own), d), np.full(len(own), -np.inf))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each query row."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_length = [F.col("norm").desc(), F.xxhash64("vec_id")]
    table = common.stored(quantised(vectors, id_col, vector_col).repartitionByRange(parts, *by_length).sortWithinPartitions(*by_length), "vectors")
    asked = table.where(is_query).select("vec_id", "v", F.xxhash64("v").alias("key")).dropDuplicates(["vec_id", "key"])
    blocks = max(1, -(-asked.count() // BLOCK))
    seeds = table.orderBy(*by_length).limit(SEEDS).select("vec_id", "v", "norm").collect()
    answers: list[DataFrame] = []
    for b in range(blocks):
        # a hash deals the queries into blocks of about BLOCK rows: bounded, whatever the size of the table
        queries = _of_rows(asked.where(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)) == b).collect(), k)
        for d, block in queries.items():
            own = [s for s in seeds if len(s.v) == d]
            first = Best(block, k)
            for a in range(0, len(own), BUCKET):
                some = own[a : a + BUCKET]
                first.take(np.array([s.vec_id for s in some]), np.array([s.v for s in some], np.int64).reshape(len(some), d), np.array([s.norm for s in some]))
            block.floor = first.floor
        sent = spark.sparkContext.broadcast(queries)
        answers.append(common.map_arrow(table, lambda batches, sent=sent: _search(sent.value, k)(batches), "query_id long, query_key long, vec_id long, score long"))
        if len(answers) >= BLOCKS_A_PLAN:
            answers = [common.stored(_merge(answers, k), "answers")]
    return _merge(answers, k).select("query_id", "rank", "vec_id", "score")


def _merge(answers: list[DataFrame], k: int) -> DataFrame:
    every = answers[0].select("query_id", "query_key", "vec_id", "score")
    for more in answers[1:]:
        every = every.union(more.select("query_id", "query_key", "vec_id", "score"))
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id"))
    return every.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of largest inner product for every hundredth vector."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from whole q join whole c on q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0
), placed as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from placed where rank <= 10
"""
