"""Groups of near copies at a word-shingle similarity: operator 8 in its general form.

A fingerprint of 64 bits at three bits finds hardly any pair of a Jaccard similarity of 0.8, and a longer one of that
kind only estimates it. So the fingerprint here is positional: a text's distinct shingles are dealt to positions by
their hash, and each position holds the SimHash of the shingles dealt to it. A shingle that two texts don't share
touches one position, so two texts of n and m shingles at a similarity of s agree at all positions but
(n + m) (1 - s) / (1 + s). That makes the method of operator 8 exact:

1. Inverted index. The postings of a text are its first filled positions, each with all 64 bits of its SimHash, one more
   than may differ. Two texts that reach s share one (prefix filter over the filled positions).
2. Count filter. For every pair that a posting list proposes, the shared positional bytes (the low byte of each SimHash,
   at FINE times the index's positions, where fewer shingles meet) are tallied; a pair below the guaranteed minimum,
   positions less those that may differ, goes.
3. Verification by the exact intersection of the shingle sets (64-bit hashes).

The number of positions grows with the text by powers of two (_positions). Texts just above such a step are indexed, and
have bytes, at the step below as well, for the sake of partners there. Texts of fewer than SMALL shingles are indexed
by single shingles. A text needs so many filled positions as it has postings; the odds that one falls short are below
10^-11. Else no step is an estimate, whatever the length of a list.

Texts that are equal but for case and blanks are one node (128-bit digest of the words). Posting lists of up to
LIST_LIMIT nodes propose their pairs. Of a longer list, which large groups of near copies make, each member is first
held against one hub, the member that stands in most long lists. Lists of one hub are then one group, which holds every
member once. Groups whose members are connected by then are done. In the others, the bytes of all pairs of different
components meet, dealt out in tasks of two blocks of members; what the count filter leaves is verified like all pairs.
Keys that a sample shows to stand in very many texts never meet in one task: their members go straight to this step, and
joins on a key are left to the engine, which splits large ones.

The texts are shuffled once, by digest, and written in buckets of it, so that whatever asks for some of them later moves
digests alone.

Defined cases: a null text is an empty one, and all wordless texts are copies of each other; a null doc_id stands behind
all others; repeated rows are copies; a text is read whole, however long; an empty table gives an empty result; extra
columns are kept by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common, graph
from varsift.llm.simhash import majority, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Shingles from which a text is indexed by positions; positions at the first step; positional bytes for each of them.
SMALL, FIRST_POSITIONS, FINE = 64, 48, 2
#: Members up to which a posting list proposes all its pairs.
LIST_LIMIT = 6
#: About so many texts are looked at to tell which keys are to be spread; at most so many are.
SAMPLE, SPREAD_KEYS = 10_000, 100_000
#: Texts of the sample that such a key is in at least, and tasks that its postings are spread over.
LEAST_SEEN, SPREAD = 10, 64
#: Members that a block of a long list holds about.
BLOCK_MEMBERS = 1 << 11


def _mixed(x: np.ndarray) -> np.ndarray:
    """Pseudo-random words for words, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(sizes: np.ndarray) -> np.ndarray:
    """The step of texts with so many shingles: -1 below SMALL, then one more with each doubling."""
    return np.frexp(sizes // SMALL)[1] - 1


def _positions(step: np.ndarray | int) -> np.ndarray:
    """Positions of the index at a step."""
    return FIRST_POSITIONS << np.maximum(step, 0)


def _bytes(step: np.ndarray | int) -> np.ndarray:
    """Positional bytes at a step; small texts have those of the first."""
    return FINE * _positions(step)


def _first_size(step: np.ndarray) -> np.ndarray:
    """Shingles from which a text is at a step."""
    return np.where(step < 0, 0, SMALL << np.maximum(step, 0))


def _differing(n, m, similarity: float):
    """Shingles, and so positions, in which two texts at the similarity may differ at most."""
    return np.floor((n + m) * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64)


def _similar(common_size, size_a, size_b, similarity: float):
    """Whether a Jaccard similarity is reached; of arrays or of columns."""
    return common_size * (1 + similarity) >= (size_a + size_b) * similarity - 1e-9


def content(text: Column) -> Column:
    """A 128-bit digest of a text's words: equal for texts that differ in case (A-Z) and blanks alone."""
    return F.md5(F.trim(F.regexp_replace(common.lower_az(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def shingle_sets(text: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    return [np.unique(shingle_hashes(t.lower().split(), words)) for t in common.text_bytes(text)]


def simhashes(sets: list[np.ndarray], positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and SimHash of every filled position, ascending, for sets with so many positions each."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate([*sets, np.empty(0, "<u8")])
    own = np.repeat(np.arange(len(sets)), sizes)
    place = (_mixed(h) % positions.astype(np.uint64)[own]).astype(np.int64)
    first = np.r_[0, np.cumsum(positions)]
    cell = first[own] + place
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    text = own[order[starts]]
    return text, cell[order[starts]] - first[text], majority(h[order], starts)


def bytes_of(sets: list[np.ndarray], steps: np.ndarray) -> list[bytes]:
    """The positional bytes of each set at a step."""
    positions = _bytes(steps)
    text, place, sims = simhashes(sets, positions)
    first = np.r_[0, np.cumsum(positions)]
    flat = np.zeros(first[-1], np.uint8)
    flat[first[text] + place] = (sims & np.uint64(255)).astype(np.uint8)
    return [flat[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist())]


def _firsts(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the first so many entries of each text; text ascends."""
    starts = np.searchsorted(text, np.arange(len(wanted)))
    return np.flatnonzero(np.arange(len(text)) - starts[text] < wanted[text])


def _below(sizes: np.ndarray, steps: np.ndarray, similarity: float) -> np.ndarray:
    """Whether a partner of fewer shingles may be a step below."""
    return (steps >= 0) & (sizes * similarity - 1e-9 <= _first_size(steps) - 1)


def _keys(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all postings of the sets, and the set that each belongs to."""
    sizes = np.array([len(s) for s in sets], np.int64)
    steps = _steps(sizes)
    below = _below(sizes, steps, similarity)
    keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

    def single(some: np.ndarray) -> None:
        """By single shingles, in the order of their hashes."""
        own = np.repeat(some, sizes[some])
        h = np.concatenate([*(sets[i] for i in some), np.empty(0, "<u8")])
        at = _firsts(np.repeat(np.arange(len(some)), sizes[some]), sizes[some] - np.ceil(similarity * sizes[some] - 1e-9).astype(np.int64) + 1)
        keys.append(_mixed(h[at]))
        owners.append(own[at])

    def positional(some: np.ndarray, step: np.ndarray, partner: np.ndarray) -> None:
        text, place, sims = simhashes([sets[i] for i in some], _positions(step))
        at = _firsts(text, _differing(sizes[some], partner, similarity) + 1)
        text, place = text[at], place[at]
        named = (step[text].astype(np.uint64) + np.uint64(1) << np.uint64(48)) + place.astype(np.uint64)
        keys.append(_mixed(sims[at] ^ _mixed(named)))
        owners.append(some[text])

    own = np.flatnonzero(steps >= 0)
    positional(own, steps[own], np.floor(sizes[own] / similarity + 1e-9))
    low = np.flatnonzero(below & (steps > 0))
    positional(low, steps[low] - 1, _first_size(steps[low]) - 1)
    single(np.flatnonzero((sizes > 0) & ((steps < 0) | below & (steps == 0))))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _spread_keys(texts: DataFrame, words: int, similarity: float) -> np.ndarray:
    """Keys that a sample tells to stand in at least one of so many texts as there are partitions. Any result is right."""
    count, parts = texts.count(), common.parts(texts.sparkSession)
    step = max(1, count // SAMPLE)

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = np.unique(_keys(shingle_sets(part.column(0), words), similarity)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["key", "n"])

    some = texts.where(F.pmod(F.xxhash64("content"), step) == 0).select("text")
    seen = common.map_texts(some, "text", batch, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = seen.where(F.col("n") >= max(LEAST_SEEN, count // step // parts)).orderBy(F.desc("n"), "key").limit(SPREAD_KEYS).collect()
    return np.sort(np.array([r.key for r in rows], np.int64))


def _prints(sets: list[np.ndarray], similarity: float) -> list[bytes]:
    """The positional bytes of each set at its step, and behind them those at the step below where it has partners."""
    sizes = np.array([len(s) for s in sets], np.int64)
    steps = _steps(sizes)
    lower = np.flatnonzero(_below(sizes, steps, similarity) & (steps > 0))
    own, below = bytes_of(sets, np.maximum(steps, 0)), bytes_of([sets[i] for i in lower], steps[lower] - 1)
    for i, x in zip(lower.tolist(), below):
        own[i] += x
    return own


def _postings(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """key, node, size and spread (a part of a key that is spread, else -1) of all postings; the first of each text has
    its bytes and its digest."""
    sent = texts.sparkSession.sparkContext.broadcast(_spread_keys(texts, words, similarity))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(1), words)
        key, own = _keys(sets, similarity)
        node = part.column(0).to_numpy()[own]
        size = np.array([len(s) for s in sets], np.int32)[own]
        spread = np.where(np.isin(key, sent.value), node % SPREAD, -1).astype(np.int32)
        first = np.zeros(len(own), bool)
        first[np.unique(own, return_index=True)[1]] = True
        firsts = pa.array(own, mask=~first)
        prints = pa.array(_prints(sets, similarity), pa.binary()).take(firsts)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(size), pa.array(spread), prints, part.column(2).take(firsts)], names=["key", "node", "size", "spread", "print", "content"])

    return common.map_texts(texts.select("node", "text", "content"), "text", batch, "key long, node long, size int, spread int, print binary, content string")


PROPOSED = "a long, b long, key long, size int, print binary, content string"


def _proposed(a, b=None, key=None, size=None, print=None, content=None) -> pa.RecordBatch:
    n = len(a)
    columns = [(a, pa.int64()), (b, pa.int64()), (key, pa.int64()), (size, pa.int32()), (print, pa.binary()), (content, pa.string())]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x) if isinstance(x, np.ndarray) else x for x, t in columns], names=["a", "b", "key", "size", "print", "content"])


def _lists(similarity: float, limit: int):
    """From a partition sorted by key: facts of the texts (a, size, print, content), pairs of the short lists (a, b), and
    the members (a, key) of the longer ones and of spread keys.

    A long list is handed on as it comes and never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        over = None  # the key of a long list that may go on
        for batch in batches:
            if batch.column(4).null_count < len(batch):
                some = batch.filter(pc.is_valid(batch.column(4)))
                yield _proposed(some.column(1), size=some.column(2), print=some.column(4), content=some.column(5))
            rows = [batch.column(i).to_numpy() for i in range(4)]
            apart = rows[3] >= 0
            if over is not None:
                apart |= rows[0] == over
            if apart.any():
                yield _proposed(rows[1][apart], key=rows[0][apart])
                rows = [x[~apart] for x in rows]
            rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from lists([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
            if len(held[0]) > limit:
                over = held[0][0]
                yield _proposed(held[1], key=held[0])
                held = None
        if held:
            yield from lists(held)

    def lists(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, size, _ = rows
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
        sizes = np.diff(np.r_[starts, len(key)])
        for length in np.unique(sizes[(sizes > 1) & (sizes <= limit)]):
            first = starts[sizes == length]
            i, j = np.triu_indices(length, 1)
            a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            may = _similar(np.minimum(size[a], size[b]), size[a], size[b], similarity) & (node[a] != node[b])
            pairs = np.unique(np.sort(np.c_[node[a[may]], node[b[may]]], axis=1), axis=0)
            if len(pairs):
                yield _proposed(np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
        long = np.repeat(sizes > limit, sizes)
        if long.any():
            yield _proposed(node[long], key=key[long])

    return run


def _stars(members: DataFrame) -> DataFrame:
    """hub, node: the hubs of long lists, which are the members that stand in most of them, with all members of theirs."""
    weighed = members.join(members.groupBy("node").count(), "node")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("count", "node"))["node"].alias("hub"))
    return members.join(hubs, "key").select("hub", "node").distinct()


def _enough(shared, size_a, size_b, positions, similarity: float):
    """The count filter: whether the guaranteed minimum of positional bytes is shared."""
    return shared >= positions - _differing(size_a, size_b, similarity)


def _at(print: bytes, own: int, step: int) -> bytes | None:
    """A text's bytes at a step, if it has them; own: the step of the text."""
    width = int(_bytes(own))
    if own == step:
        return print[:width]
    return print[width:] if own == step + 1 and len(print) > width else None


def _tallied(similarity: float):
    """The pairs that the count filter leaves; rows: a, b, size and print of a, then of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            own_a, own_b = np.maximum(_steps(size_a), 0), np.maximum(_steps(size_b), 0)
            step = np.minimum(own_a, own_b)
            shared = np.full(len(step), -1, np.int64)
            for i, (x, y, p, q, k) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), own_a.tolist(), own_b.tolist(), step.tolist())):
                x, y = _at(x, p, k), _at(y, q, k)
                if x is not None and y is not None:
                    shared[i] = np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))
            good = pa.array(_enough(shared, size_a, size_b, _bytes(step), similarity))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return run


def _joined(pairs: DataFrame, facts: DataFrame, *columns: str) -> DataFrame:
    """Pairs with facts of either node."""
    facts = facts.select("node", *columns).repartition(common.parts(facts.sparkSession), "node")  # one shuffle for both sides
    side = lambda n: facts.select(F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in columns))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{c}_{n}" for n in "ab" for c in columns))


def _chosen(texts: DataFrame, contents: DataFrame) -> DataFrame:
    """The texts of some digests; the texts stay where their buckets are."""
    return texts.join(contents.hint("shuffle_hash"), "content", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, facts: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v of the pairs whose sets of shingles are similar."""

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(1), words)
        ends = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
        flat = pa.array(np.concatenate([*sets, np.empty(0, "<u8")]).view(np.int64))
        return pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, flat)], names=["node", "set"])

    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    chosen = _chosen(texts.select("node", "text", "content"), facts.join(wanted, "node").select("content")).select("node", "text")
    # the texts that are left are a small part of all, and so are the tasks
    sets = common.stored(common.map_texts(chosen, "text", batch, T.StructType.fromDDL("node long, set array<long>")).coalesce(common.parts(texts.sparkSession, 8)), "sets")
    both = _joined(pairs, sets, "set")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(_similar(shared, F.size("set_a"), F.size("set_b"), similarity)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _tasks(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """task, node, root: the members of each group (hub, node) that has members of several components.

    A group of several blocks has a task for each pair of blocks, so that any two members of different components meet;
    blocks of the largest component don't meet each other.
    """
    placed = stars.join(roots, "node", "left").select(F.col("hub").alias("key"), "node", F.coalesce("root", "node").alias("root"))
    by_root = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    by_key = by_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK_MEMBERS).cast("int")
    mixed = by_key.where("all > top.n")
    mixed = mixed.select("key", F.col("top.root").alias("largest"), blocks(F.col("all") - F.col("top.n")).alias("rest"), blocks(F.col("top.n")).alias("most"), (F.col("all") <= BLOCK_MEMBERS).alias("one"))
    dealt = placed.join(mixed, "key").withColumn("is_most", F.col("root") == F.col("largest"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_most"), F.col("most")).otherwise(F.col("rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    same = F.transform(upto(F.col("rest")), lambda i: task(1, F.least("block", i), F.greatest("block", i)))
    other = F.transform(upto(F.col("most")), lambda i: task(2, F.col("block"), i))
    for_most = F.transform(upto(F.col("rest")), lambda i: task(2, i, F.col("block")))
    wanted = F.when(F.col("one"), F.array(task(0, F.lit(0), F.lit(0)))).when(F.col("is_most"), for_most).otherwise(F.concat(same, other))
    met = dealt.select("key", "node", "root", F.explode(wanted).alias("in"))
    # tasks whose hashes meet only compare more pairs
    return met.select(F.xxhash64("key", "in.kind", "in.x", "in.y").alias("task"), "node", "root")


def _across(node: np.ndarray, root: np.ndarray, size: np.ndarray, prints: list[bytes], similarity: float) -> Iterator[np.ndarray]:
    """Pairs of members of different components that the count filter leaves."""
    steps = np.maximum(_steps(size), 0)
    label, counts = np.unique(root, return_inverse=True, return_counts=True)[1:]
    most = counts.argmax()
    for step in np.unique(steps).tolist():
        held = [_at(p, own, step) for p, own in zip(prints, steps.tolist())]
        at = np.array([i for i, x in enumerate(held) if x is not None])
        width = int(_bytes(step))
        table = np.frombuffer(b"".join(x for x in held if x is not None), np.uint8).reshape(len(at), width)
        for row in np.flatnonzero(label[at] != most).tolist():
            i = at[row]
            # of two members of the smaller components, the one that comes first looks for the other
            may = (root[at] != root[i]) & (np.minimum(steps[at], steps[i]) == step) & ((label[at] == most) | (at > i))
            may &= _similar(np.minimum(size[at], size[i]), size[at], size[i], similarity)
            some = np.flatnonzero(may)
            for a in range(0, len(some), 4096):
                part = some[a : a + 4096]
                shared = (table[part] == table[row]).sum(1)
                near = at[part[_enough(shared, size[at[part]], size[i], width, similarity)]]
                if len(near):
                    yield np.c_[np.minimum(node[near], node[i]), np.maximum(node[near], node[i])]


def _compared(similarity: float):
    """Pairs a, b of each task of a partition sorted by task; rows: task, node, root, size, print."""

    def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root, size = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in (1, 2, 3))
        prints = [x for p in parts for x in p.column(4).to_pylist()]
        for found in _across(node, root, size.astype(np.int64), prints, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            task = batch.column(0).to_numpy()
            bounds = np.r_[0, np.flatnonzero(np.diff(task)) + 1, len(task)].tolist()
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != task[a]:
                    yield from pairs(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(held)

    return run


def _grouped(rows: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, text, row. The texts (content, least, text, row of the least doc_id, node) in buckets by content, and
    content, least and root of each: texts of one group have one root."""
    if not 0.5 < similarity <= 1:
        raise ValueError("a similarity above 0.5: partners must not be more than one step of positions below")
    spark = rows.sparkSession
    known = rows.select(content(F.col("text")).alias("content"), "doc_id", "text", "row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    first = known.groupBy("content").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("text", "row"), order).alias("first"))
    # node numbers are written with the rows, so all that follows reads the same ones
    texts = common.bucketed(first.select("content", "least", "first.text", "first.row").withColumn("node", F.monotonically_increasing_id()), "content", "texts")
    common.give_back_heap(spark)
    parts = common.parts(spark)
    postings = _postings(texts, words, similarity).repartition(parts, "key", "spread").sortWithinPartitions("key")
    proposed = common.stored(common.map_arrow(postings, _lists(similarity, LIST_LIMIT), PROPOSED), "proposed")
    common.give_back_heap(spark)
    facts = proposed.where("print is not null").select(F.col("a").alias("node"), "size", "print", "content")
    members = proposed.where("key is not null").select("key", F.col("a").alias("node"))
    some_long = not members.isEmpty()
    pairs = proposed.where("b is not null").select("a", "b")
    stars = common.on_disk(_stars(members)) if some_long else None
    if some_long:
        pairs = pairs.union(stars.where("hub <> node").select(F.least("hub", "node"), F.greatest("hub", "node")))
    left = common.on_disk(common.map_arrow(_joined(pairs.distinct(), facts, "size", "print"), _tallied(similarity), "a long, b long"))
    roots = graph.components(_verified(left, texts, facts, words, similarity))
    if some_long:
        whole = _tasks(stars, roots).join(facts, "node").select("task", "node", "root", "size", "print")
        found = common.map_arrow(whole.repartition(parts, "task").sortWithinPartitions("task"), _compared(similarity), "a long, b long")
        across = common.on_disk(found.distinct())
        links = _verified(across, texts, facts, words, similarity)
        roots = graph.components(links.union(roots.toDF("u", "v")))
        across.unpersist()
        stars.unpersist()
    left.unpersist()
    common.discard(proposed)
    return texts, texts.select("content", "least", "node").join(roots, "node", "left").select("content", "least", F.coalesce("root", "node").alias("root"))


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """content, least (smallest doc_id of the text) and root of every text: texts of one group have one root."""
    text = F.col(f"`{text_col}`")
    return _grouped(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("row")), words, similarity)[1]


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id; the columns stay as they were.

    Rows without an id stand behind all others; of rows with one id and equal texts one stays.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    i, t = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rest = [n for n in names if n != t]
    rows = docs.toDF(*names).select(F.col(i).cast("long").alias("doc_id"), F.col(t).alias("text"), F.struct(*rest).alias("row"))
    texts, labelled = _grouped(rows, words, similarity)
    first = F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "content"))
    kept = labelled.groupBy("root").agg(first.alias("first")).select("first.content")
    own = _chosen(texts, kept).select(*(F.col("text") if n == t else F.col(f"row.{n}") for n in names))
    return own.coalesce(common.parts(docs.sparkSession, 4)).toDF(*docs.columns)
