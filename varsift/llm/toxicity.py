"""Toxic spans and document scores by a linear-chain conditional random field (operator 1).

Training. Documents carry labels, tokens don't, so token labels are derived first: a word is toxic if its share among
toxic documents, against that among the others, exceeds TAG_RATIO in log terms and by more than chance over all features
would make it; a word too rare to tell goes by its leading letters. Such words of toxic documents are toxic tokens. Features are the word and its leading letters, hashed, so unseen
compounds of a known stem are found as well. Windows around those tokens and random windows train the field's weights
(a two-state chain) by gradient ascent on the conditional likelihood; expected counts come from forward-backward. The
windows of a document are bounded by MARKED_WINDOWS, NEAR_WINDOWS and RANDOM_WINDOWS; a shorter text is one window.

Scoring. Forward-backward over every token of the whole text gives marginals. Words are looked up once in a bounded
cache, and the recursions run on all rows of a batch at once: texts are cut into rows of ROW tokens, each row's product
of transfer matrices is formed, rows are chained within their text, and the marginals follow exactly, without a limit on
length. A logistic model over the largest marginal and the expected number of toxic tokens turns marginals into a score,
and runs of tokens with a marginal of a half or more are the offending spans (code points).

The labelled sample is bounded by SAMPLE_DOCS documents of each label and SAMPLE_TEXT bytes a document, taken in the
order of a hash of doc_id, so the driver's work does not grow with the corpus. Scoring takes every text whole.

Defined cases: a null or wordless text scores by its lack of evidence alone, near 0; null labels and null doc_ids are
not learnt from; a doc_id with several labels counts once for each; repeated rows give repeated results; without labelled rows of
both kinds all scores are 0; with too few to be certain of any word, the words that lean most are learnt from, and scores
rank documents but stay below the threshold; an empty table gives an empty result; extra columns are
kept by score(), but for those that have the name of a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common

#: Bounds of the labelled sample: documents of each label, and bytes of a document that is learnt from.
SAMPLE_DOCS, SAMPLE_TEXT = 2000, 32 << 10
TAG_RATIO, LEAST_DOCS = 1.5, 4
SLOTS = 1 << 18
ROW = 64
#: Tokens of a training window, and windows of a document at most: around toxic words, around words that are like them,
#: and from anywhere.
WINDOW = 24
MARKED_WINDOWS, NEAR_WINDOWS, RANDOM_WINDOWS = 8, 4, 2
THRESHOLD = 0.7
#: Where no word is certain: words that are learnt from, and what a score can reach.
UNCERTAIN_WORDS, UNCERTAIN_CEILING = 30, 0.69
CACHED_WORDS = 100_000

_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def tokens(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters; A-Z in lower case."""
    return text.translate(_CLEAN).split()


def features(word: bytes) -> list[int]:
    """Hashed features: the word, and its first three to five characters."""
    from xxhash import xxh64_intdigest

    letters = word.decode("utf-8", "replace")
    names = [b"w" + word, *(b"p" + letters[:k].encode() for k in (3, 4, 5) if len(letters) > k)]
    return [xxh64_intdigest(n) % SLOTS for n in names]


def _pass_messages(evidence: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected transitions and log likelihood part of equally long windows (rows)."""
    n, width = evidence.shape
    move = np.exp(trans)
    push = np.exp(np.clip(evidence, -30, 30))
    forward = np.empty((width, n, 2))
    backward = np.ones((width, n, 2))
    for t in range(width):
        at = np.ones((n, 2)) if not t else forward[t - 1] @ move
        at[:, 1] *= push[:, t]
        forward[t] = at / at.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        at = backward[t + 1].copy()
        at[:, 1] *= push[:, t + 1]
        at = at @ move.T
        backward[t] = at / at.sum(1, keepdims=True)
    both = forward * backward
    marginal = both[..., 1] / both.sum(2)
    steps = np.zeros((2, 2))
    for t in range(1, width):
        seen = backward[t].copy()
        seen[:, 1] *= push[:, t]
        joint = forward[t - 1][:, :, None] * move * seen[:, None, :]
        steps += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return marginal.T, steps, forward


@dataclass
class Field:
    """A fitted field: feature weights for state 1 against 0, transitions, and the document model."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    document: np.ndarray
    #: What a score can reach at most.
    ceiling: float = 1.0

    def evidence(self, word: bytes) -> float:
        return float(self.weights[features(word)].sum()) + self.bias

    def marginals(self, evidence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Marginals of state 1 for texts laid end to end, exact for any length."""
        if not len(evidence):
            return evidence
        rows = -(-lengths // ROW)
        first = np.cumsum(rows) - rows
        n = int(rows.sum())
        starts = np.cumsum(lengths) - lengths
        text = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(evidence)) - starts[text]
        slot = (first[text] + within // ROW) * ROW + within % ROW
        push = np.ones(n * ROW)
        push[slot] = np.exp(np.clip(evidence, -30, 30))
        real = np.zeros(n * ROW, bool)
        real[slot] = True
        push, real = push.reshape(n, ROW).T.copy(), real.reshape(n, ROW).T.copy()
        move = np.exp(self.trans)
        # each row's product of transfer matrices, scaled; what fills a text's last row changes nothing
        product = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        head = np.zeros(n, bool)
        head[first[rows > 0]] = True  # no transition leads into a text's first token
        for t in range(ROW):
            step = product @ move
            if not t:
                step[head] = product[head]
            step[:, :, 1] *= push[t][:, None]
            step /= step.sum((1, 2), keepdims=True)
            product = np.where(real[t][:, None, None], step, product)
        # chain the rows of each text, all texts at once
        enter, leave = np.ones((n, 2)), np.ones((n, 2))
        for k in range(1, int(rows.max())):
            at = first[rows > k] + k
            x = np.einsum("ij,ijk->ik", enter[at - 1], product[at - 1])
            enter[at] = x / x.sum(1, keepdims=True)
        for k in range(int(rows.max()) - 2, -1, -1):
            at = first[rows > k + 1] + k
            x = np.einsum("ijk,ik->ij", product[at + 1], leave[at + 1])
            leave[at] = x / x.sum(1, keepdims=True)
        forward = np.empty((ROW, n, 2))
        at = enter
        for t in range(ROW):
            step = at @ move
            if not t:
                step[head] = at[head]
            step[:, 1] *= push[t]
            step /= step.sum(1, keepdims=True)
            at = np.where(real[t][:, None], step, at)
            forward[t] = at
        out = np.empty((ROW, n))
        at = leave
        for t in range(ROW - 1, -1, -1):
            both = forward[t] * at
            out[t] = both[:, 1] / both.sum(1)
            step = at.copy()
            step[:, 1] *= push[t]
            step = step @ move.T
            step /= step.sum(1, keepdims=True)
            at = np.where(real[t][:, None], step, at)
        return out.T.ravel()[slot]

    def score(self, largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        if not len(self.document):
            return np.zeros(len(largest))
        return self.ceiling / (1 + np.exp(-np.clip(_document_features(largest, expected) @ self.document, -30, 30)))


def _document_features(largest: np.ndarray, expected: np.ndarray) -> np.ndarray:
    sure = np.clip(largest, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(sure)), np.log(sure / (1 - sure)) / 5, np.log1p(expected)], 1)


def _summary(marginal: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and summed marginal of each text; marginals that are next to nothing don't add up."""
    largest, expected = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = lengths > 0
    if full.any():
        at = (np.cumsum(lengths) - lengths)[full]
        largest[full] = np.maximum.reduceat(marginal, at)
        expected[full] = np.add.reduceat(np.where(marginal >= 0.05, marginal, 0), at)
    return largest, expected


def unlike(docs: list[list[bytes]], label: list[int], shingle: int = 4) -> list[int]:
    """Places of documents that aren't copies of earlier ones with the same label, as far as three minima of shingle
    hashes tell: a text that was copied many times would else pass for evidence from many."""
    from xxhash import xxh64_intdigest

    seen: set[tuple[int, int, int]] = set()
    kept = []
    for i, (words, y) in enumerate(zip(docs, label)):
        hashes = np.array([xxh64_intdigest(b" ".join(words[a : a + shingle])) for a in range(max(1, len(words) - shingle + 1))], np.uint64)
        own = {(y, k, int((hashes * np.uint64(m)).min())) for k, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))}
        if not own & seen:
            kept.append(i)
        seen |= own
    return kept


def fit(texts: list[bytes], toxic: list[int], seed: int = 7) -> Field:
    """A field from labelled documents."""
    rng = np.random.default_rng(seed)
    same: dict[bytes, bytes] = {}  # one object for all places of a word
    docs = [[same.setdefault(w, w) for w in tokens(t)] for t in texts]
    del same
    kept = unlike(docs, toxic)
    docs, toxic = [docs[i] for i in kept], [toxic[i] for i in kept]
    label = np.array(toxic, int)
    totals = np.bincount(label, minlength=2)
    if not totals.min():
        return Field(np.zeros(SLOTS), -5.0, np.zeros((2, 2)), np.empty(0))
    feats: dict[bytes, list[int]] = {}
    for words in docs:
        for w in words:
            if w not in feats:
                feats[w] = features(w)
    seen = [Counter(), Counter()]
    for y, words in zip(toxic, docs):
        seen[y].update({f for w in set(words) for f in feats[w]})
    share = totals[1] / totals.sum()
    # twice-corrected for the number of features looked at, so that chance alone marks none
    needed = np.log(max(2, len(seen[0] | seen[1]))) + 2

    def evidence(n1: int, n0: int) -> float:
        """Log likelihood of a feature's split over toxic and other documents against the overall share."""
        n = n1 + n0
        return n1 * np.log(n1 / (n * share)) + (n0 * np.log(n0 / (n * (1 - share))) if n0 else 0.0)

    def leaning(f: int) -> bool:
        return np.log(max(seen[1][f], 1e-9) * (1 - share) / (max(seen[0][f], 0.5) * share)) > TAG_RATIO

    def toxic_word(fs: list[int]) -> bool:
        """From the word itself to its shortest stem: the first that is certain decides."""
        for f in (fs[0], *fs[:0:-1]):
            if seen[1][f] + seen[0][f] >= LEAST_DOCS and not leaning(f):
                return False
            if leaning(f) and evidence(seen[1][f], seen[0][f]) > needed:
                return True
        return False

    marked = {w for w, fs in feats.items() if toxic_word(fs)}
    certain = bool(marked)
    if not certain:  # too few labels to be sure of any word: those that lean most, for scores that rank but don't reject
        lean = sorted(((evidence(seen[1][fs[0]], seen[0][fs[0]]), w) for w, fs in feats.items() if leaning(fs[0])), reverse=True)
        marked = {w for _, w in lean[:UNCERTAIN_WORDS]}
    near = {w for w, fs in feats.items() if any(leaning(f) for f in fs)}
    # windows: around words that are toxic, words that are like them, and from anywhere
    rows, tags = [], []
    for y, words in zip(toxic, docs):
        if not words:
            continue
        hits = [i for i, w in enumerate(words) if w in marked][:MARKED_WINDOWS]
        hits += [i for i, w in enumerate(words) if w in near and w not in marked][:NEAR_WINDOWS]
        for i in [*hits, *rng.integers(0, len(words), RANDOM_WINDOWS).tolist()]:
            a = max(0, min(i - WINDOW // 2, len(words) - WINDOW))
            rows.append(words[a : a + WINDOW])
            tags.append([y and w in marked for w in rows[-1]])
    weights, bias, trans = np.zeros(SLOTS), -2.0, np.zeros((2, 2))
    grown, grown_bias, grown_trans = np.full(SLOTS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    sizes = np.array([len(r) for r in rows])
    width = 4
    del seen
    table = {w: feats[w] + [SLOTS] * (width - len(feats[w])) for r in rows for w in r}
    for _ in range(10):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 256)):
            if not len(part):
                continue
            rise, rise_bias, rise_trans = -1e-5 * weights, 0.0, -1e-3 * trans
            padded = np.r_[weights, 0]
            for size in np.unique(sizes[part]):  # windows of short texts are shorter
                some = part[sizes[part] == size]
                at = np.array([[table[w] for w in rows[i]] for i in some])
                given = np.array([tags[i] for i in some], int)
                marginal, steps, _ = _pass_messages(padded[at].sum(2) + bias, trans)
                gap = (given - marginal) / len(part)
                rise += np.bincount(at.ravel(), np.repeat(gap.ravel(), width), SLOTS + 1)[:SLOTS]
                rise_bias += gap.sum()
                counted = np.zeros((2, 2))
                np.add.at(counted, (given[:, :-1].ravel(), given[:, 1:].ravel()), 1)
                rise_trans += (counted - steps) / len(part)
            grown += rise**2
            grown_bias += rise_bias**2
            grown_trans += rise_trans**2
            weights += 0.5 * rise / np.sqrt(grown)
            bias += 0.5 * rise_bias / np.sqrt(grown_bias)
            trans += 0.2 * rise_trans / np.sqrt(grown_trans)
    field = Field(weights, float(bias), trans, np.empty(0))
    lengths = np.array([len(w) for w in docs])
    known = {w: field.evidence(w) for w in feats}
    x = _document_features(*_summary(field.marginals(np.array([known[w] for words in docs for w in words]), lengths), lengths))
    if not marked:  # no word leans to toxic documents: no evidence against any
        return field
    field.ceiling = 1.0 if certain else UNCERTAIN_CEILING
    w, ridge = np.zeros(3), 1 / len(docs)
    each = np.where(label == 1, 0.5 / totals[1], 0.5 / totals[0])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (each * (label - p)) - ridge * w
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w += step
        if abs(step).max() < 1e-9:
            break
    field.document = w
    return field


def train(docs: DataFrame, labels: DataFrame, held_out) -> Field:
    """A field from the bounded sample of labelled rows to which `held_out` says no."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out).distinct()
    rank = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == y).orderBy(rank).limit(SAMPLE_DOCS) for y in (0, 1)]
    # at most twice SAMPLE_DOCS pairs of integers: safe to broadcast, whatever the size of the tables
    sample = F.broadcast(chosen[0].union(chosen[1]).toDF("label_id", "toxic"))
    rows = docs.select("doc_id", "text").where((F.octet_length("text") <= SAMPLE_TEXT) & F.col("text").isNotNull())
    found = rows.join(sample, rows.doc_id == sample.label_id).select("text", "toxic", rank.alias("rank")).orderBy("rank", "text").limit(2 * SAMPLE_DOCS).collect()
    return fit([r.text.encode() for r in found], [r.toxic for r in found])


SCHEMA = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.IntegerType(), False)),
    ]
)


def toxic_spans(text: bytes, marginal: np.ndarray) -> list[int]:
    """Start and end, in code points, of each run of toxic tokens; flat."""
    hot = np.flatnonzero(marginal >= 0.5).tolist()
    if not hot:
        return []
    places = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    if len(places) != len(marginal):  # only for bytes that aren't UTF-8
        return []
    out: list[int] = []
    before = -2
    for i in hot:
        if i == before + 1:
            out[-1] = places[i][1]
        else:
            out += places[i]
        before = i
    return out


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """All columns of docs, score, and spans (start and end of each offending stretch, flat, in code points).

    A column of docs that has the name of a result gives place to it.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in common.others(docs, SCHEMA.fieldNames())))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, docs.schema)), *SCHEMA.fields])
    to = common.arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        known: dict[bytes, float] = {}
        for batch in batches:
            for rows in common.slices(batch, names[at]):
                texts = common.text_bytes(rows.column(at))
                words = [tokens(t) for t in texts]
                if len(known) > CACHED_WORDS:
                    known.clear()
                for w in {w for each in words for w in each if w not in known}:
                    known[w] = field.evidence(w)
                lengths = np.array([len(w) for w in words])
                evidence = np.array([known[w] for each in words for w in each], float)
                marginal = field.marginals(evidence, lengths)
                scores = field.score(*_summary(marginal, lengths))
                ends = np.cumsum(lengths)
                spans = [toxic_spans(t, marginal[b - n : b]) for t, b, n in zip(texts, ends, lengths)]
                columns = [*rows.columns, pa.array(scores), pa.array(spans, to.field("spans").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, to)], schema=to)

    done = common.map_arrow(docs.toDF(*names), run, schema)
    return done.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)), *SCHEMA.fieldNames())


def held_out(id_col: str = "doc_id"):
    """Rows that are kept from training: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def remove_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without those that score THRESHOLD or more; the columns stay as they were."""
    names = [f"d{i}" for i in range(len(docs.columns))]
    field = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, held_out())
    scored = score(docs.toDF(*names), field, names[docs.columns.index(text_col)])
    return scored.where(F.col("score") < THRESHOLD).select(*names).toDF(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a field trained outside the held-out rows."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    field = train(docs, common.table(spark, sf_dir, "labels"), held_out())
    return score(docs, field).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.col("spans").cast("array<string>"), ",").alias("span_offsets"),
    )
