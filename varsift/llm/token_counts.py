"""Edit-aware token counts (operator 4).

A document keeps its pieces (pre-tokens) with their lengths and token counts in blocks, and a segment tree sums the
blocks. An edit re-encodes only the pieces that it touches and a bounded context, as whether a piece begins at a place
depends on the four characters before it and the three behind it: pieces that start three characters or more before the
edit, or four or more behind it, stay. The new pieces replace the old ones in their blocks, and the sums on the paths to
the root are updated; the total is the root.

Edits are made in rounds over the documents of a batch, so that all re-encoded stretches of a round are split at once.

Defined cases: a null text is an empty one; an edit beyond the text is cut to it; a null or empty list of edits, or an
edit with null parts, changes nothing there; repeated rows give repeated results; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varsift.llm import common, pretokens
from varsift.llm.bpe import _worker

BLOCK = 64
BEFORE, BEHIND = 3, 4


class SegmentTree:
    """Pieces of a text as (characters, tokens) in blocks under a binary tree of sums."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.blocks = [(chars[a : a + BLOCK], tokens[a : a + BLOCK]) for a in range(0, len(chars), BLOCK)] or [([], [])]
        self._build()

    def _build(self) -> None:
        n = len(self.blocks)
        self.size = 1 << (n - 1).bit_length() if n > 1 else 1
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (c, t) in enumerate(self.blocks):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(c), sum(t)
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int, int]:
        """Block, piece in it, and start of the piece that holds character `at`; the end for the text's length."""
        i, start = 1, 0
        if at >= self.length:
            return len(self.blocks) - 1, len(self.blocks[-1][0]), self.length
        while i < self.size:
            i *= 2
            if start + self.chars[i] <= at:
                start += self.chars[i]
                i += 1
        b = i - self.size
        for p, n in enumerate(self.blocks[b][0]):
            if start + n > at:
                return b, p, start
            start += n
        raise AssertionError("sums and blocks disagree")

    def before(self, at: int) -> int:
        """Tokens of the pieces that end at or before character `at`: a walk from the root."""
        b, p, _ = self.find(at)
        i, total = b + self.size, sum(self.blocks[b][1][:p])
        while i > 1:
            if i % 2:
                total += self.tokens[i - 1]
            i //= 2
        return total

    def splice(self, first: tuple[int, int], last: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Replace the pieces from first up to last, each a (block, piece) place."""
        (a, p), (b, q) = first, last
        c = self.blocks[a][0][:p] + chars + self.blocks[b][0][q:]
        t = self.blocks[a][1][:p] + tokens + self.blocks[b][1][q:]
        if a == b and 0 < len(c) <= 2 * BLOCK:
            self.blocks[a] = (c, t)
            i = a + self.size
            self.chars[i], self.tokens[i] = sum(c), sum(t)
            while i > 1:
                i //= 2
                self._add(i)
            return
        self.blocks[a : b + 1] = [(c[k : k + BLOCK], t[k : k + BLOCK]) for k in range(0, len(c), BLOCK)]
        if not self.blocks:
            self.blocks = [([], [])]
        self._build()


class Document:
    """A text with its tree."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.tree, self.encoded = text, SegmentTree(chars, tokens), 0

    def stretch(self, at: int, cut: int, put: str) -> tuple[str, int, tuple]:
        """Apply an edit to the text; the stretch to split anew with its context behind, the number of its characters
        that count, and where its pieces go."""
        at = min(max(at, 0), len(self.text))
        cut = min(max(cut, 0), len(self.text) - at)
        a, p, start = self.tree.find(max(0, at - BEFORE))
        b, q, end = self.tree.find(min(len(self.text), at + cut + BEHIND))
        if end < min(len(self.text), at + cut + BEHIND):  # the place is within a piece: that piece goes as well
            end += self.tree.blocks[b][0][q]
            q += 1
        fresh = self.text[start:at] + put + self.text[at + cut : end]
        behind = self.text[end : end + BEHIND]
        self.text = self.text[:at] + put + self.text[at + cut :]
        return fresh + behind, len(fresh), ((a, p), (b, q))


RESULT = "doc_id long, n_tokens long, n_tokens_edited long, n_pieces long, n_reencoded long"


def count_edited(docs: DataFrame, ranks_path: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts before and after the edits of each row, and how many pieces were encoded for them.

    edits: array of structs (at, cut, put), applied one after the other: cut characters go at `at`, and put comes in.
    """
    ranges = pretokens.rank_library_classes()
    kind = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("cut", T.IntegerType()), T.StructField("put", T.StringType())]))

    def counted(pieces: pretokens.Pieces, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        cache = _worker(ranks_path)[0]
        tokens = cache.look_up(pieces.buffer, pieces.starts, pieces.ends)[1].tolist()
        bounds = pieces.bounds.tolist()
        out = []
        for i, t in enumerate(texts):
            a, b = bounds[i], bounds[i + 1]
            starts = pieces.char_starts[a:b] - pieces.first_char[i]
            out.append((np.diff(np.r_[starts, len(t)]).tolist() if b > a else [], tokens[a:b]))
        return out

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        raw = common.text_bytes(rows.column(1))
        texts = [t.decode("utf-8", "replace") for t in raw]
        docs = [Document(t, c, n) for t, (c, n) in zip(texts, counted(pretokens.Pieces(raw, ranges), texts))]
        before = [(d.tree.total, sum(len(c) for c, _ in d.tree.blocks)) for d in docs]
        lists = [[e for e in x or [] if e and None not in e.values()] for x in rows.column(2).to_pylist()]
        for turn in range(max(map(len, lists), default=0)):
            some = [i for i, x in enumerate(lists) if len(x) > turn]
            parts = [docs[i].stretch(**lists[i][turn]) for i in some]
            fresh = [p[0] for p in parts]
            for i, (_, n, (first, last)), (chars, tokens) in zip(some, parts, counted(pretokens.Pieces([f.encode() for f in fresh], ranges), fresh)):
                # the context behind belongs to pieces that stay: what starts in it is dropped
                starts = np.cumsum([0, *chars])[:-1]
                k = int(np.searchsorted(starts, n))
                chars = chars[:k]
                if k:
                    chars[-1] = n - int(starts[k - 1])
                docs[i].tree.splice(first, last, chars, tokens[:k])
                docs[i].encoded += k
        columns = [rows.column(0), [b for b, _ in before], [d.tree.total for d in docs], [p for _, p in before], [d.encoded for d in docs]]
        return pa.RecordBatch.from_arrays([columns[0], *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["doc_id", "n_tokens", "n_tokens_edited", "n_pieces", "n_reencoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.cast(kind).alias("edits"))
    return common.map_texts(rows, "text", batch, RESULT)


def sample_edits(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Three edits of each document: words put in at a place that its id picks, a stretch cut near the end, and a
    replacement in the middle. An own choice, as the tables hold no edits."""
    n = F.coalesce(F.length(text_col), F.lit(0))
    pick = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % (n + 1)
    edit = lambda at, cut, put: F.struct(at.cast("int").alias("at"), cut.cast("int").alias("cut"), put.alias("put"))
    return F.array(edit(pick, F.lit(0), F.lit(" it's new, isn't it? ")), edit(n - F.least(n, F.lit(60)), F.lit(25), F.lit("")), edit(F.floor(n / 2), F.least(n, F.lit(12)), F.concat(F.lit("v"), F.col(id_col).cast("string"))))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return count_edited(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), sample_edits())
