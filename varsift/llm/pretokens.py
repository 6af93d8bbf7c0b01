"""Pre-tokenisation without regular expressions.

The byte-level BPE split pattern is run as a Mealy machine over code-point classes. A character's class already holds
its bounded look-ahead (space before a non-space, apostrophe before a contraction), so one state transition a character
is enough. Transition functions compose associatively: the class array is cut into rows, every row's function is
scanned for all start states at once, the rows' functions are combined by doubling, and a second scan from the right
entry states marks the boundaries. All steps are vectorised over rows; no state crosses a document, as the break class
between documents has a constant transition.

Classes of code points come from the rank-file tokenizer library, asked once on the driver, and travel as a short
list of ranges (the JSON tokenizer library was asked character by character too: it has the same 831 ranges).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from varsift.llm.piece_cache import PieceCache

LETTER, NUMBER, OTHER, SPACE, WHITE, BREAK, SPACE_NEXT, WHITE_NEXT, QUOTE2, QUOTE3 = range(10)
START, IN_LETTER, IN_NUMBER, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8
WIDTH = 128
#: Bytes of text that are split into pieces at once; each takes some thirty bytes of work space.
PORTION = 1 << 20

Ranges = tuple[tuple[int, int, int], ...]


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cut-before-this-character, both at [class * STATES + state]."""
    step = np.zeros((10, STATES), np.uint8)
    cut = np.ones((10, STATES), bool)
    for kind, run in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        step[kind] = run
        cut[kind, [run, AFTER_SPACE]] = False
    for kind, rest in ((QUOTE2, ONE_LEFT), (QUOTE3, TWO_LEFT)):
        step[kind] = rest
        step[kind, [IN_OTHER, AFTER_SPACE]] = IN_OTHER
        cut[kind, [IN_OTHER, AFTER_SPACE]] = False
    step[[SPACE, WHITE]] = IN_WHITE
    cut[[SPACE, WHITE], IN_WHITE] = False
    step[SPACE_NEXT], step[WHITE_NEXT], step[BREAK] = AFTER_SPACE, IN_WHITE, START
    # inside a contraction only its letters follow
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, START
    cut[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    return step.ravel(), cut.ravel()


STEP, CUT = _machine()


def _as_ranges(kinds: np.ndarray) -> Ranges:
    edges = np.flatnonzero(np.diff(kinds)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(kinds)]
    return tuple((int(a), int(b), int(kinds[a])) for a, b in zip(starts, ends) if kinds[a] != OTHER)


def _all_characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(1)
def rank_library_classes() -> Ranges:
    """Letters, numbers and white space as the rank-file library's pattern engine knows them."""
    import tiktoken

    every = _all_characters()
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        kinds[[ord(c) for c in probe.decode(probe.encode_ordinary(every))]] = kind
    kinds[0x20] = SPACE
    return _as_ranges(kinds)


@lru_cache(4)
def class_table(ranges: Ranges) -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for a, b, kind in ranges:
        table[a:b] = kind
    return table


def classes_of(points: np.ndarray, breaks: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Classes with look-ahead. points ends with a break; breaks are the positions of all breaks."""
    kinds = class_table(ranges)[points]
    kinds[breaks] = BREAK
    solid = np.r_[kinds[1:] <= OTHER, False]
    kinds[(kinds == SPACE) & solid] = SPACE_NEXT
    kinds[(kinds == WHITE) & solid] = WHITE_NEXT
    quotes = np.flatnonzero((points == 39) & (kinds == OTHER))
    if len(quotes):
        padded = np.r_[points, 0, 0]
        padded[breaks] = 0
        a, b = padded[quotes + 1], padded[quotes + 2]
        kinds[quotes[np.isin(a, [ord(c) for c in "stmd"])]] = QUOTE2
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        kinds[quotes[three]] = QUOTE3
    return kinds


def cuts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, breaks included."""
    n = len(kinds)
    rows = -(-n // WIDTH)
    grid = np.full(rows * WIDTH, BREAK, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, WIDTH).T) * STATES
    # 1. each row's transition function, for all states until it is constant everywhere, as it soon is
    images = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for j in range(WIDTH):
        images = STEP.take(grid[j] + images)
        if len(images) > 1 and j % 4 == 3 and (images == images[0]).all():
            images = images[:1]
    functions = np.broadcast_to(images, (STATES, rows)).copy()
    # 2. inclusive scan of the functions by doubling; composition is associative
    gap, where = 1, np.arange(rows)
    while gap < rows and not (functions == functions[0]).all():
        functions[:, gap:] = functions[functions[:, :-gap], where[gap:]]
        gap *= 2
    state = np.r_[np.uint8(START), functions[START, :-1]]
    # 3. the boundaries, from the right entry states
    found = np.empty((WIDTH, rows), bool)
    for j in range(WIDTH):
        at = grid[j] + state
        found[j] = CUT.take(at)
        state = STEP.take(at)
    return np.flatnonzero(found.T.ravel()[:n])


#: A blank behind a visible ASCII character: a piece begins there, whatever stands before and behind.
_CUT = re.compile(rb"[!-~](?= )")


def portions(texts: list[bytes], most: int = PORTION) -> Iterator[tuple[list[bytes], list[int]]]:
    """The texts in portions of about `most` bytes, and the text that each part belongs to.

    Texts longer than that are cut where a piece begins in any case; one without such a place stays whole.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        a = 0
        while a < len(text) or not text:
            found = _CUT.search(text, a + most) if len(text) - a > most else None
            b = found.end() if found else len(text)
            parts.append(text[a:b])
            owners.append(i)
            held += b - a
            a = b
            if held >= most:
                yield parts, owners
                parts, owners, held = [], [], 0
            if not text:
                break
    if parts:
        yield parts, owners


class Pieces:
    """Pieces of a list of texts: byte slices, and where each text's slices begin in the list of slices."""

    def __init__(self, texts: list[bytes], ranges: Ranges):
        texts = [t.decode("utf-8", "replace") for t in texts]
        joined = "\0".join(texts) + "\0"
        self.buffer = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        at = cuts(classes_of(points, breaks, ranges))
        width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        byte = np.r_[0, np.cumsum(width, dtype=np.int64)]
        starts, ends = byte[at], byte[np.r_[at[1:], len(points)]]
        is_break = np.zeros(len(points), bool)
        is_break[breaks] = True
        keep = ~is_break[at]
        self.char_starts = at[keep]
        self.starts, self.ends = starts[keep], ends[keep]
        self.first_char = np.r_[0, breaks[:-1] + 1]
        self.first_byte = byte[self.first_char]
        self.bounds = np.searchsorted(self.char_starts, np.r_[self.first_char, len(points)])

    def slices(self) -> list[bytes]:
        buffer = self.buffer
        return [buffer[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]


def encode(texts: list[bytes], ranges: Ranges, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the ends of the texts among them, from 0 on."""
    found, counts = [np.empty(0, np.uint32)], np.zeros(len(texts) + 1, np.int64)
    for parts, owners in portions(texts):
        pieces = Pieces(parts, ranges)
        ids, sizes = cache.look_up(pieces.buffer, pieces.starts, pieces.ends)
        found.append(ids)
        np.add.at(counts, np.array(owners) + 1, np.diff(np.r_[0, np.cumsum(sizes, dtype=np.int64)][pieces.bounds]))
    return np.concatenate(found), np.cumsum(counts)
