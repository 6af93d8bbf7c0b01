"""Trimming and merging read by read and place by place, from their definitions; the operators do the same by batches."""

from __future__ import annotations

import numpy as np

_COMPLEMENT = str.maketrans("acgtACGT", "tgcaTGCA")


def _place(read: np.ndarray, adapter: np.ndarray, rate: float, overlap: int, at_start: bool) -> tuple[int, int] | None:
    """Start and end of the best occurrence: whole anywhere, or cut off by the read's start (or end)."""
    n, m = len(read), len(adapter)
    best = None
    lowest = -(m - 1) if at_start else 0
    for a in range(lowest, n if not at_start else n - m + 1):
        part = adapter[max(0, -a) : n - a if a + m > n else m]
        if len(part) < min(overlap, m) or (a + m > n and at_start):
            continue
        errors = int((read[max(0, a) : max(0, a) + len(part)] != part).sum())
        if errors <= rate * len(part):
            rank = (-(len(part) - errors), errors, a)
            if best is None or rank < best[0]:
                best = (rank, max(0, a), max(0, a) + len(part))
    return None if best is None else best[1:]


def trim_span(seq: str | None, adapter, rate: float, overlap: int) -> tuple[int, int, bool]:
    """What is left of a read, and whether its adapters were found."""
    read = np.frombuffer((seq or "").upper().encode("latin-1", "replace"), np.uint8)
    start, end, hits, needs = 0, len(read), [], []
    if adapter.five:
        found = _place(read, np.frombuffer(adapter.five.upper().encode(), np.uint8), rate, overlap, True)
        start = found[1] if found else 0
        hits.append(found is not None)
        needs.append(adapter.five_required)
    if adapter.three:
        found = _place(read[start:], np.frombuffer(adapter.three.upper().encode(), np.uint8), rate, overlap, False)
        end = start + found[0] if found else end
        hits.append(found is not None)
        needs.append(adapter.three_required)
    linked = len(hits) == 2 and not all(needs)
    return start, end, all(h or not n for h, n in zip(hits, needs)) if linked else any(hits)


def merge_pair(seq1: str, qual1: str, seq2: str, qual2: str, least_overlap: int, most_differences: int, most_errors: float, least_length: int, top_quality: int) -> tuple[str | None, str | None, str | None]:
    """seq, qual and reason to fail of an overlapping pair; ungapped, staggered ends allowed, posterior qualities."""
    a, b = (np.frombuffer(s.upper().encode(), np.uint8) for s in (seq1, seq2.translate(_COMPLEMENT)[::-1]))
    qa, qb = (np.frombuffer(q.encode(), np.uint8).astype(int) - 33 for q in (qual1, qual2[::-1]))
    if min(len(a), len(b)) < least_length:
        return None, None, "Too_short"
    best = None
    for start in range(-(len(b) - 1), len(a)):
        lo, hi = max(0, start), min(len(a), start + len(b))
        if hi - lo < least_overlap:
            continue
        differ = int((a[lo:hi] != b[lo - start : hi - start]).sum())
        score = (hi - lo) - 4 * differ
        if best is None or score > best[0]:
            best = (score, start, lo, hi, differ)
    if best is None:
        return None, None, "Overlap_too_short"
    score, start, lo, hi, differ = best
    if score <= 0:
        return None, None, "No_alignment_found"
    if differ > most_differences:
        return None, None, "Too_many_diffs"
    x, y, px, py = a[lo:hi], b[lo - start : hi - start], 10 ** (-qa[lo:hi] / 10), 10 ** (-qb[lo - start : hi - start] / 10)
    same = x == y
    high, low = np.minimum(px, py), np.maximum(px, py)
    p = np.where(same, px * py / 3 / (1 - px - py + 4 * px * py / 3), high * (1 - low / 3) / (px + py - 4 * px * py / 3))
    middle = np.where(same | (px <= py), x, y)
    quality = np.clip(np.round(-10 * np.log10(np.maximum(p, 1e-10))), 2, top_quality).astype(int)
    # before the overlap stands the first read, behind it the second; what overhangs on the far side is cut
    seq = np.concatenate([a[:lo] if start >= 0 else a[:0], middle, b[hi - start :] if hi - start < len(b) and hi == len(a) else b[:0]])
    qual = np.concatenate([qa[:lo] if start >= 0 else qa[:0], quality, qb[hi - start :] if hi - start < len(b) and hi == len(a) else qb[:0]])
    if len(seq) < least_length:
        return None, None, "Too_short"
    if (10 ** (-qual / 10)).sum() > most_errors:
        return None, None, "Exp.errs._too_high"
    return seq.tobytes().decode(), "".join(chr(q + 33) for q in np.minimum(qual, top_quality)), None
