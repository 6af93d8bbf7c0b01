"""Plain versions of the operators' contracts, from their definitions, on lists of rows."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib

import numpy as np

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def op2(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def op3(rows):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)
            out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    return out


def op5(rows, benchmark):
    windows: dict[tuple, set] = {}
    for item, text in benchmark:
        w = words(text)
        if item is not None and w:
            for a in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[a : a + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        w = words(text)
        hit, items = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    items |= found
                    hit[a : a + n] = [True] * n
        k = sum(hit)
        out.append((doc_id, len(w), k, len(items), sha(",".join(sorted(map(str, items)))), k > 0 and 20 * k >= len(w)))
    return out


def op6(rows):
    assign = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = []
    for doc_id, text in rows:
        t = text or ""
        found = {
            "assign": [m.span() for m in assign.finditer(t) if len(m[1]) >= 8],
            "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
            "hex": [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32],
        }
        every = sorted((a, k, b, kind) for k, kind in enumerate(found) for a, b in found[kind])
        out.append((doc_id, *map(len, found.values()), sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in every))))
    return out


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7(rows):
    out = []
    for page, url in rows:
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
            host = host.translate(LOWER)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        out.append((page, host, path, best[1], best[2]))
    return out


def fingerprint(text, k=3):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op8(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = {f: f for f in prints}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    distinct = list(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    least: dict = {}
    for (doc_id, _), f in zip(rows, prints):
        if doc_id is not None:
            least[top(f)] = min(least.get(top(f), doc_id), doc_id)
    return [(doc_id, f"{f:016x}", least.get(top(f))) for (doc_id, _), f in zip(rows, prints)]


def rank_encoding():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def op9(rows):
    e = rank_encoding()
    out = []
    for doc_id, text in rows:
        ids = e.encode_ordinary(text or "")
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), hashlib.sha256(e.decode_bytes(ids)).hexdigest()))
    return out


def op4(rows):
    """Tokens of whole texts before and after the query's three edits."""
    e = rank_encoding()
    out = []
    for doc_id, text in rows:
        t = text or ""
        n = len(t)
        pick = zlib.crc32(str(doc_id).encode()) % (n + 1) if doc_id is not None else 0
        edits = [(pick, 0, " it's new, isn't it? "), (n - min(n, 60), 25, "")]
        if doc_id is not None:
            edits.append((n // 2, min(n, 12), f"v{doc_id}"))
        edited = t
        for at, cut, put in edits:
            at = min(at, len(edited))
            edited = edited[:at] + put + edited[at + cut :]
        out.append((doc_id, len(e.encode_ordinary(t)), len(e.encode_ordinary(edited))))
    return out


def marginals(evidence, trans):
    """Marginals of state 1 by forward and backward sums in logarithms, token by token."""
    n = len(evidence)
    local = np.c_[np.zeros(n), np.clip(evidence, -30, 30)]
    forward, backward = local.copy(), np.zeros((n, 2))
    for t in range(1, n):
        forward[t] += np.logaddexp(forward[t - 1][0] + trans[0], forward[t - 1][1] + trans[1])
    for t in range(n - 2, -1, -1):
        ahead = local[t + 1] + backward[t + 1]
        backward[t] = np.logaddexp(trans[:, 0] + ahead[0], trans[:, 1] + ahead[1])
    both = forward + backward
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1])) if n else np.zeros(0)


def op1(rows, field):
    """Scores by the trained field, text by text."""
    out = []
    for doc_id, text in rows:
        found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").translate(LOWER))
        m = marginals(np.array([field.evidence(w.encode()) for w in found]), field.trans)
        largest, expected = max(m, default=0.0), sum(x for x in m if x >= 0.05)
        sure = min(max(largest, 1e-6), 1 - 1e-6)
        x = np.array([1, np.log(sure / (1 - sure)) / 5, np.log1p(expected)])
        out.append((doc_id, field.ceiling / (1 + np.exp(-x @ field.document)) if len(field.document) else 0.0))
    return out


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def op10(rows):
    out = []
    for doc_id, text in rows:
        w = words(text)
        places = sorted((a, label) for p, label in PHRASES.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split())
        out.append((doc_id, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))))
    return out
