"""Read processing: quality gates, demultiplexing, trimming, orientation, merging of pairs, and read statistics.

Gates and statistics are expressions. Barcode and adapter matching and pair merging work base by base against a handful
of constants and run as Arrow-batched pandas UDFs. Matching is without gaps: of several places the one with the fewest
errors wins, then the longest, then the leftmost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varsift.functions import sequence
from varsift.plans.config import RunConfig
from varsift.shipping import ship

GATES = ["Too_short", "Min_Q_too_low", "Exp.errs._too_high"]


def least_quality(qual: str) -> Column:
    return F.array_min(sequence.phred(qual))


def quality_filter(reads: DataFrame, min_qual: int, qual: str = "qual") -> DataFrame:
    """Reads without a base below min_qual; an empty quality passes."""
    return reads.where(F.coalesce(least_quality(qual), F.lit(min_qual)) >= min_qual)


def pair_gate(config: RunConfig) -> Column:
    """The first gate that a pair (seq1, qual1, seq2, qual2) fails: length, base quality, expected errors; else null."""
    low = F.least(*[F.coalesce(least_quality(q), F.lit(config.vsearch_min_qual)) for q in ("qual1", "qual2")])
    errors = sequence.expected_errors("qual1") + sequence.expected_errors("qual2")
    return (
        F.when(F.least(F.length("seq1"), F.length("seq2")) < config.cutadapt_min_length, GATES[0])
        .when(low < config.vsearch_min_qual, GATES[1])
        .when(errors > config.vsearch_max_ee, GATES[2])
    )


def concatenate(pairs: DataFrame, config: RunConfig) -> DataFrame:
    """Trans libraries: seq and qual of both mates, the second reverse-complemented on request, and fail_reason."""
    turned = config.trans_library_reverse_complement
    seq2 = sequence.reverse_complement("seq2") if turned else F.col("seq2")
    qual2 = F.reverse("qual2") if turned else F.col("qual2")
    return pairs.withColumns({"fail_reason": pair_gate(config), "seq": F.concat("seq1", seq2), "qual": F.concat("qual1", qual2)})


def read_statistics(reads: DataFrame, by: str = "sample_id") -> DataFrame:
    """Counters of each sample: pairs, merged, and each reason to fail."""
    reasons = ["Too_short", "No_alignment_found", "Too_many_diffs", "Overlap_too_short", "Exp.errs._too_high", "Min_Q_too_low"]
    counted = [F.count_if(F.coalesce(F.col("fail_reason") == r, F.lit(False))).alias(r.replace(".", "")) for r in reasons]
    return reads.groupBy(by).agg(F.count("*").alias("Pairs"), F.count_if(F.col("fail_reason").isNull()).alias("Merged"), *counted)


def length_quantiles(reads: DataFrame, by: str = "sample_id", seq: str = "seq") -> DataFrame:
    """Lengths at places 0, n/4, n/2, 3n/4 and n-1 of the sorted lengths, from their histogram alone."""
    histogram = reads.groupBy(by, F.length(seq).alias("length")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(by).orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(by))})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("length")))
    n = F.col("n")
    return placed.groupBy(by).agg(
        F.min("length").alias("length_min"),
        at(F.floor(n / 4)).alias("length_low"),
        at(F.floor(n / 2)).alias("length_median"),
        at(F.floor(n * 3 / 4)).alias("length_high"),
        F.max("length").alias("length_max"),
    )


def quality_by_position(reads: DataFrame, by: str = "file", qual: str = "qual") -> DataFrame:
    """Quality control: number, mean and quartiles of the scores at each position."""
    each = reads.select(by, F.posexplode(sequence.phred(qual)).alias("pos", "q"))
    q = [F.percentile("q", F.lit(p)).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    return each.groupBy(by, (F.col("pos") + 1).alias("position")).agg(F.count("*").alias("n"), F.avg("q").alias("mean"), *q)


def base_composition(reads: DataFrame, by: str = "file", seq: str = "seq") -> DataFrame:
    """Quality control: number of each base at each position."""
    return reads.select(by, F.posexplode(sequence.encode(seq)).alias("pos", "base")).groupBy(by, (F.col("pos") + 1).alias("position"), F.upper("base").alias("base")).agg(F.count("*").alias("n"))


# --- demultiplexing ---------------------------------------------------------------------------------------------


def _matrix(seqs: pd.Series, width: int, fill: str = "-") -> np.ndarray:
    flat = "".join(s[:width].upper().ljust(width, fill) for s in seqs.fillna("")).encode("latin-1", "replace")
    return np.frombuffer(flat, np.uint8).reshape(len(seqs), width)


def barcode_errors(seqs: pd.Series, barcodes: list[str]) -> np.ndarray:
    """Mismatches of every read's beginning with every barcode."""
    out = np.zeros((len(seqs), len(barcodes)), np.int32)
    for width in {len(b) for b in barcodes}:
        bases = _matrix(seqs, width)
        for i, b in enumerate(barcodes):
            if len(b) == width:
                out[:, i] = (bases != np.frombuffer(b.upper().encode(), np.uint8)).sum(1)
    return out


def nearest_barcode(barcodes1: list[str], barcodes2: list[str] | None, rate: float):
    """pandas UDF: index of the barcode (pair) within the error rate and nearest to the reads' beginnings, or null."""

    def pick(errors: list[np.ndarray]) -> pd.Series:
        sides = [barcodes1, barcodes2][: len(errors)]
        good = np.logical_and.reduce([e <= np.floor(rate * np.array([len(b) for b in s])) for e, s in zip(errors, sides)])
        total = np.where(good, np.add.reduce(errors), 1 << 20)
        best = total.argmin(1)
        found = total[np.arange(len(best)), best] < 1 << 20
        return pd.Series(np.where(found, best, -1)).astype("Int32").where(pd.Series(found))

    if barcodes2 is None:

        @F.pandas_udf("int")
        def single(seq1: pd.Series) -> pd.Series:
            return pick([barcode_errors(seq1, barcodes1)])

        return single.asNondeterministic()  # once a read, not once for each use

    @F.pandas_udf("int")
    def paired(seq1: pd.Series, seq2: pd.Series) -> pd.Series:
        return pick([barcode_errors(seq1, barcodes1), barcode_errors(seq2, barcodes2)])

    return paired.asNondeterministic()


def demultiplex(reads: DataFrame, design: list[dict], rate: float, paired: bool = True) -> DataFrame:
    """sample_id (the row's new_pair_prefix; null: unknown) and reads without their barcodes."""
    ship(reads.sparkSession)
    first, second = [r["barcode1"] for r in design], [r["barcode2"] for r in design]
    which = nearest_barcode(first, second if paired else None, rate)(*["seq1", "seq2"][: 1 + paired])
    lit = lambda xs: F.array(*map(F.lit, xs))
    out = reads.withColumn("_b", which).withColumn("sample_id", F.get(lit([r["new_pair_prefix"] for r in design]), F.col("_b")))
    for side, codes in (("1", first), ("2", second))[: 1 + paired]:
        cut = F.coalesce(F.length(F.get(lit(codes), F.col("_b"))), F.lit(0))
        out = out.withColumns({f"{k}{side}": F.substring(F.col(f"{k}{side}"), cut + 1, F.length(f"{k}{side}")) for k in ("seq", "qual")})
    return out.drop("_b")


# --- trimming ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Adapter:
    """An adapter; linked ones (five;required...three;optional) are split on construction."""

    five: str | None = None
    three: str | None = None
    five_required: bool = True
    three_required: bool = True

    @classmethod
    def of(cls, five: str | None, three: str | None) -> Adapter:
        if three and "..." in three:
            parts = [p.split(";") for p in three.split("...")]
            return cls(parts[0][0], parts[1][0], "required" in parts[0], "required" in parts[1])
        return cls(five, three)

    @property
    def linked(self) -> str:
        """Both as one: the read begins with the first and may end before the second."""
        return f"{self.five};required...{self.three};optional"


def _codes(adapter: str) -> np.ndarray:
    return np.frombuffer(adapter.upper().encode(), np.uint8)


def places(bases: np.ndarray, lengths: np.ndarray, adapter: np.ndarray, rate: float, overlap: int, at_start: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every read whether the adapter occurs, and start and end of its best occurrence: whole anywhere, or cut off by
    the read's start (or end). Most matches win, then fewest errors, then the leftmost place.

    bases: a row of codes for each read, filled up with zeros by the adapter's length at least.
    """
    n, m = len(bases), len(adapter)
    most = int(lengths.max(initial=0))
    matches, errors = np.full(n, -1), np.zeros(n, np.int64)
    start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(-(m - 1) if at_start else 0, most - m + 1 if at_start else most):
        first = max(0, a)
        part = adapter[first - a :]
        width = np.minimum(len(part), lengths - first)
        # what lies beyond a read's end are zeros, which no adapter has
        equal = (bases[:, first : first + len(part)] == part).sum(1)
        wrong = width - equal
        good = (width >= min(overlap, m)) & (wrong <= rate * width)
        if at_start:
            good &= lengths >= a + m
        good &= (equal > matches) | ((equal == matches) & (wrong < errors))
        matches[good], errors[good], start[good], end[good] = equal[good], wrong[good], first, first + width[good]
    return matches >= 0, start, end


def trim_spans(seqs: pd.Series, adapter: Adapter, rate: float, overlap: int) -> pd.DataFrame:
    """start and end of what is left of each read, and whether its adapters were found."""
    lengths = seqs.str.len().fillna(0).to_numpy(np.int64)
    start, end = np.zeros(len(seqs), np.int64), lengths.copy()
    spare = max(len(adapter.five or ""), len(adapter.three or ""))
    bases = _matrix(seqs, int(lengths.max(initial=0)) + spare, "\0")
    hits, needs = [], []
    if adapter.five:
        hit, _, behind = places(bases, lengths, _codes(adapter.five), rate, overlap, True)
        start = np.where(hit, behind, 0)
        hits.append(hit)
        needs.append(adapter.five_required)
    if adapter.three:
        at = np.minimum(start[:, None] + np.arange(bases.shape[1]), bases.shape[1] - 1)
        hit, before, _ = places(np.take_along_axis(bases, at, 1), lengths - start, _codes(adapter.three), rate, overlap, False)
        end = np.where(hit, start + before, end)
        hits.append(hit)
        needs.append(adapter.three_required)
    linked = len(hits) == 2 and not all(needs)
    found = np.logical_and.reduce([h | (not n) for h, n in zip(hits, needs)]) if linked else np.logical_or.reduce(hits)
    return pd.DataFrame({"start": start, "end": end, "found": found})


def trim(reads: DataFrame, side: str, adapter: Adapter, rate: float, overlap: int, cut_front: int = 0, cut_back: int = 0) -> DataFrame:
    """Trim seq{side} and qual{side}; trimmed{side} tells whether an adapter was found. Fixed cuts come first."""
    seq, qual = f"seq{side}", f"qual{side}"
    length = F.greatest(F.length(seq) - cut_front - cut_back, F.lit(0))
    reads = reads.withColumns({c: F.substring(F.col(c), F.lit(cut_front + 1), length) for c in (seq, qual)})
    if not adapter.five and not adapter.three:
        return reads.withColumn(f"trimmed{side}", F.lit(False))

    ship(reads.sparkSession)

    @F.pandas_udf("start int, end int, found boolean")
    def spans(seqs: pd.Series) -> pd.DataFrame:
        return trim_spans(seqs, adapter, rate, overlap)

    reads = reads.withColumn("_t", spans.asNondeterministic()(seq))
    at, width = F.col("_t.start") + 1, F.col("_t.end") - F.col("_t.start")
    return reads.withColumns({seq: F.substring(F.col(seq), at, width), qual: F.substring(F.col(qual), at, width), f"trimmed{side}": F.col("_t.found")}).drop("_t")


# Design columns that ask for trimming.
TRIM_COLUMNS = ["cutadapt5First", "cutadapt5Second", "cutadapt3First", "cutadapt3Second", "cutadaptCut5First", "cutadaptCut5Second", "cutadaptCut3First", "cutadaptCut3Second"]
CONFIG_COLUMNS = dict(zip(TRIM_COLUMNS, ["cutadapt_5_first", "cutadapt_5_second", "cutadapt_3_first", "cutadapt_3_second", "cutadapt_cut_5_first", "cutadapt_cut_5_second", "cutadapt_cut_3_first", "cutadapt_cut_3_second"]))


def needs_trimming(row: dict) -> bool:
    return any(row.get(c) is not None for c in TRIM_COLUMNS)


def trim_options(row: dict, config: RunConfig) -> dict:
    """Options of a design row; the run's options stand in for those that the design leaves open."""
    return {c: row.get(c) if row.get(c) is not None else getattr(config, CONFIG_COLUMNS[c]) for c in TRIM_COLUMNS}


def shortest_variant(config: RunConfig) -> int:
    """Bases of the shortest sequence that a run keeps."""
    whole = len(config.wt_nt_seq)
    return whole if not config.retain_indels else min(whole, *config.indel_lengths, whole) if config.indel_lengths else 1


def link_adapters(row: dict, config: RunConfig) -> dict:
    """The row with linked adapters for those mates that reach, behind the 5' adapter and the shortest variant, into the
    3' one."""
    linked = {}
    for mate, name in enumerate(("First", "Second"), 1):
        five, three = f"cutadapt5{name}", f"cutadapt3{name}"
        adapter, length = Adapter.of(row.get(five), row.get(three)), row.get(f"pair{mate}_length")
        if length is None or not adapter.five or not adapter.three or "..." in row[three]:
            continue
        cuts = sum(int(row.get(f"cutadaptCut{end}{name}") or 0) for end in (5, 3))
        if int(length) - cuts > len(adapter.five) + shortest_variant(config):
            linked |= {three: adapter.linked, five: None}
    return row | linked


def trim_pairs(reads: DataFrame, row: dict, config: RunConfig) -> DataFrame:
    """Trim by a design row. Reads without any adapter are dropped unless the row only cuts or says so, and so are
    those that get too short."""
    asked = trim_options(row, config)
    if not needs_trimming(asked):
        return reads
    rate = float(row.get("cutadaptErrorRate") or config.cutadapt_error_rate)
    overlap = int(row.get("cutadaptOverlap") or config.cutadapt_overlap)
    least = int(row.get("cutadaptMinLength") or config.cutadapt_min_length)
    sides = (("1", "First"), ("2", "Second"))[: 1 + config.paired]
    found = []
    for side, name in sides:
        adapter = Adapter.of(asked[f"cutadapt5{name}"], asked[f"cutadapt3{name}"])
        reads = trim(reads, side, adapter, rate, overlap, int(asked[f"cutadaptCut5{name}"] or 0), int(asked[f"cutadaptCut3{name}"] or 0))
        if adapter.five or adapter.three:
            found.append(F.col(f"trimmed{side}"))
    if found and not row.get("run_cutadapt_cutonly"):
        reads = reads.where(found[0] if len(found) == 1 else found[0] & found[1])
    short = [F.length(f"seq{side}") < least for side, _ in sides]
    return reads.where(~(short[0] if len(short) == 1 else short[0] | short[1])).drop("trimmed1", "trimmed2")


def orient(pairs: DataFrame, forward: str, reverse: str, rate: float, overlap: int) -> DataFrame:
    """Unstranded pairs: mates are exchanged where the first fits the reverse adapter better; swapped tells where."""
    ship(pairs.sparkSession)

    @F.pandas_udf("boolean")
    def swapped(seqs: pd.Series) -> pd.Series:
        lengths = seqs.str.len().fillna(0).to_numpy(np.int64)
        bases = _matrix(seqs, int(lengths.max(initial=0)) + max(len(forward), len(reverse)), "\0")
        fits = [np.where(hit, end - start, 0) for hit, start, end in (places(bases, lengths, _codes(a), rate, overlap, True) for a in (forward, reverse))]
        return pd.Series(fits[1] > fits[0])

    turn = F.col("swapped")
    pairs = pairs.withColumn("swapped", swapped.asNondeterministic()("seq1"))
    exchanged = {f"{k}{i}": F.when(turn, F.col(f"{k}{3 - i}")).otherwise(F.col(f"{k}{i}")) for k in ("seq", "qual") for i in (1, 2)}
    return pairs.select(*[c for c in pairs.columns if c not in exchanged], *[c.alias(n) for n, c in exchanged.items()])


# --- merging ----------------------------------------------------------------------------------------------------

_COMPLEMENT = str.maketrans("acgtACGT", "tgcaTGCA")


# Reasons to fail, in the order in which they are looked at, and what fails none.
REASONS = [None, "Too_short", "Overlap_too_short", "No_alignment_found", "Too_many_diffs", "Exp.errs._too_high"]


def _rows(values: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each text as a row, filled up, and the lengths."""
    lengths = np.array([len(v) for v in values], np.int64)
    width = int(lengths.max(initial=0))
    return np.frombuffer("".join(v.ljust(width, chr(fill)) for v in values).encode("latin-1", "replace"), np.uint8).reshape(len(values), width), lengths


def merge_batch(seq1: list[str], qual1: list[str], seq2: list[str], qual2: list[str], least_overlap: int, most_differences: int, most_errors: float, least_length: int, top_quality: int) -> tuple[list, list, list]:
    """seq, qual and reason to fail of overlapping pairs; ungapped, staggered ends allowed, posterior qualities.

    All pairs are tried at one shift of the second mate after the other; the best has the most matches over differences
    at a weight of three, and of equals the one that begins first.
    """
    a, la = _rows([s.upper() for s in seq1], 0)
    b, lb = _rows([s.upper().translate(_COMPLEMENT)[::-1] for s in seq2], 1)
    qa, qb = _rows(qual1, 33)[0].astype(np.int64) - 33, _rows([q[::-1] for q in qual2], 33)[0].astype(np.int64) - 33
    n, wide_a, wide_b = len(a), a.shape[1], b.shape[1]
    top = np.full(n, np.iinfo(np.int64).min)
    shift, differ = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for start in range(-(wide_b - 1), wide_a):
        lo, off = max(0, start), max(0, -start)
        width = min(wide_a - lo, wide_b - off)
        shared = np.minimum(la, start + lb) - lo
        # beyond either mate's end the fillings differ
        wrong = (a[:, lo : lo + width] != b[:, off : off + width]).sum(1) - (width - np.maximum(shared, 0))
        score = shared - 4 * wrong
        good = (start > -lb) & (start < la) & (shared >= least_overlap) & (score > top)
        top[good], shift[good], differ[good] = score[good], start, wrong[good]
    low = np.minimum(la, lb) < least_length
    failed = np.select([low, top == np.iinfo(np.int64).min, top <= 0, differ > most_differences], [1, 2, 3, 4], 0)
    # before the overlap stands the first read, behind it the second; what overhangs on the far side is cut
    lo, hi = np.maximum(shift, 0), np.minimum(la, shift + lb)
    tail = np.where(hi == la, lb - (hi - shift), 0)
    length = np.where(failed == 0, hi + tail, 0)
    place = np.arange(int(length.max(initial=0)))[None, :]
    at_a = np.clip(place, 0, max(wide_a - 1, 0))
    at_b = np.clip(place - shift[:, None], 0, max(wide_b - 1, 0))
    if not place.size:
        return [None] * n, [None] * n, [REASONS[k] for k in failed]
    x, y = np.take_along_axis(a, np.broadcast_to(at_a, (n, place.size)), 1), np.take_along_axis(b, at_b, 1)
    sure_x, sure_y = np.take_along_axis(qa, np.broadcast_to(at_a, (n, place.size)), 1), np.take_along_axis(qb, at_b, 1)
    px, py = 10 ** (-sure_x / 10), 10 ** (-sure_y / 10)
    same = x == y
    high, least = np.minimum(px, py), np.maximum(px, py)
    with np.errstate(all="ignore"):
        p = np.where(same, px * py / 3 / (1 - px - py + 4 * px * py / 3), high * (1 - least / 3) / (px + py - 4 * px * py / 3))
        posterior = np.clip(np.round(-10 * np.log10(np.maximum(p, 1e-10))), 2, top_quality)
    both = (place >= lo[:, None]) & (place < hi[:, None])
    before = place < lo[:, None]
    seq = np.where(both, np.where(same | (px <= py), x, y), np.where(before, x, y))
    qual = np.where(both, np.nan_to_num(posterior, nan=2), np.where(before, sure_x, sure_y)).astype(np.int64)
    inside = place < length[:, None]
    errors = np.where(inside, 10 ** (-qual / 10), 0).sum(1)
    failed = np.select([failed > 0, length < least_length, errors > most_errors], [failed, 1, 5], 0)
    letters, marks = seq.astype(np.uint8).tobytes().decode("latin-1"), (np.minimum(qual, top_quality) + 33).astype(np.uint8).tobytes().decode("latin-1")
    cut = lambda text: [None if k else text[i * place.size : i * place.size + m] for i, (k, m) in enumerate(zip(failed.tolist(), length.tolist()))]
    return cut(letters), cut(marks), [REASONS[k] for k in failed]


def merge_pairs(pairs: DataFrame, config: RunConfig) -> DataFrame:
    """seq, qual and fail_reason of each pair, base quality last."""
    ship(pairs.sparkSession)
    overlap = config.vsearch_min_ovlen
    options = (overlap, overlap if overlap < 10 else 10, config.vsearch_max_ee, config.cutadapt_min_length, config.vsearch_max_qual)

    @F.pandas_udf("seq string, qual string, reason string")
    def merged(s1: pd.Series, q1: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("seq", "qual", "reason"), merge_batch(*(x.fillna("").tolist() for x in (s1, q1, s2, q2)), *options))))

    out = pairs.withColumn("_m", merged.asNondeterministic()("seq1", "qual1", "seq2", "qual2")).withColumns({"seq": F.col("_m.seq"), "qual": F.col("_m.qual")})
    low = F.coalesce(least_quality("qual") < config.vsearch_min_qual, F.lit(False))
    return out.withColumn("fail_reason", F.coalesce(F.col("_m.reason"), F.when(low, F.lit("Min_Q_too_low")))).drop("_m")


def process(reads: DataFrame, config: RunConfig) -> DataFrame:
    """The alignment stage: seq, qual and fail_reason by the kind of library."""
    if config.trans_library:
        return concatenate(reads, config)
    if config.paired:
        return merge_pairs(reads, config)
    low = F.coalesce(least_quality("qual1") < config.vsearch_min_qual, F.lit(False))
    return reads.withColumns({"seq": F.col("seq1"), "qual": F.col("qual1"), "fail_reason": F.when(low, F.lit("Min_Q_too_low"))})
