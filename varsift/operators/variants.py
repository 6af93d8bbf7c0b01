"""Stage 4: annotate variants, and part them into retained, discarded indels and rejected ones.

Every row gets all annotations and one reject_reason, the first filter that it fails (constant region, permitted
bases, too many substitutions, mixed substitutions); the parts are filters on that one table, and the statistics are
one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varsift.functions import estimates, sequence
from varsift.operators import counts
from varsift.plans.config import RunConfig
from varsift.shipping import ship
from varsift.sources.counts import read_barcodes

ANNOTATED = ["aa_seq", "WT", "STOP", "STOP_readthrough", "Nham_nt", "Nham_aa", "Nmut_codons"]
REASONS = ["constant_region", "permitted", "too_many_substitutions", "mixed_substitutions"]


@dataclass
class Processed:
    retained: DataFrame
    indel: DataFrame
    rejected: DataFrame
    nobarcode: DataFrame
    annotated: DataFrame
    stats: DataFrame


def indel_kept(seq: str, wt_length: int, lengths: list[int] | None) -> Column:
    """The indel policy: None keeps none, [] all, else those of the given lengths."""
    n = F.length(seq)
    same = n == wt_length
    if lengths is None:
        return same
    return F.lit(True) if not lengths else same | n.isin(lengths)


def annotate(df: DataFrame, config: RunConfig, native: bool = False) -> DataFrame:
    """indel, kept, the annotations, and reject_reason of every row.

    Constant positions are cut from sequences that match them; sequences that don't keep all bases. Indels have no
    annotation and no reject_reason. native: expressions alone instead of the Arrow-batched annotation.
    """
    wt, coding = config.wt_nt_seq, config.coding
    short = config.wt_variable_seq.lower()
    df = df.withColumn("indel", F.length("nt_seq") != len(wt)).withColumn("kept", indel_kept("nt_seq", len(wt), config.indel_lengths))
    constant = sequence.constant_matches("nt_seq", config.wildtype_sequence) if config.has_constant_region else F.lit(True)
    df = df.withColumn("constant_region", F.when(F.col("indel"), True).otherwise(constant))
    if config.has_constant_region:
        cut = F.when(~F.col("indel") & F.col("constant_region"), sequence.strip_constant("nt_seq", config.wildtype_sequence))
        df = df.withColumn("nt_seq", F.coalesce(cut, "nt_seq"))
    of = lambda ref: _native(ref, coding) if native else sequence.annotate(ref, coding)("nt_seq")
    if not native:
        ship(df.sparkSession)
    if config.has_constant_region:
        df = df.withColumns({"_s": of(short), "_l": of(wt)}).withColumn("_a", F.when(F.col("constant_region"), F.col("_s")).otherwise(F.col("_l")))
    else:
        df = df.withColumn("_a", of(short))
    own = ~F.col("indel")
    df = df.withColumns({name: F.when(own, F.col(f"_a.{name}")) for name in ("aa_seq", "Nham_nt", "Nham_aa", "Nmut_codons")})
    df = df.withColumns({name: F.coalesce(F.when(own, F.col(f"_a.{name}")), F.lit(False)) for name in ("STOP", "STOP_readthrough")})
    df = df.withColumn("WT", F.when(own, F.col("nt_seq") == F.when(F.col("constant_region"), F.lit(short)).otherwise(F.lit(wt))))
    far = F.col("Nham_aa") if coding else F.col("Nham_nt")
    mixed = (F.col("Nmut_codons") != F.col("Nham_aa")) & (F.col("Nham_aa") != 0) if coding and not config.mixed_substitutions else F.lit(False)
    reason = (
        F.when(F.col("indel"), F.lit(None).cast("string"))
        .when(~F.col("constant_region"), REASONS[0])
        .when(~sequence.permitted("nt_seq", config.permitted), REASONS[1])
        .when(far > config.max_substitutions, REASONS[2])
        .when(mixed, REASONS[3])
    )
    return df.withColumn("reject_reason", reason).drop("_a", "_s", "_l")


def _native(ref: str, coding: bool) -> Column:
    amino = sequence.translate("nt_seq")
    wt_amino = sequence.translate_text(ref)
    return F.struct(
        amino.alias("aa_seq"),
        sequence.hamming("nt_seq", ref).alias("Nham_nt"),
        sequence.hamming(amino, wt_amino).alias("Nham_aa"),
        (sequence.mutated_codons("nt_seq", ref) if coding and len(ref) % 3 == 0 else F.lit(0)).alias("Nmut_codons"),
        sequence.premature_stop(amino).alias("STOP"),
        sequence.stop_readthrough(amino, wt_amino.endswith("*")).alias("STOP_readthrough"),
    )


def top_sequences(df: DataFrame, count_columns: list[str], n: int = 5) -> DataFrame:
    """The sequences of largest mean count."""
    mean = estimates.row_mean([F.col(c) for c in count_columns])
    return df.select("nt_seq", mean.alias("mean_count")).orderBy(F.desc("mean_count"), "nt_seq").limit(n)


def guard_facts(annotated: DataFrame) -> DataFrame:
    """Rows left after each filter, and whether the wildtype is among those within the allowed substitutions."""
    own = F.col("kept") & ~F.col("indel")
    reason = F.coalesce("reject_reason", F.lit(""))
    stage = {r: own & ~reason.isin(REASONS[: i + 1]) for i, r in enumerate(REASONS)}
    near = stage["too_many_substitutions"]
    return annotated.agg(
        F.count_if("kept").alias("kept"),
        F.count_if(stage["permitted"]).alias("permitted"),
        F.count_if(near).alias("near"),
        F.count_if(near & F.coalesce("WT", F.lit(False))).alias("wildtype"),
        F.count_if(near & ~F.coalesce("WT", F.lit(False))).alias("others"),
        F.count_if(stage["mixed_substitutions"]).alias("unmixed"),
    )


def check(annotated: DataFrame, count_columns: list[str]) -> None:
    """One action; raises where a filter leaves nothing, the wildtype is missing or too few variants are left."""
    facts = guard_facts(annotated).first()
    if not facts.kept:
        raise RuntimeError("no variants are left after the indel filter; check the wildtype sequence and indels")
    if not facts.permitted:
        raise RuntimeError("no variants are left after the permitted-bases filter")
    if not facts.near:
        raise RuntimeError("no variants are left after the substitutions filter")
    if not facts.wildtype:
        seen = ", ".join(r.nt_seq for r in top_sequences(annotated.where("kept and not indel"), count_columns).collect())
        raise RuntimeError(f"the wildtype is not among the variants; the most frequent are: {seen}")
    if facts.others < 2:
        raise RuntimeError("fewer than two substitution variants besides the wildtype")
    if not facts.unmixed:
        raise RuntimeError("no variants are left after the mixed-substitutions filter")


def statistics(annotated: DataFrame, nobarcode: DataFrame | None, count_columns: list[str]) -> DataFrame:
    """category, nham, sample, reads: reads of each sample by fate, and of retained ones by distance (nt and aa)."""
    fate = F.when(~F.col("kept"), "indel").otherwise(F.coalesce("reject_reason", F.lit("retained")))
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in count_columns]
    base = annotated.withColumn("fate", fate)
    sets = base.groupingSets([["fate"], ["fate", "Nham_nt"], ["fate", "Nham_aa"]], "fate", "Nham_nt", "Nham_aa").agg(F.grouping_id().alias("set"), *sums)
    kind = F.when(F.col("set") == 3, F.col("fate")).when((F.col("fate") == "retained") & (F.col("set") == 1), "nuc_subst").when((F.col("fate") == "retained") & (F.col("set") == 2), "aa_subst")
    rows = sets.select(kind.alias("category"), F.coalesce("Nham_nt", "Nham_aa").alias("nham"), *count_columns).where("category is not null")
    if nobarcode is not None:
        rows = rows.unionByName(nobarcode.agg(*sums).select(F.lit("nobarcode").alias("category"), F.lit(None).cast("int").alias("nham"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in count_columns]))
    return rows.unpivot(["category", "nham"], count_columns, "sample", "reads")


def process(df: DataFrame, config: RunConfig, checked: bool = True, native: bool = False, persist: Callable[[DataFrame], DataFrame] = lambda d: d) -> Processed:
    """df: nt_seq and count_e{E}_s{S}. persist may cache or write the annotated table, which several parts read."""
    spark = df.sparkSession
    names = [c for c in df.columns if c.startswith("count_e")]
    if config.reverse_complement:
        df = df.withColumn("nt_seq", sequence.reverse_complement("nt_seq"))
    nobarcode = None
    if config.barcode_identity_path is not None:
        known, nobarcode = counts.debarcode(df, read_barcodes(spark, config.barcode_identity_path), names)
        if checked and known.isEmpty():
            raise RuntimeError("no valid barcodes; check the barcode identity file")
        df = known
    annotated = persist(annotate(df, config, native))
    if checked:
        check(annotated, names)
    good = annotated.where("kept and reject_reason is null")
    retained = good.select(
        "nt_seq", *ANNOTATED, "indel", F.col("nt_seq").alias("merge_seq"), F.lit(True).alias("error_model"), *names, "constant_region",
        F.lit(True).alias("permitted"), F.lit(False).alias("too_many_substitutions"), F.lit(False).alias("mixed_substitutions"),
    )
    # a flag is known for the filters that a row came to
    place = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reject_reason"))
    flags = {r: F.when(place == i + 1, bad).when(place > i + 1, not bad) for i, (r, bad) in enumerate(zip(REASONS, (False, False, True, True)))}
    rejected = annotated.where("kept and reject_reason is not null").select("nt_seq", *ANNOTATED, "indel", *names, *[flags[r].alias(r) for r in REASONS])
    return Processed(
        retained,
        annotated.where("not kept").select("nt_seq", *names, "indel"),
        rejected,
        nobarcode if nobarcode is not None else spark.createDataFrame([], "nt_seq string"),
        annotated,
        statistics(annotated, nobarcode, names),
    )
