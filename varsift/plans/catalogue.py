"""Registered queries over the fixture tables, each with its equivalent in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.functions import estimates, sequence
from varsift.operators import counts, enrichment, error_model, fitness, growth, mutations, reads, variants
from varsift.operators.fitness import ErrorModel, NormModel
from varsift.plans import fixture, report
from varsift.plans.config import RunConfig
from varsift.plans.fixture import ANNOTATED_SQL, COUNTS, EVENTS_SQL, INDELS_SQL, READS_SQL, REPS, VARIANTS_SQL, WT, WT_AMINO
from varsift.sources import counts as count_source
from varsift.sources.design import ExperimentDesign

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

# Models of the queries that apply given ones.
NORM = NormModel({1: 1.0, 2: 1.1, 3: 0.9}, {1: 0.0, 2: 0.05, 3: -0.02})
ERRORS = ErrorModel([{"parameter": p, "rep": e, "mean_value": v + e / 10} for p, v in (("input", 1.0), ("output", 1.2), ("reperror", 0.001)) for e in REPS])


def query(sql: str | None = None):
    def add(fn):
        _queries[fn.__name__] = fn
        if sql is not None:
            _sql[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from varsift.plans import catalogue_files  # noqa: F401  adds its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def config(**options) -> RunConfig:
    return RunConfig(experiment_design_path=__file__, **({"wildtype_sequence": WT.upper()} | options))


def design() -> ExperimentDesign:
    rows = [
        {"sample_name": f"{'in' if s == 0 else 'out'}put{e}", "experiment": e, "experiment_replicate": e, "selection_id": s, "biological_replicate": None if s == 0 else 1, "generations": None if s == 0 else 4.0 + e, "cell_density": 100.0 + 50 * s * e, "selection_time": None if s == 0 else 3.0}
        for e in REPS
        for s in (0, 1)
    ]
    return ExperimentDesign(rows)


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.process(fixture.variants(spark, sf_dir), config(), checked=False).retained


def wild(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, float]]:
    rows = retained(spark, sf_dir).persist()  # the scalars and the result come from one pass
    return rows, fitness.wildtype_counts(rows, REPS)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, wt = wild(spark, sf_dir)
    return fitness.raw_fitness(rows, wt, REPS)


def estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitness.calculate_fitness(retained(spark, sf_dir).persist(), config(), REPS)


# --- the same steps in SQL ----------------------------------------------------------------------------------------

_WT = "wild as (select " + ", ".join(f"max(case when WT then {c} end) as wt_{c[6:]}" for c in COUNTS) + " from retained)"
_ok = lambda e: f"count_e{e}_s0 > 0 and count_e{e}_s1 > 0"
_ratio = lambda e: f"case when {_ok(e)} then ln(cast(count_e{e}_s1 as double) / nullif(count_e{e}_s0, 0)) end"
_centred = lambda e: f"({_ratio(e)} - ln(cast(wt_e{e}_s1 as double) / wt_e{e}_s0))"
_poisson = lambda e: f"case when {_ok(e)} then sqrt(1.0 / nullif(count_e{e}_s1, 0) + 1.0 / nullif(count_e{e}_s0, 0) + 1.0 / wt_e{e}_s1 + 1.0 / wt_e{e}_s0) end"
RAW_SQL = f"{ANNOTATED_SQL}, {_WT}, raw as (select *, " + ", ".join(f"{_centred(e)} as fitness{e}" for e in REPS) + ", " + ", ".join(f"{_poisson(e)} as sigma{e}" for e in REPS) + " from retained cross join wild)"
_mean = "(" + " + ".join(f"count_e{e}_s0" for e in REPS) + ") / 3.0"
EST_SQL = f"{RAW_SQL}, est as (select *, {_mean} as mean_count from raw where coalesce(fitness1, fitness2, fitness3) is not null)"


def ivw_sql(f: str = "fitness{}", s: str = "sigma{}", reps=REPS) -> tuple[str, str]:
    pairs = [(f.format(e), s.format(e)) for e in reps]
    top = " + ".join(f"coalesce({a} / ({b} * {b}), 0)" for a, b in pairs)
    bottom = " + ".join(f"coalesce(case when {a} is not null then 1.0 / ({b} * {b}) end, 0)" for a, b in pairs)
    return f"({top}) / nullif({bottom}, 0)", f"1.0 / sqrt(nullif({bottom}, 0))"


IVW_F, IVW_S = ivw_sql()
_sum_cells = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in COUNTS)
_per = lambda fmt: ", ".join(fmt.format(e=e) for e in REPS)
AA_SQL = (
    f"{EST_SQL}, aa_changed as (select * from est where Nham_aa > 0), grouped as (select aa_seq as merge_seq, min(Nham_aa) as Nham_aa, {_sum_cells}, "
    + _per("sum(fitness{e} / (sigma{e} * sigma{e})) / nullif(sum(1.0 / (sigma{e} * sigma{e})), 0) as fitness{e}, 1.0 / sqrt(nullif(sum(1.0 / (sigma{e} * sigma{e})), 0)) as sigma{e}")
    + f" from aa_changed group by aa_seq), aa as (select *, {_mean} as mean_count from grouped)"
)


# --- counts -------------------------------------------------------------------------------------------------------


@query(f"with {VARIANTS_SQL} select * from variants")
def count_pivot(spark, sf_dir):
    return fixture.variants(spark, sf_dir)


def _technical(spark, sf_dir, split: str) -> DataFrame:
    """Samples split by line number as technical or output replicates, summed by way of the design."""
    rows, found = [], fixture.reads(spark, sf_dir).withColumn("t", F.col("line") % 2 + 1)
    for e in REPS:
        for s in (0, 1):
            for t in (1, 2):
                by_line = {"technical_replicate": t, "biological_replicate": 1} if split == "t" or s == 0 else {"technical_replicate": 1, "biological_replicate": t}
                rows.append({"sample_name": f"x{e}{s}" if split == "t" or s == 0 else f"x{e}{s}{t}", "experiment": e, "selection_id": s} | by_line)
    code = {(r["experiment"], r["selection_id"], i % 2 + 1): ExperimentDesign().sample_code(r) for i, r in enumerate(rows)}
    name = F.element_at(F.create_map(*[F.lit(x) for (e, s, t), c in code.items() for x in (f"{e}{s}{t}", c)]), F.concat("e", "s", F.col("t").cast("string")))
    long = found.select("nt_seq", F.col("quantity").alias("count"), name.alias("sample_id"))
    return counts.wide_counts(counts_by_sample(long), ExperimentDesign(rows))


def counts_by_sample(long: DataFrame) -> DataFrame:
    return long.groupBy("nt_seq", "sample_id").agg(F.sum("count").alias("count"))


@query(f"with {VARIANTS_SQL} select * from variants")
def techrep_sum(spark, sf_dir):
    return _technical(spark, sf_dir, "t")


@query(f"with {VARIANTS_SQL} select * from variants")
def biorep_sum(spark, sf_dir):
    return _technical(spark, sf_dir, "b")


@query(f"with {READS_SQL} select concat('count_e', e, '_s', s) as sample_id, nt_seq, count(*) as count from reads group by 1, 2")
def exact_tally(spark, sf_dir):
    return counts.sorted_tally(fixture.long_counts(spark, sf_dir), seq="nt_seq")


@query(f"with {READS_SQL} select concat('count_e', e, '_s', s) as sample_id, sum(quantity) as reads, count(distinct nt_seq) as n_unique from reads group by 1")
def tally_totals(spark, sf_dir):
    return fixture.long_counts(spark, sf_dir).groupBy("sample_id").agg(F.sum("count").alias("reads"), F.count_distinct("nt_seq").alias("n_unique"))


@query(f"with {VARIANTS_SQL} select count(*) filter (where regexp_matches(nt_seq, '[^acgt]')) as n_invalid, count(nt_seq) - count(distinct nt_seq) as n_repeated, " + ", ".join(f"min({c}) as least_{c}" for c in COUNTS) + " from variants")
def count_validate(spark, sf_dir):
    return count_source.validation(fixture.variants(spark, sf_dir), COUNTS)


_MAP = f"{VARIANTS_SQL}, barcodes as (select nt_seq as barcode, substr(nt_seq, 1, 15) || '{WT[15:]}' as variant from variants where length(replace(nt_seq, 'a', '')) % 5 <> 0)"


def _barcodes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = fixture.variants(spark, sf_dir).persist()  # the map is made from it as well
    known = rows.where(F.length(F.replace("nt_seq", F.lit("a"), F.lit(""))) % 5 != 0)
    pairs = known.select(F.col("nt_seq").alias("barcode"), F.concat(F.substring("nt_seq", 1, 15), F.lit(WT[15:])).alias("variant"))
    return counts.debarcode(rows, pairs, COUNTS)


@query(f"with {_MAP} select variant as nt_seq, {_sum_cells} from variants join barcodes on nt_seq = barcode group by 1")
def debarcode(spark, sf_dir):
    return _barcodes(spark, sf_dir)[0]


@query(f"with {_MAP} select v.* from variants v where not exists (select 1 from barcodes where barcode = nt_seq)")
def nobarcode(spark, sf_dir):
    return _barcodes(spark, sf_dir)[1]


# --- sequences and annotation -------------------------------------------------------------------------------------


def _seqs(spark, sf_dir) -> DataFrame:
    return fixture.variants(spark, sf_dir).select("nt_seq")


@query(f"with {INDELS_SQL} select nt_seq, length(nt_seq) <> 30 as indel from variants")
def indel_flag(spark, sf_dir):
    return variants.annotate(fixture.with_indels(spark, sf_dir), config(), native=True).select("nt_seq", "indel")


@query(f"with {INDELS_SQL} select * from variants where length(nt_seq) in (30, 31)")
def indel_lengths(spark, sf_dir):
    done = variants.annotate(fixture.with_indels(spark, sf_dir), config(indels="31"), native=True)
    return done.where("kept").select("nt_seq", *COUNTS)


@query(f"with {INDELS_SQL} select nt_seq, {', '.join(COUNTS)}, true as indel from variants where length(nt_seq) <> 30")
def indels_discarded(spark, sf_dir):
    return variants.process(fixture.with_indels(spark, sf_dir), config(), checked=False).indel


@query(f"with {ANNOTATED_SQL} select nt_seq, Nham_nt from annotated")
def hamming_nt(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.hamming("nt_seq", WT).alias("Nham_nt"))


@query(f"with {ANNOTATED_SQL} select nt_seq, aa_seq, Nham_aa from annotated")
def hamming_aa(spark, sf_dir):
    return _seqs(spark, sf_dir).withColumn("aa_seq", sequence.translate("nt_seq")).withColumn("Nham_aa", sequence.hamming("aa_seq", WT_AMINO))


@query(f"with {ANNOTATED_SQL} select nt_seq, Nmut_codons from annotated")
def mutated_codons(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.mutated_codons("nt_seq", WT).alias("Nmut_codons"))


@query(f"with {VARIANTS_SQL} select nt_seq, {fixture.positions_sql('nt_seq', WT)} as positions from variants")
def mutation_positions(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", F.array_join(sequence.mutated_positions("nt_seq", WT).cast("array<string>"), ",").alias("positions"))


@query(f"with {ANNOTATED_SQL} select nt_seq, aa_seq from annotated")
def translate_codons(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.translate("nt_seq").alias("aa_seq"))


@query(f"with {ANNOTATED_SQL} select nt_seq, strpos(substr(aa_seq, 1, 9), '*') > 0 as stop, substr(aa_seq, 10, 1) <> '*' as readthrough from annotated")
def stop_flags(spark, sf_dir):
    rows = _seqs(spark, sf_dir).withColumn("aa", sequence.translate("nt_seq"))
    return rows.select("nt_seq", sequence.premature_stop("aa").alias("stop"), sequence.stop_readthrough("aa", True).alias("readthrough"))


@query(f"with {VARIANTS_SQL} select nt_seq, reverse(translate(nt_seq, 'acgt', 'tgca')) as revcomp from variants")
def revcomp(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.reverse_complement("nt_seq").alias("revcomp"))


@query(f"with {ANNOTATED_SQL} select nt_seq, aa_seq, Nham_nt, Nham_aa, Nmut_codons, WT, STOP, STOP_readthrough from annotated")
def annotate_variants(spark, sf_dir):
    done = variants.annotate(fixture.variants(spark, sf_dir), config())
    return done.select("nt_seq", "aa_seq", "Nham_nt", "Nham_aa", "Nmut_codons", "WT", "STOP", "STOP_readthrough")


@query(f"with {VARIANTS_SQL} select nt_seq, substr(nt_seq, 1, 6) = '{WT[:6]}' as matches from variants")
def constant_region(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.constant_matches("nt_seq", fixture.CODED).alias("matches"))


@query(f"with {VARIANTS_SQL} select nt_seq, substr(nt_seq, 7) as variable from variants")
def strip_constant(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.strip_constant("nt_seq", fixture.CODED).alias("variable"))


@query(f"with {VARIANTS_SQL} select nt_seq, regexp_matches(nt_seq, '{sequence.permitted_pattern('N' * 10 + 'VHDB' * 5)}') as permitted from variants")
def permitted_iupac(spark, sf_dir):
    return _seqs(spark, sf_dir).select("nt_seq", sequence.permitted("nt_seq", "N" * 10 + "VHDB" * 5).alias("permitted"))


_REASON = "case when Nham_aa > 1 then 'too_many_substitutions' when Nmut_codons <> Nham_aa and Nham_aa <> 0 then 'mixed_substitutions' end"


@query(f"with {ANNOTATED_SQL} select nt_seq, {_REASON} as reject_reason from annotated")
def reject_reasons(spark, sf_dir):
    return variants.annotate(fixture.variants(spark, sf_dir), config(max_substitutions=1)).select("nt_seq", "reject_reason")


@query(f"with {ANNOTATED_SQL} select * from (select nt_seq, {', '.join(COUNTS)}, true as too_many_substitutions from annotated where Nham_aa > 1)")
def too_many_subs(spark, sf_dir):
    done = variants.process(fixture.variants(spark, sf_dir), config(max_substitutions=1), checked=False)
    return done.rejected.where("too_many_substitutions").select("nt_seq", *COUNTS, "too_many_substitutions")


@query(f"with {ANNOTATED_SQL} select nt_seq, Nham_aa, Nmut_codons from annotated where Nham_aa <= 2 and Nmut_codons <> Nham_aa and Nham_aa <> 0")
def mixed_subs(spark, sf_dir):
    return variants.process(fixture.variants(spark, sf_dir), config(), checked=False).rejected.where("mixed_substitutions").select("nt_seq", "Nham_aa", "Nmut_codons")


@query(
    f"with {ANNOTATED_SQL}, fates as (select *, coalesce({_REASON}, 'retained') as category from annotated) select * from ("
    + " union all ".join(f"select category, '{c}' as sample, cast(sum({c}) as bigint) as reads from fates group by 1" for c in COUNTS)
    + ")"
)
def reject_stats(spark, sf_dir):
    stats = variants.process(fixture.variants(spark, sf_dir), config(max_substitutions=1), checked=False).stats
    return stats.where("category in ('retained', 'too_many_substitutions', 'mixed_substitutions')").select("category", "sample", "reads")


@query(f"with {ANNOTATED_SQL} " + " union all ".join(f"select 'nuc_subst' as category, Nham_nt as nham, '{c}' as sample, cast(sum({c}) as bigint) as reads from retained group by 2 union all select 'aa_subst', Nham_aa, '{c}', cast(sum({c}) as bigint) from retained group by 2" for c in COUNTS))
def subst_histogram(spark, sf_dir):
    stats = variants.process(fixture.variants(spark, sf_dir), config(), checked=False).stats
    return stats.where("category like '%subst'").orderBy("category", "sample", "nham")


_ALL_MEAN = "(" + " + ".join(COUNTS) + ") / 6.0"


@query(f"with {VARIANTS_SQL} select nt_seq, round({_ALL_MEAN}, 6) as mean_count from variants order by {_ALL_MEAN} desc, nt_seq limit 5")
def wt_guard_top5(spark, sf_dir):
    top = variants.top_sequences(fixture.variants(spark, sf_dir), COUNTS)
    return top.select("nt_seq", r6("mean_count", "mean_count"))


@query(
    f"with {ANNOTATED_SQL} select count(*) as kept, count(*) as permitted, count(*) filter (where Nham_aa <= 2) as near, count(*) filter (where WT) as wildtype, "
    "count(*) filter (where Nham_aa <= 2 and not WT) as others, (select count(*) from retained) as unmixed from annotated"
)
def wt_guard_facts(spark, sf_dir):
    return variants.guard_facts(variants.annotate(fixture.variants(spark, sf_dir), config()))


# --- count filters ------------------------------------------------------------------------------------------------


def _filtered(spark, sf_dir, **options) -> DataFrame:
    return fitness.filter_low_counts(retained(spark, sf_dir), config(**options), REPS).select("nt_seq", *COUNTS)


_nulled = lambda s, t: ", ".join(f"case when {c} < {t} then null else {c} end as {c}" if c.endswith(s) else c for c in COUNTS)


@query(f"with {ANNOTATED_SQL} select nt_seq, {_nulled('s0', 400)} from retained where greatest(count_e1_s0, count_e2_s0, count_e3_s0) >= 400")
def min_count_any(spark, sf_dir):
    return _filtered(spark, sf_dir, fitness_min_input_count_any="400")


@query(f"with {ANNOTATED_SQL} select nt_seq, {', '.join(COUNTS)} from retained where least(count_e1_s1, count_e2_s1, count_e3_s1) >= 300")
def min_count_all(spark, sf_dir):
    return _filtered(spark, sf_dir, fitness_min_output_count_all="300")


@query(f"with {ANNOTATED_SQL} select nt_seq, {', '.join(COUNTS)} from retained where case Nham_nt when 1 then least(count_e1_s0, count_e2_s0, count_e3_s0) >= 300 when 2 then least(count_e1_s0, count_e2_s0, count_e3_s0) >= 450 else true end")
def min_count_by_dist(spark, sf_dir):
    return _filtered(spark, sf_dir, fitness_min_input_count_all="1:300,2:450")


@query(f"with {ANNOTATED_SQL} select nt_seq, {_nulled('s1', 350)} from retained")
def null_below(spark, sf_dir):
    names = [c for c in COUNTS if c.endswith("s1")]
    return retained(spark, sf_dir).withColumns(fitness.null_below(names, 350)).select("nt_seq", *COUNTS)


# --- fitness and errors -------------------------------------------------------------------------------------------


@query(f"with {ANNOTATED_SQL} select nt_seq, " + ", ".join(f"round({_ratio(e)}, 6) as ratio{e}" for e in REPS) + " from retained")
def raw_log_ratio(spark, sf_dir):
    return retained(spark, sf_dir).select("nt_seq", *[r6(estimates.log_ratio(e), f"ratio{e}") for e in REPS])


@query(f"with {RAW_SQL} select nt_seq, " + _per("round(fitness{e}, 6) as fitness{e}") + " from raw")
def wt_fitness(spark, sf_dir):
    return raw(spark, sf_dir).select("nt_seq", *[r6(f"fitness{e}_uncorr", f"fitness{e}") for e in REPS])


@query(f"with {ANNOTATED_SQL} select nt_seq, " + _per("cast(case when count_e{e}_s1 = 0 and count_e{e}_s0 > 0 then count_e{e}_s1 + 0.5 else count_e{e}_s1 end as double) as count_e{e}_s1") + " from retained")
def dropout_pseudo(spark, sf_dir):
    done = fitness.add_dropout_pseudocount(retained(spark, sf_dir), 0.5, REPS)
    return done.select("nt_seq", *[F.col(f"count_e{e}_s1").cast("double").alias(f"count_e{e}_s1") for e in REPS])


@query(f"with {EST_SQL} select nt_seq, " + _per("round(sigma{e}, 6) as sigma{e}") + ", round(mean_count, 6) as mean_count from est")
def poisson_sigma(spark, sf_dir):
    return estimated(spark, sf_dir).select("nt_seq", *[r6(f"sigma{e}_uncorr", f"sigma{e}") for e in REPS], r6("mean_count", "mean_count"))


_ALL = " and ".join(_ok(e) for e in REPS)
P1_SQL = f"{ANNOTATED_SQL}, ratios as (" + " union all ".join(f"select {_ratio(e)} as f from retained where {_ALL}" for e in REPS) + "), least as (select exp(-quantile_cont(f, 0.01)) as t from ratios)"


@query(f"with {P1_SQL} select round(t, 6) as input_threshold from least")
def input_threshold_p1(spark, sf_dir):
    return error_model.input_threshold(retained(spark, sf_dir), REPS).select(r6("input_threshold", "input_threshold"))


_ABOVE = " and ".join(f"count_e{e}_s0 > t" for e in REPS)


@query(f"with {P1_SQL} select nt_seq, {_ALL} as all_reads, {_ABOVE} as above from retained cross join least")
def usable_variants(spark, sf_dir):
    rows = retained(spark, sf_dir).persist()
    least = error_model.input_threshold(rows, REPS).first()[0]
    return rows.select("nt_seq", estimates.all_reads(REPS).alias("all_reads"), estimates.inputs_above(REPS, least).alias("above"))


@query(f"with {ANNOTATED_SQL}, sizes as (select Nham_nt, count(*) as n from retained group by 1), total as (select count(*) as n from retained) select r.nt_seq, round(case when s.n > sqrt(t.n) then sqrt(s.n) else sqrt(sqrt(t.n)) end, 6) as weight from retained r join sizes s using (Nham_nt) cross join total t")
def diversity_weight(spark, sf_dir):
    return error_model.diversity_weight(retained(spark, sf_dir)).select("nt_seq", r6("error_model_weighting", "weight"))


@query(f"with {RAW_SQL} select nt_seq, " + ", ".join(f"round(sqrt({NORM.scale[e]}) * sigma{e}, 6) as cbe{e}" for e in REPS) + " from raw")
def count_based_error(spark, sf_dir):
    rows, wt = wild(spark, sf_dir)
    return rows.select("nt_seq", *[r6(estimates.poisson_error(e, wt[f"count_e{e}_s0"], wt[f"count_e{e}_s1"], NORM.scale[e]), f"cbe{e}") for e in REPS])


_CENTRE = sum(NORM.shift[e] * NORM.scale[e] for e in REPS) / 3


@query(f"with {RAW_SQL} select nt_seq, " + ", ".join(f"round((fitness{e} + {NORM.shift[e]}) * {NORM.scale[e]} - ({_CENTRE!r}::double), 6) as fitness{e}" for e in REPS) + " from raw")
def normalised_fitness_fixed(spark, sf_dir):
    return fitness.normalise(raw(spark, sf_dir), NORM, REPS).select("nt_seq", *[r6(f"fitness{e}_uncorr", f"fitness{e}") for e in REPS])


def _model_sql(e: int) -> str:
    p = [ERRORS.value(x, e) for x in ("input", "output", "reperror")]
    return f"case when {_ok(e)} then sqrt({NORM.scale[e]} * ({p[0]} / nullif(count_e{e}_s0, 0) + {p[1]} / nullif(count_e{e}_s1, 0)) + {p[2]}) end"


@query(f"with {RAW_SQL} select nt_seq, " + ", ".join(f"round({_model_sql(e)}, 6) as sigma{e}" for e in REPS) + " from raw")
def model_sigma_fixed(spark, sf_dir):
    rows = fitness.add_sigma(raw(spark, sf_dir), {}, REPS, ERRORS, NORM.scale)
    return rows.select("nt_seq", *[r6(f"sigma{e}_uncorr", f"sigma{e}") for e in REPS])


@query(f"with {EST_SQL} select nt_seq, round({IVW_F}, 6) as fitness, round({IVW_S}, 6) as sigma from est")
def ivw_replicates(spark, sf_dir):
    return fitness.merge(estimated(spark, sf_dir), REPS).select("nt_seq", r6("fitness", "fitness"), r6("sigma", "sigma"))


FLAGSHIP_SQL = f"with {EST_SQL} select nt_seq, aa_seq, cast(Nham_nt as int) as Nham_nt, round(mean_count, 6) as mean_count, round({IVW_F}, 6) as fitness, round({IVW_S}, 6) as sigma from est order by nt_seq"


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Counts to merged fitness with count-based errors, in order of sequence."""
    rows = fitness.merge(estimated(spark, sf_dir), REPS)
    return rows.select("nt_seq", "aa_seq", "Nham_nt", r6("mean_count", "mean_count"), r6("fitness", "fitness"), r6("sigma", "sigma")).orderBy("nt_seq")


_same = "select nt_seq as merge_seq, {em} as error_model, " + ", ".join(COUNTS) + " from annotated where Nham_aa = 0"


@query(f"with {ANNOTATED_SQL} {_same.format(em='false')} union all select aa_seq, true, {_sum_cells} from annotated where Nham_aa <= 2 group by 1")
def aa_count_sum(spark, sf_dir):
    rows = variants.process(fixture.variants(spark, sf_dir), config(mixed_substitutions=True), checked=False).retained
    return fitness.aggregate_counts(rows, REPS).select("merge_seq", "error_model", *COUNTS)


@query(f"with {AA_SQL} select merge_seq, Nham_aa, {', '.join(COUNTS)}, " + _per("round(fitness{e}, 6) as fitness{e}, round(sigma{e}, 6) as sigma{e}") + ", round(mean_count, 6) as mean_count from aa")
def aa_ivw(spark, sf_dir):
    rows = fitness.aggregate_fitness(estimated(spark, sf_dir), REPS).where("Nham_aa > 0")
    return rows.select("merge_seq", "Nham_aa", *COUNTS, *[r6(f"{k}{e}_uncorr", f"{k}{e}") for e in REPS for k in ("fitness", "sigma")], r6("mean_count", "mean_count"))


# --- mutants ------------------------------------------------------------------------------------------------------


def _single_sql(seq: str, ref: str, source: str, distance: str) -> str:
    case = " ".join(f"when substr({seq}, {i + 1}, 1) <> '{c}' then {i + 1}" for i, c in enumerate(ref))
    return f"select *, case {case} end as Pos from {source} where {distance} = 1"


def _double_sql(seq: str, ref: str, source: str, distance: str) -> str:
    first = " ".join(f"when substr({seq}, {i + 1}, 1) <> '{c}' then {i + 1}" for i, c in enumerate(ref))
    last = " ".join(f"when substr({seq}, {i + 1}, 1) <> '{c}' then {i + 1}" for i, c in reversed(list(enumerate(ref))))
    return f"select *, case {first} end as Pos1, case {last} end as Pos2 from {source} where {distance} = 2"


_AAS = f"{AA_SQL}, s as ({_single_sql('merge_seq', WT_AMINO, 'aa', 'Nham_aa')}), singles as (select *, substr(merge_seq, Pos, 1) as Mut, substr('{WT_AMINO}', Pos, 1) as WT_AA, {IVW_F} as fitness, {IVW_S} as sigma from s)"
_NTS = f"{EST_SQL}, s as ({_single_sql('nt_seq', WT, 'est', 'Nham_nt')}), singles as (select *, substr(nt_seq, Pos, 1) as Mut, substr('{WT}', Pos, 1) as WT_AA, {IVW_F} as fitness, {IVW_S} as sigma from s)"


def _tables(spark, sf_dir, coding: bool = True) -> dict[str, DataFrame]:
    rows = estimated(spark, sf_dir)
    rows = fitness.aggregate_fitness(rows, REPS) if coding else rows.withColumn("merge_seq", F.col("nt_seq"))
    own = rows.where("error_model")
    ref = WT_AMINO if coding else WT
    single = mutations.singles(own, ref, coding)
    return mutations.merged_tables(rows, single, mutations.doubles(own, single, ref, coding), REPS, coding, len(ref)) | {"own": own, "single": single}


@query(f"with {_AAS} select Pos, Mut, WT_AA, merge_seq as aa_seq, round(mean_count, 6) as mean_count, round(fitness, 6) as fitness, round(sigma, 6) as sigma from singles")
def singles_aa(spark, sf_dir):
    return _tables(spark, sf_dir)["singles"].select("Pos", "Mut", "WT_AA", "aa_seq", r6("mean_count", "mean_count"), r6("fitness", "fitness"), r6("sigma", "sigma"))


@query(f"with {_NTS} select Pos, Mut, WT_AA as WT_nt, nt_seq, round(mean_count, 6) as mean_count, round(fitness, 6) as fitness, round(sigma, 6) as sigma from singles")
def singles_nt(spark, sf_dir):
    return _tables(spark, sf_dir, False)["singles"].select("Pos", "Mut", "WT_nt", "nt_seq", r6("mean_count", "mean_count"), r6("fitness", "fitness"), r6("sigma", "sigma"))


def _doubles_select(seq: str, ref: str) -> str:
    return (
        f"select d.Pos1, d.Pos2, substr(d.{seq}, d.Pos1, 1) as Mut1, substr(d.{seq}, d.Pos2, 1) as Mut2, round(a.fitness, 6) as fitness1, round(a.sigma, 6) as sigma1, "
        f"round(b.fitness, 6) as fitness2, round(b.sigma, 6) as sigma2, round({ivw_sql('d.fitness{}', 'd.sigma{}')[0]}, 6) as fitness_uncorr, round({ivw_sql('d.fitness{}', 'd.sigma{}')[1]}, 6) as sigma_uncorr, round(d.mean_count, 6) as mean_count "
        f"from d left join singles a on a.Pos = d.Pos1 and a.Mut = substr(d.{seq}, d.Pos1, 1) left join singles b on b.Pos = d.Pos2 and b.Mut = substr(d.{seq}, d.Pos2, 1)"
    )


_DOUBLE = ["fitness1", "sigma1", "fitness2", "sigma2", "fitness_uncorr", "sigma_uncorr", "mean_count"]


@query(f"with {_AAS}, d as ({_double_sql('merge_seq', WT_AMINO, 'aa', 'Nham_aa')}) {_doubles_select('merge_seq', WT_AMINO)}")
def doubles_aa(spark, sf_dir):
    return _tables(spark, sf_dir)["doubles"].select("Pos1", "Pos2", "Mut1", "Mut2", *[r6(c, c) for c in _DOUBLE])


@query(f"with {_NTS}, d as ({_double_sql('nt_seq', WT, 'est', 'Nham_nt')}) {_doubles_select('nt_seq', WT)}")
def doubles_nt(spark, sf_dir):
    return _tables(spark, sf_dir, False)["doubles"].select("Pos1", "Pos2", "Mut1", "Mut2", *[r6(c, c) for c in _DOUBLE])


_name_sql = lambda c: f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in sequence.AMINO_NAMES.items()) + " end"


@query(f"with {_AAS} select 'p.' || {_name_sql('WT_AA')} || Pos || {_name_sql('Mut')} as hgvs_pro, round(fitness, 6) as score, round(sigma, 6) as se from singles")
def hgvs_pro(spark, sf_dir):
    return _tables(spark, sf_dir)["database"].select("hgvs_pro", r6("score", "score"), r6("se", "se"))


@query(f"with {_NTS} select 'n.' || Pos || upper(WT_AA) || '>' || upper(Mut) as hgvs_nt, round(fitness, 6) as score, round(sigma, 6) as se from singles")
def hgvs_nt(spark, sf_dir):
    return _tables(spark, sf_dir, False)["database"].select("hgvs_nt", r6("score", "score"), r6("se", "se"))


@query(f"with {EST_SQL} select nt_seq, WT, round({IVW_F}, 6) as fitness from est where Nham_aa = 0")
def split_synonymous(spark, sf_dir):
    return _tables(spark, sf_dir)["synonymous"].select("nt_seq", "WT", r6("fitness", "fitness"))


@query(f"with {EST_SQL} select nt_seq, round({IVW_F}, 6) as fitness, round({IVW_S}, 6) as sigma from est where WT")
def split_wildtype(spark, sf_dir):
    return _tables(spark, sf_dir)["wildtype"].select("nt_seq", r6("fitness", "fitness"), r6("sigma", "sigma"))


@query(f"with {AA_SQL} select null as nt_seq, merge_seq as aa_seq, round({IVW_F}, 6) as fitness from aa union all select nt_seq, aa_seq, round({IVW_F}, 6) from est where WT")
def split_all(spark, sf_dir):
    return _tables(spark, sf_dir)["all_variants"].select("nt_seq", "aa_seq", r6("fitness", "fitness"))


# --- libraries ----------------------------------------------------------------------------------------------------

_REF, _SPIKES = WT, [WT[:29] + "a", WT[:29] + "g"]
_LIB = f"{VARIANTS_SQL}, lib as (select *, " + ", ".join(f"{_ratio(e)} as f{e}" for e in REPS) + f", {_mean} as mean_count from variants)"
_offset = {
    "none": lambda e: "0.0",
    "median": lambda e: f"(select median(f{e}) from lib)",
    "total": lambda e: f"(select ln(cast(sum(count_e{e}_s1) as double) / sum(count_e{e}_s0)) from lib)",
    "reference": lambda e: f"(select coalesce(max(f{e}), 0) from lib where nt_seq = '{_REF}')",
    "spikein": lambda e: f"(select coalesce(avg(f{e}), 0) from lib where nt_seq in ('{_SPIKES[0]}', '{_SPIKES[1]}'))",
}
_lib_sigma = lambda e: f"case when {_ok(e)} then sqrt(1.0 / nullif(count_e{e}_s1, 0) + 1.0 / nullif(count_e{e}_s0, 0)) end"


def _enrich(strategy: str):
    sql = (
        f"with {_LIB}, done as (select nt_seq, mean_count, " + ", ".join(f"f{e} - {_offset[strategy](e)} as fitness{e}, {_lib_sigma(e)} as sigma{e}" for e in REPS) + " from lib) "
        f"select nt_seq, 30 as length, round(mean_count, 6) as mean_count, " + _per("round(fitness{e}, 6) as enrichment{e}, round(sigma{e}, 6) as sigma{e}") + f", round({IVW_F}, 6) as fitness, round({IVW_S}, 6) as sigma "
        "from done where coalesce(fitness1, fitness2, fitness3) is not null"
    )

    def run(spark, sf_dir):
        options = config(enrichment_mode=True, enrichment_normalise=strategy, enrichment_reference_id=_REF.upper(), enrichment_spikein_ids=",".join(_SPIKES).upper())
        table = enrichment.report(enrichment.calculate(enrichment.annotate(fixture.variants(spark, sf_dir), options), options, REPS), REPS)
        return table.select("nt_seq", "length", *[r6(c, c) for c in table.columns[2:]])

    run.__name__ = f"enrich_{strategy}"
    query(sql)(run)


for _strategy in _offset:
    _enrich(_strategy)


# --- generations, growth ------------------------------------------------------------------------------------------

_GEN = {e: 4.0 + e for e in REPS}


@query(f"with {EST_SQL} select nt_seq, " + ", ".join(f"round(fitness{e} / ({_GEN[e]} * ln(2)), 6) as fitness{e}, round(sigma{e} / ({_GEN[e]} * ln(2)), 6) as sigma{e}" for e in REPS) + " from est")
def generations_norm(spark, sf_dir):
    done = fitness.by_generations(estimated(spark, sf_dir), design().mean("generations", 1), REPS)
    return done.select("nt_seq", *[r6(f"{k}{e}_uncorr", f"{k}{e}") for e in REPS for k in ("fitness", "sigma")])


_TOTALS = "totals as (select " + ", ".join(f"cast(sum({c}) as double) as t_{c[6:]}" for c in COUNTS) + " from est)"
_rate = lambda e: f"ln((count_e{e}_s1 / t_e{e}_s1 * {100.0 + 50 * e}) / (count_e{e}_s0 / t_e{e}_s0 * 100.0 + 1e-30)) / 3.0"
_GROWTH = (
    f"{EST_SQL}, {_TOTALS}, rates as (select *, " + ", ".join(f"case when {_ok(e)} then {_rate(e)} end as g{e}" for e in REPS) + f", {IVW_F} as fitness, {IVW_S} as sigma from est cross join totals), "
    "lines as (select " + _per("regr_slope(g{e}, fitness{e}) as m{e}, regr_intercept(g{e}, fitness{e}) as c{e}") + " from rates), "
    "own as (select nt_seq, fitness, sigma, " + _per("fitness{e} * m{e} + c{e} as gr{e}, sigma{e} * abs(m{e}) as gs{e}") + " from rates cross join lines), "
    f"merged as (select *, {ivw_sql('gr{}', 'gs{}')[0]} as gm from own), last as (select regr_slope(gm, fitness) as m, regr_intercept(gm, fitness) as c from merged)"
)


@query(f"with {_GROWTH} select nt_seq, round(fitness * m + c, 6) as growthrate, round(sigma * abs(m), 6) as growthrate_sigma from merged cross join last")
def growth_rate(spark, sf_dir):
    done = growth.infer(fitness.merge(estimated(spark, sf_dir), REPS).persist(), design(), REPS)
    return done.select("nt_seq", r6("growthrate", "growthrate"), r6("growthrate_sigma", "growthrate_sigma"))


# --- report data --------------------------------------------------------------------------------------------------

_z = lambda e: f"(fitness{e} - {ivw_sql(reps=[r for r in REPS if r != e])[0]}) / sigma{e}"


@query(f"with {EST_SQL} select * from (" + " union all ".join(f"select nt_seq, {e} as rep, round({_z(e)}, 6) as z from est" for e in REPS) + ") where z is not null")
def loo_zscore(spark, sf_dir):
    return report.z_scores(estimated(spark, sf_dir), REPS).select("nt_seq", "rep", r6("z", "z"))


@query(f"with {EST_SQL} " + " union all ".join(f"select 'fitness{a}_uncorr' as x, 'fitness{b}_uncorr' as y, round(corr(fitness{a}, fitness{b}), 6) as r from est" for a, b in ((1, 2), (1, 3), (2, 3))))
def replicate_corr(spark, sf_dir):
    return report.correlations(estimated(spark, sf_dir), [f"fitness{e}_uncorr" for e in REPS]).select("x", "y", r6("r", "r"))


@query(f"with {EST_SQL} select nt_seq, round(var_samp(f), 6) as variance from (" + " union all ".join(f"select nt_seq, fitness{e} as f, fitness1 + fitness2 + fitness3 as whole from est" for e in REPS) + ") where whole is not null group by 1")
def row_variances(spark, sf_dir):
    rows = estimated(spark, sf_dir)
    names = [F.col(f"fitness{e}_uncorr") for e in REPS]
    return rows.where(sum(names[1:], names[0]).isNotNull()).select("nt_seq", r6(estimates.row_variance(names), "variance"))


@query(f"with {VARIANTS_SQL} select nt_seq, length(nt_seq) as n, substr(nt_seq, 1, 1) as first, substr(nt_seq, 30, 1) as last from variants")
def encoded_sequences(spark, sf_dir):
    """A sequence as characters, and the same put together again."""
    rows = _seqs(spark, sf_dir).withColumn("chars", sequence.encode("nt_seq"))
    return rows.select(sequence.decode("chars").alias("nt_seq"), F.size("chars").cast("bigint").alias("n"), F.get("chars", F.lit(0)).alias("first"), F.element_at("chars", -1).alias("last"))


_BIN = "cast(floor(log10(count_e1_s0 + 1.0) / 0.2) as bigint) + 1"


@query(f"with {ANNOTATED_SQL} select least(Nham_nt, 3) as nham, {_BIN} as bin, count(*) as n from retained group by 1, 2")
def count_hist(spark, sf_dir):
    return report.count_histogram(retained(spark, sf_dir), "count_e1_s0").select("nham", "bin", "n")


_cell = lambda c: f"case when {c} >= hi_{c} then 41 else cast(floor(cast(40 as double) * ({c} - lo_{c}) / (hi_{c} - lo_{c})) as bigint) + 1 end"
_bounds = lambda c: f"min({c}) as lo_{c}, case when max({c}) > min({c}) then max({c}) else min({c}) + 1 end as hi_{c}"


@query(f"with {ANNOTATED_SQL}, b as (select {_bounds('count_e1_s0')}, {_bounds('count_e1_s1')} from retained) select {_cell('count_e1_s0')} as bin_x, {_cell('count_e1_s1')} as bin_y, count(*) as n from retained cross join b group by 1, 2")
def count_grid(spark, sf_dir):
    return report.density_grid(retained(spark, sf_dir), "count_e1_s0", "count_e1_s1")


_PLACES = [(i - 0.5) / 400 for i in range(1, 401)]
_Z_ROWS = "z as (" + " union all ".join(f"select {e} as rep, least(greatest({_z(e)}, -10), 10) as z from est where {_z(e)} is not null" for e in REPS) + ")"


@query(f"with {EST_SQL}, {_Z_ROWS}, q as (select rep, unnest(cast({[round(NormalDist().inv_cdf(p), 6) for p in _PLACES]} as double[])) as expected, unnest(quantile_cont(z, {_PLACES})) as z from z group by rep) select rep, expected, round(z, 6) as z from q")
def qq_points(spark, sf_dir):
    return report.qq_points(estimated(spark, sf_dir), REPS).select("rep", r6("expected", "expected"), r6("z", "z"))


_FATE = "case when length(nt_seq) <> 30 then 'Indels (discarded)' when Nham_aa > 2 then 'Too many subs' when Nmut_codons <> Nham_aa and Nham_aa <> 0 then 'Mixed codon' when Nham_nt = 0 then '0 substitutions' when Nham_nt = 1 then '1 substitution' when Nham_nt = 2 then '2 substitutions' else '3+ substitutions' end"
_ALL_SQL = f"{INDELS_SQL}, whole as (select * from variants where length(nt_seq) = 30), translated as (select *, {fixture.amino_sql('nt_seq')} as aa_seq from whole), annotated as (select nt_seq, {', '.join(COUNTS)}, {fixture.differ_sql('nt_seq', WT)} as Nham_nt, {fixture.differ_sql('aa_seq', WT_AMINO)} as Nham_aa, {fixture.codons_sql('nt_seq', WT)} as Nmut_codons from translated union all select nt_seq, {', '.join(COUNTS)}, null, null, null from variants where length(nt_seq) <> 30)"


@query(f"with {_ALL_SQL} select {_FATE} as row, " + ", ".join(f"cast(sum({c}) as bigint) as {report.short_name(c)}" for c in COUNTS) + " from annotated group by 1 having " + " + ".join(f"sum({c})" for c in COUNTS) + " > 0")
def stats_table(spark, sf_dir):
    done = variants.process(fixture.with_indels(spark, sf_dir), config(), checked=False)
    return report.stats_table(done.stats, COUNTS)


@query(
    f"with {ANNOTATED_SQL}, rows as (" + " union all ".join(f"select '{c}' as sample, Nham_nt as nham, sum({c}) as reads from retained group by 2" for c in COUNTS) + "), "
    + "lost as (" + " union all ".join(f"select '{c}' as sample, case when Nham_aa > 2 then 'too_many_substitutions' else 'mixed_substitutions' end as category, sum({c}) as reads from annotated where Nham_aa > 2 or (Nmut_codons <> Nham_aa and Nham_aa <> 0) group by 2" for c in COUNTS) + "), "
    "every as (select sample, 'nuc_subst' as category, nham, reads from rows union all select sample, category, null, reads from lost) "
    "select sample, category, cast(nham as int) as nham, cast(reads as bigint) as reads, round(reads / sum(reads) over (partition by sample), 6) as share from every"
)
def processing_shares(spark, sf_dir):
    stats = variants.process(fixture.variants(spark, sf_dir), config(), checked=False).stats
    return report.processing_shares(stats).select("sample", "category", "nham", "reads", r6("share", "share"))


# --- reads --------------------------------------------------------------------------------------------------------

_READ_OPTIONS = {"cutadapt_min_length": 14, "vsearch_min_qual": 29, "vsearch_max_ee": 0.02, "trans_library": True, "trans_library_reverse_complement": True}
_EE = "(case when i % 13 = 0 then power(10, -0.2) + (length(seq1) - 1) * power(10, -4.0) else length(seq1) * power(10, -event_quality / 10.0) end + length(seq2) * power(10, -event_quality / 10.0))"
_GATE = f"case when least(length(seq1), length(seq2)) < 14 then 'Too_short' when least(least1, event_quality) < 29 then 'Min_Q_too_low' when {_EE} > 0.02 then 'Exp.errs._too_high' end"


@query(f"with {EVENTS_SQL} select read_id, seq1 from quality where least1 >= 30")
def phred_filter(spark, sf_dir):
    return reads.quality_filter(fixture.event_pairs(spark, sf_dir), 30, "qual1").select("read_id", "seq1")


@query(f"with {EVENTS_SQL} select read_id, round({_EE}, 6) as expected_errors from quality")
def expected_errors(spark, sf_dir):
    both = sequence.expected_errors("qual1") + sequence.expected_errors("qual2")
    return fixture.event_pairs(spark, sf_dir).select("read_id", r6(both, "expected_errors"))


@query(f"with {EVENTS_SQL} select read_id, seq1 || reverse(translate(seq2, 'ACGT', 'TGCA')) as seq, {_GATE} as fail_reason from quality")
def trans_concat(spark, sf_dir):
    return reads.concatenate(fixture.event_pairs(spark, sf_dir), config(**_READ_OPTIONS)).select("read_id", "seq", "fail_reason")


_QUAL = lambda n: f"repeat(chr(cast(33 + event_quality as int)), cast({n} as int))"


@query(f"with {EVENTS_SQL} select read_id, case when i % 13 = 0 then '#' || repeat('I', cast(length(seq1) - 1 as int)) else {_QUAL('length(seq1)')} end || {_QUAL('length(seq2)')} as qual from quality")
def trans_quality(spark, sf_dir):
    return reads.concatenate(fixture.event_pairs(spark, sf_dir), config(**_READ_OPTIONS)).select("read_id", "qual")


_reason = lambda r: f"count(*) filter (where g = '{r}')"


@query(f"with {EVENTS_SQL}, gated as (select *, {_GATE} as g from quality) select sample_id, count(*) as Pairs, count(*) filter (where g is null) as Merged, {_reason('Too_short')} as Too_short, {_reason('Min_Q_too_low')} as Min_Q_too_low, {_reason('Exp.errs._too_high')} as Exp_errs_too_high from gated group by 1")
def read_stats(spark, sf_dir):
    done = reads.read_statistics(reads.concatenate(fixture.event_pairs(spark, sf_dir), config(**_READ_OPTIONS)))
    return done.select("sample_id", "Pairs", "Merged", "Too_short", "Min_Q_too_low", F.col("Experrs_too_high").alias("Exp_errs_too_high"))


@query(f"with {EVENTS_SQL}, s as (select sample_id, list_sort(list(length(seq1))) as l from quality group by 1) select sample_id, l[1] as length_min, l[len(l) // 4 + 1] as length_low, l[len(l) // 2 + 1] as length_median, l[3 * len(l) // 4 + 1] as length_high, l[len(l)] as length_max from s")
def length_quantiles(spark, sf_dir):
    return reads.length_quantiles(fixture.event_pairs(spark, sf_dir), seq="seq1")


@query(f"with {EVENTS_SQL}, each as (select sample_id, unnest(range(1, length(seq2) + 1)) as position, event_quality as q from quality) select sample_id, position, count(*) as n, round(avg(q), 6) as mean from each group by 1, 2")
def quality_positions(spark, sf_dir):
    rows = reads.quality_by_position(fixture.event_pairs(spark, sf_dir), "sample_id", "qual2")
    return rows.select("sample_id", F.col("position").cast("bigint").alias("position"), "n", r6("mean", "mean"))


@query(f"with {EVENTS_SQL}, each as (select sample_id, seq2, unnest(range(1, length(seq2) + 1)) as position from quality) select sample_id, position, substr(seq2, position, 1) as base, count(*) as n from each group by 1, 2, 3")
def base_counts(spark, sf_dir):
    rows = reads.base_composition(fixture.event_pairs(spark, sf_dir), "sample_id", "seq2")
    return rows.select("sample_id", F.col("position").cast("bigint").alias("position"), "base", "n")


_CODES = ["ACGT", "CATG", "TTGA", "GCCA"]
_code_sql = "case " + " ".join(f"when substr(seq1, 1, 4) = '{c}' then 'bc{i}'" for i, c in enumerate(_CODES)) + " end"


@query(f"with {EVENTS_SQL}, d as (select *, {_code_sql} as bc from pairs) select read_id, bc, case when bc is null then seq1 else substr(seq1, 5) end as seq from d")
def demux(spark, sf_dir):
    rows = [{"new_pair_prefix": f"bc{i}", "barcode1": c, "barcode2": c} for i, c in enumerate(_CODES)]
    done = reads.demultiplex(fixture.event_pairs(spark, sf_dir).drop("sample_id"), rows, 0.0, paired=False)
    return done.select("read_id", F.col("sample_id").alias("bc"), F.col("seq1").alias("seq"))


@query(f"with {EVENTS_SQL} select read_id, strpos(seq1, 'ACG') > 0 as found, case when strpos(seq1, 'ACG') > 0 then substr(seq1, 1, strpos(seq1, 'ACG') - 1) else seq1 end as seq from pairs")
def adapter_trim(spark, sf_dir):
    done = reads.trim(fixture.event_pairs(spark, sf_dir), "1", reads.Adapter.of(None, "ACG"), 0.0, 3)
    return done.select("read_id", F.col("trimmed1").alias("found"), F.col("seq1").alias("seq"))


_linked = "strpos(seq1, 'ACG') > 0"
_rest = "substr(seq1, strpos(seq1, 'ACG') + 3)"


@query(f"with {EVENTS_SQL}, cut as (select read_id, {_linked} as found, case when {_linked} then {_rest} else seq1 end as rest from pairs) select read_id, found, case when strpos(rest, 'TTG') > 0 then substr(rest, 1, strpos(rest, 'TTG') - 1) else rest end as seq from cut")
def adapter_linked(spark, sf_dir):
    done = reads.trim(fixture.event_pairs(spark, sf_dir), "1", reads.Adapter.of(None, "ACG;required...TTG;optional"), 0.0, 3)
    return done.select("read_id", F.col("trimmed1").alias("found"), F.col("seq1").alias("seq"))


@query(f"with {EVENTS_SQL} select read_id, strpos(seq1, 'GTC') > 0 as found, case when strpos(seq1, 'GTC') > 0 then substr(seq1, strpos(seq1, 'GTC') + 3) else seq1 end as seq from pairs")
def adapter_five(spark, sf_dir):
    done = reads.trim(fixture.event_pairs(spark, sf_dir), "1", reads.Adapter.of("GTC", None), 0.0, 3)
    return done.select("read_id", F.col("trimmed1").alias("found"), F.col("seq1").alias("seq"))


_wrong = lambda seq, code: "(" + " + ".join(f"cast(substr({seq}, {i}, 1) <> '{c}' as int)" for i, c in enumerate(code, 1)) + ")"
_NEAR = ", ".join(f"case when {_wrong('seq1', c)} <= 1 and {_wrong('seq2', c)} <= 1 then {_wrong('seq1', c)} + {_wrong('seq2', c)} else 99 end as d{i}" for i, c in enumerate(_CODES))
_LEAST = "least(" + ", ".join(f"d{i}" for i in range(len(_CODES))) + ")"
_PICK = f"case when {_LEAST} = 99 then null " + " ".join(f"when d{i} = {_LEAST} then 'bc{i}'" for i in range(len(_CODES))) + " end"


@query(f"with {EVENTS_SQL}, near as (select *, {_NEAR} from pairs), picked as (select *, {_PICK} as bc from near) select read_id, bc, case when bc is null then seq1 else substr(seq1, 5) end as seq1, case when bc is null then seq2 else substr(seq2, 5) end as seq2 from picked")
def demux_mates(spark, sf_dir):
    """Barcodes on both mates, with an error each."""
    rows = [{"new_pair_prefix": f"bc{i}", "barcode1": c, "barcode2": c} for i, c in enumerate(_CODES)]
    done = reads.demultiplex(fixture.event_pairs(spark, sf_dir).drop("sample_id"), rows, 0.25)
    return done.select("read_id", F.col("sample_id").alias("bc"), "seq1", "seq2")


_MERGE = f"""{EVENTS_SQL}, mates as (
  select read_id, i, event_quality, seq1 as a, 'GTACGT' || substr(seq1, 3) as b from quality
), shifted as (
  select *, unnest(range(1 - length(b), length(a))) as s from mates
), overlapped as (
  select *, greatest(0, s) as lo, least(length(a), s + length(b)) as hi from shifted
), compared as (
  select *, list_filter(range(lo, hi), lambda x: substr(a, x + 1, 1) <> substr(b, x - s + 1, 1)) as differ from overlapped where hi - lo >= 8
), ranked as (
  select *, hi - lo - 4 * len(differ) as score, row_number() over (partition by read_id order by hi - lo - 4 * len(differ) desc, s) as place from compared
)"""


@query(f"with {_MERGE}, best as (select *, case when score <= 0 then 'No_alignment_found' when len(differ) > 8 then 'Too_many_diffs' end as failed from ranked where place = 1) select read_id, case when failed is not null then null when i % 13 <> 0 then substr(a, 1, greatest(s, 0)) || substr(b, greatest(-s, 0) + 1) else case when s > 0 then substr(a, 1, 1) else substr(b, 1 - s, 1) end || substr(a, 2, hi - 1) || case when hi = length(a) then substr(b, hi - s + 1) else '' end end as seq, case when failed is not null then failed when len(list_filter(differ, lambda x: x > 0 or i % 13 <> 0)) > 0 or (s > 0 and (event_quality < 30 or i % 13 = 0)) then 'Min_Q_too_low' end as fail_reason from best")
def pair_merge(spark, sf_dir):
    """The second mate lacks the first two bases and has six others. Its bases are the better ones, but in pairs whose
    first mate is as good behind its first base."""
    pairs = fixture.event_pairs(spark, sf_dir)
    mate = F.concat(sequence.reverse_complement(F.substring("seq1", 3, 40)), F.lit("ACGTAC"))
    pairs = pairs.withColumns({"seq2": mate, "qual2": F.repeat(F.lit("I"), F.length(mate))})
    return reads.merge_pairs(pairs, config(cutadapt_min_length=5, vsearch_min_ovlen=8, vsearch_max_ee=5.0)).select("read_id", "seq", "fail_reason")


# --- models -------------------------------------------------------------------------------------------------------


@query()
def norm_model(spark, sf_dir):
    _, norm = error_model.fit(retained(spark, sf_dir).persist(), REPS, True, True, n_bootstraps=1)
    row = norm.row()
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))


@query()
def error_model_fit(spark, sf_dir):
    errors, _ = error_model.fit(retained(spark, sf_dir).persist(), REPS, True, True)
    return spark.createDataFrame([tuple(r.values()) for r in errors.rows], "parameter string, rep int, mean_value double, CI90_lower double, CI90_upper double, ensemble int")


@query()
def fitness_run(spark, sf_dir):
    """A whole run from counts: annotation, both models, fitness, all variants merged."""
    from varsift.plans.pipeline import fitness_tables

    plain = ExperimentDesign([r | {"generations": None, "cell_density": None} for r in design().rows])
    tables, *_ = fitness_tables(retained(spark, sf_dir), config(), plain, REPS)
    return tables["all_variants"].select("nt_seq", "aa_seq", "Nham_aa", "mean_count", "fitness", "sigma")
