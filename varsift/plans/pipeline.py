"""Runs: reads to counts to fitness, counts to fitness, and enrichment of libraries.

Stages 0 to 3 process reads, 4 annotates variants, 5 estimates fitness. A run may stop after any stage and start at
stage 4 from a stored tally, or at stage 5 from the stored annotated table.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varsift.functions import estimates, sequence
from varsift.operators import counts, enrichment, error_model, fitness, growth, mutations, reads, variants
from varsift.plans import outputs, report
from varsift.plans.config import RunConfig
from varsift.sources import fastq, files, reports
from varsift.sources.counts import read_count_file, read_stored, read_tally
from varsift.sources.design import ExperimentDesign, read_barcode_design, read_synonyms

LOG = logging.getLogger(__name__)


def read_design(config: RunConfig) -> ExperimentDesign:
    return ExperimentDesign.read(config.experiment_design_path, config.count_path, config.fastq_file_dir, config.experiment_design_pair_duplicates)


def sample_reads(spark: SparkSession, config: RunConfig, design: ExperimentDesign) -> dict[str, tuple[dict, DataFrame]]:
    """For each design row its sample code and its reads with columns seq1, qual1 (and seq2, qual2), demultiplexed."""

    def load(folder: str, first: str, second: str | None) -> DataFrame:
        a = [str(files.locate(folder) / first)]
        if config.paired and second:
            return fastq.read_fastq(spark, a, [str(files.locate(folder) / second)])
        return fastq.read_fastq(spark, a).withColumnsRenamed({"seq": "seq1", "qual": "qual1"})

    parts: dict[str, DataFrame] = {}
    if config.barcode_design_path is not None:
        rows = read_barcode_design(config.barcode_design_path)
        for pair in dict.fromkeys((r["pair_directory"], r["pair1"], r.get("pair2")) for r in rows):
            own = [r for r in rows if (r["pair_directory"], r["pair1"], r.get("pair2")) == pair]
            split = reads.demultiplex(load(*pair), own, config.barcode_error_rate, config.paired)
            for r in own:
                one = split.where(F.col("sample_id") == r["new_pair_prefix"]).drop("sample_id")
                parts[r["new_pair_prefix"]] = parts[r["new_pair_prefix"]].unionByName(one) if r["new_pair_prefix"] in parts else one
    out = {}
    for row in design.rows:
        prefix = str(row.get("pair1") or "").split(".fastq")[0].removesuffix("1")
        source = parts[prefix] if prefix in parts else load(row["pair_directory"], row["pair1"], row.get("pair2"))
        out[design.sample_code(row)] = (row, source)
    return out


def run_reads(spark: SparkSession, config: RunConfig, design: ExperimentDesign) -> DataFrame | None:
    """Stages 0 to 3; the tally as (sample_id, nt_seq, count), stored in 5_tally."""
    samples = sample_reads(spark, config, design)
    project = config.project_path
    if config.stop_stage < 1:
        return None
    if config.start_stage <= 1:
        for code, (_, df) in samples.items():
            quality = reads.quality_by_position(df.withColumn("file", F.lit(code)), qual="qual1")
            quality.write.mode("overwrite").parquet(files.uri(project / "2_fastqc" / f"{code}.parquet"))
            bases = reads.base_composition(df.withColumn("file", F.lit(code)), seq="seq1")
            bases.write.mode("overwrite").parquet(files.uri(project / "2_fastqc" / f"{code}_bases.parquet"))
        if config.stop_stage < 2:
            return None
    if config.start_stage <= 2:
        for code, (row, df) in samples.items():
            asked = row if config.trans_library else reads.link_adapters(row | reads.trim_options(row, config), config)
            if not config.stranded and config.paired and asked.get("cutadapt5First") and asked.get("cutadapt5Second"):
                df = reads.orient(df, asked["cutadapt5First"], asked["cutadapt5Second"], config.cutadapt_error_rate, config.cutadapt_overlap)
            samples[code] = (row, reads.trim_pairs(df, asked, config))
    if config.stop_stage < 3:
        for code, (_, df) in samples.items():
            df.write.mode("overwrite").parquet(files.uri(project / "3_trim" / f"{code}.parquet"))
        return None
    aligned = None
    for code, (_, df) in samples.items():
        one = reads.process(df, config).select(F.lit(code).alias("sample_id"), "seq", "qual", "fail_reason")
        aligned = one if aligned is None else aligned.unionByName(one)
    aligned.write.mode("overwrite").parquet(files.uri(project / "4_align" / "reads.parquet"))
    aligned = spark.read.parquet(files.uri(project / "4_align" / "reads.parquet"))
    good = aligned.where("fail_reason is null")
    facts = reads.read_statistics(aligned).join(reads.length_quantiles(good), "sample_id", "left").collect()
    for r in facts:
        stats = {k: r[k.replace(".", "")] for k in reports.COUNTERS}
        stats |= {f"Merged_length_{k}": "NA" if r[f"length_{k}"] is None else r[f"length_{k}"] for k in reports.LENGTHS}
        reports.write_report(project / "4_align" / f"{r.sample_id}.report", stats)
    counts.tally(good.withColumn("seq", F.lower("seq"))).write.mode("overwrite").partitionBy("sample_id").parquet(files.uri(project / "5_tally"))
    return spark.read.parquet(files.uri(project / "5_tally"))


def build_counts(spark: SparkSession, config: RunConfig, design: ExperimentDesign) -> DataFrame | None:
    """nt_seq and count_e{E}_s{S}: from the count file, a stored tally, or reads. None if the run ends with reads."""
    if config.count_path is not None:
        return counts.cells_from_columns(read_count_file(spark, config.count_path, design), design)
    if config.start_stage >= 4:
        stored = config.project_path / "5_tally"
        if any(stored.glob("*.vsearch.unique")):
            tally = read_tally(spark, {design.sample_code(r): files.uri(stored / f"{design.sample_code(r)}.vsearch.unique") for r in design.rows})
        else:
            tally = read_stored(spark, files.uri(stored))
    else:
        tally = run_reads(spark, config, design)
    if tally is None or config.stop_stage < 4:
        return None
    return counts.wide_counts(tally.select("nt_seq", "count", "sample_id"), design)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run(spark: SparkSession, config: RunConfig) -> dict[str, DataFrame]:
    """A whole run; result tables by name (empty if it stopped early). Files go below output_path / project_name."""
    config.tmp_path.mkdir(parents=True, exist_ok=True)
    design = read_design(config)
    reps = design.retained(config.retained_replicates)
    if len(reps) < 2 and not config.enrichment_mode:
        LOG.warning("fewer than two replicates: neither normalisation nor error model")
        config.fitness_normalise = config.fitness_error_model = False
    if config.enrichment_mode:
        return run_enrichment(spark, config, design, reps)
    stored = config.project_path / f"{config.project_name}_variant_data_merge.parquet"
    stats = wide = None
    if config.start_stage < 5:
        wide = build_counts(spark, config, design)
        if wide is None:
            return {}
        # the annotated table has all reads' variants and is read by several parts: written once, at any size
        annotated = files.scratch(spark, "annotated")
        done = variants.process(wide, config, persist=lambda d: written(d, annotated))
        for kind, rows in (("_indel", done.indel), ("_rejected", done.rejected), ("", done.retained)):
            outputs.write_text(rows, config.project_path / f"{config.project_name}{kind}_variant_data_merge.tsv")
        done.retained.write.mode("overwrite").parquet(files.uri(stored))
        done.stats.write.mode("overwrite").parquet(files.uri(config.tmp_path / "stats.parquet"))
        files.remove(annotated)
    if config.stop_stage < 5:
        return {}
    retained = read_stored(spark, files.uri(stored))
    stats = read_stored(spark, files.uri(config.tmp_path / "stats.parquet"))
    return run_fitness(retained, stats, config, design, reps)


def fitness_tables(retained: DataFrame, config: RunConfig, design: ExperimentDesign, reps: list[int]) -> tuple[dict[str, DataFrame], DataFrame, fitness.ErrorModel | None, fitness.NormModel | None]:
    """Result tables, the fitness of all variants, and the models; written nowhere."""
    ref = config.wt_variable_seq.lower() if config.has_constant_region else config.wt_nt_seq
    rows = fitness.filter_low_counts(retained, config, reps).withColumn("error_model", F.lit(True))
    if config.coding and config.mixed_substitutions:
        synonyms = read_synonyms(config.synonym_sequence_path) if config.synonym_sequence_path else []
        rows = fitness.aggregate_counts(rows, reps, synonyms)
    else:
        rows = rows.withColumn("merge_seq", F.col("nt_seq"))
    rows = rows.persist()  # small next to the reads, and the models, scalars and all tables come from it
    errors, norm = error_model.fit(rows, reps, config.fitness_normalise, config.fitness_error_model)
    rows = fitness.add_dropout_pseudocount(rows, config.fitness_dropout_pseudocount, reps)
    every = fitness.calculate_fitness(rows, config, reps, errors, norm)
    if config.coding and not config.mixed_substitutions:
        every = fitness.aggregate_fitness(every, reps)
    every = every.persist()
    own = every.where(F.coalesce("error_model", F.lit(True)))
    target = sequence.translate_text(ref) if config.coding else ref
    single = mutations.singles(own, target, config.coding)
    double = mutations.doubles(own, single, target, config.coding)
    if design.has_generations():
        generations = design.mean("generations", 1)
        every, double = (fitness.by_generations(d, generations, reps) for d in (every, double))
        single = fitness.by_generations(single, generations, reps, suffix="")
    if design.has_growth_data():
        every = growth.infer(fitness.merge(every, reps), design, reps)
    return mutations.merged_tables(every, single, double, reps, config.coding, len(target)), every, errors, norm


def run_fitness(retained: DataFrame, stats: DataFrame, config: RunConfig, design: ExperimentDesign, reps: list[int]) -> dict[str, DataFrame]:
    tables, every, errors, norm = fitness_tables(retained, config, design, reps)
    outputs.write_models(config.tmp_path, errors, norm)
    outputs.write_fitness(tables, config.project_path, config.project_name, config.coding)
    names = estimates.count_names(reps)
    spark = retained.sparkSession
    found = {
        "reads": reports.collect_reports(spark, config.project_path) if (config.project_path / "4_align").is_dir() else None,
        "trimmed": reports.collect_trim_stats(spark, config.project_path) if list((config.project_path / "3_trim").glob("*.stdout")) else None,
    }
    report.write_report(config.project_path / "report.html", config, stats, retained, every, reps, names, **found)
    return tables


def run_enrichment(spark: SparkSession, config: RunConfig, design: ExperimentDesign, reps: list[int]) -> dict[str, DataFrame]:
    stored = config.project_path / f"{config.project_name}_library_variant_data.parquet"
    if config.start_stage < 5:
        wide = build_counts(spark, config, design)
        if wide is None:
            return {}
        library = enrichment.annotate(wide, config)
        outputs.write_text(library, config.project_path / f"{config.project_name}_library_variant_data.tsv")
        library.write.mode("overwrite").parquet(files.uri(stored))
    if config.stop_stage < 5:
        return {}
    rows = fitness.filter_low_counts(read_stored(spark, files.uri(stored)), config, reps).withColumn("error_model", F.lit(True))
    rows = fitness.add_dropout_pseudocount(rows, config.fitness_dropout_pseudocount, reps)
    norm = enrichment_normalisation(rows, reps)
    table = enrichment.calculate(rows, config, reps, norm)
    if design.has_generations():
        table = enrichment.by_generations(table, design.mean("generations", 1), reps)
    outputs.write_models(config.tmp_path, None, norm, "_enrichment")
    out = enrichment.report(table, reps)
    outputs.write_enrichment(out, config.project_path, config.project_name)
    return {"variants": out}


def enrichment_normalisation(rows: DataFrame, reps: list[int]) -> fitness.NormModel | None:
    """Scale and shift of the replicates of a library; none without two replicates or sequences read in all."""
    if len(reps) < 2:
        return None
    least = error_model.input_threshold(rows, reps).first()[0]
    if least is None:
        return None
    work = rows.withColumns({f"fitness{e}": estimates.log_ratio(e) for e in reps})
    work = work.where(F.coalesce(estimates.all_reads(reps) & estimates.inputs_above(reps, least), F.lit(False)))
    return None if work.isEmpty() else error_model.fit_normalisation(work, reps)
