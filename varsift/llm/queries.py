"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varsift.llm import bpe, common, decontaminate, licenses, secrets_scan, simhash, token_counts, token_store, topk, toxicity, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [toxicity.op1_toxicity, token_store.op2_token_store, topk.op3_topk, token_counts.op4_token_counts, decontaminate.op5_decontaminate, secrets_scan.op6_secrets, url_rules.op7_url_rules, simhash.op8_simhash, bpe.op9_byte_bpe, licenses.op10_licenses]
    return {f.__name__: _prepared(f) for f in found}


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.small_batches(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": topk.SQL, "op5_decontaminate": decontaminate.SQL, "op7_url_rules": url_rules.SQL, "op10_licenses": licenses.SQL}
