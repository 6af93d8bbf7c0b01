"""Every registered query against its brute-force version, on edge cases, on empty tables, and on the small tables."""

from __future__ import annotations

import os

import pytest

from tests.llm import brute
from tests.llm.test_parts import plain_labels
from varsift.llm import licenses, queries, toxicity

SMALL = "/root/testdata/sf0.001"
DIRS = ["edge", pytest.param("small", marks=pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables"))]
Q = {name.split("_")[0]: fn for name, fn in queries.queries().items()}


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture(params=DIRS)
def folder(request, edge_dir):
    return edge_dir if request.param == "edge" else SMALL


def rows(spark, folder, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{table}.parquet").select(*columns).collect()]


def docs(spark, folder):
    return rows(spark, folder, "documents", "doc_id", "text")


def test_token_store(spark, folder):
    from pyspark.sql import functions as F

    ordered = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id", F.xxhash64("text"), "text").select("doc_id", "text").collect()]
    same(Q["op2"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), brute.op2(ordered))


def test_topk(spark, folder):
    same(Q["op3"](spark, folder).select("query_id", "rank", "vec_id", "score").collect(), brute.op3(rows(spark, folder, "embeddings", "vec_id", "embedding")))


def test_decontaminate(spark, folder):
    got = Q["op5"](spark, folder).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute.op5(docs(spark, folder), rows(spark, folder, "benchmark", "item_id", "text"))
    same(got, want)
    assert any(r[2] for r in want)


def test_secrets(spark, folder):
    got = Q["op6"](spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    same(got, brute.op6(docs(spark, folder)))


def test_url_rules(spark, folder):
    same(Q["op7"](spark, folder).select("page_id", "host", "path", "rule", "verdict").collect(), brute.op7(rows(spark, folder, "pages", "page_id", "url")))


def test_simhash(spark, folder):
    same(Q["op8"](spark, folder).select("doc_id", "fingerprint", "component_id").collect(), brute.op8(docs(spark, folder)))


def test_byte_bpe(spark, folder):
    same(Q["op9"](spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), brute.op9(docs(spark, folder)))


def test_licenses(spark, folder):
    found = Q["op10"](spark, folder).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found], brute.op10(docs(spark, folder)))
    assert all(0 <= r.score <= 1 for r in found)
    want = [(i, ",".join(sorted({*filter(None, base.split(",")), *plain_labels(t, licenses.TEMPLATES, licenses.CONTAINMENT)}))) for (i, t), (*_, base) in zip(docs(spark, folder), brute.op10(docs(spark, folder)))]
    same([(r.doc_id, r.labels) for r in found], want)


def test_token_counts(spark, folder):
    same(Q["op4"](spark, folder).select("doc_id", "n_tokens", "n_tokens_edited").collect(), brute.op4(docs(spark, folder)))


def test_toxicity_scores(spark, folder):
    """Scores and flags are those of the trained field by forward and backward sums of each whole text."""
    frames = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    field = toxicity.train(frames[0].select("doc_id", "text"), frames[1], toxicity.held_out())
    got = sorted(((r.doc_id, r.score) for r in Q["op1"](spark, folder).collect()), key=key)
    want = sorted(brute.op1(docs(spark, folder), field), key=key)
    assert [d for d, _ in got] == [d for d, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


def test_toxicity_rows(spark, folder):
    found = Q["op1"](spark, folder).collect()
    assert len(found) == len(docs(spark, folder))
    import zlib

    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty_dir, name):
    assert Q[name](spark, empty_dir).collect() == []
