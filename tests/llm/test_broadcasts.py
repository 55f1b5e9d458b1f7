"""Joins whose sides Spark sizes far too low: nothing that grows with the data is broadcast."""

import re

import pytest
from conftest import sentence

from tallyflow.llm import simhash_golay, templates


def joins(df):
    """Kinds of joins in the first and the last plan of a table that has been collected."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(\w+Join) (\[.*?\]), \[.*?\], \w+(?:, (Build\w+))?", plan)


@pytest.fixture
def copies(spark, tmp_path):
    """Five texts 2,000 times each, which take a few KB as a file, and rows that repeat id and text."""
    texts = [sentence(k, 100) for k in range(5)]
    rows = spark.range(10_000).selectExpr("id AS doc_id", "id % 5 AS k")
    rows = rows.union(rows.where("doc_id < 3")).join(spark.createDataFrame(list(enumerate(texts)), "k bigint, text string"), "k")
    rows.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_index_and_look_ups_of_fingerprints_are_merged(spark):
    fps = [x * 0x9E3779B97F4A7C15 % 2**63 for x in range(1, 300)]
    fps += [f ^ 1 << k % 60 for k, f in enumerate(fps) if k % 3 == 0]
    found = simhash_golay.links(spark.createDataFrame([(f,) for f in set(fps)], "fp bigint"))
    got = {(r.a, r.b) for r in found.collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3} and len(got) >= 100
    assert {kind for kind, _, _ in joins(found)} == {"SortMergeJoin"}


def test_fingerprints_of_copies_are_merged(spark, copies):
    found = simhash_golay.components(copies)
    assert {r.component for r in found.collect()} == set(range(5)) and found.count() == 10_003
    kinds = {(kind, build) for kind, keys, build in joins(found) if keys.startswith("[fp#")}
    assert kinds and ("BroadcastHashJoin", "BuildLeft") not in kinds


def test_documents_with_copies_are_not_broadcast(spark, copies):
    left = simhash_golay.first_of_each(copies)
    assert sorted(r.doc_id for r in left.collect()) == list(range(5))
    kinds = {(kind, build) for kind, keys, build in joins(left) if "doc_id#" in keys}
    assert kinds and ("BroadcastHashJoin", "BuildLeft") not in kinds


def test_windows_of_many_items_are_merged(spark, tmp_path, monkeypatch):
    items = spark.range(1_500).selectExpr("id AS item_id", f"'{sentence(7, 80)}' AS text")
    items.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "so " + sentence(7, 80)), (2, sentence(8, 80)), (3, None)], "doc_id bigint, text string")
    for kind in ("SortMergeJoin", "BroadcastHashJoin"):
        found = templates.matches(docs, items)
        got = {(r.id, r.item_id, r.n_windows, r.exact) for r in found.collect()}
        assert got == {(1, k, 71, True) for k in range(1_500)}
        assert {j[0] for j in joins(found) if j[1].startswith("[wh#")} == {kind}
        monkeypatch.setattr(templates, "BROADCAST", 1 << 40)
