import os
import shutil
import subprocess
import sys

import pytest
from check_sql import compare, connect

import __spark_entry__ as entry
from workload.registry import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "select_points", "metric_path", "points_sink_round_trip", "counter_rate", "math_ratio", "rollup_by_user",
    "rollup_catalog", "route_chain", "bucket_previous_fill", "top_series", "distribution_cumulative",
    "host_status", "missing_series", "throughput_per_user", "disk_histogram_pd_latency_read",
    "extract_with_rules", "extract_sections", "drop_stale", "stream_rate", "extract_with_math", "extract_every_column",
    "extract_at_item_rates", "route_job_sums", "service_table_mds", "server_table", "tag_catalog",
    "throughput_per_job_over_time", "stream_latest_merged", "stream_extract_rates", "stream_throughput_per_job",
)


def test_every_query_has_its_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())
    assert len(QUERIES) > 120


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_id", "avg", "max", "current"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    ok, detail = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, detail


BAD_PLANS = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def test_no_plan_crosses_tables_or_leaves_the_jvm(spark):
    for name, fn in QUERIES.items():
        if name.startswith(("stream_", "extract_", "points_sink")):
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(b in plan for b in BAD_PLANS), name


def test_scans_read_only_what_a_query_needs(spark):
    plan = entry.queries()["rollup_by_target"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "event_id" not in read and "EqualTo(event_type,view)" in plan.split("PushedFilters: ")[1]


WITHOUT_DOCUMENTS = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
assert not any(n == "pipeline" or n.startswith("op") for n in entry.queries())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert entry.queries()["select_points"](spark, "/root/testdata/sf0.001").count() > 0
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_without_the_document_operators(tmp_path, pipeline):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    left_out = shutil.ignore_patterns("llm", "__pycache__")
    for name in ("tallyflow", "workload"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=left_out)
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(f"{root}/{name}"):
            shutil.copy(f"{root}/{name}", tmp_path / name)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", WITHOUT_DOCUMENTS], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
