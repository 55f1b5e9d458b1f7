"""Time ranges, ties, replaced windows and streamed rates of mixed points."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.text import number
from tallyflow.model import POINT_SCHEMA
from tallyflow.operators import rates as R
from tallyflow.operators import status as H
from tallyflow.operators import summary as S
from tallyflow.plans import panels as Q
from tallyflow.sources import points as P
from tallyflow.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("order", [1, -1])
def test_ties_at_a_chunks_end(spark, order):
    data = [("m", "h", {}, at(s), "derive", float(v)) for s, v in ((0, 40), (3540, 100), (3540, 160), (3600, 220))][::order]
    points = spark.createDataFrame(data, POINT_SCHEMA).coalesce(1)
    whole = {r.ts: r.value for r in R.rate(points, chunk=None).collect()}
    assert {r.ts: r.value for r in R.rate(points, chunk=3600).collect()} == whole and whole[at(3600)] == 1.0


def test_numbers_are_cut_off(spark):
    rows = [("12.7", 12.0), ("-5", None), ("007", 7.0), (" 3 ", 3.0), ("", None), ("x1", None), (None, None)]
    df = spark.createDataFrame(rows, "x string, y double").select(F.expr(number("x")).alias("got"), "y")
    assert all(r.got == r.y for r in df.collect())


def test_ranges_prune_stored_tables(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")  # plans show all pushed filters
    data = [("ost_kbytesinfo_free", "h", {"fs_name": f"fs{k % 2}", "ost_index": "0"}, at(86400 * k), "gauge", float(k)) for k in range(8)]
    points = spark.createDataFrame(data, POINT_SCHEMA)
    P.write_points(points, str(tmp_path / "p"))
    stored = P.read_points(spark, str(tmp_path / "p"))
    span = {"start": "2024-01-03", "end": "2024-01-06"}
    found = Q.capacity_per_ost(stored, "fs0", **span)
    assert [(r.avg, r.max) for r in found.collect()] == [(3.0, 4.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(fs_name,fs0)" in plan
    rolled = points.select(F.lit("cqm_ost_kbytesinfo_free-fs_name").alias("measurement"), "tags", F.col("ts").alias("window_start"), F.col("value").alias("sum"))
    P.write_rollup(rolled, str(tmp_path / "r"))
    table = P.read_rollups(spark, str(tmp_path / "r"))
    chosen = P.select_rollups(table, "cqm_ost_kbytesinfo_free-fs_name", where={"fs_name": "fs1"}, **span)
    assert [r.sum for r in chosen.collect()] == [3.0]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(fs_name,fs1)" in plan
    assert [r.ost_index for r in P.tag_values(stored, "ost_kbytesinfo_free", "ost_index", start="2024-02-01").collect()] == []
    with pytest.raises(TypeError):
        Q.cpu_by_state(points, begin="x")


def test_bucket_range_reaches_the_input(spark):
    data = [("m", "h", {}, at(60 * k), "gauge", float(k)) for k in range(10)]
    points = spark.createDataFrame(data, POINT_SCHEMA)
    got = S.bucket(points, "2 minutes", ["host"], fn="sum", start=F.lit(at(150)), end=F.lit(at(400)))
    assert sorted((r.bucket, r.value) for r in got.collect()) == [(at(120), 5.0), (at(240), 9.0), (at(360), 13.0)]


def test_replacing_a_window_keeps_the_rest_of_its_day(spark, tmp_path):
    schema = "measurement string, tags map<string,string>, window_start timestamp, sum double"
    rows = [("r", {"fs_name": "a", "job": j}, at(240 * k), 1.0) for k in range(4) for j in "xy"]
    path = str(tmp_path / "r")
    P.write_rollup(spark.createDataFrame(rows, schema), path)
    for _ in range(2):
        P.replace_rollup(spark, spark.createDataFrame([("r", {"fs_name": "a", "job": "x"}, at(240), 9.0)], schema), path)
        back = sorted((r.window_start, r.tags["job"], r.sum) for r in P.read_rollups(spark, path).collect())
        assert back == sorted([(at(240 * k), j, 1.0) for k in (0, 2, 3) for j in "xy"] + [(at(240), "x", 9.0)])


def _stream(spark, folder, data, files, schema=POINT_SCHEMA):
    step = -(-len(data) // files)
    for k in range(files):
        part = data[k * step : (k + 1) * step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_rate_of_mixed_points(spark, tmp_path):
    schema = T.StructType([*POINT_SCHEMA.fields, T.StructField("first_value", T.DoubleType()), T.StructField("interval_gauge", T.BooleanType())])
    data = []
    for k in range(12):
        data.append(("c", "h", {"job": "a"}, at(60 * k), "derive", 120.0 * k + 60, None, False))
        data.append(("f", "h", {"job": "a"}, at(60 * k), "derive", 60.0 * k + 60, 0.0, False))
        data.append(("i", "h", {"job": "a"}, at(60 * k), "derive", 5.0, None, True))
        data.append(("g", "h", {"job": "a"}, at(60 * k), "gauge", 7.0, None, None))
    stream = _stream(spark, str(tmp_path / "in"), data, 4, schema)
    q = J.append_to_table(J.stream_rate(stream), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(120)
    key = lambda r: (r.measurement, r.ts, r.ds_type)
    got = {key(r): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = R.rate(spark.createDataFrame(data, schema))
    expected = {key(r): r.value for r in batch.collect()}
    assert len(expected) == 11 + 12 + 12 + 12 and got == pytest.approx(expected)


def test_latest_table_outlives_a_checkpoint(spark, tmp_path):
    table = str(tmp_path / "t")
    for name, values in (("one", (1, 2)), ("two", (3,)), ("one", (4,))):
        data = [("m", "h", {"job": name}, at(60 * v), "gauge", float(v)) for v in values]
        stream = _stream(spark, str(tmp_path / name), data, len(data))
        q = J.stream_latest(stream, ["job"], table, str(tmp_path / f"cp-{name}"), once=True)
        assert q.awaitTermination(120)
    assert {r.job: r.value for r in J.latest_table(spark, table).collect()} == {"one": 4.0, "two": 3.0}
    with pytest.raises(ValueError):
        J.latest_table(spark, str(tmp_path / "none"))


def test_status_rules_select_by_identifier(spark):
    rows = [("h", "cpu", "", "idle", at(0), 3.0), ("h", "cpu", "", "user", at(0), 90.0), ("k", "load", "", "shortterm", at(0), 1.0)]
    schema = "host string, plugin string, plugin_instance string, type_instance string, ts timestamp, value double"
    points = spark.createDataFrame(rows, schema).withColumn("measurement", F.lit("v"))
    assert {r.host: r.status for r in H.host_status(points).collect()} == {"h": "red", "k": "green"}
