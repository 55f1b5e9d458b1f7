import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyflow.definitions import MathEntry, lustre
from tallyflow.functions.tags import job_owner, parse_tags, size_order
from tallyflow.functions.text import from_posix
from tallyflow.model import POINT_SCHEMA
from tallyflow.operators import aggregate as A
from tallyflow.operators import histogram as H
from tallyflow.operators import metric_math as M
from tallyflow.operators import rates as R
from tallyflow.operators import rollup as U
from tallyflow.operators import status as T
from tallyflow.operators import summary as S
from tallyflow.sources import points as P
from tallyflow.sources.snapshots import as_snapshots, read_snapshots

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def points(spark, rows):
    """rows: (measurement, host, tags, seconds, ds_type, value)"""
    return spark.createDataFrame([(m, h, t, at(s), d, float(v)) for m, h, t, s, d, v in rows], POINT_SCHEMA)


def counter(spark, readings, tags=None):
    return points(spark, [("m", "h", tags or {"a": "1"}, s, "derive", v) for s, v in readings])


@pytest.mark.parametrize("chunk", [None, 1, 100, 86400])
def test_rate_is_the_same_for_any_chunk(spark, chunk):
    rng = random.Random(3)
    rows, expected = [], {}
    for series in range(4):
        t, v, last = 0, 0, None
        for _ in range(60):
            t += rng.choice([1, 7, 60, 260])
            v += rng.randint(0, 50)
            if last:
                expected[(str(series), t)] = (v - last[1]) / (t - last[0])
            rows.append(("m", "h", {"s": str(series)}, t, "derive", v))
            last = (t, v)
    rows.append(("g", "h", {"s": "9"}, 5, "gauge", 42))
    out = R.rate(points(spark, rows), chunk=chunk).collect()
    got = {(r.tags["s"], int((r.ts - T0).total_seconds())): r.value for r in out if r.measurement == "m"}
    assert got == pytest.approx(expected)
    assert [r.value for r in out if r.measurement == "g"] == [42]


def test_reset_policies_and_first_value(spark):
    df = counter(spark, [(0, 100), (60, 160), (120, 30), (180, 90)])
    value = lambda **kw: [round(r.value, 6) for r in R.rate(df, chunk=100, **kw).orderBy("ts").collect()]
    assert value() == [1.0, round(-130 / 60, 6), 1.0]
    assert value(on_reset="null") == [1.0, 1.0]
    assert value(on_reset="zero_base") == [1.0, 0.5, 1.0]
    assert value(first_value=0, interval=50) == [2.0, 1.0, round(-130 / 60, 6), 1.0]
    with pytest.raises(ValueError):
        R.rate(df, on_reset="x")


def test_a_hot_series_is_spread_over_tasks(spark):
    df = counter(spark, [(60 * i, i) for i in range(600)])
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        parts = R.rate(df, chunk=3600).groupBy(F.spark_partition_id()).count().collect()
        whole = R.rate(df, chunk=None).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set(setting, "true")
    assert len(parts) > 1 and len(whole) == 1
    assert sum(r["count"] for r in parts) == sum(r["count"] for r in whole) == 599


def test_sum_of_deltas_is_last_minus_first(spark):
    df = counter(spark, [(60 * i, i * i) for i in range(200)])
    total = R.rate(df, chunk=600).agg(F.sum(F.col("value") * 60)).first()[0]
    assert total == pytest.approx(199 * 199)


def test_math_entries(spark):
    tags = {"fs_name": "a", "ost_index": "OST0"}
    rows = [("t", "h", tags, 0, "gauge", 100), ("f", "h", tags, 0, "gauge", 30), ("t", "h", tags, 60, "gauge", 100),
            ("s", "h", tags, 0, "gauge", 50), ("n", "h", tags, 0, "gauge", 4), ("s", "x", tags, 0, "gauge", 50),
            ("n", "x", tags, 0, "gauge", 0)]
    entries = [MathEntry("t", "-", "f", "used", "used"), MathEntry("s", "/", "n", "mean", "mean"), MathEntry("s", "-", "n", "gap", "gap")]
    out = {(r.measurement, r.host): (r.value, r.tags) for r in M.apply_math(points(spark, rows), entries).collect()}
    assert out == {("used", "h"): (70, tags), ("mean", "h"): (12.5, tags), ("gap", "h"): (46, tags), ("gap", "x"): (50, tags)}
    plan = M.apply_math(points(spark, rows), entries)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert len(lustre.definition("es5_1").math) == 4 + 2 * 77 + 29


def test_rollups(spark):
    rows = [("ost_jobstats_bytes", "h", {"fs_name": "a", "job_id": j, "optype": o, "ost_index": t}, s, "derive", 1 + i)
            for i, (j, o, t, s) in enumerate((j, o, t, s) for j in ("x.1", "y.2") for o in ("sum_read_bytes", "sum_write_bytes", "other")
                                             for t in ("OST0", "OST1") for s in range(0, 600, 60))]
    df = points(spark, rows)
    one = U.rollup(df, "ost_jobstats_bytes", ["job_id", "fs_name"])
    assert {r.measurement for r in one.collect()} == {"cqm_ost_jobstats_bytes-fs_name-job_id"}
    first = one.where("job_id = 'x.1'").orderBy("window_start").first()
    assert first["sum"] == sum(v for _, _, t, s, _, v in rows if t["job_id"] == "x.1" and s < 240) / 4

    reg = U.RollupRegistry()
    rw = ("optype", ("sum_read_bytes", "sum_write_bytes"))
    a = reg.register(U.Rollup("ost_jobstats_bytes", ("fs_name", "job_id"), only=rw))
    reg.register(a)
    with pytest.raises(ValueError):
        reg.register(U.Rollup("ost_jobstats_bytes", ("job_id", "fs_name")))
    reg.register(U.Rollup("ost_jobstats_bytes", ("fs_name", "job_id", "ost_index"), only=rw))
    reg.register(U.Rollup("ost_jobstats_bytes", ("fs_name",)))
    many = U.rollup_many(df, reg).collect()
    got = {(r.measurement, tuple(sorted(r.tags.items())), r.window_start): r["sum"] for r in many}
    expected = {}
    for spec in reg:
        for m, h, t, s, d, v in rows:
            if spec.only and t["optype"] not in spec.only[1]:
                continue
            key = (spec.name, tuple(sorted((k, t[k]) for k in spec.tags)), at(s - s % 240))
            expected[key] = expected.get(key, 0) + v / 4
    assert got == pytest.approx(expected)


def test_rollup_of_a_rollup(spark):
    df = points(spark, [("m", "h", {"a": str(i % 3), "b": str(i % 5)}, 30 * i, "gauge", i) for i in range(100)])
    fine = U.rollup(df, "m", ["a", "b"], interval=60, periods=1).withColumnsRenamed({"window_start": "ts", "sum": "value"})
    direct = {(r.a, r.window_start): r["sum"] for r in U.rollup(df, "m", ["a"]).collect()}
    again = U.rollup(fine.drop("measurement"), "m", ["a"])
    assert {(r.a, r.window_start): r["sum"] for r in again.collect()} == pytest.approx(direct)


def test_absent_tag_is_one_group(spark):
    df = points(spark, [("m", "h", {"a": str(i)}, 0, "gauge", 1) for i in range(5)])
    assert [(r.optype, r["sum"]) for r in U.rollup(df, "m", ["optype"]).collect()] == [("", 1.25)]


def test_aggregate_and_route(spark):
    rows = [("h1", "cpu", str(c), "cpu", st, at(s), float(v)) for c in range(4) for st, v in (("idle", c * 10), ("user", c)) for s in (0, 60)]
    rows += [("h1", "sensors", "x", "temperature", "t1", at(0), 40.0), ("h1", "sensors", "x", "temperature", "t2", at(0), 55.0)]
    df = spark.createDataFrame(rows, "host string, plugin string, plugin_instance string, type string, type_instance string, ts timestamp, value double")
    avg = {(r.type_instance, r.ts): r.value for r in A.aggregate(df, A.CPU_AVERAGE).collect()}
    assert avg == {(t, at(s)): v for t, v in (("idle", 15.0), ("user", 1.5)) for s in (0, 60)}
    assert {(r.plugin, r.plugin_instance) for r in A.aggregate(df, A.CPU_AVERAGE).collect()} == {("aggregation", "cpu-average")}
    rules = [A.RouteRule({"plugin": "^cpu$", "plugin_instance": "^[0-9]+$"}, A.CPU_AVERAGE, stop=True),
             A.RouteRule({"plugin": "^sensors$", "type": "^temperature$"}, A.MAX_TEMPERATURE)]
    out = A.route(df, rules).collect()
    assert sorted((r.plugin, r.value) for r in out if r.type == "temperature") == [("aggregation", 55.0), ("sensors", 40.0), ("sensors", 55.0)]
    assert sum(r.plugin == "cpu" for r in out) == 0 and sum(r.plugin_instance == "cpu-average" for r in out) == 4
    jobs = A.Aggregation(plugin="/^cp.$/", set_plugin="ALL", set_plugin_instance="x-%{aggregation}", by=("host",),
                         functions=("num", "sum", "minimum", "maximum", "stddev"), type="cpu")
    got = {r.plugin_instance: r.value for r in A.aggregate(df, jobs).where("ts = '2024-01-01'").collect()}
    assert got["x-num"] == 8 and got["x-sum"] == 66 and got["x-maximum"] == 30 and got["x-minimum"] == 0


def test_summary_tables(spark):
    df = points(spark, [("m", "h", {"j": j}, s, "gauge", v) for j, s, v in
                        [("a", 0, 5), ("a", 60, 9), ("a", 120, 1), ("b", 0, 7), ("b", 300, 3)]])
    table = {r.j: (r.avg, r.max, r.current) for r in S.series_summary(df, ["j"]).collect()}
    assert table == {"a": (5, 9, 1), "b": (5, 7, 3)}
    assert [r.j for r in S.top(S.series_summary(df, ["j"]), ties=["j"]).collect()] == ["b", "a"]
    assert [r.j for r in S.top(S.series_summary(df, ["j"]), 1, descending=False, ties=["j"]).collect()] == ["a"]
    assert {r.j: (r.ts, r.value) for r in S.latest(df, ["j"]).collect()} == {"a": (at(120), 1), "b": (at(300), 3)}
    assert {r.j: (r.min, r.max) for r in S.extent(df, ["j"]).collect()} == {"a": (1, 9), "b": (3, 7)}
    assert [(r.j, r.value) for r in S.series(df, ["j"]).collect()] == [("a", 5), ("a", 9), ("a", 1), ("b", 7), ("b", 3)]
    full = {(r.j, r.bucket): r.value for r in S.bucket(df, "1 minute", ["j"], fn="sum", fill="null").collect()}
    assert len(full) == 3 + 6 and full[("b", at(60))] is None and full[("b", at(300))] == 3
    span = S.bucket(df, "1 minute", ["j"], fill=0, start=F.lit(at(-60)), end=F.lit(at(301)))
    assert span.count() == 14 and span.agg(F.sum("value")).first()[0] == 25
    prev = {(r.j, r.bucket): r.value for r in S.bucket(df, "1 minute", ["j"], fill="previous").collect()}
    assert prev[("b", at(240))] == 7
    heights = {(r.ts, r.j): r.stacked for r in S.stack(df, [], "j").collect()}
    assert heights[(at(0), "a")] == 5 and heights[(at(0), "b")] == 12


def test_distribution(spark):
    rows = [("m", "h", {"field": f, "size": b}, s, "gauge", v) for f, b, v in
            [("r", "4K", 10), ("r", "16K", 30), ("r", "1M", 60), ("w", "4K", 0)] for s in (0, 60)]
    out = {(r.field, r.size): r for r in H.distribution(points(spark, rows), ["field"], cumulative=True).collect()}
    assert out[("r", "4K")].share == 10 and out[("r", "16K")].cum_share == 40 and out[("r", "1M")].cum_share == 100
    assert out[("w", "4K")].share is None and out[("r", "1M")].bucket_order == 1048576
    assert sum(v.share for k, v in out.items() if k[0] == "r") == pytest.approx(100)


def test_status(spark):
    ok = {"cpu_idle": 90, "load": 1, "memory_free": 5000 * T.MIB, "root_free": 50 * T.GIB}
    hosts = {"good": {}, "warm": {"load": 6}, "bad": {"load": 6, "root_free": 0.5 * T.GIB}, "edge": {"cpu_idle": 20}}
    rows = [(m, h, {}, s, "gauge", v) for h, over in hosts.items() for m, v in (ok | over).items() for s in (60,)]
    rows += [("cpu_idle", "good", {}, 0, "gauge", 1)]
    out = {r.host: r.status for r in T.host_status(points(spark, rows)).collect()}
    assert out == {"good": "green", "warm": "yellow", "bad": "red", "edge": "green"}

    now = points(spark, [("m", "h", {"a": "1"}, 60, "gauge", 1), ("m", "h", {"a": "2"}, 0, "gauge", 1), ("m", "h", {"a": "3"}, 0, "gauge", 1)])
    before = points(spark, [("m", "h", {"a": "1"}, 0, "gauge", 1), ("m", "h", {"a": "2"}, 0, "gauge", 1)])
    assert {r.a: r.fresh for r in T.freshness(before, now, ["a"]).collect()} == {"1": True, "2": False, "3": True}
    assert T.newest_time(now, "m", {"a": "1"}).first().newest == at(60)

    targets = spark.createDataFrame([("fs", "OST0"), ("fs", "OST1")], "fs_name string, ost_index string")
    seen = points(spark, [(m, "h", {"fs_name": "fs", "ost_index": "OST0"}, 0, "gauge", 1) for m in T.EXPECTED["ost"]]
                  + [("ost_filesinfo_free", "h", {"fs_name": "fs", "ost_index": "OST1"}, 0, "gauge", 1)])
    gone = T.missing_series(seen, targets, T.EXPECTED["ost"], ["fs_name", "ost_index"]).collect()
    assert {r.ost_index for r in gone} == {"OST1"} and len(gone) == 5


def test_small_functions(spark):
    df = spark.createDataFrame([("a=1 b=x",), ("NA",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(parse_tags(F.col("t"))).collect()] == [{"a": "1", "b": "x"}, {}, {}, {}]
    sizes = spark.createDataFrame([("64K_pages",), ("16",), ("1M",)], "b string")
    assert [r[0] for r in sizes.select(size_order(F.col("b"))).collect()] == [65536, 16, 1048576]
    jobs = spark.createDataFrame([("dd.500",), ("a.b.7",), ("root",)], "job_id string")
    assert [r[0] for r in jobs.select(job_owner()).collect()] == [
        {"procname": "dd", "uid": "500"}, {"procname": "a.b", "uid": "7"}, {}]
    assert from_posix("dd[.][[:digit:]]+") == "dd[.][0-9]+"


def test_points_at_rest(spark, tmp_path):
    df = points(spark, [(m, "h", {"fs_name": f, "x": str(i)}, 86400 * d, "gauge", i) for m in ("a", "b")
                        for f in ("p", "q") for d in range(2) for i in range(3)])
    path = str(tmp_path / "points")
    P.write_points(df, path)
    back = P.read_points(spark, path)
    assert back.count() == df.count()
    picked = P.select_points(back, "a", where={"fs_name": "p"}, start="2024-01-02")
    assert picked.count() == 3
    plan = picked._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "measurement" in pruned and "date" in pruned
    assert [r[0] for r in P.tag_values(back, "a", "x", where={"fs_name": "q"}).collect()] == ["0", "1", "2"]

    rolled = U.rollup(df, "a", ["fs_name"])
    table = str(tmp_path / "rollups")
    P.replace_rollup(spark, rolled, table)
    P.replace_rollup(spark, rolled, table)
    assert spark.read.parquet(table).count() == rolled.count()
    P.write_rollup(rolled, table)
    assert spark.read.parquet(table).count() == 2 * rolled.count()


def test_metric_names(spark):
    df = spark.createDataFrame([("node.1", "fs-MDT0", "md_stats", "derive", "open"), ("n", "load", "", "load", "")],
                               "host string, plugin string, plugin_instance string, type string, type_instance string")
    assert [r[0] for r in df.select(P.metric_path(df)).collect()] == ["node.1/fs-MDT0-md_stats/derive-open", "n/load/load"]
    assert df.select(P.metric_path(df, sep=".", prefix="top.")).first()[0] == "top.node_1.fs-MDT0-md_stats.derive-open"


def test_read_snapshot_files(spark, tmp_path):
    f = tmp_path / "node7" / "proc" / "fs" / "lustre" / "mdt" / "a-MDT0000" / "md_stats"
    f.parent.mkdir(parents=True)
    f.write_text("open 5 samples [reqs]\n")
    (f.parent / "not_used").write_text("x")
    (tmp_path / "node7" / "show vd c all").write_text("y")
    d = lustre.definition("2.12")
    snap = read_snapshots(spark, str(tmp_path), definition=d, layout="^/([^/]+)(/.*)$")
    assert [(r.host, r.path) for r in snap.collect()] == [("node7", "/proc/fs/lustre/mdt/a-MDT0000/md_stats")]
    from tallyflow.operators.extract import extract

    assert [r.value for r in extract(snap, d).collect()] == [5]
    other = read_snapshots(spark, str(tmp_path / "node7"), host="h", at="2024-01-01", extra_tags={"extrahost": "arr"})
    row = other.where("path = '/show vd c all'").first()
    assert row.host == "h" and row.extra_tags == {"extrahost": "arr"} and row.collected_at == T0
    assert as_snapshots(other.select("path", "content")).columns == other.columns


def test_rates_read_their_input_once_and_mend_every_seam(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, t * 600 + rng.randrange(600), float(rng.randrange(1000))) for s in range(4) for t in range(200) if s < 3 or t % 30 == 0]
    rows += [(0, 5, 1.0), (0, 5, 7.0)]
    made = spark.createDataFrame(rows, "s int, sec bigint, value double").select(
        F.lit("m").alias("measurement"), F.lit("h").alias("host"), F.create_map(F.lit("k"), F.col("s").cast("string")).alias("tags"),
        F.timestamp_seconds("sec").alias("ts"), F.lit("derive").alias("ds_type"), "value",
    )
    made.write.parquet(f"{tmp_path}/points")
    want = {}
    for s in range(4):
        own = sorted((t, v) for k, t, v in rows if k == s)
        for (t0, v0), (t1, v1) in zip(own, own[1:]):
            if t1 > t0:
                want[str(s), t1, round((v1 - v0) / (t1 - t0), 9)] = 1
    for chunk in (3600, 700, 10**7, None):
        df = R.rate(spark.read.parquet(f"{tmp_path}/points"), chunk=chunk)
        got = {(r.tags["k"], int(r.ts.timestamp()), round(r.value, 9)): 1 for r in df.collect()}
        assert got == want
    df = R.rate(spark.read.parquet(f"{tmp_path}/points").drop("ds_type"))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_rules_of_a_chain_share_one_scan_and_one_shuffle(spark, tmp_path):
    rows = [(h, f"fs0-{t}000{i}", pi, "derive", "open", T0, float(v)) for v, (h, t, i, pi) in enumerate(
        (h, t, i, pi) for h in ("a", "b") for t in ("OST", "MDT") for i in range(3) for pi in ("jobstats-1", "stats"))]
    schema = "host string, plugin string, plugin_instance string, type string, type_instance string, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/p")
    df = spark.read.parquet(f"{tmp_path}/p")
    for keep in (False, True):
        got = A.route(df, A.job_sums(keep=keep)).collect()
        own = [r for r in got if r.function is None]
        assert len(own) == (24 if keep else 12)
        want = {(n, h, f): v for n, t in (("MDS", "MDT"), ("OSS", "OST")) for h in "ab"
                for vs in [[r[6] for r in rows if r[0] == h and t in r[1] and r[2] != "stats"]] for f, v in (("sum", sum(vs)), ("average", sum(vs) / 3))}
        assert {(r.plugin, r.host, r.function): r.value for r in got if r.function} == want
    plan = A.route(df, A.job_sums())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 2
    with pytest.raises(ValueError, match="at most 30"):
        A.route(df, [A.RouteRule({"plugin": "x"}, A.CPU_AVERAGE)] * 31)
    assert A.route(df, []).count() == 24


@pytest.mark.parametrize("by", [["j"], []])
@pytest.mark.parametrize("fill", ["null", "previous", 0])
def test_fill_over_blocks_equals_a_plain_walk(spark, monkeypatch, by, fill):
    monkeypatch.setattr(S, "FILL_BLOCK", 4)
    rng = random.Random(9)
    rows = [(j, s * 60, float(s)) for j in "ab" for s in sorted(rng.sample(range(-30, 200), 40))]
    df = spark.createDataFrame(rows, "j string, s bigint, value double").select("j", F.timestamp_seconds("s").alias("ts"), "value")
    for low, high in ((None, None), (-40 * 60, 230 * 60)):
        bounds = {} if low is None else {"start": F.timestamp_seconds(F.lit(low)), "end": F.timestamp_seconds(F.lit(high))}
        got = {(r.j if by else "", int(r.bucket.timestamp())): r.value for r in S.bucket(df, "1 minute", by, fn="sum", fill=fill, **bounds).collect()}
        want = {}
        for j in "ab" if by else [""]:
            own = {}
            for k, s, v in rows:
                if k == j or not by:
                    own[s] = own.get(s, 0.0) + v
            last = None
            for s in range(min(own) if low is None else low, (max(own) if high is None else high) + 1, 60):
                last = own.get(s, last)
                want[j, s] = own.get(s, {"null": None, "previous": last}.get(fill, fill))
        assert got == want


def test_a_series_that_is_silent_for_a_year_is_filled_by_the_second(spark):
    year = 365 * 86400
    df = spark.createDataFrame([("a", 0, 1.0), ("a", year, 2.0)], "j string, s bigint, value double").select("j", F.timestamp_seconds("s").alias("ts"), "value")
    for by in (["j"], []):
        filled = S.bucket(df, "1 second", by, fn="sum", fill="previous")
        assert filled.agg(F.count("*"), F.sum("value")).first() == (year + 1, year + 2.0)
