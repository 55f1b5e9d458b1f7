"""Streamed results equal batch results."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from texts import counter_file

from tallyflow.definitions import MathEntry, lustre
from tallyflow.model import POINT_SCHEMA
from tallyflow.operators import rates as R
from tallyflow.operators import rollup as U
from tallyflow.operators import summary as S
from tallyflow.operators.extract import extract
from tallyflow.operators.metric_math import apply_math
from tallyflow.sources import points as P
from tallyflow.sources import tag_catalog
from tallyflow.sources.keyed_table import KeyedTable
from tallyflow.sources.snapshots import read_snapshots, stream_snapshots
from tallyflow.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def rows():
    rng = random.Random(5)
    out = []
    for s in range(0, 3000, 60):
        for j in ("a", "b"):
            out.append(("m", "h", {"job": j}, T0 + dt.timedelta(seconds=s), "derive", float(s * 2 + rng.randint(0, 50))))
            out.append(("n", "h", {"job": j}, T0 + dt.timedelta(seconds=s), "gauge", float(1 + s % 7)))
    return out


@pytest.fixture
def source(spark, tmp_path):
    """Batch table and its stream in five files, oldest first."""
    data = rows()
    folder = tmp_path / "in"
    step = len(data) // 5
    for i in range(5):
        part = spark.createDataFrame(data[i * step : (i + 1) * step], POINT_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(folder))
    batch = spark.createDataFrame(data, POINT_SCHEMA)
    stream = spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return batch, stream


def finish(spark, stream, tmp_path):
    q = J.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(60)
    return spark.read.parquet(str(tmp_path / "out"))


def as_set(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_rollup(spark, source, tmp_path):
    batch, stream = source
    out = finish(spark, J.stream_rollup(stream, "m", ["job"], watermark="60 seconds"), tmp_path)
    closed = batch.agg(F.max("ts") - F.expr("interval 60 seconds")).first()[0]
    expected = U.rollup(batch, "m", ["job"]).where(F.col("window_start") + F.expr("interval 240 seconds") <= F.lit(closed))
    assert out.count() > 20 and as_set(out) == as_set(expected)


def test_late_points_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    for i, s in enumerate((0, 3000, 3060, 10, 6000)):
        spark.createDataFrame([("m", "h", {"job": "a"}, T0 + dt.timedelta(seconds=s), "gauge", 4.0)], POINT_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = finish(spark, J.stream_rollup(stream, "m", ["job"]), tmp_path)
    first = out.where(F.col("window_start") == F.lit(T0)).collect()
    assert [r["sum"] for r in first] == [1.0]


@pytest.mark.parametrize("policy", ["keep", "zero_base"])
def test_rate(spark, source, tmp_path, policy):
    batch, stream = source
    out = finish(spark, J.stream_rate(stream.where("ds_type = 'derive'"), on_reset=policy, first_value=0), tmp_path)
    expected = R.rate(batch.where("ds_type = 'derive'"), on_reset=policy, first_value=0)
    key = lambda r: (r.tags["job"], r.ts)
    assert {key(r): r.value for r in out.collect()} == pytest.approx({key(r): r.value for r in expected.collect()})


def test_rate_by_tags(spark, source, tmp_path):
    batch, stream = source
    out = finish(spark, J.stream_rate(stream.where("measurement = 'm'"), ["job"]), tmp_path)
    expected = R.rate(batch.where("measurement = 'm'"), ["job"])
    assert {(r.job, r.ts): r.value for r in out.collect()} == pytest.approx({(r.tags["job"], r.ts): r.value for r in expected.collect()})


def test_math(spark, source, tmp_path):
    batch, stream = source
    entries = [MathEntry("m", "/", "n", "ratio", "ratio"), MathEntry("m", "-", "n", "gap", "gap")]
    out = finish(spark, J.stream_math(stream, entries), tmp_path)
    closed = batch.agg(F.max("ts") - F.expr("interval 60 seconds")).first()[0]
    expected = apply_math(batch, entries).where(F.col("ts") + F.expr("interval 60 seconds") <= F.lit(closed))
    flat = lambda df: {(r.measurement, r.tags["job"], r.ts): r.value for r in df.collect()}
    assert len(flat(out)) > 100 and flat(out) == flat(expected)


def test_latest(spark, source, tmp_path):
    batch, stream = source
    q = J.stream_latest(stream, ["measurement", "job"], str(tmp_path / "t"), str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(120)
    assert as_set(J.latest_table(spark, str(tmp_path / "t"))) == as_set(S.latest(batch, ["measurement", "job"]))


def test_extract(spark, tmp_path):
    for i in range(3):
        f = tmp_path / "in" / f"node{i}" / "proc" / "fs" / "lustre" / "mdt" / "a-MDT0000" / "md_stats"
        f.parent.mkdir(parents=True)
        f.write_text(counter_file({"open": i, "close": i * 2}))
    d, root, layout = lustre.definition("2.12"), str(tmp_path / "in"), "^/([^/]+)(/.*)$"
    out = finish(spark, J.stream_extract(stream_snapshots(spark, root, layout=layout, max_files=1), d), tmp_path)
    batch = extract(read_snapshots(spark, root, layout=layout), d)
    flat = lambda df: sorted((r.host, r.measurement, r.tags["optype"], r.value) for r in df.collect())
    assert flat(out) == flat(batch) and len(flat(out)) == 6


def wait(query):
    assert query.awaitTermination(180)


def test_latest_costs_what_the_batch_holds(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), 8)
    newest = lambda df: S.latest(df, ["job"])
    at = lambda rows: spark.createDataFrame([(j, T0 + dt.timedelta(seconds=s), float(v)) for j, s, v in rows], "job string, ts timestamp, value double")
    assert table.merge(at([(f"j{k}", 0, k) for k in range(100)]), ["job"], newest, "a", 0)
    first = table.manifest()
    assert table.merge(at([("j7", 5, -7)]), ["job"], newest, "a", 1) and not table.merge(at([("j7", 9, 0)]), ["job"], newest, "a", 1)
    changed = [b for b, folder in table.manifest().folders.items() if first.folders[b] != folder]
    assert len(first.folders) == 8 and len(changed) == 1
    assert {r.job: r.value for r in table.read().collect()} == {f"j{k}": float(k) if k != 7 else -7.0 for k in range(100)}
    for k in range(2, 9):
        table.merge(at([("j7", 10 + k, k)]), ["job"], newest, "a", k)
    folders = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert len(list((tmp_path / "t" / "manifests").glob("*.json"))) == 4 and len(folders) <= 6


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    newest = lambda df: S.latest(df, ["job"])

    def write(name):
        table = KeyedTable(spark, str(tmp_path / "t"), 4)
        for k in range(6):
            rows = [(f"{name}{i}", T0, float(k)) for i in range(k * 5, k * 5 + 5)] + [("both", T0 + dt.timedelta(seconds=k), float(k))]
            table.merge(spark.createDataFrame(rows, "job string, ts timestamp, value double"), ["job"], newest, name, k)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, ("a", "b")))
    table = KeyedTable(spark, str(tmp_path / "t"))
    assert table.manifest().version == 12 and table.manifest().jobs == {"a": 5, "b": 5}
    got = {r.job: r.value for r in table.read().collect()}
    assert got == {f"{n}{i}": float(i // 5) for n in "ab" for i in range(30)} | {"both": 5.0}


def test_a_new_checkpoint_is_another_stream(spark, source, tmp_path):
    _, stream = source
    for name in ("one", "two"):
        wait(J.stream_latest(stream, ["measurement", "job"], str(tmp_path / "t"), str(tmp_path / name), once=True))
    jobs = KeyedTable(spark, str(tmp_path / "t")).manifest().jobs
    assert sorted(jobs.values()) == [4, 4]


def test_rollups_of_a_catalog(spark, source, tmp_path):
    batch, stream = source
    rollups = [U.Rollup("m", ("job",)), U.Rollup("n", ()), U.Rollup("n", ("job",), only=("job", ("a",)))]
    path = str(tmp_path / "t")
    closed = batch.agg(F.max("ts") - F.expr("interval 60 seconds")).first()[0]
    expected = U.rollup_many(batch, rollups).where(F.col("window_start") + F.expr("interval 240 seconds") <= F.lit(closed))
    flat = lambda df: sorted((r.measurement, str(sorted(r.tags.items())), r.window_start, r["sum"]) for r in df.collect())
    for checkpoint in ("one", "two"):  # the second starts from nothing and meets its own windows
        wait(J.stream_rollups(stream, rollups, path, str(tmp_path / checkpoint), watermark="60 seconds", once=True))
        assert flat(P.read_rollups(spark, path)) == flat(expected) and expected.count() > 30


@pytest.mark.parametrize("case", ["keep", "zero_base", "forget"])
def test_rates_with_a_table_of_last_readings(spark, source, tmp_path, case):
    batch, stream = source
    more = lambda df: df.withColumns({"plugin": F.lit("p"), "type_instance": F.col("measurement")})
    options = {"on_reset": "zero_base", "first_value": 0} if case == "zero_base" else {"forget_after": 60, "first_value": 3} if case == "forget" else {}
    places = [str(tmp_path / x) for x in ("out", "state", "cp")]
    wait(J.stream_rates(more(stream), *places, once=True, **options))
    out = J.rated_table(spark, places[0])
    expected = R.rate(more(batch), **options)
    assert sorted(out.columns) == sorted(expected.columns)
    flat = lambda df: {(r.measurement, r.tags["job"], r.ts, r.plugin, r.type_instance): r.value for r in df.collect()}
    assert out.count() == expected.count() and flat(out) == pytest.approx(flat(expected))
    last = KeyedTable(spark, places[1]).read()
    assert last.count() == 2 and {r.ts for r in last.collect()} == {batch.agg(F.max("ts")).first()[0]}


def test_late_points_change_their_windows(spark, tmp_path):
    folder, places = tmp_path / "in", [str(tmp_path / x) for x in ("points", "rollups", "clock", "cp")]
    arrivals = ((0, 60), (3000,), (10, 3060), (6000,), (5, 3001))
    rollups = [U.Rollup("m", ("job",))]
    for i, seconds in enumerate(arrivals):
        rows = [("m", "h", {"job": "a"}, T0 + dt.timedelta(seconds=s), "gauge", 4.0) for s in seconds]
        spark.createDataFrame(rows, POINT_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(POINT_SCHEMA).parquet(str(folder))
        wait(J.stream_points(stream, places[0], rollups, *places[1:], once=True))
        seen = [s for some in arrivals[: i + 1] for s in some]
        want = {}
        for s in seen:
            if s // 240 * 240 + 480 <= max(seen):
                want[s // 240 * 240] = want.get(s // 240 * 240, 0.0) + 1.0
        table = P.read_rollups(spark, places[1]).collect() if want else []
        assert {(r.window_start - T0).total_seconds(): r["sum"] for r in table} == want and len(table) == len(want)
    assert J.stored_points_table(spark, places[0]).count() == 8


def test_tag_catalog(spark, tmp_path):
    rows = [("m", f"h{k % 2}", {"job": f"j{k}", "none": ""}, T0 + dt.timedelta(days=k), "gauge", 1.0) for k in range(6)]
    df, path = spark.createDataFrame(rows, POINT_SCHEMA), str(tmp_path / "t")
    for _ in range(2):  # adding twice changes nothing
        for k in range(3):
            tag_catalog.record(df.where(f"dayofyear(ts) % 3 = {k}"), path)
    table = tag_catalog.read_catalog(spark, path)
    assert table.count() == 8 and [r.job for r in tag_catalog.listed_values(table, "m", "job").collect()] == [f"j{k}" for k in range(6)]
    assert [r.job for r in tag_catalog.listed_values(table, "m", "job", start="2024-01-03", end="2024-01-04").collect()] == ["j2", "j3"]
    listed = {r.tag: (r.n_values, r.first_day.day, r.last_day.day) for r in tag_catalog.listed_tags(table).collect()}
    assert listed == {"fqdn": (2, 1, 6), "job": (6, 1, 6)}


def test_batches_without_adaptive_execution_write_few_files(spark, tmp_path):
    """Every task used to write a file for every measurement of a stateful stream's batch."""
    data = [(f"m{k % 20}", "h", {"job": f"j{k}"}, T0 + dt.timedelta(seconds=k), "gauge", float(k)) for k in range(400)]
    spark.createDataFrame(data, POINT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    # A point of a much later day closes all windows before it.
    last = [("m0", "h", {"job": "j"}, T0 + dt.timedelta(days=9), "gauge", 0.0)]
    spark.createDataFrame(last, POINT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINT_SCHEMA).parquet(str(tmp_path / "in"))
    rollups = [U.Rollup(f"m{k}", ("job",)) for k in range(20)]
    query = J.stream_rollups(stream, rollups, str(tmp_path / "table"), str(tmp_path / "cp"), once=True)
    assert query.awaitTermination(60)
    assert P.read_rollups(spark, str(tmp_path / "table")).count() == 400
    assert len(list((tmp_path / "table").glob("*/*/*.parquet"))) <= 20 + 4  # one for each measurement, and where tasks meet


def in_steps(spark, folder, *steps):
    for data in steps:
        spark.createDataFrame(data, POINT_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(POINT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def reading(job, second, value):
    return ("m", "h", {"job": job}, T0 + dt.timedelta(seconds=second), "derive", float(value))


def test_stream_rate_keeps_a_state_for_each_bucket(spark, tmp_path):
    """There used to be a call and a state for each series."""
    stream = in_steps(spark, tmp_path / "in", [reading(f"j{k}", 0, k) for k in range(60)], [reading(f"j{k}", 60, k + 60) for k in range(60)])
    q = J.append_to_table(J.stream_rate(stream, ["job"], buckets=4), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["job"] for r in rows) == sorted(f"j{k}" for k in range(60)) and {r["value"] for r in rows} == {1.0}
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 4


def test_stream_rate_forgets_one_series_of_a_bucket(spark, tmp_path):
    first = [reading("a", 0, 0), reading("b", 0, 0), reading("b", 1000, 1000)]
    stream = in_steps(spark, tmp_path / "in", first, [reading("b", 1050, 1050)], [reading("a", 1100, 1100), reading("b", 1100, 1100)])
    rated = J.stream_rate(stream, ["job"], first_value=0, ttl_seconds=300, watermark="10 seconds", buckets=1)
    got = sorted((r["job"], r["value"]) for r in finish(spark, rated, tmp_path).collect())
    # In the second step a was silent for too long, so it counts as new: 1100 / 60.
    assert got == [("a", 0.0), ("a", 1100 / 60), ("b", 0.0), ("b", 1.0), ("b", 1.0), ("b", 1.0)]
