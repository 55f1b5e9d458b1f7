"""The continuous operators, fed from the events table until it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.definitions import MathEntry, lustre
from tallyflow.model import tag_columns
from tallyflow.operators.rollup import Rollup
from tallyflow.plans import panels
from tallyflow.plans.rollup_catalog import TOTAL_BYTES, catalog
from tallyflow.session import shared_folder
from tallyflow.sources.points import read_rollups
from tallyflow.streaming import jobs as J
from workload.operators import CATALOG_MEASUREMENT, CATALOG_TAGS, F32_AVG, HOURS, catalog_sql, f32, f32_sql, flat, r6, summary_flat, tag_text
from workload.registry import query
from workload.tables import DIMENSIONS, EVENTS_SQL, load, points_sql

SPAN = 4 * HOURS


def _stream(spark, sf) -> DataFrame:
    schema = load(spark, sf, "events").schema
    # A one-letter class makes the file name a pattern, which the file source wants.
    table = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table.withColumn("k", number).withColumn("ts", F.col("ts").cast("timestamp"))


def _points(
    spark, sf, tags: list[str] | dict[str, str], ds_type: str = "gauge", value: str = "value", measurement: str = "event_type", stream=None
) -> DataFrame:
    named = {t: t for t in tags} if isinstance(tags, list) else tags
    pairs = [c for t, d in named.items() for c in (F.lit(t), F.expr(DIMENSIONS[d]))]
    return (_stream(spark, sf) if stream is None else stream).select(
        F.expr(measurement).alias("measurement"),
        F.expr(DIMENSIONS["host"]).alias("host"),
        F.create_map(*pairs).alias("tags"),
        "ts",
        F.lit(ds_type).alias("ds_type"),
        F.expr(value).alias("value"),
    )


def _run(spark, stream: DataFrame) -> DataFrame:
    """Run until the input is read, then give the table that was written."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    J.append_to_table(stream, f"{folder}/table", f"{folder}/checkpoint", once=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


@query(
    "stream_rollup",
    points_sql(["fs_name", "job_id"])
    + f", w AS (SELECT max(epoch_us(ts)) / 1e6 - 600 AS mark FROM p) SELECT fs_name, job_id, CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} AS window_start, round(sum(value) / 4, 6) AS sum"
    f" FROM p, w WHERE measurement = 'click' AND CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} + {SPAN} <= mark GROUP BY ALL",
)
def _(spark, sf):
    """Windows the watermark has passed, each emitted once."""
    rolled = J.stream_rollup(_points(spark, sf, ["fs_name", "job_id"]), "click", ["fs_name", "job_id"], interval=HOURS, watermark="600 seconds")
    out = _run(spark, rolled)
    return out.select("fs_name", "job_id", F.unix_seconds("window_start").alias("window_start"), r6("sum").alias("sum"))


@query(
    "stream_rate",
    f"WITH {EVENTS_SQL}, c AS (SELECT {DIMENSIONS['job_id']} AS job_id, sec, ts, epoch_us(ts) / 1e6 AS moment, event_id::DOUBLE AS v FROM e),"
    " d AS (SELECT *, (v - lag(v) OVER w) / (moment - lag(moment) OVER w) AS rate FROM c WINDOW w AS (PARTITION BY job_id ORDER BY ts))"
    f" SELECT job_id, sec, {f32_sql('rate')} AS rate FROM d WHERE rate IS NOT NULL",
)
def _(spark, sf):
    """Rates with the last reading of every series kept as state."""
    p = _points(spark, sf, ["job_id"], "derive", "CAST(event_id AS DOUBLE)")
    out = _run(spark, J.stream_rate(p, ["job_id"], watermark="30 days"))
    return out.select("job_id", F.unix_seconds("ts").alias("sec"), f32("value").alias("rate"))


@query(
    "stream_math",
    f"WITH {EVENTS_SQL}, g AS (SELECT {DIMENSIONS['job_id']} AS job_id, CAST(floor(sec / 60) AS BIGINT) * 60 AS sec, max(value) AS s, max(k) AS n FROM e GROUP BY ALL),"
    " w AS (SELECT max(epoch_us(ts)) / 1e6 - 60 AS mark FROM e)"
    f" SELECT job_id, sec, {f32_sql('s / n')} AS value FROM g, w WHERE n > 0 AND sec + 60 <= mark",
)
def _(spark, sf):
    """Mean of two operands that fall into the same collect interval."""
    e = _stream(spark, sf)
    tags = F.create_map(F.lit("job_id"), F.expr(DIMENSIONS["job_id"]))
    both = F.array(F.struct(F.lit("sum").alias("m"), F.col("value").alias("v")), F.struct(F.lit("samples").alias("m"), F.col("k").cast("double").alias("v")))
    listed = e.select(F.lit("h").alias("host"), tags.alias("tags"), "ts", both.alias("both"))
    p = listed.select("host", "tags", "ts", F.explode("both").alias("b")).select(F.col("b.m").alias("measurement"), "host", "tags", "ts", F.col("b.v").alias("value"))
    out = _run(spark, J.stream_math(p, [MathEntry("sum", "/", "samples", "mean", "mean")], interval=60))
    return out.select(*tag_columns(out, ["job_id"]), F.unix_seconds("ts").alias("sec"), f32("value").alias("value"))


@query("stream_extract", f"WITH {EVENTS_SQL} SELECT {DIMENSIONS['host']} AS host, 'MDT000' || (k % 2) AS mdt_index, sec, (k + 1)::DOUBLE AS value FROM e")
def _(spark, sf):
    """Every event as a small file that arrives and is read once."""
    content = "concat('snapshot_time 1.2 secs.usecs\nopen                      ', k + 1, ' samples [reqs]\n')"
    snap = _stream(spark, sf).select(
        F.expr(DIMENSIONS["host"]).alias("host"),
        F.expr("concat('/proc/fs/lustre/mdt/fs-MDT000', k % 2, '/md_stats')").alias("path"),
        F.col("ts").alias("collected_at"),
        F.expr(content).alias("content"),
    )
    out = _run(spark, J.stream_extract(snap, lustre.definition("2.12").select(["md_stats_open"])))
    return out.select("host", *tag_columns(out, ["mdt_index"]), F.unix_seconds("ts").alias("sec"), "value")


@query("stream_latest", points_sql(["job_id"]) + " SELECT job_id, arg_max(sec, ts) AS sec, arg_max(value, ts) AS value FROM p GROUP BY ALL")
def _(spark, sf):
    """A table with the newest point of every series, merged batch by batch."""
    folder = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    J.stream_latest(_points(spark, sf, ["job_id"]), ["job_id"], f"{folder}/table", f"{folder}/checkpoint", once=True).awaitTermination()
    out = J.latest_table(spark, f"{folder}/table")
    return out.select("job_id", F.unix_seconds("ts").alias("sec"), "value")


#: Pieces of time in which events arrive for the queries below.
ARRIVALS = 4


def _arrive(spark, sf, run, *, shuffled: bool = False) -> None:
    """Events arrive one piece of time after the other; ``run(stream)`` starts the query anew for each, on its checkpoint.

    ``shuffled``: pieces of any time, so that most points come late.
    """
    folder = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    table = load(spark, sf, "events")
    first, last = table.agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    if first is None:
        return
    span = (last - first).total_seconds() or 1.0
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(first.timestamp())
    piece = F.least(F.floor(at / F.lit(span) * ARRIVALS), F.lit(ARRIVALS - 1))
    if shuffled:
        piece = F.pmod(F.xxhash64("event_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        table.where(piece == k).write.parquet(f"{folder}/piece={k}")
        stream = spark.readStream.schema(table.schema).parquet(f"{folder}/piece=*")
        number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        run(stream.withColumn("k", number).withColumn("ts", F.col("ts").cast("timestamp"))).awaitTermination()


@query(
    "stream_rollup_catalog",
    f"{catalog_sql('catalog')}, w AS (SELECT max(epoch_us(ts)) / 1e6 - {SPAN} AS mark FROM p)"
    f" SELECT catalog.* FROM catalog, w WHERE window_start + {SPAN} <= mark",
)
def _(spark, sf):
    """All standing rollups as one stream, over several micro-batches and restarts, read back from the rollup table."""
    folder = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"

    def run(stream):
        p = _points(spark, sf, CATALOG_TAGS, measurement=CATALOG_MEASUREMENT, stream=stream)
        return J.stream_rollups(p, catalog(), f"{folder}/table", f"{folder}/checkpoint", interval=HOURS, once=True)

    _arrive(spark, sf, run)
    return flat(read_rollups(spark, f"{folder}/table").withColumn("tags", tag_text())).select("measurement", "tags", "window_start", "sum")


@query(
    "stream_throughput_per_job",
    points_sql(["fs_name", "job_id", "optype"], measurement="'ost_jobstats_bytes'")
    + f", w AS (SELECT max(epoch_us(ts)) / 1e6 - {SPAN} AS mark FROM p),"
    f" r AS (SELECT job_id, CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} AS ts, sum(value) / 4 AS value FROM p"
    f" WHERE fs_name = 'fs1' AND optype IN ('sum_read_bytes', 'sum_write_bytes') GROUP BY ALL)"
    f" SELECT job_id, {F32_AVG} AS avg, round(max(value), 6) AS max, round(arg_max(value, ts), 6) AS current"
    f" FROM r, w WHERE ts + {SPAN} <= mark GROUP BY job_id",
)
def _(spark, sf):
    """A panel answered from the table that the stream of rollups keeps."""
    folder = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    rollups = [Rollup("ost_jobstats_bytes", ("fs_name", "job_id"), only=TOTAL_BYTES)]

    def run(stream):
        p = _points(spark, sf, ["fs_name", "job_id", "optype"], measurement="'ost_jobstats_bytes'", stream=stream)
        return J.stream_rollups(p, rollups, f"{folder}/table", f"{folder}/checkpoint", interval=HOURS, once=True)

    _arrive(spark, sf, run)
    return summary_flat(panels.throughput_per_job(read_rollups(spark, f"{folder}/table"), "fs1"))


@query("stream_latest_merged", points_sql(["job_id"]) + " SELECT job_id, arg_max(sec, ts) AS sec, arg_max(value, ts) AS value FROM p GROUP BY ALL")
def _(spark, sf):
    """The newest point of every series, kept over several batches and restarts."""
    folder = f"{shared_folder(spark)}/latest-{uuid.uuid4().hex}"
    _arrive(spark, sf, lambda stream: J.stream_latest(
        _points(spark, sf, ["job_id"], stream=stream), ["job_id"], f"{folder}/table", f"{folder}/checkpoint", once=True, buckets=8))
    out = J.latest_table(spark, f"{folder}/table")
    return out.select("job_id", F.unix_seconds("ts").alias("sec"), "value")


@query(
    "stream_extract_rates",
    f"WITH {EVENTS_SQL}, c AS (SELECT {DIMENSIONS['host']} AS host, 'MDT000' || (k % 2) AS mdt_index, sec, ts, epoch_us(ts) / 1e6 AS moment, (event_id + 1)::DOUBLE AS v FROM e),"
    " d AS (SELECT *, (v - lag(v) OVER w) / (moment - lag(moment) OVER w) AS rate FROM c WINDOW w AS (PARTITION BY host, mdt_index ORDER BY ts))"
    f" SELECT host, mdt_index, 'fs-' || mdt_index AS plugin, 'open' AS type_instance, 'md_stats_open' AS item, sec, {f32_sql('rate')} AS rate FROM d WHERE rate IS NOT NULL",
)
def _(spark, sf):
    """Text to points to rates as streams, over several batches; identifiers stay with the points."""
    folder = f"{shared_folder(spark)}/rates-{uuid.uuid4().hex}"
    content = "concat('snapshot_time 1.2 secs.usecs\nopen                      ', event_id + 1, ' samples [reqs]\n')"

    def run(stream):
        snap = stream.select(
            F.expr(DIMENSIONS["host"]).alias("host"),
            F.expr("concat('/proc/fs/lustre/mdt/fs-MDT000', k % 2, '/md_stats')").alias("path"),
            F.col("ts").alias("collected_at"),
            F.expr(content).alias("content"),
        )
        p = J.stream_extract(snap, lustre.definition("2.12").select(["md_stats_open"]))
        return J.stream_rates(p, f"{folder}/rates", f"{folder}/last", f"{folder}/checkpoint", once=True, buckets=8)

    _arrive(spark, sf, run)
    out = J.rated_table(spark, f"{folder}/rates")
    return out.select("host", *tag_columns(out, ["mdt_index"]), "plugin", "type_instance", "item", F.unix_seconds("ts").alias("sec"), f32("value").alias("rate"))


@query(
    "stream_late_points",
    points_sql(["fs_name", "job_id"])
    + f", w AS (SELECT max(sec) - {SPAN} AS mark FROM p) SELECT fs_name, job_id, CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} AS window_start, round(sum(value) / 4, 6) AS sum"
    f" FROM p, w WHERE measurement = 'click' AND CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} + {SPAN} <= mark GROUP BY ALL",
)
def _(spark, sf):
    """Three of four points come late; their windows are computed anew, so the table holds every point."""
    folder = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    rollups = [Rollup("click", ("fs_name", "job_id"))]

    def run(stream):
        p = _points(spark, sf, ["fs_name", "job_id"], stream=stream)
        places = (f"{folder}/points", rollups, f"{folder}/rollups", f"{folder}/clock", f"{folder}/checkpoint")
        return J.stream_points(p, *places, delay=SPAN, interval=HOURS, once=True)

    _arrive(spark, sf, run, shuffled=True)
    out = read_rollups(spark, f"{folder}/rollups")
    return out.select(*tag_columns(out, ["fs_name", "job_id"]), F.unix_seconds("window_start").alias("window_start"), r6("sum").alias("sum"))
