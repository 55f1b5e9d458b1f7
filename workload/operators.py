"""One query per operator over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyflow.definitions import MathEntry
from tallyflow.functions.tags import job_owner, parse_tags, size_order
from tallyflow.model import tag_columns
from tallyflow.operators import aggregate as A
from tallyflow.operators import summary as S
from tallyflow.operators.histogram import distribution
from tallyflow.operators.metric_math import apply_math
from tallyflow.operators.rates import per_interval, rate
from tallyflow.operators.rollup import rollup, rollup_many, rollup_name
from tallyflow.operators.status import EXPECTED, StatusRule, freshness, host_status, missing_series, newest_time
from tallyflow.plans.rollup_catalog import catalog
from tallyflow.session import shared_folder
from tallyflow.sources import points as P
from tallyflow.sources.tag_catalog import listed_values, read_catalog, record
from workload.registry import query
from workload.tables import DIMENSIONS, EVENTS_SQL, events, load, points, points_sql

HOURS = 3600
JOBS = ["fs_name", "ost_index", "job_id", "optype"]


def r6(column):
    return F.round(column, 6)


def f32(column):
    """Averages of decimals often end in a 5 where a rounding would cut them, so
    they are compared in single precision instead."""
    return (F.col(column) if isinstance(column, str) else column).cast("float").cast("double")


def f32_sql(expression: str) -> str:
    return f"CAST(CAST({expression} AS FLOAT) AS DOUBLE)"


F32_AVG = f32_sql("avg(value)")


# ------------------------------------------------------------ points at rest


@query(
    "select_points",
    points_sql(["fs_name", "job_id"])
    + " SELECT sec, host, job_id, value FROM p WHERE measurement = 'purchase' AND fs_name = 'fs1'"
    " AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'",
)
def _(spark, sf):
    p = points(spark, sf, ["fs_name", "job_id"])
    found = P.select_points(p, "purchase", where={"fs_name": "fs1"}, start="2024-01-05", end="2024-01-20")
    return found.select(F.unix_seconds("ts").alias("sec"), "host", *tag_columns(found, ["job_id"]), "value")


@query("tag_values", points_sql(["fs_name", "job_id"]) + " SELECT DISTINCT job_id FROM p WHERE measurement = 'click' AND fs_name = 'fs1'")
def _(spark, sf):
    return P.tag_values(points(spark, sf, ["fs_name", "job_id"]), "click", "job_id", where={"fs_name": "fs1"})


_IDENTIFIER = (
    "concat(fs_name, '-', ost_index) AS plugin",
    "CASE WHEN k % 3 = 0 THEN '' ELSE 'stats' END AS plugin_instance",
    "'derive' AS type",
    "mdop AS type_instance",
)


def _identified(spark, sf):
    e = events(spark, sf)
    named = e.select("*", *[F.expr(DIMENSIONS[d]).alias(d) for d in ("host", "fs_name", "ost_index", "mdop")])
    return named.selectExpr("host", "value", *_IDENTIFIER)


def _identified_sql(expression: str) -> str:
    inner = ", ".join(f"{DIMENSIONS[d]} AS {d}" for d in ("host", "fs_name", "ost_index", "mdop"))
    return (
        f"WITH {EVENTS_SQL}, n AS (SELECT *, {inner} FROM e), i AS (SELECT host, value, {', '.join(_IDENTIFIER)} FROM n)"
        f" SELECT {expression} AS path, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY 1"
    )


@query(
    "metric_path",
    _identified_sql(
        "host || '/' || plugin || CASE WHEN plugin_instance = '' THEN '' ELSE '-' || plugin_instance END || '/' || type || '-' || type_instance"
    ),
)
def _(spark, sf):
    i = _identified(spark, sf)
    named = i.select(P.metric_path(i).alias("path"), "value")
    return named.groupBy("path").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "metric_path_dotted",
    _identified_sql(
        "'site.' || host || '.' || plugin || CASE WHEN plugin_instance = '' THEN '' ELSE '-' || plugin_instance END || '.' || type || '-' || type_instance"
    ),
)
def _(spark, sf):
    i = _identified(spark, sf)
    named = i.select(P.metric_path(i, sep=".", prefix="site.").alias("path"), "value")
    return named.groupBy("path").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "points_sink_round_trip",
    points_sql(["fs_name"])
    + " SELECT measurement, strftime(ts, '%Y-%m-%d') AS day, fs_name, count(*) AS n, round(sum(value), 6) AS total FROM p GROUP BY 1, 2, 3",
)
def _(spark, sf):
    """Write every point partitioned by measurement and date, read it back."""
    path = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    P.write_points(points(spark, sf, ["fs_name"]), path, mode="errorifexists")
    back = P.read_points(spark, path)
    return back.groupBy("measurement", F.date_format("date", "yyyy-MM-dd").alias("day"), "fs_name").agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("total")
    )


# -------------------------------------------------------- tags and templates


@query(
    "parse_tags",
    f"WITH {EVENTS_SQL} SELECT event_id, event_type AS op, CASE WHEN k < 50 THEN concat('', user_id) ELSE '' END AS who FROM e WHERE k % 10 <> 0"
    f" UNION ALL SELECT event_id, '' AS op, '' AS who FROM e WHERE k % 10 = 0",
)
def _(spark, sf):
    text = (
        "CASE WHEN k % 20 = 0 THEN 'NA' WHEN k % 10 = 0 THEN '' WHEN k < 50 THEN concat('op=', event_type, ' who=', user_id)"
        " ELSE concat('op=', event_type) END"
    )
    e = events(spark, sf).select("event_id", parse_tags(F.expr(text)).alias("tags"))
    return e.select("event_id", *tag_columns(e, ["op", "who"]))


@query(
    "job_owner",
    f"WITH {EVENTS_SQL} SELECT event_type AS procname, concat('', user_id) AS uid, count(*) AS n FROM e GROUP BY 1, 2",
)
def _(spark, sf):
    e = events(spark, sf).select(F.expr(DIMENSIONS["job_id"]).alias("job_id"))
    owned = e.select(job_owner().alias("tags"))
    return owned.groupBy(*tag_columns(owned, ["procname", "uid"])).agg(F.count("*").alias("n"))


@query(
    "size_order",
    f"WITH {EVENTS_SQL}, s AS (SELECT {DIMENSIONS['size']} AS size FROM e) SELECT size, CASE size WHEN '4K_Bytes' THEN 4096.0::DOUBLE"
    " WHEN '64K_Bytes' THEN 65536.0::DOUBLE WHEN '1M_Bytes' THEN 1048576.0::DOUBLE ELSE 8.0::DOUBLE END AS bytes, count(*) AS n FROM s GROUP BY 1, 2",
)
def _(spark, sf):
    s = events(spark, sf).select(F.expr(DIMENSIONS["size"]).alias("size"))
    return s.groupBy("size", size_order(F.col("size")).alias("bytes")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- rates

_COUNTER = "CAST(event_id AS DOUBLE)"
_WRAPPING = "CAST(event_id % 1000 AS DOUBLE)"


def _counters(spark, sf, reading: str):
    """Event numbers grow with time, so within a series they are a counter."""
    return events(spark, sf).select(
        F.lit("counter").alias("measurement"),
        F.expr(DIMENSIONS["host"]).alias("host"),
        F.expr(DIMENSIONS["job_id"]).alias("job_id"),
        "ts",
        F.lit("derive").alias("ds_type"),
        F.expr(reading).alias("value"),
    )


def _rate_sql(reading: str, expression: str) -> str:
    return (
        f"WITH {EVENTS_SQL}, c AS (SELECT {DIMENSIONS['job_id']} AS job_id, sec, epoch_us(ts) / 1e6 AS moment, ts, {reading} AS v FROM e),"
        " d AS (SELECT *, v - lag(v) OVER w AS dv, moment - lag(moment) OVER w AS dt, lag(moment) OVER w AS before FROM c WINDOW w AS (PARTITION BY job_id ORDER BY ts, v)),"
        f" r AS (SELECT job_id, sec, {expression} AS rate FROM d) SELECT job_id, sec, round(rate, 6) AS rate FROM r WHERE rate IS NOT NULL"
    )


def _rated(df):
    return df.select("job_id", F.unix_seconds("ts").alias("sec"), r6("value").alias("rate"))


@query("counter_rate", _rate_sql(_COUNTER, "dv / dt"))
def _(spark, sf):
    return _rated(rate(_counters(spark, sf, _COUNTER), ["job_id"]))


@query("counter_rate_whole_series", _rate_sql(_COUNTER, "dv / dt"))
def _(spark, sf):
    return _rated(rate(_counters(spark, sf, _COUNTER), ["job_id"], chunk=None))


_TIES_SQL = _rate_sql("CAST(event_id * 10 AS DOUBLE)", "dv / NULLIF(dt, 0)").replace(
    "AS v FROM e)", "AS v FROM (SELECT * FROM e UNION ALL SELECT * REPLACE (event_id + 0.3 AS event_id) FROM e))"
)


@query("counter_rate_ties", _TIES_SQL)
def _(spark, sf):
    """Two readings at every time: the chunks must settle ties as the whole series does."""
    twice = _counters(spark, sf, "CAST(event_id * 10 AS DOUBLE)")
    return _rated(rate(twice.withColumn("value", F.col("value") + 3).unionByName(twice), ["job_id"]))


@query("counter_rate_keep_reset", _rate_sql(_WRAPPING, "dv / dt"))
def _(spark, sf):
    return _rated(rate(_counters(spark, sf, _WRAPPING), ["job_id"]))


@query("counter_rate_drop_reset", _rate_sql(_WRAPPING, "CASE WHEN dv >= 0 THEN dv / dt END"))
def _(spark, sf):
    return _rated(rate(_counters(spark, sf, _WRAPPING), ["job_id"], on_reset="null"))


@query("counter_rate_zero_base", _rate_sql(_WRAPPING, "CASE WHEN dv >= 0 THEN dv / dt ELSE v / dt END"))
def _(spark, sf):
    return _rated(rate(_counters(spark, sf, _WRAPPING), ["job_id"], on_reset="zero_base"))


@query("counter_rate_first_value", _rate_sql(_COUNTER, "CASE WHEN before IS NULL THEN v / 60 ELSE dv / dt END"))
def _(spark, sf):
    return _rated(rate(_counters(spark, sf, _COUNTER), ["job_id"], first_value=0, interval=60))


@query(
    "reset_on_read_passes",
    f"WITH {EVENTS_SQL} SELECT event_type AS measurement, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY 1",
)
def _(spark, sf):
    """Counters that reset when read already are amounts: they pass unchanged."""
    p = points(spark, sf, ["job_id"], ds_type="derive").withColumn("interval_gauge", F.lit(True))
    return rate(p).groupBy("measurement").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("per_interval", f"WITH {EVENTS_SQL} SELECT event_id, round(value / 60, 6) AS value FROM e")
def _(spark, sf):
    return per_interval(events(spark, sf), 60).select("event_id", r6("value").alias("value"))


# ---------------------------------------------------------------------- math


def _operands(spark, sf, operands: dict[str, tuple[str, str]]):
    """Each event read as several points of one time: name -> (value, condition)."""
    e = events(spark, sf)
    made = F.array_compact(
        F.array(
            *[
                F.when(F.expr(cond), F.struct(F.lit(m).alias("measurement"), F.expr(v).cast("double").alias("value")))
                for m, (v, cond) in operands.items()
            ]
        )
    )
    tags = F.create_map(F.lit("fs_name"), F.expr(DIMENSIONS["fs_name"]), F.lit("job_id"), F.expr(DIMENSIONS["job_id"]))
    rows = e.select(F.expr(DIMENSIONS["host"]).alias("host"), tags.alias("tags"), "ts", F.explode(made).alias("m"))
    return rows.select("m.measurement", "host", "tags", "ts", "m.value")


@query(
    "math_difference",
    f"WITH {EVENTS_SQL} SELECT 'ost_kbytesinfo_used' AS measurement, {DIMENSIONS['job_id']} AS job_id, sec, round(1000 + k - value, 6) AS value FROM e WHERE k >= 20",
)
def _(spark, sf):
    """Used = total - free; without both there is no result."""
    p = _operands(spark, sf, {"ost_kbytesinfo_total": ("1000 + k", "k >= 20"), "ost_kbytesinfo_free": ("value", "true")})
    entry = MathEntry("ost_kbytesinfo_total", "-", "ost_kbytesinfo_free", "ost_kbytesinfo_used", "kbytesused")
    out = apply_math(p, [entry])
    return out.select("measurement", *tag_columns(out, ["job_id"]), F.unix_seconds("ts").alias("sec"), r6("value").alias("value"))


@query(
    "math_ratio",
    f"WITH {EVENTS_SQL}, b AS (SELECT {DIMENSIONS['job_id']} AS job_id, sec, k, value FROM e WHERE k > 0)"
    " SELECT 'mean' AS measurement, job_id, sec, CAST(CAST(value / k AS FLOAT) AS DOUBLE) AS value FROM b"
    " UNION ALL SELECT 'mean_square' AS measurement, job_id, sec, CAST(CAST(value * value / k AS FLOAT) AS DOUBLE) AS value FROM b",
)
def _(spark, sf):
    """Mean and mean square of one statistic; zero samples give nothing."""
    p = _operands(spark, sf, {"sum": ("value", "true"), "sum_square": ("value * value", "true"), "samples": ("k", "true")})
    entries = [MathEntry("sum", "/", "samples", "mean", "mean"), MathEntry("sum_square", "/", "samples", "mean_square", "mean_square")]
    out = apply_math(p, entries)
    return out.select("measurement", *tag_columns(out, ["job_id"]), F.unix_seconds("ts").alias("sec"), f32("value").alias("value"))


# ------------------------------------------------------------------- rollups


def rollup_sql(measurement: str, tags: list[str], *, where: str = "true", span: int = 4 * HOURS, periods: int = 4, prelude: str | None = None) -> str:
    keys = "".join(f", {t}" for t in tags)
    name = rollup_name(measurement, tags)
    return (
        f"{prelude or points_sql(JOBS + ['uid'])} SELECT '{name}' AS measurement{keys}, CAST(floor(sec / {span}) AS BIGINT) * {span} AS window_start,"
        f" round(sum(value) / {periods}, 6) AS sum FROM p WHERE measurement = '{measurement}' AND ({where}) GROUP BY ALL"
    )


def flat(rolled):
    return rolled.withColumn("window_start", F.unix_seconds("window_start")).withColumn("sum", r6("sum"))


@query("rollup_by_job", rollup_sql("purchase", ["fs_name", "job_id"]))
def _(spark, sf):
    return flat(rollup(points(spark, sf, JOBS), "purchase", ["fs_name", "job_id"], interval=HOURS))


@query("rollup_by_target", rollup_sql("view", ["fs_name", "ost_index"], span=240))
def _(spark, sf):
    return flat(rollup(points(spark, sf, JOBS), "view", ["fs_name", "ost_index"]))


_TOTAL = "optype = 'sum_read_bytes' OR optype = 'sum_write_bytes'"


@query("rollup_filtered", rollup_sql("click", ["fs_name", "job_id", "ost_index"], where=_TOTAL))
def _(spark, sf):
    p = points(spark, sf, JOBS)
    keep = F.col("tags")["optype"].isin("sum_read_bytes", "sum_write_bytes")
    return flat(rollup(p, "click", ["fs_name", "job_id", "ost_index"], interval=HOURS, where=keep))


@query("rollup_by_user", rollup_sql("click", ["fs_name", "uid"], where="k <> 7", prelude=points_sql(JOBS + ["uid"]).replace("value, ", "value, k, ")))
def _(spark, sf):
    """Only points whose job id names a user have the tag."""
    table = events(spark, sf)
    job = F.when(F.col("k") == 7, F.lit("root")).otherwise(F.expr(DIMENSIONS["job_id"]))
    named = table.select(
        F.col("event_type").alias("measurement"), "ts", "value", F.expr(DIMENSIONS["fs_name"]).alias("fs_name"), job.alias("job_id")
    ).withColumn("tags", job_owner())
    return flat(rollup(named, "click", ["fs_name", "uid"], interval=HOURS, where=F.col("tags")["uid"].isNotNull()))


@query("rollup_absent_tag", rollup_sql("error", ["fs_name"]).replace("-fs_name'", "-fs_name-rack'").replace(", CAST(floor", ", '' AS rack, CAST(floor"))
def _(spark, sf):
    """A tag the points do not have is one empty group."""
    return flat(rollup(points(spark, sf, JOBS), "error", ["fs_name", "rack"], interval=HOURS))


CATALOG_TAGS = {
    "fs_name": "fs_name", "optype": "optype", "user_id": "user_id", "group_id": "host", "project_id": "k_tag",
    "exp_client": "exp_client", "job_id": "job_id", "uid": "uid", "fqdn": "host", "ost_index": "ost_index",
    "mdt_index": "mdt_index", "field": "field", "size": "size",
}
_CATALOG_MEASUREMENTS = sorted({r.measurement for r in catalog()})
CATALOG_MEASUREMENT = (
    f"CASE k % {len(_CATALOG_MEASUREMENTS)} "
    + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_CATALOG_MEASUREMENTS))
    + " END"
)


def catalog_sql(name: str | None = None) -> str:
    """All standing rollups; as one more WITH term of that name, if it has one."""
    parts = []
    for r in catalog():
        where = f"optype IN {r.only[1]}" if r.only else "true"
        label = " || ',' || ".join(f"'{t}=' || {t}" for t in sorted(r.tags))
        parts.append(
            f"SELECT '{r.name}' AS measurement, {label} AS tags, CAST(floor(sec / 14400) AS BIGINT) * 14400 AS window_start,"
            f" round(sum(value) / 4, 6) AS sum FROM p WHERE measurement = '{r.measurement}' AND {where} GROUP BY ALL"
        )
    terms, union = points_sql(CATALOG_TAGS, measurement=CATALOG_MEASUREMENT), " UNION ALL ".join(parts)
    return f"{terms}, {name} AS ({union})" if name else f"{terms} {union}"


def tag_text():
    """A tag map as text, tags in order."""
    return F.concat_ws(",", F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e.key, F.lit("="), e.value))))


@query("rollup_catalog", catalog_sql())
def _(spark, sf):
    """All standing rollups from one scan and one shuffle."""
    p = points(spark, sf, CATALOG_TAGS, measurement=CATALOG_MEASUREMENT)
    return flat(rollup_many(p, catalog(), interval=HOURS).withColumn("tags", tag_text()))


# --------------------------------------------------------------- aggregation


def _cpu_points(spark, sf):
    """Events of one hour as readings of one time of the cores of a host."""
    e = events(spark, sf)
    return e.select(
        F.expr(DIMENSIONS["host"]).alias("host"),
        F.when(F.col("event_type") == "error", "sensors").otherwise(F.lit("cpu")).alias("plugin"),
        F.expr(DIMENSIONS["cpu"]).alias("plugin_instance"),
        F.when(F.col("event_type") == "error", "temperature").otherwise(F.lit("cpu")).alias("type"),
        F.col("event_type").alias("type_instance"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / HOURS) * HOURS).alias("ts"),
        "value",
    )


_CPU_SQL = (
    f"WITH {EVENTS_SQL}, p AS (SELECT {DIMENSIONS['host']} AS host, CASE WHEN event_type = 'error' THEN 'sensors' ELSE 'cpu' END AS plugin,"
    f" {DIMENSIONS['cpu']} AS plugin_instance, CASE WHEN event_type = 'error' THEN 'temperature' ELSE 'cpu' END AS type,"
    " event_type AS type_instance, CAST(floor(sec / 3600) AS BIGINT) * 3600 AS sec, value FROM e)"
)


def _at_seconds(df):
    return df.withColumn("sec", F.unix_seconds("ts")).withColumn("value", f32("value")).drop("ts")


@query(
    "aggregate_functions",
    _CPU_SQL
    + " SELECT host, type_instance, sec, count(value) AS num, round(sum(value), 6) AS sum, " + F32_AVG + " AS average, min(value) AS minimum,"
    " max(value) AS maximum, " + f32_sql("stddev_pop(value)") + " AS stddev FROM p WHERE plugin = 'cpu' AND regexp_matches(plugin_instance, '^[0-5]$') GROUP BY ALL",
)
def _(spark, sf):
    spec = A.Aggregation(plugin="cpu", plugin_instance="/^[0-5]$/", functions=tuple(A.FUNCTIONS), set_plugin_instance="all-%{aggregation}")
    long = A.aggregate(_cpu_points(spark, sf), spec)
    wide = long.groupBy("host", "type_instance", F.unix_seconds("ts").alias("sec")).agg(
        *[F.max(F.when(F.col("function") == f, F.col("value"))).alias(f) for f in A.FUNCTIONS]
    )
    return wide.select("host", "type_instance", "sec", F.col("num").cast("bigint").alias("num"),
                       *[r6(f).alias(f) for f in ("sum", "minimum", "maximum")], *[f32(f).alias(f) for f in ("average", "stddev")])


@query(
    "cpu_average",
    _CPU_SQL + " SELECT host, type_instance, sec, 'cpu' AS type, 'aggregation' AS plugin, 'cpu-average' AS plugin_instance, 'average' AS function,"
    " " + F32_AVG + " AS value FROM p WHERE plugin = 'cpu' GROUP BY ALL",
)
def _(spark, sf):
    return _at_seconds(A.aggregate(_cpu_points(spark, sf), A.CPU_AVERAGE))


@query(
    "max_temperature",
    _CPU_SQL + " SELECT host, sec, 'temperature' AS type, 'aggregation' AS plugin, 'sensors-maximum' AS plugin_instance, 'maximum' AS function,"
    " " + f32_sql("max(value)") + " AS value FROM p WHERE plugin = 'sensors' GROUP BY ALL",
)
def _(spark, sf):
    return _at_seconds(A.aggregate(_cpu_points(spark, sf), A.MAX_TEMPERATURE))


@query(
    "aggregate_by_interval",
    f"WITH {EVENTS_SQL} SELECT {DIMENSIONS['host']} AS host, CAST(floor(sec / 600) AS BIGINT) * 600 AS sec, {f32_sql('sum(value)')} AS value FROM e GROUP BY ALL",
)
def _(spark, sf):
    e = events(spark, sf).select(F.expr(DIMENSIONS["host"]).alias("host"), F.lit("OST").alias("plugin"), F.lit("job").alias("plugin_instance"),
                                 F.lit("derive").alias("type"), "ts", "value")
    spec = A.Aggregation(plugin="/^OST$/", type="derive", by=("host",), functions=("sum",), set_plugin="OSS", set_plugin_instance="jobstat-sum")
    return _at_seconds(A.aggregate(e, spec, interval=600)).select("host", "sec", "value")


@query(
    "route_chain",
    _CPU_SQL
    + " SELECT 'aggregation' AS plugin, 'cpu-average' AS plugin_instance, host, type_instance, sec, " + F32_AVG + " AS value FROM p"
    " WHERE plugin = 'cpu' GROUP BY ALL UNION ALL SELECT 'aggregation', 'sensors-maximum', host, NULL, sec, " + f32_sql("max(value)") + " FROM p WHERE plugin = 'sensors' GROUP BY ALL"
    " UNION ALL SELECT plugin, plugin_instance, host, type_instance, sec, " + f32_sql("value") + " FROM p WHERE plugin = 'sensors'",
)
def _(spark, sf):
    """CPU readings are replaced by their average; temperatures are kept beside their maximum."""
    rules = [
        A.RouteRule({"plugin": "^cpu$", "plugin_instance": "^[0-9]+$"}, A.CPU_AVERAGE, stop=True),
        A.RouteRule({"plugin": "^sensors$", "type": "^temperature$"}, A.MAX_TEMPERATURE),
    ]
    out = A.route(_cpu_points(spark, sf), rules)
    return _at_seconds(out).select("plugin", "plugin_instance", "host", "type_instance", "sec", "value")


_TARGETS_SQL = (
    f"WITH {EVENTS_SQL}, p AS (SELECT {DIMENSIONS['host']} AS host, 'fs0-' || CASE WHEN k % 5 = 0 THEN {DIMENSIONS['mdt_index']} ELSE {DIMENSIONS['ost_index']} END AS plugin,"
    f" CASE WHEN k % 7 = 0 THEN 'stats' ELSE 'jobstats-' || {DIMENSIONS['job_id']} END AS plugin_instance, 'derive' AS type,"
    " event_type AS type_instance, CAST(floor(sec / 3600) AS BIGINT) * 3600 AS sec, value FROM e)"
)


@query(
    "route_job_sums",
    _TARGETS_SQL
    + ", j AS (SELECT CASE WHEN plugin LIKE '%MDT%' THEN 'MDS' ELSE 'OSS' END AS plugin, host, type_instance, sec, value FROM p WHERE plugin_instance LIKE 'jobstat%')"
    + " SELECT plugin, 'jobstat-sum' AS plugin_instance, 'sum' AS function, host, type_instance, sec, " + f32_sql("sum(value)") + " AS value FROM j GROUP BY ALL"
    + " UNION ALL SELECT plugin, 'jobstat-sum', 'average', host, type_instance, sec, " + F32_AVG + " FROM j GROUP BY ALL"
    + " UNION ALL SELECT plugin, plugin_instance, NULL, host, type_instance, sec, " + f32_sql("value") + " FROM p WHERE plugin_instance = 'stats'",
)
def _(spark, sf):
    """Job statistics of a server's targets are replaced by their sum and average; all else passes."""
    e = events(spark, sf)
    target = f"concat('fs0-', CASE WHEN k % 5 = 0 THEN {DIMENSIONS['mdt_index']} ELSE {DIMENSIONS['ost_index']} END)"
    p = e.select(
        F.expr(DIMENSIONS["host"]).alias("host"), F.expr(target).alias("plugin"),
        F.expr(f"CASE WHEN k % 7 = 0 THEN 'stats' ELSE concat('jobstats-', {DIMENSIONS['job_id']}) END").alias("plugin_instance"),
        F.lit("derive").alias("type"), F.col("event_type").alias("type_instance"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / HOURS) * HOURS).alias("ts"), "value",
    )
    out = A.route(p, A.job_sums())
    return _at_seconds(out).select("plugin", "plugin_instance", "function", "host", "type_instance", "sec", "value")


# ------------------------------------------------------------- series tables

_BUCKETED = (
    points_sql(["fs_name"])
    + ", b AS (SELECT fs_name, CAST(floor(sec / 3600) AS BIGINT) * 3600 AS bucket, sum(value) AS value FROM p WHERE measurement = 'click' GROUP BY ALL),"
    " s AS (SELECT fs_name, min(bucket) AS lo, max(bucket) AS hi FROM b GROUP BY fs_name),"
    " g AS (SELECT fs_name, unnest(range(lo, hi + 1, 3600)) AS bucket FROM s)"
)


def _clicks(spark, sf):
    p = points(spark, sf, ["fs_name"])
    return p.where("measurement = 'click'")


def _bucket_flat(df):
    return df.select("fs_name", F.unix_seconds("bucket").alias("bucket"), r6("value").alias("value"))


@query("bucket_null_fill", _BUCKETED + " SELECT g.fs_name, g.bucket, round(b.value, 6) AS value FROM g LEFT JOIN b USING (fs_name, bucket)")
def _(spark, sf):
    return _bucket_flat(S.bucket(_clicks(spark, sf), "1 hour", ["fs_name"], fn="sum", fill="null"))


@query("bucket_zero_fill", _BUCKETED + " SELECT g.fs_name, g.bucket, round(coalesce(b.value, 0), 6) AS value FROM g LEFT JOIN b USING (fs_name, bucket)")
def _(spark, sf):
    return _bucket_flat(S.bucket(_clicks(spark, sf), "1 hour", ["fs_name"], fn="sum", fill=0))


@query(
    "bucket_previous_fill",
    _BUCKETED
    + " SELECT g.fs_name, g.bucket, round(last_value(b.value IGNORE NULLS) OVER (PARTITION BY g.fs_name ORDER BY g.bucket), 6) AS value FROM g LEFT JOIN b USING (fs_name, bucket)",
)
def _(spark, sf):
    return _bucket_flat(S.bucket(_clicks(spark, sf), "1 hour", ["fs_name"], fn="sum", fill="previous"))


@query(
    "bucket_mean",
    points_sql(["fs_name"]) + " SELECT fs_name, CAST(floor(sec / 3600) AS BIGINT) * 3600 AS bucket, " + F32_AVG + " AS value FROM p WHERE measurement = 'click' GROUP BY ALL",
)
def _(spark, sf):
    out = S.bucket(_clicks(spark, sf), "1 hour", ["fs_name"])
    return out.select("fs_name", F.unix_seconds("bucket").alias("bucket"), f32("value").alias("value"))


@query("series_by_job", points_sql(["job_id"]) + " SELECT job_id, sec, value FROM p")
def _(spark, sf):
    out = S.series(points(spark, sf, ["job_id"]), ["job_id"])
    return out.select("job_id", F.unix_seconds("ts").alias("sec"), "value")


_SUMMARY = F32_AVG + " AS avg, round(max(value), 6) AS max, round(arg_max(value, ts), 6) AS current"


def summary_flat(df):
    return df.select(*[c for c in df.columns if c not in ("avg", "max", "current")], f32("avg").alias("avg"), *[r6(c).alias(c) for c in ("max", "current")])


@query("series_summary", points_sql(["job_id"]) + f" SELECT measurement, job_id, {_SUMMARY} FROM p GROUP BY ALL")
def _(spark, sf):
    return summary_flat(S.series_summary(points(spark, sf, ["job_id"]), ["measurement", "job_id"]))


@query(
    "series_summary_all_tags",
    points_sql(["job_id", "ost_index"]) + f" SELECT measurement, host, job_id, ost_index, {_SUMMARY} FROM p GROUP BY ALL",
)
def _(spark, sf):
    """A series is the measurement, the host and the whole tag set."""
    out = S.series_summary(points(spark, sf, ["job_id", "ost_index"]), None)
    tags = F.map_from_entries("_series_tags")
    out = out.select("measurement", "host", tags["job_id"].alias("job_id"), tags["ost_index"].alias("ost_index"), "avg", "max", "current")
    return summary_flat(out)


@query(
    "top_series",
    points_sql(["job_id"]) + f" SELECT job_id, {_SUMMARY} FROM p GROUP BY job_id ORDER BY current DESC, job_id LIMIT 10",
)
def _(spark, sf):
    return summary_flat(S.top(S.series_summary(points(spark, sf, ["job_id"]), ["job_id"]), 10, ties=["job_id"]))


@query("sorted_series", points_sql(["job_id"]) + f" SELECT job_id, {_SUMMARY} FROM p GROUP BY job_id")
def _(spark, sf):
    return summary_flat(S.top(S.series_summary(points(spark, sf, ["job_id"]), ["job_id"]), column="avg", descending=False, ties=["job_id"]))


@query("latest_point", points_sql(["job_id"]) + " SELECT job_id, arg_max(sec, ts) AS sec, arg_max(value, ts) AS value FROM p GROUP BY ALL")
def _(spark, sf):
    out = S.latest(points(spark, sf, ["job_id"]), ["job_id"])
    return out.select("job_id", F.unix_seconds("ts").alias("sec"), "value")


@query(
    "extent",
    points_sql([]) + " SELECT host, measurement, CAST(floor(sec / 86400) AS BIGINT) * 86400 AS window_start, min(value) AS min, max(value) AS max FROM p GROUP BY ALL",
)
def _(spark, sf):
    p = points(spark, sf, ["job_id"])
    out = S.extent(p, ["host", "measurement"], window="1 day")
    return out.withColumn("window_start", F.unix_seconds("window_start"))


_SIZES = points_sql(["field", "size"]) + ", a AS (SELECT field, size, sum(value) AS amount FROM p GROUP BY ALL)"


@query("distribution", _SIZES + " SELECT field, size, round(amount, 6) AS amount, round(100 * amount / sum(amount) OVER (PARTITION BY field), 6) AS share FROM a")
def _(spark, sf):
    out = distribution(points(spark, sf, ["field", "size"]), ["field"])
    return out.select("field", "size", r6("amount").alias("amount"), r6("share").alias("share"))


@query(
    "distribution_cumulative",
    _SIZES
    + ", o AS (SELECT *, CASE size WHEN '8_Bytes' THEN 1 WHEN '4K_Bytes' THEN 2 WHEN '64K_Bytes' THEN 3 ELSE 4 END AS pos FROM a)"
    " SELECT field, size, round(100 * sum(amount) OVER (PARTITION BY field ORDER BY pos) / sum(amount) OVER (PARTITION BY field), 6) AS cum_share FROM o",
)
def _(spark, sf):
    out = distribution(points(spark, sf, ["field", "size"]), ["field"], cumulative=True)
    return out.select("field", "size", r6("cum_share").alias("cum_share"))


_LINES_SIZES = (
    "WITH a AS (SELECT l_returnflag AS field, CASE WHEN l_quantity <= 8 THEN '8K' WHEN l_quantity <= 16 THEN '16K' WHEN l_quantity <= 32 THEN '32K' ELSE '64K' END AS size,"
    " sum(l_extendedprice) AS amount FROM lineitem GROUP BY ALL)"
)


@query(
    "distribution_lineitem",
    _LINES_SIZES + " SELECT field, size, round(100 * amount / sum(amount) OVER (PARTITION BY field), 4) AS share,"
    " round(100 * sum(amount) OVER (PARTITION BY field ORDER BY CAST(replace(size, 'K', '') AS INTEGER)) / sum(amount) OVER (PARTITION BY field), 4) AS cum_share FROM a",
)
def _(spark, sf):
    size = "CASE WHEN l_quantity <= 8 THEN '8K' WHEN l_quantity <= 16 THEN '16K' WHEN l_quantity <= 32 THEN '32K' ELSE '64K' END"
    lines = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("field"), F.expr(size).alias("size"), F.col("l_extendedprice").alias("value"))
    out = distribution(lines, ["field"], cumulative=True)
    return out.select("field", "size", F.round("share", 4).alias("share"), F.round("cum_share", 4).alias("cum_share"))


@query(
    "stack",
    points_sql(["controller"])
    + ", h AS (SELECT CAST(floor(sec / 3600) AS BIGINT) * 3600 AS sec, controller, sum(value) AS value FROM p GROUP BY ALL)"
    " SELECT sec, controller, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY sec ORDER BY controller), 6) AS stacked FROM h",
)
def _(spark, sf):
    p = points(spark, sf, ["controller"])
    hourly = p.withColumn("ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / HOURS) * HOURS))
    out = S.stack(hourly, [], "controller")
    return out.select(F.unix_seconds("ts").alias("sec"), "controller", r6("value").alias("value"), r6("stacked").alias("stacked"))


# -------------------------------------------------------------------- status

_STATUS_RULES = (
    StatusRule("view", warning=60, critical=20),
    StatusRule("click", warning=80, critical=120, above=True),
    StatusRule("purchase", warning=30, critical=5),
    StatusRule("signup", warning=25, critical=3),
)


@query(
    "host_status",
    f"WITH {EVENTS_SQL}, p AS (SELECT concat('user', user_id) AS host, event_type AS m, value, ts FROM e),"
    " l AS (SELECT host, arg_max(value, ts) FILTER (m = 'view') AS v, arg_max(value, ts) FILTER (m = 'click') AS c,"
    " arg_max(value, ts) FILTER (m = 'purchase') AS b, arg_max(value, ts) FILTER (m = 'signup') AS s FROM p WHERE m <> 'error' GROUP BY host)"
    " SELECT host, CASE WHEN coalesce(v < 20, false) OR coalesce(c > 120, false) OR coalesce(b < 5, false) OR coalesce(s < 3, false) THEN 'red'"
    " WHEN coalesce(v < 60, false) OR coalesce(c > 80, false) OR coalesce(b < 30, false) OR coalesce(s < 25, false) THEN 'yellow' ELSE 'green' END AS status FROM l",
)
def _(spark, sf):
    named = events(spark, sf).select(F.concat(F.lit("user"), "user_id").alias("host"), F.col("event_type").alias("measurement"), "ts", "value")
    return host_status(named, _STATUS_RULES).select("host", "status")


@query(
    "freshness",
    points_sql(["job_id"])
    + " SELECT job_id, max(sec) FILTER (ts < TIMESTAMP '2024-01-25') AS before, max(sec) AS newest,"
    " coalesce(max(ts) > max(ts) FILTER (ts < TIMESTAMP '2024-01-25'), true) AS fresh FROM p GROUP BY job_id",
)
def _(spark, sf):
    """A look at the 25th and a look at the end."""
    p = points(spark, sf, ["job_id"])
    out = freshness(p.where("ts < timestamp '2024-01-25'"), p, ["job_id"])
    return out.select("job_id", F.unix_seconds("before").alias("before"), F.unix_seconds("newest").alias("newest"), "fresh")


@query("newest_time", points_sql(["fs_name"]) + " SELECT max(sec) AS newest FROM p WHERE measurement = 'view' AND fs_name = 'fs0'")
def _(spark, sf):
    out = newest_time(points(spark, sf, ["fs_name"]), "view", {"fs_name": "fs0"})
    return out.select(F.unix_seconds("newest").alias("newest"))


_OST_EXPECTED = EXPECTED["ost"]
_SEEN_MEASUREMENT = f"CASE event_type WHEN 'click' THEN '{_OST_EXPECTED[0]}' WHEN 'view' THEN '{_OST_EXPECTED[1]}' WHEN 'signup' THEN '{_OST_EXPECTED[3]}' ELSE 'other' END"


@query(
    "missing_series",
    points_sql({"fs_name": "uid", "ost_index": "ost_index"}, measurement=_SEEN_MEASUREMENT)
    + f", t AS (SELECT DISTINCT fs_name, ost_index FROM p), x AS (SELECT fs_name, ost_index, unnest({list(_OST_EXPECTED)}) AS measurement FROM t)"
    " SELECT x.* FROM x ANTI JOIN p USING (fs_name, ost_index, measurement)",
)
def _(spark, sf):
    p = points(spark, sf, {"fs_name": "uid", "ost_index": "ost_index"}, measurement=_SEEN_MEASUREMENT)
    by = ["fs_name", "ost_index"]
    targets = p.select(*tag_columns(p, by)).distinct()
    return missing_series(p, targets, _OST_EXPECTED, by).select(*by, "measurement")


# -------------------------------------------------------------- tag catalog

_DAYS = "strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day"


@query(
    "tag_catalog",
    points_sql(["fs_name", "job_id"])
    + f" SELECT measurement, 'fs_name' AS tag, fs_name AS tag_value, {_DAYS} FROM p GROUP BY ALL"
    + f" UNION ALL SELECT measurement, 'job_id', job_id, {_DAYS} FROM p GROUP BY ALL"
    + f" UNION ALL SELECT measurement, 'fqdn', host, {_DAYS} FROM p GROUP BY ALL",
)
def _(spark, sf):
    """Tag values with their first and last day, kept over several loads of points."""
    path, p = f"{shared_folder(spark)}/tags-{uuid.uuid4().hex}", points(spark, sf, ["fs_name", "job_id"])
    for third in range(3):
        record(p.where(F.pmod(F.xxhash64("ts", "host"), F.lit(3)) == third), path)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return read_catalog(spark, path).select("measurement", "tag", "tag_value", day("first_day"), day("last_day"))


@query("tag_values_listed", points_sql(["job_id"]) + " SELECT DISTINCT job_id FROM p WHERE measurement = 'click'")
def _(spark, sf):
    """Values of a tag from the catalog: no point is read."""
    path = f"{shared_folder(spark)}/tags-{uuid.uuid4().hex}"
    record(points(spark, sf, ["fs_name", "job_id"]), path)
    return listed_values(read_catalog(spark, path), "click", "job_id")
