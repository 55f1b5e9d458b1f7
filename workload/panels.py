"""One query per panel over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyflow.operators.rates import rate
from tallyflow.operators.rollup import Rollup, rollup, rollup_many
from tallyflow.operators.status import GIB, MIB, host_status
from tallyflow.plans import panels as Q
from tallyflow.plans.rollup_catalog import TOTAL_BYTES
from tallyflow.session import shared_folder
from tallyflow.sources import points as P
from tallyflow.sources.points import tag_values
from workload.operators import F32_AVG, HOURS, f32, r6, summary_flat
from workload.registry import query
from workload.tables import DIMENSIONS, EVENTS_SQL, events, points, points_sql

FS = "fs1"
SPAN = 4 * HOURS


def _rolled(spark, sf, tags, measurement: str, rollups: list[Rollup]):
    return rollup_many(points(spark, sf, tags, measurement=measurement), rollups, interval=HOURS)


def _rolled_sql(tags, measurement: str, wanted: str, by: list[str], *, where: str = "true") -> str:
    """``r``: the rollup of the wanted measurement in one file system."""
    keys = "".join(f"{t}, " for t in by)
    return (
        f"{points_sql(tags, measurement=measurement)}, r AS (SELECT {keys}CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} AS ts,"
        f" sum(value) / 4 AS value FROM p WHERE measurement = '{wanted}' AND fs_name = '{FS}' AND {where} GROUP BY ALL)"
    )


def _summary_sql(by: list[str]) -> str:
    keys = ", ".join(by)
    return f" SELECT {keys}, {F32_AVG} AS avg, round(max(value), 6) AS max, round(arg_max(value, ts), 6) AS current FROM r GROUP BY {keys}"


def _over_time_sql(by: list[str]) -> str:
    keys = "".join(f"{t}, " for t in by)
    return f" SELECT {keys}ts, round(value, 6) AS value FROM r"


def _over_time(df):
    return df.withColumn("ts", F.unix_seconds("ts")).withColumn("value", r6("value"))


def _two(a: str, b: str) -> str:
    """Half of the events each: two measurements of one panel."""
    return f"CASE WHEN event_type IN ('click', 'view', 'error') THEN '{a}' ELSE '{b}' END"


# ------------------------------------------------------- capacity and inodes

for _what in ("free", "used"):
    for _name, _prefix, _fn in (("capacity", "ost_kbytesinfo", Q.capacity_total), ("inodes", "mdt_filesinfo", Q.inodes_total)):
        _m = _two(f"{_prefix}_free", f"{_prefix}_used")
        _tags = ["fs_name", "ost_index", "mdt_index"]

        @query(f"{_name}_{_what}_total", _rolled_sql(_tags, _m, f"{_prefix}_{_what}", []) + _over_time_sql([]))
        def _(spark, sf, what=_what, prefix=_prefix, fn=_fn, m=_m, tags=_tags):
            rolled = _rolled(spark, sf, tags, m, [Rollup(f"{prefix}_free", ("fs_name",)), Rollup(f"{prefix}_used", ("fs_name",))])
            return _over_time(fn(rolled, FS, what))

    _m = _two("ost_kbytesinfo_free", "ost_kbytesinfo_used")

    @query(
        f"capacity_{_what}_per_ost",
        points_sql(["fs_name", "ost_index"], measurement=_m)
        + f", r AS (SELECT * FROM p WHERE measurement = 'ost_kbytesinfo_{_what}' AND fs_name = '{FS}')" + _summary_sql(["ost_index"]),
    )
    def _(spark, sf, what=_what, m=_m):
        return summary_flat(Q.capacity_per_ost(points(spark, sf, ["fs_name", "ost_index"], measurement=m), FS, what))

    _m = _two("mdt_filesinfo_free", "mdt_filesinfo_used")
    _tags = {"fs_name": "fs_name", "mdt_index": "ost_index"}

    @query(
        f"inodes_{_what}_per_mdt",
        points_sql(_tags, measurement=_m)
        + f" SELECT mdt_index, arg_max(sec, ts) AS ts, arg_max(value, ts) AS value FROM p WHERE measurement = 'mdt_filesinfo_{_what}' AND fs_name = '{FS}' GROUP BY mdt_index",
    )
    def _(spark, sf, what=_what, m=_m, tags=_tags):
        return _over_time(Q.inodes_per_mdt(points(spark, sf, tags, measurement=m), FS, what))

    @query(
        f"inodes_{_what}_of_mdt",
        points_sql(_tags, measurement=_m)
        + f" SELECT mdt_index, sec AS ts, value FROM p WHERE measurement = 'mdt_filesinfo_{_what}' AND fs_name = '{FS}' AND mdt_index = 'OST0001'",
    )
    def _(spark, sf, what=_what, m=_m, tags=_tags):
        return _over_time(Q.inodes_of_mdt(points(spark, sf, tags, measurement=m), FS, "OST0001", what))


_OWNER = {"user": "user_id", "group": "host", "project": "k_tag"}
for _kind, _dim in _OWNER.items():
    _tags = {"fs_name": "fs_name", "optype": "usage", f"{_kind}_id": _dim, "mdt_index": "ost_index"}
    for _target, _name, _used, _fn in (
        ("ost", "capacity", "usage_kbytes", Q.capacity_per_owner),
        ("mdt", "inodes", "usage_inodes", Q.inodes_per_owner),
    ):
        _m = f"{_target}_acct{_kind}_samples"

        @query(
            f"{_name}_per_{_kind}",
            _rolled_sql(_tags, f"'{_m}'", _m, [f"{_kind}_id"], where=f"optype = '{_used}'") + _summary_sql([f"{_kind}_id"]),
        )
        def _(spark, sf, m=_m, tags=_tags, kind=_kind, fn=_fn):
            rolled = _rolled(spark, sf, tags, f"'{m}'", [Rollup(m, ("fs_name", "optype", f"{kind}_id"))])
            return summary_flat(fn(rolled, FS, kind))

    _m = f"mdt_acct{_kind}_samples"

    @query(
        f"inodes_per_{_kind}_of_mdt",
        points_sql(_tags, measurement=f"'{_m}'")
        + f", r AS (SELECT * FROM p WHERE fs_name = '{FS}' AND mdt_index = 'OST0001' AND optype = 'usage_inodes')" + _summary_sql([f"{_kind}_id"]),
    )
    def _(spark, sf, m=_m, tags=_tags, kind=_kind):
        return summary_flat(Q.inodes_per_owner_of_mdt(points(spark, sf, tags, measurement=f"'{m}'"), FS, "OST0001", kind))


# ------------------------------------------------------------ data throughput

_IO_TAGS = {"fs_name": "fs_name", "ost_index": "ost_index", "fqdn": "host", "optype": "direction", "exp_client": "exp_client"}
_BYTES = "'ost_stats_bytes'"


@query("throughput_total", _rolled_sql(_IO_TAGS, _BYTES, "ost_stats_bytes", ["optype"]) + _over_time_sql(["optype"]))
def _(spark, sf):
    return _over_time(Q.throughput_total(_rolled(spark, sf, _IO_TAGS, _BYTES, [Rollup("ost_stats_bytes", ("fs_name", "optype"))]), FS))


@query("throughput_per_ost", _rolled_sql(_IO_TAGS, _BYTES, "ost_stats_bytes", ["ost_index"]) + _summary_sql(["ost_index"]))
def _(spark, sf):
    rolled = _rolled(spark, sf, _IO_TAGS, _BYTES, [Rollup("ost_stats_bytes", ("fs_name", "ost_index"))])
    return summary_flat(Q.throughput_per_ost(rolled, FS))


@query("throughput_per_server", _rolled_sql(_IO_TAGS, _BYTES, "ost_stats_bytes", ["fqdn"]) + _summary_sql(["fqdn"]))
def _(spark, sf):
    rolled = _rolled(spark, sf, _IO_TAGS, _BYTES, [Rollup("ost_stats_bytes", ("fqdn", "fs_name"))])
    return summary_flat(Q.throughput_per_server(rolled, FS))


for _rw in ("read", "write"):

    @query(
        f"{_rw}_throughput_per_server",
        _rolled_sql(_IO_TAGS, _BYTES, "ost_stats_bytes", ["fqdn"], where=f"optype = '{_rw}'") + _summary_sql(["fqdn"]),
    )
    def _(spark, sf, rw=_rw):
        rolled = _rolled(spark, sf, _IO_TAGS, _BYTES, [Rollup("ost_stats_bytes", ("fqdn", "fs_name", "optype"))])
        return summary_flat(Q.throughput_per_server(rolled, FS, rw))

    @query(
        f"{_rw}_throughput_per_ost",
        points_sql(_IO_TAGS, measurement=_BYTES) + f", r AS (SELECT * FROM p WHERE fs_name = '{FS}' AND optype = '{_rw}')" + _summary_sql(["ost_index"]),
    )
    def _(spark, sf, rw=_rw):
        return summary_flat(Q.throughput_per_ost_by_direction(points(spark, sf, _IO_TAGS, measurement=_BYTES), FS, rw))

    @query(
        f"{_rw}_throughput_per_client",
        _rolled_sql(_IO_TAGS, "'exp_ost_stats_bytes'", "exp_ost_stats_bytes", ["exp_client"], where=f"optype = '{_rw}'") + _summary_sql(["exp_client"]),
    )
    def _(spark, sf, rw=_rw):
        rolled = _rolled(spark, sf, _IO_TAGS, "'exp_ost_stats_bytes'", [Rollup("exp_ost_stats_bytes", ("exp_client", "fs_name", "optype"))])
        return summary_flat(Q.throughput_per_client(rolled, FS, rw))


_JOB_TAGS = ["fs_name", "ost_index", "job_id", "uid", "optype"]
_JOB_BYTES = "'ost_jobstats_bytes'"
_BOTH = "optype IN ('sum_read_bytes', 'sum_write_bytes')"

for _who, _label in (("job_id", "job"), ("uid", "user")):

    @query(f"throughput_per_{_label}", _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", [_who], where=_BOTH) + _summary_sql([_who]))
    def _(spark, sf, who=_who):
        rolled = _rolled(spark, sf, _JOB_TAGS, _JOB_BYTES, [Rollup("ost_jobstats_bytes", ("fs_name", who), only=TOTAL_BYTES)])
        fn = Q.throughput_per_job if who == "job_id" else Q.throughput_per_user
        return summary_flat(fn(rolled, FS))

    @query(
        f"throughput_per_{_label}_and_ost",
        _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", [_who, "ost_index"], where=_BOTH) + _summary_sql([_who, "ost_index"]),
    )
    def _(spark, sf, who=_who):
        rolled = _rolled(spark, sf, _JOB_TAGS, _JOB_BYTES, [Rollup("ost_jobstats_bytes", ("fs_name", who, "ost_index"), only=TOTAL_BYTES)])
        return summary_flat(Q.throughput_per_job_and_ost(rolled, FS, who))

    for _rw in ("read", "write"):

        @query(
            f"{_rw}_throughput_per_{_label}",
            _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", [_who], where=f"optype = 'sum_{_rw}_bytes'") + _summary_sql([_who]),
        )
        def _(spark, sf, who=_who, rw=_rw):
            rolled = _rolled(spark, sf, _JOB_TAGS, _JOB_BYTES, [Rollup("ost_jobstats_bytes", ("fs_name", who, "optype"))])
            fn = Q.throughput_per_job if who == "job_id" else Q.throughput_per_user
            return summary_flat(fn(rolled, FS, f"sum_{rw}_bytes"))


@query(
    "job_throughput_over_time",
    _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", ["job_id"], where=_BOTH)
    + ", s AS (SELECT job_id, min(ts) AS lo, max(ts) AS hi FROM r GROUP BY job_id), g AS (SELECT job_id, unnest(range(lo, hi + 1, 14400)) AS ts FROM s)"
    " SELECT g.job_id, g.ts AS bucket, round(r.value, 6) AS value FROM g LEFT JOIN r USING (job_id, ts)",
)
def _(spark, sf):
    rolled = _rolled(spark, sf, _JOB_TAGS, _JOB_BYTES, [Rollup("ost_jobstats_bytes", ("fs_name", "job_id"), only=TOTAL_BYTES)])
    out = Q.job_throughput_over_time(rolled, FS, "4 hours")
    return out.select("job_id", F.unix_seconds("bucket").alias("bucket"), r6("value").alias("value"))


# ------------------------------------------------------------------ metadata

_MD_TAGS = {"fs_name": "fs_name", "mdt_index": "ost_index", "optype": "mdop", "exp_client": "exp_client", "job_id": "job_id", "uid": "uid"}
for _scope, (_measurement, _keys) in Q.METADATA_SCOPES.items():
    _by = [t for t in _keys if t != "fs_name"]

    @query(
        f"metadata_rate_{_scope}",
        _rolled_sql(_MD_TAGS, f"'{_measurement}'", _measurement, _by) + (_summary_sql(_by) if _by else _over_time_sql([])),
    )
    def _(spark, sf, scope=_scope, measurement=_measurement, keys=tuple(_keys), by=tuple(_by)):
        out = Q.metadata_rate(_rolled(spark, sf, _MD_TAGS, f"'{measurement}'", [Rollup(measurement, keys)]), FS, scope)
        return summary_flat(out) if by else _over_time(out)


# ---------------------------------------------------------------- bulk I/O

_BULK_TAGS = {"fs_name": "uid_fs", "field": "field", "size": "size"}
DIMENSIONS["uid_fs"] = "concat('fs', user_id % 2)"
_BULK = "ost_brw_stats_{}_samples"
_ORDER = "CASE size WHEN '8_Bytes' THEN 1 WHEN '4K_Bytes' THEN 2 WHEN '64K_Bytes' THEN 3 ELSE 4 END"

for _field, _label in (("read_sample", "read"), ("write_sample", "write")):
    _m = _BULK.format("rpc_bulk")

    @query(f"bulk_{_label}_rate_per_size", _rolled_sql(_BULK_TAGS, f"'{_m}'", _m, ["size"], where=f"field = '{_field}'") + _summary_sql(["size"]))
    def _(spark, sf, m=_m, field=_field):
        rolled = _rolled(spark, sf, _BULK_TAGS, f"'{m}'", [Rollup(m, ("field", "fs_name", "size"))])
        return summary_flat(Q.bulk_rate(rolled, FS, field))


for _kind in ("rpc_bulk", "page_discontiguous_rpc", "block_discontiguous_rpc", "fragmented_io", "io_in_flight", "io_time", "io_size"):
    _m = _BULK.format(_kind)

    @query(
        f"distribution_{_kind}",
        _rolled_sql(_BULK_TAGS, f"'{_m}'", _m, ["field", "size"])
        + ", a AS (SELECT field, size, sum(value) AS v FROM r GROUP BY ALL) SELECT field, size, round(100 * v / sum(v) OVER (PARTITION BY field), 6) AS share,"
        f" round(100 * sum(v) OVER (PARTITION BY field ORDER BY {_ORDER}) / sum(v) OVER (PARTITION BY field), 6) AS cum_share FROM a",
    )
    def _(spark, sf, m=_m, kind=_kind):
        rolled = _rolled(spark, sf, _BULK_TAGS, f"'{m}'", [Rollup(m, ("field", "fs_name", "size"))])
        out = Q.bulk_distribution(rolled, FS, kind, cumulative=True)
        return out.select("field", "size", r6("share").alias("share"), r6("cum_share").alias("cum_share"))


# ------------------------------------------------------------ service threads

for _service, _request in (("mdt", "req_waittime"), ("mdt_readpage", "mds_close"), ("ost_io", "ost_read"), ("ldlm_canceld", "req_active")):
    _m = f"CASE WHEN k < 50 THEN '{_service}_stats_{_request}_min' WHEN k < 95 THEN '{_service}_stats_{_request}_max' ELSE 'other' END"

    @query(
        f"service_extent_{_service}_{_request}",
        points_sql([], measurement=_m)
        + " SELECT host, CAST(floor(sec / 86400) AS BIGINT) * 86400 AS window_start, min(value) FILTER (measurement LIKE '%\\_min' ESCAPE '\\') AS min,"
        " max(value) FILTER (measurement LIKE '%\\_max' ESCAPE '\\') AS max FROM p WHERE measurement <> 'other' GROUP BY ALL",
    )
    def _(spark, sf, service=_service, request=_request, m=_m):
        out = Q.service_extent(points(spark, sf, ["k_tag"], measurement=m), service, request, "1 day")
        return out.withColumn("window_start", F.unix_seconds("window_start"))


@query(
    "service_mean",
    f"WITH {EVENTS_SQL} SELECT {DIMENSIONS['host']} AS host, sec, CAST(CAST(value / k AS FLOAT) AS DOUBLE) AS value FROM e WHERE k > 0",
)
def _(spark, sf):
    e = events(spark, sf)
    made = F.array(
        F.struct(F.lit("mdt_stats_req_qdepth_sum").alias("measurement"), F.col("value")),
        F.struct(F.lit("mdt_stats_req_qdepth_samples").alias("measurement"), F.col("k").cast("double").alias("value")),
    )
    tags = F.create_map(F.lit("event"), F.col("event_id").cast("string"))
    p = e.select(F.expr(DIMENSIONS["host"]).alias("host"), tags.alias("tags"), "ts", F.explode(made).alias("m")).select(
        "m.measurement", "host", "tags", "ts", "m.value"
    )
    return Q.service_mean(p, "mdt", "req_qdepth").select("host", F.unix_seconds("ts").alias("sec"), f32("value").alias("value"))


for _server in Q.SERVER_SERVICES:
    _names = Q.service_statistics(_server)
    _list = ", ".join(f"'{n}'" for n in _names)
    _m = f"element_at(array({_list}), CAST(pmod(event_id * 7 + k, {len(_names)}) AS INT) + 1)"
    _m_sql = f"[{_list}][((event_id * 7 + k) % {len(_names)}) + 1]"

    @query(
        f"service_table_{_server.lower()}",
        f"WITH {EVENTS_SQL}, p AS (SELECT {_m_sql} AS measurement, {DIMENSIONS['host']} AS host, CAST(floor(sec / 86400) AS BIGINT) * 86400 AS window_start, value FROM e),"
        " n AS (SELECT host, window_start, value, regexp_extract(measurement, '^(.+?)_stats_(.+)_([a-z]+)$', 1) AS service,"
        " regexp_extract(measurement, '^(.+?)_stats_(.+)_([a-z]+)$', 2) AS statistic, regexp_extract(measurement, '^(.+?)_stats_(.+)_([a-z]+)$', 3) AS what FROM p)"
        " SELECT host, service, statistic, window_start, min(value) FILTER (what = 'min') AS min, max(value) FILTER (what = 'max') AS max,"
        " CAST(CAST(CASE WHEN sum(value) FILTER (what = 'samples') > 0 THEN sum(value) FILTER (what = 'sum') / sum(value) FILTER (what = 'samples') END AS FLOAT) AS DOUBLE) AS mean"
        " FROM n GROUP BY ALL",
    )
    def _(spark, sf, server=_server, m=_m):
        out = Q.service_table(points(spark, sf, [], measurement=m), server, "1 day")
        return out.withColumn("window_start", F.unix_seconds("window_start")).withColumn("mean", f32("mean"))


# ----------------------------------------------------------------- over time

_OVER = ("2024-01-02", "2024-01-05")


def _over_sql(by: str, measurement: str, wanted: str, where: str) -> str:
    """Buckets of four hours from the first to the last of the bounds, empty ones shown, for every series that has any."""
    lo, hi = (f"epoch(TIMESTAMP '{t}')::BIGINT" for t in _OVER)
    return (
        f"{points_sql(['fs_name', 'job_id', 'exp_client', 'optype'], measurement=measurement)}, r AS (SELECT {by}, CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} AS bucket, round(sum(value) / 4, 6) AS value"
        f" FROM p WHERE measurement = '{wanted}' AND fs_name = '{FS}' AND {where} AND sec >= {lo} AND sec < {hi} GROUP BY ALL),"
        f" s AS (SELECT DISTINCT {by} FROM r), g AS (SELECT {by}, unnest(range({lo}, {hi}, {SPAN})) AS bucket FROM s)"
        f" SELECT {by}, bucket, value FROM g LEFT JOIN r USING ({by}, bucket)"
    )


for _name, _panel, _by, _r, _where in (
    ("job", Q.throughput_per_job, "job_id", Rollup("ost_jobstats_bytes", ("fs_name", "job_id"), only=TOTAL_BYTES), "optype IN ('sum_read_bytes', 'sum_write_bytes')"),
    ("client", Q.throughput_per_client, "exp_client", Rollup("exp_ost_stats_bytes", ("exp_client", "fs_name", "optype")), "optype = 'sum_read_bytes'"),
):

    @query(f"throughput_per_{_name}_over_time", _over_sql(_by, f"'{_r.measurement}'", _r.measurement, _where))
    def _(spark, sf, panel=_panel, r=_r, by=_by):
        """A table panel shown over time, empty buckets too."""
        rolled = _rolled(spark, sf, ["fs_name", "job_id", "exp_client", "optype"], f"'{r.measurement}'", [r])
        more = ["sum_read_bytes"] if "optype" in r.tags else []
        out = Q.over_time(panel, "4 hours", "null", "sum")(rolled, FS, *more, start=_OVER[0], end=_OVER[1])
        return out.select(by, F.unix_seconds("bucket").alias("bucket"), r6("value").alias("value"))


# ------------------------------------------------------- locks and recovery

_LOCK_TAGS = {"fs_name": "fs_name", "mdt_index": "ost_index", "optype": "mdop"}
for _what in ("lock_count", "lock_timeouts"):
    _m = _two("mdt_lock_count", "mdt_lock_timeouts")

    @query(
        _what,
        points_sql(_LOCK_TAGS, measurement=_m) + f" SELECT mdt_index, sec AS ts, value FROM p WHERE measurement = 'mdt_{_what}' AND fs_name = '{FS}' AND mdt_index = 'OST0003'",
    )
    def _(spark, sf, what=_what, m=_m):
        return _over_time(Q.lock_series(points(spark, sf, _LOCK_TAGS, measurement=m), FS, "OST0003", what))


@query(
    "recovery_clients",
    points_sql(_LOCK_TAGS, measurement="'mdt_recovery_status'") + f" SELECT optype, sec AS ts, value FROM p WHERE fs_name = '{FS}' AND mdt_index = 'OST0003'",
)
def _(spark, sf):
    return _over_time(Q.recovery_clients(points(spark, sf, _LOCK_TAGS, measurement="'mdt_recovery_status'"), FS, "OST0003"))


# ------------------------------------------------------------------- servers


def _server_points(spark, sf, plugin: str, kind: str):
    return events(spark, sf).select(
        F.expr(DIMENSIONS["host"]).alias("host"),
        F.lit(plugin).alias("plugin"),
        F.expr(DIMENSIONS["cpu"]).alias("plugin_instance"),
        F.lit(kind).alias("type"),
        F.col("event_type").alias("type_instance"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / HOURS) * HOURS).alias("ts"),
        "value",
    )


_HOURLY = f"WITH {EVENTS_SQL}, p AS (SELECT {DIMENSIONS['host']} AS host, event_type, CAST(floor(sec / 3600) AS BIGINT) * 3600 AS ts, value FROM e)"


@query("server_cpu_by_state", _HOURLY + " SELECT host, event_type AS type_instance, ts, " + F32_AVG + " AS value FROM p GROUP BY ALL")
def _(spark, sf):
    out = Q.cpu_by_state(_server_points(spark, sf, "cpu", "cpu"))
    return out.select("host", "type_instance", F.unix_seconds("ts").alias("ts"), f32("value").alias("value"))


@query("server_temperature", _HOURLY + " SELECT host, ts, max(value) AS value FROM p GROUP BY ALL")
def _(spark, sf):
    return _over_time(Q.temperature(_server_points(spark, sf, "sensors", "temperature")).select("host", "ts", "value"))


@query(
    "server_disk_rates",
    f"WITH {EVENTS_SQL}, c AS (SELECT {DIMENSIONS['host']} AS host, {DIMENSIONS['disk_index']} AS disk, {DIMENSIONS['direction']} AS optype, sec, epoch_us(ts) / 1e6 AS moment, ts, CAST(event_id AS DOUBLE) AS v FROM e),"
    " d AS (SELECT *, (v - lag(v) OVER w) / (moment - lag(moment) OVER w) AS value FROM c WINDOW w AS (PARTITION BY host, disk, optype ORDER BY ts))"
    " SELECT host, disk, optype, sec AS ts, round(value, 6) AS value FROM d WHERE value IS NOT NULL",
)
def _(spark, sf):
    e = events(spark, sf)
    p = e.select(
        F.expr(DIMENSIONS["host"]).alias("host"), F.expr(DIMENSIONS["disk_index"]).alias("disk"), F.expr(DIMENSIONS["direction"]).alias("optype"),
        "ts", F.lit("derive").alias("ds_type"), F.col("event_id").cast("double").alias("value"),
    )
    out = Q.disk_rates(p, ["host", "disk", "optype"])
    return _over_time(out.select("host", "disk", "optype", "ts", "value"))


_SERVER = "CASE event_type WHEN 'click' THEN 'memory' WHEN 'view' THEN 'df_root' WHEN 'signup' THEN 'load' WHEN 'error' THEN 'uptime' ELSE 'users' END"
for _m in ("memory", "df_root", "load", "uptime", "users"):

    @query(
        f"server_{_m}",
        points_sql({"fqdn": "host", "state": "mdop"}, measurement=_SERVER) + f", r AS (SELECT * FROM p WHERE measurement = '{_m}')" + _summary_sql(["fqdn", "state"]),
    )
    def _(spark, sf, m=_m):
        return summary_flat(Q.gauge_table(points(spark, sf, {"fqdn": "host", "state": "mdop"}, measurement=_SERVER), m, ["fqdn", "state"]))


_PLUGIN = "CASE event_type WHEN 'click' THEN 'memory' WHEN 'view' THEN 'df' WHEN 'signup' THEN 'load' WHEN 'error' THEN 'uptime' ELSE 'users' END"
_PLUGIN_INSTANCE = "CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'root' ELSE 'boot' END ELSE '' END"
_PARTS = {
    "click": ("used", "buffered", "cached", "free", "slab_recl", "slab_unrecl", "other"), "view": ("free", "used", "reserved"),
    "signup": ("shortterm", "midterm", "longterm"),
}
_TYPE_INSTANCE = "CASE event_type " + " ".join(
    f"WHEN '{e}' THEN CASE k % {len(p)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(p)) + " END" for e, p in _PARTS.items()
) + " ELSE '' END"


@query(
    "server_table",
    f"WITH {EVENTS_SQL}, p AS (SELECT {_PLUGIN} AS plugin, {_PLUGIN_INSTANCE} AS instance, {_TYPE_INSTANCE} AS part, {DIMENSIONS['host']} AS host, ts, value FROM e),"
    " r AS (SELECT CASE plugin WHEN 'df' THEN 'root' ELSE plugin END AS panel, host, part, ts, value FROM p WHERE part <> 'other' AND (plugin <> 'df' OR instance = 'root'))"
    + _summary_sql(["panel", "host", "part"]),
)
def _(spark, sf):
    """Memory by category, load by term, root usage, uptime and users of every server, by identifier and in one scan."""
    p = events(spark, sf).select(
        F.expr(DIMENSIONS["host"]).alias("host"), F.expr(_PLUGIN).alias("plugin"), F.expr(_PLUGIN_INSTANCE).alias("plugin_instance"),
        F.expr(_TYPE_INSTANCE).alias("type_instance"), "ts", "value",
    )
    return summary_flat(Q.server_table(p))


@query(
    "cluster_status",
    f"WITH {EVENTS_SQL}, l AS (SELECT concat('user', user_id) AS host, arg_max(value, ts) FILTER (event_type = 'view') AS idle, arg_max(value, ts) FILTER (event_type = 'click') AS load,"
    " arg_max(value, ts) FILTER (event_type = 'purchase') AS memory, arg_max(value, ts) FILTER (event_type = 'signup') AS root FROM e WHERE event_type <> 'error' GROUP BY 1)"
    " SELECT host, CASE WHEN coalesce(idle < 5, false) OR coalesce(load / 10 > 10, false) OR coalesce(memory * 20 < 100, false) OR coalesce(root / 3 < 1, false) THEN 'red'"
    " WHEN coalesce(idle < 20, false) OR coalesce(load / 10 > 5, false) OR coalesce(memory * 20 < 1000, false) OR coalesce(root / 3 < 10, false) THEN 'yellow' ELSE 'green' END AS status FROM l",
)
def _(spark, sf):
    e = events(spark, sf)
    metric = F.expr("CASE event_type WHEN 'view' THEN 'cpu_idle' WHEN 'click' THEN 'load' WHEN 'purchase' THEN 'memory_free' WHEN 'signup' THEN 'root_free' ELSE 'other' END")
    value = (
        F.when(F.col("event_type") == "click", F.col("value") / 10)
        .when(F.col("event_type") == "purchase", F.col("value") * 20 * MIB)
        .when(F.col("event_type") == "signup", F.col("value") / 3 * GIB)
        .otherwise(F.col("value"))
    )
    p = e.select(F.concat(F.lit("user"), "user_id").alias("host"), metric.alias("measurement"), "ts", value.alias("value"))
    return host_status(p).select("host", "status")


# --------------------------------------------------------------- disk arrays

_DISK = {"disk_index": "disk_index", "controller": "controller"}
_RATE_TYPE = "CASE WHEN k < 40 THEN 'iops' WHEN k < 70 THEN 'KiBps' ELSE 'W_KiBps' END"
DIMENSIONS["rate_type"] = _RATE_TYPE
DIMENSIONS["iosize"] = "CASE WHEN value < 16 THEN 'le4KiB' WHEN value < 64 THEN 'le64KiB' WHEN value < 128 THEN 'le1MiB' ELSE 'gt4MiB' END"
DIMENSIONS["latency"] = "CASE WHEN value < 16 THEN 'le16ms' WHEN value < 64 THEN 'le64ms' WHEN value < 128 THEN 'le1s' ELSE 'avg' END"


def _hourly(p):
    return p.withColumn("ts", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / HOURS) * HOURS))


for _kind, _column in (("pd", "iops"), ("vd", "iops"), ("pd", "KiBps"), ("vd", "W_KiBps")):
    _tags = _DISK | {"type": "rate_type", "fqdn": "host"}
    _divide = 60 if (_kind, _column) == ("pd", "iops") else 1

    @query(
        f"disk_rate_{_kind}_{_column}",
        points_sql(_tags, measurement=f"'{_kind}_rate'")
        + ", h AS (SELECT CAST(floor(sec / 3600) AS BIGINT) * 3600 AS ts, controller, sum(value) / " + str(_divide)
        + f" AS value FROM p WHERE fqdn IN ('node1') AND disk_index = '2' AND type = '{_column}' GROUP BY ALL)"
        " SELECT ts, controller, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY ts ORDER BY controller), 6) AS stacked FROM h",
    )
    def _(spark, sf, kind=_kind, column=_column, tags=_tags):
        p = _hourly(points(spark, sf, tags, measurement=f"'{kind}_rate'"))
        out = Q.disk_rate_by_controller(p, kind, "node1", "2", column)
        return _over_time(out).withColumn("stacked", r6("stacked"))


for _kind, _what, _rw in (("vd", "iosize", "read"), ("pd", "iosize", "write"), ("vd", "latency", "write"), ("pd", "latency", "read")):
    _tags = _DISK | {"type": "direction", "fqdn": "host", _what: _what}
    _order = (
        f"CASE {_what} WHEN 'le4KiB' THEN 1 WHEN 'le64KiB' THEN 2 WHEN 'le1MiB' THEN 3 WHEN 'gt4MiB' THEN 4 WHEN 'le16ms' THEN 1 WHEN 'le64ms' THEN 2 ELSE 3 END"
    )

    @query(
        f"disk_histogram_{_kind}_{_what}_{_rw}",
        points_sql(_tags, measurement=f"'{_kind}_{_what}'")
        + f", h AS (SELECT CAST(floor(sec / 3600) AS BIGINT) * 3600 AS ts, {_what}, sum(value) / 60 AS value FROM p WHERE fqdn = 'node1' AND disk_index = '2' AND type = '{_rw}' AND {_what} <> 'avg' GROUP BY ALL)"
        f" SELECT ts, {_what}, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY ts ORDER BY {_order}), 6) AS stacked FROM h",
    )
    def _(spark, sf, kind=_kind, what=_what, rw=_rw, tags=_tags):
        p = _hourly(points(spark, sf, tags, measurement=f"'{kind}_{what}'"))
        return _over_time(Q.disk_histogram(p, kind, what, "node1", "2", rw)).withColumn("stacked", r6("stacked"))


@query("fs_choices", points_sql(["fs_name"], measurement=_two("ost_kbytesinfo_free", "x")) + " SELECT DISTINCT fs_name FROM p WHERE measurement = 'ost_kbytesinfo_free'")
def _(spark, sf):
    """The choices a panel offers for its file system."""
    return tag_values(points(spark, sf, ["fs_name"], measurement=_two("ost_kbytesinfo_free", "x")), "ost_kbytesinfo_free", "fs_name")


@query(
    "rate_then_rollup",
    f"WITH {EVENTS_SQL}, c AS (SELECT {DIMENSIONS['job_id']} AS job_id, sec, epoch_us(ts) / 1e6 AS moment, ts, CAST(event_id AS DOUBLE) AS v FROM e),"
    " d AS (SELECT *, (v - lag(v) OVER w) / (moment - lag(moment) OVER w) AS value FROM c WINDOW w AS (PARTITION BY job_id ORDER BY ts))"
    f" SELECT job_id, CAST(floor(sec / {SPAN}) AS BIGINT) * {SPAN} AS window_start, round(sum(value) / 4, 6) AS sum FROM d WHERE value IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    """Stored counters to a rolled-up rate: the whole path of one panel."""
    ids = events(spark, sf).select("ts", "user_id", "event_type", F.col("event_id").cast("double").alias("value"))
    counters = ids.select(
        F.lit("mdt_jobstats_samples").alias("measurement"), F.expr(DIMENSIONS["job_id"]).alias("job_id"), "ts", F.lit("derive").alias("ds_type"), "value"
    )
    rolled = rollup(rate(counters, ["job_id"]), "mdt_jobstats_samples", ["job_id"], interval=HOURS)
    return rolled.select("job_id", F.unix_seconds("window_start").alias("window_start"), r6("sum").alias("sum"))


# ------------------------------------------- the stored rollup table, in a range

_STORED = [Rollup("ost_jobstats_bytes", ("fs_name", "job_id"), only=TOTAL_BYTES)]
_RANGE = {"start": "2024-01-05 00:00:00", "end": "2024-01-20 00:00:00"}
_IN_RANGE = f" AND sec >= epoch(TIMESTAMP '{_RANGE['start']}') AND sec < epoch(TIMESTAMP '{_RANGE['end']}')"


def _stored_rollups(spark, sf) -> str:
    path = f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}"
    P.write_rollup(_rolled(spark, sf, _JOB_TAGS, _JOB_BYTES, _STORED), path)
    return path


@query(
    "throughput_per_job_in_range",
    _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", ["job_id"], where=_BOTH + _IN_RANGE) + _summary_sql(["job_id"]),
)
def _(spark, sf):
    """A panel over the stored table; the range prunes its partitions."""
    return summary_flat(Q.throughput_per_job(P.read_rollups(spark, _stored_rollups(spark, sf)), FS, **_RANGE))


def _read_back(spark, path):
    back = P.select_rollups(P.read_rollups(spark, path), _STORED[0].name, where={"fs_name": FS})
    return _over_time(back.select(F.col("tags")["job_id"].alias("job_id"), F.col("window_start").alias("ts"), F.col("sum").alias("value")))


@query(
    "rollup_write_back",
    _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", ["job_id"], where=_BOTH) + _over_time_sql(["job_id"]),
)
def _(spark, sf):
    return _read_back(spark, _stored_rollups(spark, sf))


@query(
    "rollup_replace_window",
    _rolled_sql(_JOB_TAGS, _JOB_BYTES, "ost_jobstats_bytes", ["job_id"], where=_BOTH)
    + f" SELECT job_id, ts, round(CASE WHEN (ts // {SPAN}) % 2 = 0 THEN 2 * value ELSE value END, 6) AS value FROM r",
)
def _(spark, sf):
    """Every other window is replaced by one of twice the value; the rest of its day stays."""
    path = _stored_rollups(spark, sf)
    stored = P.read_rollups(spark, path)
    chosen = stored.where((F.unix_seconds("window_start") / SPAN).cast("bigint") % 2 == 0).drop("date", *P.HOT_TAGS)
    P.replace_rollup(spark, chosen.withColumn("sum", F.col("sum") * 2), path)
    return _read_back(spark, path)
