"""The questions operators ask, as thin compositions of the operators.

Panels over rollups take the rollup table (``measurement, tags, window_start,
sum``), the others take points.  Those that take ``fs_name`` show one file system.
All take ``start`` and ``end`` (times as text): the first counts, the second does
not, and on stored tables both prune the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.definitions import MathEntry
from tallyflow.definitions.disk_array import LATENCY_COLUMNS, SIZE_COLUMNS
from tallyflow.definitions.lustre import QUEUE_STATS, SERVICES
from tallyflow.model import has_column, tag
from tallyflow.operators import aggregate as A
from tallyflow.operators import summary as S
from tallyflow.operators.histogram import distribution
from tallyflow.operators.metric_math import apply_math
from tallyflow.operators.rates import per_interval, rate
from tallyflow.operators.rollup import rollup_name
from tallyflow.sources.points import in_range, select_points, select_rollups

# ---------------------------------------------------------------- helpers


def _rolled(
    rollups: DataFrame,
    measurement: str,
    tags: Sequence[str],
    fs_name: str,
    *,
    start: str | None = None,
    end: str | None = None,
    **where: str,
) -> DataFrame:
    """One rollup of one file system with its tags as columns."""
    name = rollup_name(measurement, tags)
    found = select_rollups(rollups, name, where={"fs_name": fs_name, **where}, start=start, end=end)
    shown = [t for t in tags if t != "fs_name"]
    return found.select(
        *[tag(found, t).alias(t) for t in shown], F.col("window_start").alias("ts"), F.col("sum").alias("value")
    )


#: Step, fill and function of the panel that is shown over time just now.
_OVER_TIME: ContextVar[tuple | None] = ContextVar("_OVER_TIME", default=None)


def over_time(panel: Callable[..., DataFrame], step: str, fill: str | float | None = None, fn: str = "mean") -> Callable[..., DataFrame]:
    """The panel with one value per series and time bucket in place of its table or its points.

    ``over_time(throughput_per_job, "1 minute", "null")(rollups, "fs0", start=...)``; ``fill`` as in ``bucket``.  With
    bounds, empty buckets span all of them.
    """

    def shown(*args, **options) -> DataFrame:
        wanted = (step, fill, fn, options.get("start"), options.get("end"))
        token = _OVER_TIME.set(wanted)
        try:
            out = panel(*args, **options)
        finally:
            _OVER_TIME.reset(token)
        # A panel that gives its points has not been through _table.
        return out if "bucket" in out.columns else _bucketed(out, [c for c in out.columns if c not in ("ts", "value")], wanted)

    return shown


def _bucketed(series: DataFrame, by: Sequence[str], wanted: tuple) -> DataFrame:
    step, fill, fn, start, end = wanted
    # ``end`` does not count any more.
    bounds = {"start": F.lit(start).cast("timestamp") if start else None, "end": F.lit(end).cast("timestamp") - F.expr("interval 1 microsecond") if end else None}
    return S.bucket(series, step, by, fn=fn, fill=fill, **bounds)


def _table(series: DataFrame, by: Sequence[str], column: str = "current") -> DataFrame:
    """Average, maximum and current per series, largest current first; or buckets, see ``over_time``."""
    shown = _OVER_TIME.get()
    if shown is not None:
        return _bucketed(series, by, shown)
    return S.top(S.series_summary(series, by), column=column, ties=by)


def _in_fs(
    points: DataFrame, measurement: str, fs_name: str, *, start: str | None = None, end: str | None = None, **where: str
) -> DataFrame:
    return select_points(points, measurement, where={"fs_name": fs_name, **where}, start=start, end=end)


def _bounds(span: dict[str, str | None]) -> dict[str, str | None]:
    """``start`` and ``end`` of a panel's keywords; any other keyword is an error."""
    unknown = span.keys() - {"start", "end"}
    if unknown:
        raise TypeError(f"unknown keywords: {sorted(unknown)}")
    return {"start": span.get("start"), "end": span.get("end")}


# ------------------------------------------------------- capacity and inodes


def capacity_total(rollups: DataFrame, fs_name: str, what: str = "free", **span: str | None) -> DataFrame:
    """Free or used capacity of the file system over time."""
    return _rolled(rollups, f"ost_kbytesinfo_{what}", ["fs_name"], fs_name, **span).orderBy("ts")


def capacity_per_ost(points: DataFrame, fs_name: str, what: str = "free", **span: str | None) -> DataFrame:
    return _table(_in_fs(points, f"ost_kbytesinfo_{what}", fs_name, **span), ["ost_index"])


def capacity_per_owner(rollups: DataFrame, fs_name: str, kind: str = "user", **span: str | None) -> DataFrame:
    """Used capacity per user, group or project."""
    owner = f"{kind}_id"
    series = _rolled(
        rollups, f"ost_acct{kind}_samples", ["fs_name", "optype", owner], fs_name, optype="usage_kbytes", **span
    )
    return _table(series, [owner])


def inodes_total(rollups: DataFrame, fs_name: str, what: str = "free", **span: str | None) -> DataFrame:
    return _rolled(rollups, f"mdt_filesinfo_{what}", ["fs_name"], fs_name, **span).orderBy("ts")


def inodes_per_mdt(points: DataFrame, fs_name: str, what: str = "free", **span: str | None) -> DataFrame:
    """Current inode number of every metadata target."""
    return S.latest(_in_fs(points, f"mdt_filesinfo_{what}", fs_name, **span), ["mdt_index"])


def inodes_of_mdt(points: DataFrame, fs_name: str, mdt_index: str, what: str = "free", **span: str | None) -> DataFrame:
    """Inode number of one metadata target over time."""
    return S.series(_in_fs(points, f"mdt_filesinfo_{what}", fs_name, mdt_index=mdt_index, **span), ["mdt_index"])


def inodes_per_owner(rollups: DataFrame, fs_name: str, kind: str = "user", **span: str | None) -> DataFrame:
    owner = f"{kind}_id"
    series = _rolled(
        rollups, f"mdt_acct{kind}_samples", ["fs_name", "optype", owner], fs_name, optype="usage_inodes", **span
    )
    return _table(series, [owner])


def inodes_per_owner_of_mdt(points: DataFrame, fs_name: str, mdt_index: str, kind: str = "user", **span: str | None) -> DataFrame:
    series = _in_fs(points, f"mdt_acct{kind}_samples", fs_name, mdt_index=mdt_index, optype="usage_inodes", **span)
    return _table(series, [f"{kind}_id"])


# ------------------------------------------------------------ data throughput


def throughput_total(rollups: DataFrame, fs_name: str, **span: str | None) -> DataFrame:
    """Bytes per second read and written over time."""
    return _rolled(rollups, "ost_stats_bytes", ["fs_name", "optype"], fs_name, **span).orderBy("optype", "ts")


def throughput_per_ost(rollups: DataFrame, fs_name: str, **span: str | None) -> DataFrame:
    return _table(_rolled(rollups, "ost_stats_bytes", ["fs_name", "ost_index"], fs_name, **span), ["ost_index"])


def throughput_per_ost_by_direction(rates: DataFrame, fs_name: str, optype: str, **span: str | None) -> DataFrame:
    """Read or write throughput per target, from rates (there is no rollup by both)."""
    return _table(_in_fs(rates, "ost_stats_bytes", fs_name, optype=optype, **span), ["ost_index"])


def throughput_per_server(rollups: DataFrame, fs_name: str, optype: str | None = None, **span: str | None) -> DataFrame:
    if optype is None:
        return _table(_rolled(rollups, "ost_stats_bytes", ["fs_name", "fqdn"], fs_name, **span), ["fqdn"])
    return _table(_rolled(rollups, "ost_stats_bytes", ["fs_name", "fqdn", "optype"], fs_name, optype=optype, **span), ["fqdn"])


def throughput_per_client(rollups: DataFrame, fs_name: str, optype: str, **span: str | None) -> DataFrame:
    series = _rolled(rollups, "exp_ost_stats_bytes", ["fs_name", "exp_client", "optype"], fs_name, optype=optype, **span)
    return _table(series, ["exp_client"])


def throughput_per_job(rollups: DataFrame, fs_name: str, optype: str | None = None, **span: str | None) -> DataFrame:
    """``optype`` None: both directions; ``sum_read_bytes`` or ``sum_write_bytes``: one."""
    return _throughput_per(rollups, fs_name, "job_id", optype, **span)


def throughput_per_user(rollups: DataFrame, fs_name: str, optype: str | None = None, **span: str | None) -> DataFrame:
    return _throughput_per(rollups, fs_name, "uid", optype, **span)


def _throughput_per(rollups: DataFrame, fs_name: str, who: str, optype: str | None, **span: str | None) -> DataFrame:
    if optype is None:
        return _table(_rolled(rollups, "ost_jobstats_bytes", ["fs_name", who], fs_name, **span), [who])
    series = _rolled(rollups, "ost_jobstats_bytes", ["fs_name", who, "optype"], fs_name, optype=optype, **span)
    return _table(series, [who])


def throughput_per_job_and_ost(rollups: DataFrame, fs_name: str, who: str = "job_id", **span: str | None) -> DataFrame:
    series = _rolled(rollups, "ost_jobstats_bytes", ["fs_name", who, "ost_index"], fs_name, **span)
    return _table(series, [who, "ost_index"])


def job_throughput_over_time(rollups: DataFrame, fs_name: str, step: str = "1 minute", who: str = "job_id", **span: str | None) -> DataFrame:
    """Sum per bucket and job with empty buckets shown."""
    series = _rolled(rollups, "ost_jobstats_bytes", ["fs_name", who], fs_name, **span)
    return S.bucket(series, step, [who], fn="sum", fill="null")


# ------------------------------------------------------------------ metadata

METADATA_SCOPES = {
    "total": ("md_stats", ["fs_name"]),
    "mdt": ("md_stats", ["fs_name", "mdt_index"]),
    "client": ("exp_md_stats", ["fs_name", "exp_client"]),
    "type": ("md_stats", ["fs_name", "optype"]),
    "job": ("mdt_jobstats_samples", ["fs_name", "job_id"]),
    "user": ("mdt_jobstats_samples", ["fs_name", "uid"]),
}


def metadata_rate(rollups: DataFrame, fs_name: str, scope: str = "total", **span: str | None) -> DataFrame:
    """Metadata operations per second in total (over time) or as a table."""
    measurement, tags = METADATA_SCOPES[scope]
    series = _rolled(rollups, measurement, tags, fs_name, **span)
    by = [t for t in tags if t != "fs_name"]
    return _table(series, by) if by else series.orderBy("ts")


# ---------------------------------------------------------------- bulk I/O


def bulk_rate(rollups: DataFrame, fs_name: str, field: str = "write_sample", kind: str = "rpc_bulk", **span: str | None) -> DataFrame:
    """Requests per second by size."""
    series = _rolled(rollups, f"ost_brw_stats_{kind}_samples", ["field", "fs_name", "size"], fs_name, field=field, **span)
    return _table(series, ["size"])


def bulk_distribution(rollups: DataFrame, fs_name: str, kind: str = "rpc_bulk", *, cumulative: bool = False, **span: str | None) -> DataFrame:
    """Share of each size among reads and among writes."""
    series = _rolled(rollups, f"ost_brw_stats_{kind}_samples", ["field", "fs_name", "size"], fs_name, **span)
    return distribution(series, ["field"], "size", cumulative=cumulative)


# ------------------------------------------------------------ service threads


def service_extent(points: DataFrame, service: str, request: str, window: str, **span: str | None) -> DataFrame:
    """Least and greatest value of one service statistic per host and window."""
    low, high = f"{service}_stats_{request}_min", f"{service}_stats_{request}_max"
    found = in_range(points.where(F.col("measurement").isin(low, high)), "ts", **_bounds(span))
    both = found.select(
        "host",
        "ts",
        F.when(F.col("measurement") == low, F.col("value")).alias("low"),
        F.when(F.col("measurement") == high, F.col("value")).alias("high"),
    )
    return S.extent(both, ["host"], window=window, low="low", high="high")


def service_mean(points: DataFrame, service: str, request: str, **span: str | None) -> DataFrame:
    """Mean of one service statistic at each time."""
    m = f"{service}_stats_{request}"
    points = in_range(points, "ts", **_bounds(span))
    return apply_math(points, [MathEntry(f"{m}_sum", "/", f"{m}_samples", f"{m}_mean", f"{request}_mean")])


#: Services whose statistics the panels of either kind of server show.
SERVER_SERVICES = {
    "MDS": ("mdt", "mdt_readpage", "mdt_setattr", "mdt_fld", "mdt_out", "mdt_seqm", "mdt_seqs", "ldlm_canceld", "ldlm_cbd"),
    "OSS": ("ost", "ost_io", "ost_create", "ost_seq", "ldlm_canceld", "ldlm_cbd"),
}
_STATISTIC = "^(.+?)_stats_(.+)_(samples|min|max|sum)$"


def service_statistics(server: str) -> list[str]:
    """Measurements of a kind of server's services, which prune a stored table."""
    requests = {s: [r for listed in (QUEUE_STATS, SERVICES[s][1]) for rs in listed.values() for r in rs] for s in SERVER_SERVICES[server]}
    return [f"{s}_stats_{r}_{what}" for s, rs in requests.items() for r in rs for what in ("samples", "min", "max", "sum")]


def service_table(points: DataFrame, server: str, window: str, **span: str | None) -> DataFrame:
    """Least, greatest and mean value of every statistic of every service of an ``MDS`` or ``OSS``, per host and window.

    All panels of the dashboard at once: one scan and one shuffle.  A mean is what was summed over what was counted in
    the window, null where nothing was counted.
    """
    found = in_range(points.where(F.col("measurement").isin(service_statistics(server))), "ts", **_bounds(span))
    part = lambda k: F.regexp_extract("measurement", _STATISTIC, k)
    named = found.select("host", "ts", "value", part(1).alias("service"), part(2).alias("statistic"), part(3).alias("what"))
    of = lambda what: F.when(F.col("what") == what, F.col("value"))
    return (
        named.groupBy("host", "service", "statistic", F.window("ts", window).alias("w"))
        .agg(F.min(of("min")).alias("min"), F.max(of("max")).alias("max"), F.sum(of("sum")).alias("_sum"), F.sum(of("samples")).alias("_samples"))
        .select("host", "service", "statistic", F.col("w.start").alias("window_start"), "min", "max",
                F.when(F.col("_samples") > 0, F.col("_sum") / F.col("_samples")).alias("mean"))
    )


# ------------------------------------------------------- locks and recovery


def lock_series(points: DataFrame, fs_name: str, mdt_index: str, what: str = "lock_count", **span: str | None) -> DataFrame:
    return S.series(_in_fs(points, f"mdt_{what}", fs_name, mdt_index=mdt_index, **span), ["mdt_index"])


def recovery_clients(points: DataFrame, fs_name: str, mdt_index: str, **span: str | None) -> DataFrame:
    """Recovery state of a target: one series per counter."""
    return S.series(_in_fs(points, "mdt_recovery_status", fs_name, mdt_index=mdt_index, **span), ["optype"])


# ------------------------------------------------------------------- servers


def cpu_by_state(points: DataFrame, **span: str | None) -> DataFrame:
    return A.aggregate(in_range(points, "ts", **_bounds(span)), A.CPU_AVERAGE)


def temperature(points: DataFrame, **span: str | None) -> DataFrame:
    return A.aggregate(in_range(points, "ts", **_bounds(span)), A.MAX_TEMPERATURE)


def disk_rates(points: DataFrame, by: Sequence[str], *, plugin: str = "disk", **span: str | None) -> DataFrame:
    """Read and write rate of the disks of each server; points that name their plugin are selected by it."""
    if has_column(points, "plugin"):
        points = points.where(F.col("plugin") == plugin)
    return rate(in_range(points, "ts", **_bounds(span)), by)


def gauge_table(points: DataFrame, measurement: str, by: Sequence[str], **span: str | None) -> DataFrame:
    """Memory by category, root usage, load, uptime or users of each server."""
    return _table(select_points(points, measurement, **_bounds(span)), by)


# What the server panels show, by identifier.
SERVER_PANELS = {
    "memory": ({"plugin": "memory"}, ("used", "buffered", "cached", "free", "slab_recl", "slab_unrecl")),
    "load": ({"plugin": "load"}, ("shortterm", "midterm", "longterm")),
    "root": ({"plugin": "df", "plugin_instance": "root"}, ("free", "used", "reserved")),
    "uptime": ({"plugin": "uptime"}, ()),
    "users": ({"plugin": "users"}, ()),
}


def server_table(points: DataFrame, panels: Sequence[str] = tuple(SERVER_PANELS), **span: str | None) -> DataFrame:
    """Average, maximum and current of memory by category, load by term, root usage, uptime and users of each server.

    Points are known by their identifier (plugin and instances), so all panels come out of one scan.
    """
    panel = F.lit(None).cast("string")
    for name in panels:
        wanted, shown = SERVER_PANELS[name]
        mine = F.lit(True)
        for part, value in wanted.items():
            mine &= F.col(part) == value
        if shown:
            mine &= F.col("type_instance").isin(*shown)
        panel = F.when(mine, F.lit(name)).otherwise(panel)
    plugins = sorted({SERVER_PANELS[name][0]["plugin"] for name in panels})
    found = in_range(points.where(F.col("plugin").isin(*plugins)), "ts", **_bounds(span)).withColumn("panel", panel)
    part = F.coalesce("type_instance", F.lit("")).alias("part")
    return S.series_summary(found.where("panel IS NOT NULL").select("panel", "host", part, "ts", "value"), ["panel", "host", "part"])


# --------------------------------------------------------------- disk arrays


def disk_rate_by_controller(
    points: DataFrame, kind: str, fqdn: str, disk_index: str, column: str, interval: float = 60.0, **span: str | None
) -> DataFrame:
    """One rate column of one disk, stacked by controller.

    Only the operations of physical disks are reported as an amount per collect
    interval; every other column already is a rate.
    """
    found = select_points(points, f"{kind}_rate", where={"fqdn": fqdn, "disk_index": disk_index, "type": column}, **_bounds(span))
    if kind == "pd" and column == "iops":
        found = per_interval(found, interval)
    return S.stack(found, [], "controller")


def disk_histogram(
    points: DataFrame, kind: str, what: str, fqdn: str, disk_index: str, rw: str, interval: float = 60.0, **span: str | None
) -> DataFrame:
    """I/O size or latency of one disk, stacked by bucket."""
    columns = SIZE_COLUMNS if what == "iosize" else LATENCY_COLUMNS[kind][1:]
    found = select_points(
        points,
        f"{kind}_{what}",
        where={"fqdn": fqdn, "disk_index": disk_index, "type": rw, what: list(columns)},
        **_bounds(span),
    )
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(what))
    return S.stack(per_interval(found, interval), [], what, order=order)
