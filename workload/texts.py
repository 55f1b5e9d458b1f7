"""Queries over text: the tables are printed as statistics files and read back.

Each query prints events in the layout a system prints them, extracts points
from that text and returns them flat.  The check computes the same numbers from
the table without any text, so an error in reading shows up as a difference.
Files are small by construction: a file holds the rows of one group of tags.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.definitions import burst_buffer, disk_array, gpfs, infiniband, lustre
from tallyflow.functions.tags import PROCNAME_UID
from tallyflow.model import tag_columns
from tallyflow.operators.extract import ExtendedParse, decimate, drop_stale, extract, match_path
from tallyflow.operators.metric_math import apply_math, with_math
from tallyflow.operators.rates import rate
from tallyflow.operators.rollup import rollup
from tallyflow.session import shared_folder
from tallyflow.sources.points import metric_path, read_points, write_points
from workload.operators import f32, f32_sql, r6
from workload.registry import query
from workload.tables import DIMENSIONS, EVENTS_SQL, events

DAY = 86400
_NAMES = ("host", "fs_name", "ost_index", "mdt_index", "job_id", "uid", "mdop", "direction", "disk_index", "controller")
_DIMS = ", ".join(f"{DIMENSIONS[d]} AS {d}" for d in _NAMES)
_SIZE = "CASE WHEN value < 16 THEN '4K' WHEN value < 64 THEN '64K' WHEN value < 128 THEN '1M' ELSE '8' END"
#: ``t``: events with their tags, the start of their day and their value in cents
T_SQL = (
    f"WITH {EVENTS_SQL}, t AS (SELECT event_id, event_type, k, ts, sec, value, CAST(round(value * 100) AS BIGINT) AS cents,"
    f" CAST(floor(sec / {DAY}) AS BIGINT) * {DAY} AS day, {_DIMS}, {_SIZE} AS bucket FROM e)"
)


def tagged(spark, sf) -> DataFrame:
    e = events(spark, sf)
    return e.select(
        "event_id", "event_type", "k", "ts", "value",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.timestamp_seconds(F.floor(F.unix_seconds("ts") / DAY) * DAY).alias("day"),
        *[F.expr(DIMENSIONS[d]).alias(d) for d in _NAMES],
        F.expr(_SIZE).alias("bucket"),
    )


def files(df: DataFrame, keys: list[str], path: str, line: str, *, host: str = "host", head: str = "", tail: str = "") -> DataFrame:
    """One file per group: a header, its lines in order, a trailer.

    A group has as many lines as the layout has names (operations, sizes, disks
    or the few jobs of one user), never one per event.
    """
    lines = F.array_join(F.array_sort(F.collect_list(F.expr(line))), "")
    grouped = df.groupBy(*keys, "day").agg(lines.alias("_lines"))
    return grouped.select(
        (F.col("host") if "host" in keys else F.lit("server")).alias("host"),
        F.expr(path).alias("path"),
        F.col("day").alias("collected_at"),
        F.concat(F.lit(head), F.col("_lines"), F.lit(tail)).alias("content"),
    )


def flat(points: DataFrame, tags: list[str], *, more: tuple[str, ...] = ()) -> DataFrame:
    return points.select("measurement", *more, *tag_columns(points, tags), F.unix_seconds("ts").alias("day"), "value")


OST_FOLDER = "'/proc/fs/lustre/obdfilter/', fs_name, '-', ost_index"
MDT_FOLDER = "'/proc/fs/lustre/mdt/', fs_name, '-', mdt_index"


# ------------------------------------------------------- single-number files


def _capacity_files(spark, sf) -> DataFrame:
    per = tagged(spark, sf).groupBy("fs_name", "ost_index", "day").agg(F.sum("cents").alias("total"), F.count("*").alias("free"))
    kinds = F.array(F.struct(F.lit("kbytestotal").alias("name"), F.col("total").alias("n")), F.struct(F.lit("kbytesfree").alias("name"), F.col("free").alias("n")))
    listed = per.select("fs_name", "ost_index", "day", kinds.alias("kinds"))
    out = listed.select("fs_name", "ost_index", "day", F.explode("kinds").alias("f"))
    path = "concat('/proc/fs/lustre/osd-ldiskfs/', fs_name, '-', ost_index, '/', f.name)"
    return out.select(F.lit("server").alias("host"), F.expr(path).alias("path"), F.col("day").alias("collected_at"), F.expr("concat(f.n, '\\n')").alias("content"))


_CAPACITY = ", c AS (SELECT fs_name, ost_index, day, sum(cents) AS total, count(*) AS free FROM t GROUP BY ALL)"


@query(
    "extract_single_numbers",
    T_SQL + _CAPACITY + " SELECT 'ost_kbytesinfo_total' AS measurement, fs_name, ost_index, day, total::DOUBLE AS value FROM c"
    " UNION ALL SELECT 'ost_kbytesinfo_free', fs_name, ost_index, day, free::DOUBLE FROM c",
)
def _(spark, sf):
    return flat(extract(_capacity_files(spark, sf), lustre.definition("2.12")), ["fs_name", "ost_index"])


@query(
    "extract_then_math",
    T_SQL + _CAPACITY + " SELECT 'ost_kbytesinfo_used' AS measurement, fs_name, ost_index, day, (total - free)::DOUBLE AS value FROM c",
)
def _(spark, sf):
    """Used capacity from the two files of each target."""
    d = lustre.definition("2.12")
    return flat(apply_math(extract(_capacity_files(spark, sf), d), d.math), ["fs_name", "ost_index"])


# ------------------------------------------------------------- counter lines


def _md_files(spark, sf, timed: bool = False) -> DataFrame:
    per = tagged(spark, sf).groupBy("fs_name", "mdt_index", "mdop", "day").agg(
        F.count("*").alias("n"), F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.sum("cents").alias("s"), F.sum(F.col("cents") * F.col("cents")).alias("q")
    )
    line = "concat(rpad(mdop, 25, ' '), ' ', n, ' samples [reqs]\n')"
    if timed:
        line = "concat(rpad(mdop, 25, ' '), ' ', n, ' samples [usecs] ', lo, ' ', hi, ' ', s, ' ', q, '\n')"
    head = "snapshot_time             1420966209.227519 secs.usecs\n"
    return files(per, ["fs_name", "mdt_index"], f"concat({MDT_FOLDER}, '/md_stats')", line, head=head)


_MD = ", m AS (SELECT fs_name, mdt_index, mdop AS optype, day, count(*) AS n, min(cents) AS lo, max(cents) AS hi, sum(cents) AS s, sum(cents * cents) AS q FROM t GROUP BY ALL)"


@query("extract_counter_lines", T_SQL + _MD + " SELECT 'md_stats' AS measurement, 'derive' AS ds_type, fs_name, mdt_index, optype, day, n::DOUBLE AS value FROM m")
def _(spark, sf):
    return flat(extract(_md_files(spark, sf), lustre.definition("2.5")), ["fs_name", "mdt_index", "optype"], more=("ds_type",))


@query(
    "extract_latency_columns",
    T_SQL + _MD + "".join(
        f"{' UNION ALL' if i else ''} SELECT 'md_stats{suffix}' AS measurement, fs_name, mdt_index, optype, day, {c}::DOUBLE AS value FROM m"
        for i, (suffix, c) in enumerate((("", "n"), ("_min", "lo"), ("_max", "hi"), ("_sum", "s"), ("_sumsq", "q")))
    ),
)
def _(spark, sf):
    """One line fans out to five measurements."""
    return flat(extract(_md_files(spark, sf, timed=True), lustre.definition("es6_0")), ["fs_name", "mdt_index", "optype"])


@query("extract_selected_items", T_SQL + _MD + " SELECT 'md_stats' AS measurement, fs_name, mdt_index, optype, day, n::DOUBLE AS value FROM m WHERE optype IN ('open', 'getattr')")
def _(spark, sf):
    points = extract(_md_files(spark, sf), lustre.definition("2.5"), select=["md_stats_open", "md_stats_getattr"])
    return flat(points, ["fs_name", "mdt_index", "optype"])


@query(
    "extract_mixed_versions",
    T_SQL + _MD + " SELECT 'md_stats' AS measurement, fs_name, mdt_index, optype, day, n::DOUBLE AS value FROM m"
    " UNION ALL SELECT 'md_stats_sum', fs_name, mdt_index, optype, day, s::DOUBLE FROM m WHERE mdt_index = 'MDT0001'"
    " UNION ALL SELECT 'md_stats_min', fs_name, mdt_index, optype, day, lo::DOUBLE FROM m WHERE mdt_index = 'MDT0001'"
    " UNION ALL SELECT 'md_stats_max', fs_name, mdt_index, optype, day, hi::DOUBLE FROM m WHERE mdt_index = 'MDT0001'"
    " UNION ALL SELECT 'md_stats_sumsq', fs_name, mdt_index, optype, day, q::DOUBLE FROM m WHERE mdt_index = 'MDT0001'",
)
def _(spark, sf):
    """One scan reads each host with the catalog of its own release."""
    old = _md_files(spark, sf).where(~F.col("path").contains("MDT0001")).withColumn("version", F.lit("2.5"))
    new = _md_files(spark, sf, timed=True).where(F.col("path").contains("MDT0001")).withColumn("version", F.lit("es6_0"))
    catalogs = {"2.5": lustre.definition("2.5"), "es6_0": lustre.definition("es6_0")}
    return flat(extract(old.unionByName(new), catalogs), ["fs_name", "mdt_index", "optype"])


@query(
    "match_path",
    T_SQL + ", f AS (SELECT DISTINCT fs_name, ost_index, uid, day FROM t) SELECT fs_name, ost_index, '10.0.0.' || uid AS client, 'tcp' AS net, day FROM f",
)
def _(spark, sf):
    """Path variables of export files; files outside the catalog are left out."""
    per = tagged(spark, sf).select("fs_name", "ost_index", "uid", "day").distinct()
    paths = per.select("day", F.explode(F.array(
        F.expr(f"concat({OST_FOLDER}, '/exports/10.0.0.', uid, '@tcp/stats')"), F.expr(f"concat({OST_FOLDER}, '/exports/', uid, '/other')")
    )).alias("path"))
    snap = paths.select(F.lit("server").alias("host"), "path", F.col("day").alias("collected_at"), F.lit("").alias("content"))
    found = match_path(snap, lustre.definition("2.12", per_client=True))
    tags = F.col("path_tags")
    return found.select(tags["fs_name"].alias("fs_name"), tags["ost_index"].alias("ost_index"), tags["ost_exp_client"].alias("client"),
                        tags["ost_exp_type"].alias("net"), F.unix_seconds("collected_at").alias("day"))


@query(
    "extract_exports",
    T_SQL + ", x AS (SELECT fs_name, ost_index, '10.0.0.' || uid AS exp_client, direction AS optype, day, count(*) AS n, sum(cents) AS s FROM t GROUP BY ALL)"
    " SELECT 'exp_ost_stats_samples' AS measurement, fs_name, ost_index, exp_client, optype, day, n::DOUBLE AS value FROM x"
    " UNION ALL SELECT 'exp_ost_stats_bytes', fs_name, ost_index, exp_client, optype, day, s::DOUBLE FROM x",
)
def _(spark, sf):
    per = tagged(spark, sf).groupBy("fs_name", "ost_index", "uid", "direction", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("s"))
    line = "concat(rpad(concat(direction, '_bytes'), 25, ' '), ' ', n, ' samples [bytes] 1 9 ', s, '\n')"
    path = f"concat({OST_FOLDER}, '/exports/10.0.0.', uid, '@tcp/stats')"
    snap = files(per, ["fs_name", "ost_index", "uid"], path, line, head="snapshot_time 1 secs.usecs\n")
    return flat(extract(snap, lustre.definition("2.12", per_client=True)), ["fs_name", "ost_index", "exp_client", "optype"])


# -------------------------------------------------------------- job records

_ZERO_LINES = "".join(f"\n  {op}:{' ' * (16 - len(op))}{{ samples:           0, unit:  reqs }}" for op in lustre.OST_JOB_OPS)


def _job_files(spark, sf) -> DataFrame:
    per = tagged(spark, sf).groupBy("fs_name", "ost_index", "uid", "job_id", "day").agg(
        F.count("*").alias("n"), F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.sum("cents").alias("s")
    )
    size = "'{{ samples: ', lpad({n}, 11, ' '), ', unit: bytes, min:', lpad(lo, 8, ' '), ', max:', lpad(hi, 8, ' '), ', sum:', lpad({s}, 16, ' '), ' }}'"
    line = (
        "concat('- job_id:          ', job_id, '\n  snapshot_time:   1495525343\n  read_bytes:      ', "
        + size.format(n="n", s="s") + ", '\n  write_bytes:     ', " + size.format(n="n + 1", s="s * 2") + f", '{_ZERO_LINES}\n')"
    )
    return files(per, ["fs_name", "ost_index", "uid"], f"concat({OST_FOLDER}, '/job_stats')", line, head="job_stats:\n")


_JOBS = ", j AS (SELECT fs_name, ost_index, job_id, uid, event_type AS procname, day, count(*) AS n, min(cents) AS lo, max(cents) AS hi, sum(cents) AS s FROM t GROUP BY ALL)"
_JOB_BYTES = (
    ", b AS (SELECT *, 'min_read_bytes' AS optype, lo AS v FROM j UNION ALL SELECT *, 'max_read_bytes', hi FROM j UNION ALL SELECT *, 'sum_read_bytes', s FROM j"
    " UNION ALL SELECT *, 'min_write_bytes', lo FROM j UNION ALL SELECT *, 'max_write_bytes', hi FROM j UNION ALL SELECT *, 'sum_write_bytes', s * 2 FROM j)"
)
_JOB_TAGS = ["fs_name", "ost_index", "job_id", "optype"]


@query(
    "extract_job_records",
    T_SQL + _JOBS + _JOB_BYTES + " SELECT 'ost_jobstats_bytes' AS measurement, fs_name, ost_index, job_id, optype, day, v::DOUBLE AS value FROM b"
    " UNION ALL SELECT 'ost_jobstats_samples', fs_name, ost_index, job_id, 'read_samples', day, n::DOUBLE FROM j"
    " UNION ALL SELECT 'ost_jobstats_samples', fs_name, ost_index, job_id, 'write_samples', day, (n + 1)::DOUBLE FROM j"
    f" UNION ALL SELECT 'ost_jobstats_samples', fs_name, ost_index, job_id, unnest({list(lustre.OST_JOB_OPS)}), day, 0::DOUBLE FROM j",
)
def _(spark, sf):
    """Records of many lines; every counter of a record becomes a point."""
    return flat(extract(_job_files(spark, sf), lustre.definition("2.12")), _JOB_TAGS)


@query(
    "extract_job_owner",
    T_SQL + _JOBS + " SELECT 'ost_jobstats_bytes' AS measurement, procname, uid, fs_name, ost_index, day, sum(s)::DOUBLE AS value FROM j GROUP BY ALL",
)
def _(spark, sf):
    """Process and user read from the job id with a second pattern."""
    owner = ExtendedParse("ost_jobstats", "job_id", PROCNAME_UID, ("procname", "uid"))
    points = extract(_job_files(spark, sf), lustre.definition("2.12"), extended=[owner])
    reads = points.where((F.col("measurement") == "ost_jobstats_bytes") & (F.col("tags")["optype"] == "sum_read_bytes"))
    return flat(reads, ["procname", "uid", "fs_name", "ost_index"])


@query(
    "extract_with_rules",
    T_SQL + _JOBS + _JOB_BYTES + " SELECT 'ost_jobstats_bytes' AS measurement, fs_name, ost_index, job_id, optype, day, v::DOUBLE AS value FROM b"
    " WHERE (procname = 'click' AND s >= 1000) OR procname = 'view'",
)
def _(spark, sf):
    """Rules of one alternative must all hold; alternatives are a choice."""
    rules = {"ost_jobstats": [
        [("job_id", "click[.][[:digit:]]+"), ("sum_read_bytes", "^[1-9][0-9]{3,}")],
        [("job_id", "^view[.]")],
    ]}
    points = extract(_job_files(spark, sf), lustre.definition("2.12"), rules=rules)
    return flat(points.where("measurement = 'ost_jobstats_bytes'"), _JOB_TAGS)


@query(
    "extract_without_fields",
    T_SQL + _JOBS + _JOB_BYTES + " SELECT 'ost_jobstats_bytes' AS measurement, fs_name, ost_index, job_id, optype, day, v::DOUBLE AS value FROM b"
    " WHERE optype IN ('sum_read_bytes', 'sum_write_bytes')"
    " UNION ALL SELECT 'ost_jobstats_samples', fs_name, ost_index, job_id, 'read_samples', day, n::DOUBLE FROM j",
)
def _(spark, sf):
    dropped = [f"{w}_{rw}_bytes" for w in ("min", "max") for rw in ("read", "write")] + ["write_samples", *lustre.OST_JOB_OPS]
    return flat(extract(_job_files(spark, sf), lustre.definition("2.12"), drop_fields=dropped), _JOB_TAGS)


@query(
    "extract_rate_rollup",
    T_SQL + _JOBS + ", c AS (SELECT fs_name, ost_index, job_id, day, s AS v FROM j),"
    " r AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN v / 86400.0 ELSE (v - lag(v) OVER w) / (day - lag(day) OVER w)::DOUBLE END AS rate FROM c"
    " WINDOW w AS (PARTITION BY fs_name, ost_index, job_id ORDER BY day))"
    " SELECT job_id, CAST(floor(day / (4 * 86400)) AS BIGINT) * 4 * 86400 AS window_start, round(sum(rate) / 4, 6) AS sum FROM r GROUP BY ALL",
)
def _(spark, sf):
    """Text to stored points to rates to a rollup: the whole path of a panel.

    Points are stored before rates are taken, so each file is read once."""
    path = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    write_points(extract(_job_files(spark, sf), lustre.definition("2.12")), path)
    points = read_points(spark, path)
    reads = points.where((F.col("measurement") == "ost_jobstats_bytes") & (F.col("tags")["optype"] == "sum_read_bytes"))
    rates = rate(reads, interval=DAY)
    rolled = rollup(rates, "ost_jobstats_bytes", ["job_id"], interval=DAY)
    return rolled.select("job_id", F.unix_seconds("window_start").alias("window_start"), r6("sum").alias("sum"))


@query(
    "extract_quota",
    T_SQL + ", q AS (SELECT fs_name, ost_index, uid AS user_id, day, count(*) AS inodes, sum(cents) AS kbytes FROM t GROUP BY ALL)"
    " SELECT 'ost_acctuser_samples' AS measurement, fs_name, ost_index, user_id, 'usage_inodes' AS optype, day, inodes::DOUBLE AS value FROM q"
    " UNION ALL SELECT 'ost_acctuser_samples', fs_name, ost_index, user_id, 'usage_kbytes', day, kbytes::DOUBLE FROM q",
)
def _(spark, sf):
    per = tagged(spark, sf).groupBy("fs_name", "ost_index", "uid", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("s"))
    line = "concat('- id:      ', uid, '\n  usage:   { inodes: ', lpad(n, 20, ' '), ', kbytes: ', lpad(s, 20, ' '), ' }\n')"
    path = "concat('/proc/fs/lustre/osd-ldiskfs/', fs_name, '-', ost_index, '/quota_slave/acct_user')"
    snap = files(per, ["fs_name", "ost_index", "uid"], path, line, head="usr_accounting:\n")
    return flat(extract(snap, lustre.definition("2.12")), ["fs_name", "ost_index", "user_id", "optype"])


# ------------------------------------------------------------ contexts

_BULK = (
    ", h AS (SELECT fs_name, ost_index, bucket, day, count(*) FILTER (direction = 'read') AS r, count(*) FILTER (direction = 'write') AS w FROM t GROUP BY ALL)"
)


def _bulk_files(spark, sf) -> DataFrame:
    read = F.when(F.col("direction") == "read", 1)
    write = F.when(F.col("direction") == "write", 1)
    per = tagged(spark, sf).groupBy("fs_name", "ost_index", "bucket", "day").agg(F.count(read).alias("r"), F.count(write).alias("w"))
    row = "bucket, ':\t\t ', {r}, '  10  10   |  ', {w}, '  20  20\n'"
    first, second = row.format(r="r", w="w"), row.format(r="r * 2", w="w * 3")
    grouped = per.groupBy("fs_name", "ost_index", "day").agg(
        F.array_join(F.array_sort(F.collect_list(F.expr(f"concat({first})"))), "").alias("one"),
        F.array_join(F.array_sort(F.collect_list(F.expr(f"concat({second})"))), "").alias("two"),
    )
    content = "concat('snapshot_time: 1.2 (secs.usecs)\n\npages per bulk r/w     rpcs  % cum % |  rpcs  % cum %\n', one, '\ndisk I/O size          ios   % cum % |  ios   % cum %\n', two, '\n')"
    path = "concat('/proc/fs/lustre/osd-ldiskfs/', fs_name, '-', ost_index, '/brw_stats')"
    return grouped.select(F.lit("server").alias("host"), F.expr(path).alias("path"), F.col("day").alias("collected_at"), F.expr(content).alias("content"))


@query(
    "extract_sections",
    T_SQL + _BULK + ", x AS (SELECT 'rpc_bulk' AS kind, '_pages' AS unit, *, r AS rv, w AS wv FROM h UNION ALL SELECT 'io_size', '_Bytes', *, r * 2, w * 3 FROM h)"
    " SELECT 'ost_brw_stats_' || kind || '_samples' AS measurement, fs_name, ost_index, 'read_sample' AS field, bucket || unit AS size, day, rv::DOUBLE AS value FROM x"
    " UNION ALL SELECT 'ost_brw_stats_' || kind || '_samples', fs_name, ost_index, 'write_sample', bucket || unit, day, wv::DOUBLE FROM x"
    " UNION ALL SELECT 'ost_brw_stats_' || kind || unnest(['_percentage', '_cum']), fs_name, ost_index, unnest(['read_percentage', 'read_cum']), bucket || unit, day, 10::DOUBLE FROM x"
    " UNION ALL SELECT 'ost_brw_stats_' || kind || unnest(['_percentage', '_cum']), fs_name, ost_index, unnest(['write_percentage', 'write_cum']), bucket || unit, day, 20::DOUBLE FROM x",
)
def _(spark, sf):
    """Rows look alike in every section; the header above them tells them apart."""
    return flat(extract(_bulk_files(spark, sf), lustre.definition("2.12")), ["fs_name", "ost_index", "field", "size"])


_DISKS = ", d AS (SELECT host, disk_index, day, count(*) FILTER (controller = '0') AS a, count(*) FILTER (controller = '1') AS b, count(*) AS n FROM t GROUP BY ALL)"


def _disk_files(spark, sf) -> DataFrame:
    count = lambda c: F.count(F.when(F.col("controller") == c, 1))
    per = tagged(spark, sf).groupBy("host", "disk_index", "day").agg(count("0").alias("a"), count("1").alias("b"), F.count("*").alias("n"))
    cell = lambda x: f"lpad({x}, 9, ' ')"
    rates = "'    ', disk_index, " + ", ".join(cell(x) for x in ("a", "a * 4", "4", "0", "0", "a", "0")) + ", '|', " + ", ".join(cell(x) for x in ("b", "b * 4", "4", "0", "0", "b", "0")) + ", '|\n'"
    latency = "'    ', disk_index, " + ", ".join(cell(x) for x in ("7", "n", *["0"] * 11)) + ", ' \n'"
    sizes = "'    ', disk_index, " + ", ".join(cell(x) for x in ("n * 5", *["0"] * 11)) + ", ' \n'"
    depth = "'    ', disk_index, " + ", ".join(cell(x) for x in ("{v}", *["0"] * 10)) + ", ' \n'"
    sections = {"one": rates, "two": latency, "three": sizes, "four": depth.format(v="a"), "five": depth.format(v="b")}
    grouped = per.groupBy("host", "day").agg(
        *[F.array_join(F.array_sort(F.collect_list(F.expr(f"concat({row})"))), "").alias(name) for name, row in sections.items()]
    )
    title = "Virtual Disk {}:  Elapsed time = 1.2 seconds\n  Idx ...\n------\n"
    content = ", ".join(
        f"'{title.format(t)}', {c}, '\n'"
        for t, c in (("Counters", "one"), ("Read Latency", "two"), ("Write Latency", "two"), ("Read IO Size", "three"), ("Write IO Size", "three"), ("Qdepth", "four"), ("Qdepth", "five"))
    )
    return grouped.select(
        F.lit("collector").alias("host"), F.lit("show vd c all").alias("path"), F.col("day").alias("collected_at"),
        F.expr(f"concat({content})").alias("content"), F.create_map(F.lit("extrahost"), "host").alias("extra_tags"),
    )


@query(
    "extract_between_markers",
    T_SQL + _DISKS + ", v AS (SELECT host, disk_index, day, 'vd_rate' AS measurement, unnest(['0', '1']) AS x, unnest([a, b]) AS value FROM d)"
    " SELECT measurement, host, disk_index, x AS controller, 'iops' AS kind, day, value::DOUBLE AS value FROM v"
    " UNION ALL SELECT measurement, host, disk_index, x, 'KiBps', day, (value * 4)::DOUBLE FROM v UNION ALL SELECT measurement, host, disk_index, x, 'KiBpIO', day, 4::DOUBLE FROM v"
    " UNION ALL SELECT measurement, host, disk_index, x, unnest(['Fwd_iops', 'Fwd_KiBps', 'W_KiBps']), day, 0::DOUBLE FROM v"
    " UNION ALL SELECT measurement, host, disk_index, x, 'R_KiBps', day, value::DOUBLE FROM v"
    " UNION ALL SELECT 'vd_qdepth', host, disk_index, x, '1', day, value::DOUBLE FROM v UNION ALL SELECT 'vd_latency', host, disk_index, unnest(['read', 'write']), 'le16ms', day, n::DOUBLE FROM d"
    " UNION ALL SELECT 'vd_iosize', host, disk_index, unnest(['read', 'write']), 'le4KiB', day, (n * 5)::DOUBLE FROM d",
)
def _(spark, sf):
    """Sections between literal titles, one of them found twice; the array names its own host."""
    points = extract(_disk_files(spark, sf), disk_array.definition("11.0"))
    t = F.col("tags")
    kind = F.coalesce(t["latency"], t["iosize"], t["qdepth"], t["type"])
    owner = F.when(F.col("measurement").isin("vd_rate", "vd_qdepth"), t["controller"]).otherwise(t["type"])
    shown = points.where((F.col("measurement") == "vd_rate") | kind.isin("1", "le16ms", "le4KiB"))
    return shown.select("measurement", "host", t["disk_index"].alias("disk_index"), owner.alias("controller"), kind.alias("kind"), F.unix_seconds("ts").alias("day"), "value")


def _columns_sql(measurement: str, owner: str, columns, value: str) -> str:
    """One row per column of a table, the n-th with ``value`` + n."""
    names, places = list(columns), list(range(len(columns)))
    return f"SELECT '{measurement}' AS measurement, host, disk_index, '{owner}' AS owner, unnest({names}) AS kind, day, ({value} + unnest({places}))::DOUBLE AS value FROM d"


@query(
    "extract_every_column",
    T_SQL + _DISKS + " " + " UNION ALL ".join([
        _columns_sql("vd_latency", "read", disk_array.LATENCY_COLUMNS["vd"], "n"),
        _columns_sql("vd_latency", "write", disk_array.LATENCY_COLUMNS["vd"], "n * 100"),
        _columns_sql("vd_iosize", "read", disk_array.SIZE_COLUMNS, "n * 2000"),
        _columns_sql("vd_iosize", "write", disk_array.SIZE_COLUMNS, "n * 30000"),
        _columns_sql("vd_qdepth", "0", disk_array.DEPTH_COLUMNS, "a"),
        _columns_sql("vd_qdepth", "1", disk_array.DEPTH_COLUMNS, "b * 100"),
        _columns_sql("vd_rate", "0", disk_array.RATE_COLUMNS, "a * 7"),
        _columns_sql("vd_rate", "1", disk_array.RATE_COLUMNS, "b * 9"),
    ]),
)
def _(spark, sf):
    """Every column of every table of a disk report holds another number, so a column read as its neighbour shows."""
    count = lambda c: F.count(F.when(F.col("controller") == c, 1))
    per = tagged(spark, sf).groupBy("host", "disk_index", "day").agg(count("0").alias("a"), count("1").alias("b"), F.count("*").alias("n"))
    cells = lambda value, columns: ", ".join(f"lpad({value} + {k}, 12, ' ')" for k in range(len(columns)))
    row = lambda *parts: "'    ', disk_index, " + ", '|', ".join(parts) + (", '|\n'" if len(parts) > 1 else ", ' \n'")
    latency, size = disk_array.LATENCY_COLUMNS["vd"], disk_array.SIZE_COLUMNS
    tables = {
        "Counters": row(cells("a * 7", disk_array.RATE_COLUMNS), cells("b * 9", disk_array.RATE_COLUMNS)),
        "Read Latency": row(cells("n", latency)), "Write Latency": row(cells("n * 100", latency)),
        "Read IO Size": row(cells("n * 2000", size)), "Write IO Size": row(cells("n * 30000", size)),
        "Qdepth": row(cells("a", disk_array.DEPTH_COLUMNS)), "Qdepth ": row(cells("b * 100", disk_array.DEPTH_COLUMNS)),
    }
    names = {title: f"_t{k}" for k, title in enumerate(tables)}
    grouped = per.groupBy("host", "day").agg(
        *[F.array_join(F.array_sort(F.collect_list(F.expr(f"concat({line})"))), "").alias(names[t]) for t, line in tables.items()]
    )
    content = ", ".join(f"'Virtual Disk {t.strip()}:  Elapsed time = 1.2 seconds\n  Idx ...\n------\n', {names[t]}, '\n'" for t in tables)
    snap = grouped.select(
        F.lit("collector").alias("host"), F.lit("show vd c all").alias("path"), F.col("day").alias("collected_at"),
        F.expr(f"concat({content})").alias("content"), F.create_map(F.lit("extrahost"), "host").alias("extra_tags"),
    )
    points = extract(snap, disk_array.definition("11.0"))
    t = F.col("tags")
    kind = F.coalesce(t["latency"], t["iosize"], t["qdepth"], t["type"])
    owner = F.when(F.col("measurement").isin("vd_rate", "vd_qdepth"), t["controller"]).otherwise(t["type"])
    return points.select("measurement", "host", t["disk_index"].alias("disk_index"), owner.alias("owner"), kind.alias("kind"), F.unix_seconds("ts").alias("day"), "value")


# ----------------------------------------------------- other systems' output


@query(
    "extract_service_means",
    T_SQL + f", m AS (SELECT host, day, {f32_sql('sum(cents)::DOUBLE / count(*)')} AS mean, {f32_sql('sum(cents * cents)::DOUBLE / count(*)')} AS square FROM t GROUP BY ALL)"
    " SELECT 'mdt_stats_req_waittime_mean' AS measurement, host, day, mean AS value FROM m UNION ALL SELECT 'mdt_stats_req_waittime_mean_square', host, day, square FROM m",
)
def _(spark, sf):
    """Files that reset when read: amounts per interval, then their means."""
    per = tagged(spark, sf).groupBy("host", "day").agg(
        F.count("*").alias("n"), F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.sum("cents").alias("s"), F.sum(F.col("cents") * F.col("cents")).alias("q")
    )
    line = "concat('req_waittime              ', n, ' samples [usec] ', lo, ' ', hi, ' ', s, ' ', q, '\n')"
    snap = files(per, ["host"], "'/sys/kernel/debug/lustre/mds/MDS/mdt/stats'", line, head="snapshot_time 1.2 secs.usecs\n")
    d = lustre.definition("2.12")
    points = rate(extract(snap, d), chunk=None)
    out = apply_math(points, d.math)
    return out.select("measurement", "host", F.unix_seconds("ts").alias("day"), f32("value").alias("value"))


@query(
    "extract_node_io",
    T_SQL + ", g AS (SELECT host, fs_name, day, sum(cents) AS s, count(*) AS n FROM t GROUP BY ALL)"
    " SELECT 'fs_io_bytes' AS measurement, host, fs_name, 'read' AS optype, day, s::DOUBLE AS value FROM g UNION ALL SELECT 'fs_io_bytes', host, fs_name, 'write', day, (s + 1)::DOUBLE FROM g"
    " UNION ALL SELECT 'fs_io_count', host, fs_name, unnest(['open', 'close', 'read', 'write', 'readdir', 'inode_update']), day, n::DOUBLE FROM g",
)
def _(spark, sf):
    per = tagged(spark, sf).groupBy("host", "fs_name", "day").agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
    line = (
        "concat('_fs_io_s_ _n_ 10.0.0.1 _nn_ ', host, ' _rc_ 0 _t_ 1 _tu_ 2 _cl_ c1 _fs_ ', fs_name, ' _d_ 2 _br_ ', s, ' _bw_ ', s + 1,"
        " ' _oc_ ', n, ' _cc_ ', n, ' _rdc_ ', n, ' _wc_ ', n, ' _dir_ ', n, ' _iu_ ', n, '\n')"
    )
    return flat(extract(files(per, ["host"], "'fs_io_s'", line), gpfs.definition()), ["fs_name", "optype"], more=("host",))


@query(
    "extract_device_table",
    T_SQL + ", g AS (SELECT host, disk_index AS device, day, count(*) AS n FROM t GROUP BY ALL)"
    " SELECT 'ime_nvm_' || unnest(['read_IOs', 'read_Lat', 'read_MBs', 'write_IOs', 'write_Lat', 'write_MBs', 'unmap_IOs', 'unmap_Lat', 'free']) AS measurement,"
    " 'ime_' || host AS host, device, unnest(['read', 'read', 'read', 'write', 'write', 'write', 'unmap', 'unmap', '']) AS rw, day,"
    " unnest([n, 5, n * 2, n * 3, 6, 0, 0, 0, 99])::DOUBLE AS value FROM g",
)
def _(spark, sf):
    """A table of devices; numbers with a fraction keep their integer part."""
    per = tagged(spark, sf).groupBy("host", "disk_index", "day").agg(F.count("*").alias("n"))
    line = (
        "concat('|  ', disk_index, ' |    /dev/nvme', disk_index, ' |      ', n, ' |     5 |    ', n * 2, '.7 |       ', n * 3, ' |     6 |    0.9 |       0 |       0 |  99.13 |     Device is OK |\n')"
    )
    snap = files(per, ["host"], f"'{burst_buffer.COMMANDS['1.2'][0]}'", line, head="CML Device Stats\n| ID | NAME | READ |\n")
    return flat(extract(snap, burst_buffer.definition("1.2")), ["device", "rw"], more=("host",))


@query(
    "extract_port_counters",
    T_SQL + " SELECT unnest(['port_rcv_data', 'port_xmit_data']) AS measurement, host, 'mlx5' AS driver_type, controller AS port_number, day, unnest([sum(cents), count(*)])::DOUBLE AS value FROM t GROUP BY host, controller, day",
)
def _(spark, sf):
    per = tagged(spark, sf).groupBy("host", "controller", "day").agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
    kinds = F.array(F.struct(F.lit("port_rcv_data").alias("name"), F.col("s").alias("v")), F.struct(F.lit("port_xmit_data").alias("name"), F.col("n").alias("v")))
    listed = per.select("host", "controller", "day", kinds.alias("kinds")).select("host", "controller", "day", F.explode("kinds").alias("f"))
    path = "concat('/sys/class/infiniband/mlx5_0/ports/', controller, '/counters/', f.name)"
    snap = listed.select("host", F.expr(path).alias("path"), F.col("day").alias("collected_at"), F.expr("concat(f.v, '\n')").alias("content"))
    return flat(extract(snap, infiniband.definition()), ["driver_type", "port_number"], more=("host",))


# ------------------------------------------------------ which snapshots count


def _stamped(spark, sf) -> DataFrame:
    """Each event as output produced some seconds before it was collected."""
    made = "date_format(timestamp_seconds(unix_seconds(ts) - k), 'EEE MMM dd HH:mm:ss yyyy')"
    content = f"concat('{{node}}: Data was produced by PID ', event_id, ' at ', {made}, '\n{{node}}: ', k, ' ', event_id, '\n')".replace("{node}", "n1")
    return events(spark, sf).select(
        F.lit("n1").alias("host"), F.lit("output").alias("path"), F.col("ts").alias("collected_at"), F.expr(content).alias("content"), "event_id"
    )


@query("drop_stale", f"WITH {EVENTS_SQL} SELECT event_id, sec, k || ' ' || event_id AS last_line FROM e WHERE k < 60")
def _(spark, sf):
    """Output older than a minute is dropped, and so is the node name before each line."""
    kept = drop_stale(_stamped(spark, sf))
    last = F.trim(F.element_at(F.split(F.rtrim(F.regexp_replace("content", "\n$", "")), "\n"), -1))
    return kept.select("event_id", F.unix_seconds("collected_at").alias("sec"), last.alias("last_line"))


@query("decimate", f"WITH {EVENTS_SQL} SELECT event_id, sec FROM e WHERE CAST(floor(sec / 60) AS BIGINT) % 10 = 0")
def _(spark, sf):
    """Read an item only every tenth collect interval."""
    return decimate(_stamped(spark, sf), 10, 60).select("event_id", F.unix_seconds("collected_at").alias("sec"))


@query(
    "extract_at_item_rates",
    T_SQL + _MD + " SELECT 'md_stats' AS measurement, fs_name, mdt_index, optype, day, n::DOUBLE AS value FROM m"
    f" WHERE (day / {DAY}) % (CASE optype WHEN 'open' THEN 3 WHEN 'close' THEN 2 ELSE 1 END) = 0",
)
def _(spark, sf):
    """Items of one file read at different rates: every third day, every second day, every day."""
    points = extract(_md_files(spark, sf), lustre.definition("2.5"), every={"md_stats_open": 3, "md_stats_close": 2}, interval=DAY)
    return flat(points, ["fs_name", "mdt_index", "optype"])


@query(
    "extract_with_math",
    T_SQL + _CAPACITY + " SELECT 'server/' || fs_name || '-' || ost_index || '-kbytesinfo/gauge-' || kind AS path, day, v::DOUBLE AS value"
    " FROM (SELECT *, 'kbytestotal' AS kind, total AS v FROM c UNION ALL SELECT *, 'kbytesfree', free FROM c UNION ALL SELECT *, 'kbytesused', total - free FROM c)",
)
def _(spark, sf):
    """Points as they are in the text and those derived from them, all named by their identifier."""
    d, path = lustre.definition("2.12"), f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    write_points(extract(_capacity_files(spark, sf), d), path)
    out = with_math(read_points(spark, path), d.math)
    return out.select(metric_path(out).alias("path"), F.unix_seconds("ts").alias("day"), "value")
