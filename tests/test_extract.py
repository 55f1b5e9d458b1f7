import datetime as dt
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from texts import bulk_file, counter_file, disk_report, mdt_jobs, ost_jobs, quota_file, timed_file

from tallyflow.definitions import burst_buffer, disk_array, gpfs, infiniband, lustre
from tallyflow.functions.tags import PROCNAME_UID
from tallyflow.model import SNAPSHOT_SCHEMA
from tallyflow.operators import extract as E
from tallyflow.operators.dispatch import plain_numbers
from tallyflow.session import tune
from tallyflow.sources.points import metric_path

AT = dt.datetime(2024, 1, 1)


def snapshots(spark, files, extra=None):
    rows = [("node1", path, AT, content, extra or {}) for path, content in files.items()]
    return spark.createDataFrame(rows, SNAPSHOT_SCHEMA)


def values(points, measurement, *tags):
    """{tag values: value} of one measurement."""
    rows = points.where(F.col("measurement") == measurement).collect()
    out = {}
    for r in rows:
        key = tuple(r.tags.get(t) for t in tags)
        key = key[0] if len(key) == 1 else key
        assert key not in out, f"two points for {measurement} {key}"
        out[key] = r.value
    return out


MD = "/proc/fs/lustre/mdt/lustre-MDT0000"
OST = "/proc/fs/lustre/obdfilter/scratch-OST0012"
MD_COUNTS = dict(open=1303, close=1108, mknod=4, link=2, unlink=1111111, mkdir=53, rmdir=33, rename=42, getattr=1607,
                 setattr=61, getxattr=33, setxattr=1, statfs=31, sync=4, samedir_rename=42, crossdir_rename=11)


def test_counter_lines_quota_and_single_numbers(spark):
    files = {
        f"{MD}/md_stats": counter_file(MD_COUNTS),
        "/proc/fs/lustre/osd-ldiskfs/lustre-MDT0000/quota_slave/acct_user": quota_file({"0": (238, 1388), "500": (2, 0)}),
        "/proc/fs/lustre/lod/testfs-MDT0000-mdtlov/filestotal": "1000\n",
        "/proc/fs/lustre/unrelated/file": "open 5 samples [reqs]",
    }
    p = E.extract(snapshots(spark, files), lustre.definition("2.5")).cache()
    assert values(p, "md_stats", "optype") == {k: float(v) for k, v in MD_COUNTS.items()}
    quota = values(p, "mdt_acctuser_samples", "user_id", "optype")
    assert quota == {("0", "usage_inodes"): 238, ("0", "usage_kbytes"): 1388,
                     ("500", "usage_inodes"): 2, ("500", "usage_kbytes"): 0}
    assert values(p, "mdt_filesinfo_total", "fs_name", "mdt_index") == {("testfs", "MDT0000"): 1000}
    paths = {r.p: r.value for r in p.select(metric_path(p).alias("p"), "value").collect()}
    assert paths["node1/lustre-MDT0000-md_stats/derive-open"] == 1303
    assert paths["node1/lustre-MDT0000-acctuser_500/gauge-usage_inodes"] == 2
    assert {r.ds_type for r in p.where("measurement = 'md_stats'").collect()} == {"derive"}


def test_job_records(spark):
    ops = dict(zip(lustre.MD_OPS + lustre.RENAME_OPS, range(1, 17)))
    ops |= {"open": 2116165, "statfs": 11814475}
    ost = {"read_bytes": (13666, 1048576, 2097152, 14330888192), "write_bytes": (4168, 140, 16777216, 67455942796)}
    ost |= {op: i for i, op in enumerate(lustre.OST_JOB_OPS)}
    files = {
        f"{MD}/job_stats": mdt_jobs({"root": ops, "dd.500": {k: v + 1 for k, v in ops.items()}}),
        f"{OST}/job_stats": ost_jobs({"root": ost, "dd.500": ost}),
    }
    p = E.extract(snapshots(spark, files), lustre.definition("ieel-2.7")).cache()
    mdt = values(p, "mdt_jobstats_samples", "job_id", "optype")
    assert mdt[("root", "open")] == 2116165 and mdt[("dd.500", "statfs")] == 11814476
    assert len(mdt) == 32
    size = values(p, "ost_jobstats_bytes", "job_id", "optype")
    assert size[("root", "sum_read_bytes")] == 14330888192
    assert size[("dd.500", "sum_write_bytes")] == 67455942796
    assert size[("root", "min_write_bytes")] == 140
    count = values(p, "ost_jobstats_samples", "job_id", "optype")
    assert count[("root", "write_samples")] == 4168 and count[("root", "quotactl")] == 9
    assert {r.first_value for r in p.collect()} == {0.0}
    kinds = {(r.tags["optype"], r.ds_type) for r in E.as_gauges(p).where("measurement = 'ost_jobstats_bytes'").collect()}
    assert ("min_read_bytes", "gauge") in kinds and ("sum_read_bytes", "derive") in kinds


def test_rules_fields_and_owner(spark):
    ost = {"read_bytes": (5, 1, 2, 900), "write_bytes": (4, 1, 2, 5000)} | {op: 0 for op in lustre.OST_JOB_OPS}
    big = ost | {"read_bytes": (5, 1, 2, 90000)}
    files = {f"{OST}/job_stats": ost_jobs({"dd.1": ost, "dd.2": big, "iozone.3": ost, "cp.4": ost})}
    snap = snapshots(spark, files)
    d = lustre.definition("2.12")
    rules = {"ost_jobstats": [
        [("job_id", "dd[.][[:digit:]]+"), ("sum_read_bytes", r"^[1-9]\d{3,}")],
        [("job_id", "iozone[.][[:digit:]]+")],
    ]}
    owner = E.ExtendedParse("ost_jobstats", "job_id", r"^(.+)[.]([0-9]+)$", ("procname", "uid"))
    p = E.extract(snap, d, rules=rules, drop_fields=["min_read_bytes", "statfs"], extended=[owner])
    assert values(p, "ost_jobstats_bytes", "job_id", "procname", "uid", "optype") == {
        (j, j.split(".")[0], j.split(".")[1], f"{w}_{rw}_bytes"): float(v)
        for j, s in (("dd.2", big), ("iozone.3", ost))
        for rw in ("read", "write")
        for w, v in zip(("min", "max", "sum"), s[f"{rw}_bytes"][1:])
        if (w, rw) != ("min", "read")
    }
    assert "statfs" not in {r.field for r in p.collect()}
    renamed = E.ExtendedParse("ost_jobstats", "job_id", owner.pattern, owner.names, "who=${extendfield:uid}")
    q = E.extract(snap, d, extended=[renamed])
    assert {r.tags["who"] for r in q.collect()} == {"1", "2", "3", "4"}
    plain = E.extract(snapshots(spark, {f"{OST}/job_stats": ost_jobs({"nodot": ost})}), d, extended=[owner])
    assert {r.tags.get("uid") for r in plain.collect()} == {None}


def test_selecting_items_prunes_the_plan(spark):
    d = lustre.definition("2.12").select(["md_stats_open", "md_stats_unlink"])
    p = E.extract(snapshots(spark, {f"{MD}/md_stats": counter_file(MD_COUNTS)}), d)
    assert values(p, "md_stats", "optype") == {"open": 1303, "unlink": 1111111}
    with pytest.raises(ValueError):
        d.select(["nothing"])
    assert not any(n.startswith("exp_") for n in lustre.definition("2.12").item_names())


def test_bulk_histograms_stay_in_their_section(spark):
    text = bulk_file({
        "pages per bulk r/w   ": {"1": (10, 50, 50, 3, 30, 30), "256": (10, 50, 100, 7, 70, 100)},
        "discontiguous pages  ": {"0": (20, 100, 100, 10, 100, 100)},
        "disk I/O size        ": {"4K": (1, 5, 5, 2, 20, 20), "1M": (19, 95, 100, 8, 80, 100)},
    })
    p = E.extract(
        snapshots(spark, {"/proc/fs/lustre/osd-ldiskfs/scratch-OST0001/brw_stats": text}), lustre.definition("2.12")
    ).cache()
    assert values(p, "ost_brw_stats_rpc_bulk_samples", "size", "field") == {
        ("1_pages", "read_sample"): 10, ("1_pages", "write_sample"): 3,
        ("256_pages", "read_sample"): 10, ("256_pages", "write_sample"): 7}
    assert values(p, "ost_brw_stats_io_size_cum", "size", "field")[("1M_Bytes", "write_cum")] == 100
    assert values(p, "ost_brw_stats_page_discontiguous_rpc_percentage", "size", "field") == {
        ("0_pages", "read_percentage"): 100, ("0_pages", "write_percentage"): 100}


def test_exports_services_recovery_locks_clients(spark):
    service = timed_file({"req_waittime": (10, 1, 9, 50, 300), "mds_getattr": (4, 2, 3, 10, 26)}, "usec")
    service += timed_file({"req_qdepth": (10, 0, 2, 5, 7)}, "reqs")
    pool = "snapshot_time             1420966209.2 secs.usecs\n" + "".join(
        f"{n:<25} 1 samples [{u}] {i} {i} {i}\n" for i, (n, u) in enumerate(lustre.LOCK_POOL_UNITS.items()))
    recovery = "status: COMPLETE\nrecovery_start: 1500\nrecovery_duration: 12\ncompleted_clients: 3/4\nevicted_clients: 1\n"
    debug, sysfs = "/sys/kernel/debug/lustre", "/sys/fs/lustre"
    files = {
        f"{OST}/exports/10.0.0.1@tcp/stats":
            "read_bytes                7 samples [bytes] 4096 8192 40960\n" + counter_file({"punch": 3}),
        f"{MD}/exports/10.0.0.2@o2ib/stats": counter_file({"open": 5, "rename": 1, "samedir_rename": 9}),
        f"{MD}/recovery_status": recovery,
        f"{debug}/mds/MDS/mdt/stats": service,
        f"{debug}/mds/MDS/mdt_out/threads_max": "16\n",
        f"{debug}/ldlm/namespaces/filter-scratch-OST0012_UUID/pool/stats": pool,
        f"{sysfs}/ldlm/namespaces/mdt-lustre-MDT0000_UUID/lock_count": "77\n",
        f"{debug}/llite/scratch-ffff8800/stats":
            "read_bytes 3 samples [bytes] 1 2 9\nopen 4 samples [usec] 1 5 12\nioctl 8 samples [reqs]\n",
        "/proc/fs/lustre/mdc/lustre-MDT0001-mdc-ffff8800/max_rpcs_in_flight": "8\n",
    }
    p = E.extract(snapshots(spark, files), lustre.definition("es5_1", per_client=True)).cache()
    assert values(p, "exp_ost_stats_bytes", "exp_client", "exp_type", "optype") == {("10.0.0.1", "tcp", "read"): 40960}
    assert values(p, "exp_ost_stats_samples", "optype") == {"read": 7, "punch": 3}
    assert values(p, "exp_md_stats", "exp_client", "optype") == {
        ("10.0.0.2", "open"): 5, ("10.0.0.2", "rename"): 1, ("10.0.0.2", "samedir_rename"): 9}
    assert values(p, "mdt_recovery_status", "optype") == {
        "recovery_start": 1500, "recovery_duration": 12, "evicted_clients": 1,
        "connected_clients": 3, "recoverable_clients": 4}
    one = lambda m: list(values(p, m, "none").values())
    assert one("mdt_stats_req_waittime_sum") == [50] and one("mdt_stats_mds_getattr_sum_square") == [26]
    assert one("mdt_stats_req_qdepth_max") == [2] and one("mds_thread_max") == [16]
    assert values(p, "ldlm_stats", "optype")["recalc_timing"] == 8
    assert values(p, "mdt_lock_count", "fs_name", "mdt_index") == {("lustre", "MDT0000"): 77}
    assert one("client_stats_open_sum") == [12] and one("client_stats_ioctl_samples") == [8]
    assert values(p, "max_rpcs_in_flight", "mdt_index") == {"MDT0001": 8}
    assert {r.interval_gauge for r in p.where("plugin_instance = 'client_stats'").collect()} == {True}


def test_timed_release(spark):
    md = timed_file({"open": (5, 1, 2, 9, 21), "samedir_rename": (1, 1, 1, 1, 1), "rename": (2, 3, 4, 7, 25)})
    jobs = {"root": {op: (1, 2, 3, 4, 5) for op in lustre.MD_OPS + lustre.PARALLEL_RENAME_OPS}}
    text = "job_stats:\n- job_id:          root\n  snapshot_time:   1\n" + "".join(
        f"  {op}: {{ samples: {v[0]}, unit: usecs, min: {v[1]}, max: {v[2]}, sum: {v[3]}, sumsq: {v[4]} }}\n"
        for op, v in jobs["root"].items())
    p = E.extract(snapshots(spark, {f"{MD}/md_stats": md, f"{MD}/job_stats": text}), lustre.definition("es6_0")).cache()
    assert values(p, "md_stats", "optype") == {"open": 5, "rename": 2}
    assert values(p, "md_stats_sumsq", "optype") == {"open": 21, "rename": 25}
    assert values(p, "mdt_jobstats_sumsq", "optype")["parallel_rename_dir"] == 5
    assert len(values(p, "mdt_jobstats_samples", "optype")) == 18


def test_disk_reports(spark):
    zeros = lambda n: [0] * n
    text = disk_report(
        "Virtual",
        {"0": ([3753, 15012, 4, 0, 0, 15012, 0], zeros(7)), "1": (zeros(7), [3622, 14488, 4, 0, 0, 14485, 3])},
        {"Read": {"0": [0, 4639] + zeros(11), "1": [0, 4455] + zeros(11)}, "Write": {"0": zeros(13), "1": [0, 1] + zeros(11)}},
        {"Read": {"0": [4650] + zeros(11)}, "Write": {"1": [1] + zeros(11)}},
        depths=[{"0": [3091, 1309] + zeros(9)}, {"0": [7379033] + zeros(10)}],
    )
    p = E.extract(snapshots(spark, {"show vd c all": text}, {"extrahost": "array1"}), disk_array.definition("11.0")).cache()
    rate = values(p, "vd_rate", "disk_index", "controller", "type")
    assert rate[("0", "0", "iops")] == 3753 and rate[("1", "1", "R_KiBps")] == 14485 and len(rate) == 28
    latency = values(p, "vd_latency", "type", "disk_index", "latency")
    assert latency[("read", "0", "le16ms")] == 4639 and latency[("read", "1", "le16ms")] == 4455
    assert latency[("write", "1", "le16ms")] == 1 and len(latency) == 52
    size = values(p, "vd_iosize", "type", "disk_index", "iosize")
    assert size[("read", "0", "le4KiB")] == 4650 and size[("write", "1", "le4KiB")] == 1 and len(size) == 24
    depth = values(p, "vd_qdepth", "controller", "disk_index", "qdepth")
    assert depth[("0", "0", "2")] == 1309 and depth[("1", "0", "1")] == 7379033 and len(depth) == 22
    assert {r.host for r in p.collect()} == {"array1"}
    first = p.where("measurement = 'vd_rate' and field = 'controller0_iops'").select(metric_path(p)).first()[0]
    assert first.startswith("array1/vd_rate_") and first.endswith("-controller0/gauge-iops")

    newer = disk_report(
        "Physical",
        {"851": ([443, 15343, 34, 0, 0, 1336, 14006, 9], zeros(8))},
        {rw: {"851": zeros(13)} for rw in ("Read", "Write")},
        {rw: {"851": zeros(12)} for rw in ("Read", "Write")},
        unmap={"851": ((5, 6), (7, 8))},
    )
    q = E.extract(snapshots(spark, {"show pd c all": newer}), disk_array.definition("11.6")).cache()
    assert values(q, "pd_rate", "controller", "type")[("0", "Unmap_KiBps")] == 9
    assert values(q, "pd_unmap", "controller", "type") == {
        ("0", "count"): 5, ("0", "blocks"): 6, ("1", "count"): 7, ("1", "blocks"): 8}


def test_burst_buffer(spark):
    devices = (
        "Data was produced by PID 1 at Fri Apr 26 21:59:49 2019\n"
        + "\n".join(f"{label + ':':<17} {i}" for i, label in enumerate(burst_buffer.FILE_LABELS["1.2"], start=100))
        + "\n\n| ID |        NAME       |  ...\n"
        "|  0 |   //dev/md/cmtlog |      13 |     141 |    0.3 |       3 |     144 |    7.9 |       0 |       0 |  99.13 |     Device is OK |\n"
        "| 10 |   /dev/nvme17 |       0 |       0 |    0.0 |       0 |       0 |    0.0 |       5 |       6 |  97.79 |     Device is OK |\n"
    )
    usage = (
        "\tMin Free Space Ratio   = 5\n\tSync Threshold         = 40\n"
        "\t       359860273152 |    19203738304512 |           98.13 |  98.96 |   2.28 | - |\n"
        "\t              0 |                     1 |      37579655332 |                  2 |\n"
        "\t        63558 |          556 |         4467 |              109 |              3 |\n"
    )
    one, two = burst_buffer.COMMANDS["1.2"]
    p = E.extract(snapshots(spark, {one: devices, two: usage}), burst_buffer.definition("1.2")).cache()
    assert values(p, "ime_nvm_write_MBs", "device", "rw") == {("0", "write"): 7, ("10", "write"): 0}
    assert values(p, "ime_nvm_free", "device", "rw") == {("0", None): 99, ("10", None): 97}
    got = {m: v for m in ("ime_bfs_read_bytes", "ime_bfs_ns_multi_errors", "ime_Cap_Total", "ime_PCT_Free",
                          "ime_AppsHeapRsvd", "ime_DM_Clean", "ime_FBS_pinned", "ime_UM_FlushThresholdRatio")
           for v in values(p, m, "none").values()}
    assert got == {"ime_bfs_read_bytes": 100, "ime_bfs_ns_multi_errors": 117, "ime_Cap_Total": 19203738304512,
                   "ime_PCT_Free": 98, "ime_AppsHeapRsvd": 2, "ime_DM_Clean": 37579655332, "ime_FBS_pinned": 3,
                   "ime_UM_FlushThresholdRatio": 40}
    assert {r.host for r in p.collect()} == {"ime_node1"}

    old = (
        "\tMinFreeSpaceRatio   = 15\n\tFlushThresholdRatio = 40\n"
        "\t          681836544 |    19203738304512 |            99.996449 |\n"
        "\t              0 |                     0 |        681782264 |                  0 |\n"
        "\t            0 |            0 |           81 |                1 |              0 |\n"
    )
    q = E.extract(snapshots(spark, {burst_buffer.COMMANDS["1.1"][1]: old}), burst_buffer.definition("1.1"))
    assert list(values(q, "ime_FBS_FullClean", "none").values()) == [81]


def test_gpfs_and_infiniband(spark):
    head = "_n_ 10.0.0.1 _nn_ node1 _rc_ 0 _t_ 1066660148 _tu_ 407431"
    io = f"_fs_io_s_ {head} _cl_ c1 _fs_ gpfs1 _d_ 2 _br_ 6291456 _bw_ 314572800 _oc_ 10 _cc_ 16 _rdc_ 101 _wc_ 300 _dir_ 7 _iu_ 2\n"
    rhist = (
        f"_rhist_ {head.replace('_rc_', '_req_ s _rc_')} _k_ r\n_R_ 0 255 _NR_ 5\n_L_ 0.0 1.0 _NL_ 3\n_R_ 256 511 _NR_ 6\n"
        f"_rhist_ {head.replace('_rc_', '_req_ s _rc_')} _k_ w\n_R_ 0 255 _NR_ 9\n_L_ 1.1 10.0 _NL_ 4\n_end_\n"
    )
    p = E.extract(
        snapshots(spark, {"fs_io_s": io, "io_s": io.replace("_fs_io_s_", "_io_s_").replace("_cl_ c1 _fs_ gpfs1 _d_ 2 ", ""),
                          gpfs.HISTOGRAM_COMMAND: rhist}),
        gpfs.definition(),
    ).cache()
    assert values(p, "fs_io_bytes", "fs_name", "cluster", "optype") == {
        ("gpfs1", "c1", "read"): 6291456, ("gpfs1", "c1", "write"): 314572800}
    assert values(p, "io_count", "optype")["inode_update"] == 2
    assert values(p, "rhist_request_size_number", "optype", "extent") == {
        ("read", "0_to_255"): 5, ("read", "256_to_511"): 6, ("write", "0_to_255"): 9}
    assert values(p, "rhist_request_latency_number", "optype", "extent") == {
        ("read", "0.0_to_1.0"): 3, ("write", "1.1_to_10.0"): 4}

    files = {f"/sys/class/infiniband/mlx5_0/ports/{n}/counters/port_rcv_data": f"{n}00\n" for n in (1, 2)}
    q = E.extract(snapshots(spark, files), infiniband.definition())
    assert values(q, "port_rcv_data", "driver_type", "driver_index", "port_number") == {
        ("mlx5", "0", "1"): 100, ("mlx5", "0", "2"): 200}


def test_mixed_versions_in_one_scan(spark):
    rows = [
        ("old", f"{MD}/md_stats", AT, counter_file({"open": 1, "samedir_rename": 2}), {}, "2.5"),
        ("mid", f"{MD}/md_stats", AT, counter_file({"open": 3, "samedir_rename": 4}), {}, "2.12"),
        ("new", f"{MD}/md_stats", AT, timed_file({"open": (5, 1, 2, 3, 4)}), {}, "es6_0"),
        ("none", f"{MD}/md_stats", AT, counter_file({"open": 9}), {}, "other"),
    ]
    snap = spark.createDataFrame(rows, StructType([*SNAPSHOT_SCHEMA, StructField("version", StringType())]))
    catalogs = {v: lustre.definition(v) for v in lustre.RELEASES}
    p = E.extract(snap, catalogs)
    got = {(r.host, r.measurement, r.tags["optype"]): r.value for r in p.collect()}
    assert got[("old", "md_stats", "samedir_rename")] == 2 and ("mid", "md_stats", "samedir_rename") not in got
    assert got[("new", "md_stats_sum", "open")] == 3 and not any(k[0] == "none" for k in got)
    plan = E.extract(snap, catalogs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") - plan.count("LocalTableScan") == 1  # the catalog's own tables are local


def test_decimation_and_stale_output(spark):
    rows = [("n", "p", AT + dt.timedelta(seconds=60 * i), f"node1: Data was produced by PID 1 at Mon Jan  1 00:00:30 2024\nnode1: x 5", {}) for i in range(6)]
    snap = spark.createDataFrame(rows, SNAPSHOT_SCHEMA)
    assert E.decimate(snap, 3).count() == 2
    kept = E.drop_stale(snap).orderBy("collected_at").collect()
    assert [r.collected_at.minute for r in kept] == [0, 1]
    assert kept[0].content.splitlines()[1].split() == ["x", "5"]


def test_path_starts_reach_the_scan(spark, tmp_path):
    files = {f"{MD}/md_stats": counter_file(MD_COUNTS), "/etc/passwd": "x"}
    snapshots(spark, files).write.parquet(str(tmp_path / "s"))
    p = E.extract(spark.read.parquet(str(tmp_path / "s")), lustre.definition("2.12").select(["md_stats_open"]))
    assert "StringStartsWith(path,/proc/fs/lustre/mdt/)" in p._jdf.queryExecution().executedPlan().toString()
    assert [r.value for r in p.collect()] == [1303]


def test_match_path(spark):
    snap = snapshots(spark, {f"{OST}/exports/a-b@tcp1/stats": "", "/etc/passwd": ""})
    rows = E.match_path(snap, lustre.definition("2.12", per_client=True)).collect()
    assert [r.path_tags for r in rows] == [
        {"fs_name": "scratch", "ost_index": "OST0012", "ost_exp_client": "a-b", "ost_exp_type": "tcp1"}]


def test_items_at_different_rates(spark):
    text = counter_file({"open": 1, "close": 2, "mknod": 3})
    other = counter_file({"getattr": 4}, "reqs")
    rows = [("n", path, AT + dt.timedelta(seconds=60 * i), content, {}) for i in range(12)
            for path, content in ((f"{MD}/md_stats", text), (f"{OST}/stats", other))]
    snap = spark.createDataFrame(rows, SNAPSHOT_SCHEMA)
    every = {"md_stats_open": 3, "md_stats_mknod": 4}
    p = E.extract(snap, lustre.definition("2.5"), every=every)
    seen = {}
    for r in p.collect():
        seen.setdefault((r.measurement, r.tags["optype"]), []).append((r.ts - AT).seconds // 60)
    seen = {k: sorted(v) for k, v in seen.items()}
    assert seen[("md_stats", "open")] == [0, 3, 6, 9] and seen[("md_stats", "mknod")] == [0, 4, 8]
    assert seen[("md_stats", "close")] == seen[("ost_stats_samples", "getattr")] == list(range(12))
    with pytest.raises(ValueError, match="unknown items"):
        E.extract(snap, lustre.definition("2.5"), every={"no_such_item": 2})


def test_the_tree_finds_every_path_and_only_those(spark):
    for release in lustre.RELEASES:
        definition = lustre.definition(release, per_client=True)
        made = {"fs_name": "fs1", "mdt_index": "MDT000a", "ost_index": "OST0001", "mdc_tag": "mdc-x", "client_uuid": "ffff"}
        paths = []
        for e in definition.entries:
            path = e.path
            for v in e.variables:
                path = path.replace(f"{{{v}}}", made.get(v, "x1" if "client" in v else "tcp"))
            paths.append(path)
        wrong = [p + "/more" for p in paths] + ["/x" + p for p in paths] + [p.rsplit("/", 1)[0] for p in paths]
        snap = spark.createDataFrame([("n", p, AT, "", {}) for p in paths + wrong], SNAPSHOT_SCHEMA)
        regexes = [re.compile(e.regex) for e in definition.entries]
        want = sorted(p for p in paths + wrong if any(r.match(p) for r in regexes))
        assert sorted(r.path for r in E.match_path(snap, definition).collect()) == want


def test_groups_of_digits():
    assert plain_numbers(r"^(a|b) +([0-9]+) \(([0-9]+)\) [(]([0-9.]+)(?:([0-9]+))") == {2, 3, 5}


def test_no_lambda_and_no_codegen_failure_in_the_hot_path(spark):
    snap = snapshots(spark, {f"{MD}/md_stats": counter_file({"open": 1})})
    plan = E.extract(snap, lustre.definition("2.12"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def path_of(template, **made):
    for name, value in {"fs_name": "fs1", "mdt_index": "MDT0003", "ost_index": "OST0007", **made}.items():
        template = template.replace(f"{{{name}}}", value)
    return template


@pytest.mark.parametrize("release", sorted(lustre.RELEASES))
def test_every_release_reads_its_own_files(spark, release):
    """Counter lines, histograms, quota and single numbers where and as each release writes them."""
    r, d = lustre.RELEASES[release], lustre.definition(release)
    entries = {e.path: e for e in d.entries}
    ops = {op: 10 + k for k, op in enumerate(r.md_ops)}
    timed = {op: (n, 1, 9, 5 * n, 25 * n) for op, n in ops.items()}
    files = {path_of(r.md_stats): timed_file(timed) if r.timed else counter_file(ops)}
    stats = next(p for p in entries if p.endswith("/stats") and "obdfilter" in p and "exports" not in p)
    ost_ops = {op: 20 + k for k, op in enumerate(lustre.OST_OPS)}
    bytes_lines = "read_bytes                7 samples [bytes] 4096 1048576 70\nwrite_bytes               8 samples [bytes] 4096 1048576 80\n"
    timed_ops = {op: (n, 1, 9, 5 * n, 25 * n) for op, n in ost_ops.items()}
    files[path_of(stats)] = (timed_file(timed_ops) if r.timed else counter_file(ost_ops)) + bytes_lines
    kind = "block_discontiguous_rpc"
    rows = {"1": (5, 50, 50, 6, 60, 60), "4K": (7, 50, 100, 8, 40, 100)}
    files[path_of(r.bulk)] = bulk_file({"pages per bulk r/w": rows, "discontiguous blocks": rows})
    quota = [(p, e) for p, e in entries.items() if p.endswith("acct_user")]
    for k, (p, _) in enumerate(quota):
        files[path_of(p)] = quota_file({"0": (k + 1, k + 100), "500": (2, 3)})
    numbers = {p: 1000 + k for k, p in enumerate(p for p, e in entries.items() if e.items[0].pattern == "(.+)" and {*e.variables} <= {"fs_name", "mdt_index", "ost_index"})}
    files |= {path_of(p): f"{n}\n" for p, n in numbers.items()}
    out = E.extract(snapshots(spark, files), d).cache()

    assert values(out, "md_stats", "optype") == ops
    if r.timed:
        assert values(out, "md_stats_sum", "optype") == {op: 5 * n for op, n in ops.items()}
        assert values(out, "ost_stats_max_latency", "optype") == {op: 9 for op in ost_ops}
    assert values(out, "ost_stats_samples", "optype") == {**ost_ops, "read": 7, "write": 8}
    assert values(out, "ost_stats_bytes", "optype") == {"read": 70, "write": 80}
    pages = values(out, "ost_brw_stats_rpc_bulk_samples", "field", "size")
    assert pages == {("read_sample", "1_pages"): 5, ("write_sample", "1_pages"): 6, ("read_sample", "4K_pages"): 7, ("write_sample", "4K_pages"): 8}
    name, unit = ("blk_discontiguous_rpc", "blks") if r.old_block_names else (kind, "blocks")
    shares = values(out, f"ost_brw_stats_{name}_percentage", "field", "size")
    assert shares[("write_percentage", f"4K_{unit}")] == 40 and len(shares) == 4
    seen = {(row.measurement, row.tags["user_id"], row.tags["optype"], row.value) for row in out.where("measurement LIKE '%acctuser%'").collect()}
    assert len(seen) >= (6 if len(quota) >= 2 else 4 if quota else 0)
    got = sorted(row.value for row in out.where("field NOT LIKE '%usage%' AND value >= 1000").collect())
    assert got == sorted(float(n) for n in numbers.values())


@pytest.mark.parametrize("version", sorted(disk_array.RELEASES))
def test_every_disk_array_release_reads_its_report(spark, version):
    zeros = lambda n: [0] * n
    wide = version == "11.6"
    text = disk_report(
        "Physical",
        {"5": ([9, 18, 2, 0, 0, 12, 6] + [1] * wide, zeros(7 + wide))},
        {rw: {"5": [3] + zeros(12)} for rw in ("Read", "Write")},
        {rw: {"5": zeros(11) + [4]} for rw in ("Read", "Write")},
        unmap={"5": ((5, 6), (7, 8))} if wide else None,
    )
    p = E.extract(snapshots(spark, {"show pd c all": text}), disk_array.definition(version)).cache()
    rate = values(p, "pd_rate", "controller", "type")
    assert rate[("0", "iops")] == 9 and rate[("0", "W_KiBps")] == 6 and rate[("1", "R_KiBps")] == 0
    assert values(p, "pd_latency", "type", "latency")[("write", "avg")] == 3
    assert values(p, "pd_iosize", "type", "iosize")[("read", "gt4MiB")] == 4


def test_extended_tags_are_read_once_for_each_record(spark):
    """They used to be read for each of a record's points, above the join that makes these."""
    snaps = spark.createDataFrame([("h", "/x", None, "c")], "host string, path string, collected_at timestamp, content string")
    owner = E.ExtendedParse("ost_jobstats", "job_id", PROCNAME_UID, ("procname", "uid"))
    plan = E.extract(snaps, lustre.definition("2.12"), extended=[owner])._jdf.queryExecution().optimizedPlan().toString()
    assert PROCNAME_UID in plan and PROCNAME_UID not in plan[: plan.index("Join")]


def test_tuned_sessions_leave_no_method_too_long_to_be_compiled(spark):
    assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
