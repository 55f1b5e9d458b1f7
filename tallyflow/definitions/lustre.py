"""Lustre statistics files, per release.

Releases differ in where a file lives, in which operations it lists and in
whether an operation line carries latency columns, so a release is a set of
choices (``Release``) and the definition is built from them.

Patterns are anchored to the start of a line: unanchored, ``rename`` would also
read ``samedir_rename`` and ``link`` would also read ``unlink``.
"""

from __future__ import annotations

from dataclasses import dataclass

from tallyflow.definitions import KEYS, Definition, Entry, Field, Item, MathEntry, Section

# ---------------------------------------------------------------------------
# Operation names, units, headers and roots as the files have them.
MD_OPS = (
    "open", "close", "mknod", "link", "unlink", "mkdir", "rmdir", "rename",
    "getattr", "setattr", "getxattr", "setxattr", "statfs", "sync",
)
RENAME_OPS = ("samedir_rename", "crossdir_rename")
PARALLEL_RENAME_OPS = ("samedir_rename", "parallel_rename_file", "parallel_rename_dir", "crossdir_rename")
OST_OPS = (
    "getattr", "setattr", "punch", "sync", "destroy", "create",
    "statfs", "get_info", "set_info_async", "quotactl",
)
EXPORT_OST_OPS = OST_OPS[:-1]
OST_JOB_OPS = (
    "getattr", "setattr", "punch", "sync", "destroy", "create",
    "statfs", "get_info", "set_info", "quotactl",
)
OST_JOB_OPS_SHORT = ("setattr", "punch", "sync")
CACHE_OPS = {"get_page": "usec", "cache_access": "pages", "cache_hit": "pages", "cache_miss": "pages"}

BULK_SECTIONS = {
    "rpc_bulk": ("pages per bulk", "pages"),
    "page_discontiguous_rpc": ("discontiguous pages", "pages"),
    "block_discontiguous_rpc": ("discontiguous blocks", "blocks"),
    "fragmented_io": ("disk fragmented", "fragments"),
    "io_in_flight": ("disk I/Os", "ios"),
    "io_time": ("I/O time", "milliseconds"),
    "io_size": ("disk I/O size", "Bytes"),
}

RECOVERY_NUMBERS = (
    "recovery_start", "recovery_duration", "replayed_requests", "last_transno", "time_remaining",
    "req_replay_clients", "lock_replay_clients", "evicted_clients", "queued_requests", "next_transno",
)
RECOVERY_PAIRS = ("completed_clients", "connected_clients")

QUEUE_STATS = {
    "usec": ("req_waittime",),
    "reqs": ("req_qdepth", "req_active"),
    "sec": ("req_timeout",),
    "bufs": ("reqbuf_avail",),
}
#: service -> (folder, requests timed there by unit)
SERVICES = {
    "mdt": (
        "mds/MDS/mdt",
        {
            "usec": ("mds_getattr", "mds_connect", "mds_get_root", "mds_statfs", "mds_getxattr", "obd_ping"),
            "reqs": ("ldlm_ibits_enqueue",),
        },
    ),
    "mdt_readpage": ("mds/MDS/mdt_readpage", {"usec": ("mds_close", "mds_readpage")}),
    "mdt_setattr": ("mds/MDS/mdt_setattr", {}),
    "mdt_fld": ("mds/MDS/mdt_fld", {}),
    "mdt_out": ("mds/MDS/mdt_out", {}),
    "mdt_seqm": ("mds/MDS/mdt_seqm", {}),
    "mdt_seqs": ("mds/MDS/mdt_seqs", {}),
    "ost": ("ost/OSS/ost", {}),
    "ost_io": ("ost/OSS/ost_io", {"usec": ("ost_read", "ost_write", "ost_punch")}),
    "ost_create": ("ost/OSS/ost_create", {}),
    "ost_seq": ("ost/OSS/ost_seq", {}),
    "ldlm_canceld": ("ldlm/services/ldlm_canceld", {}),
    "ldlm_cbd": ("ldlm/services/ldlm_cbd", {}),
}
#: service -> (measurement prefix, plugin, plugin instance) of its thread counts
THREADS = {
    "mdt": ("mds", "mds", "normal_metadata_ops"),
    "mdt_readpage": ("mds", "mds", "readpage"),
    "mdt_setattr": ("mds", "mds", "setattr_service"),
    "mdt_fld": ("mds", "mds", "fld_service"),
    "mdt_out": ("mds", "mds", "metadata_out_service"),
    "mdt_seqm": ("mds", "mds", "metadata_seqm_service"),
    "mdt_seqs": ("mds", "mds", "metadata_seqs_service"),
    "ost": ("ost", "ost", "normal_data"),
    "ost_io": ("ost_io", "ost", "bulk_data_IO"),
    "ost_create": ("ost_create", "ost", "obj_pre-creation_service"),
    "ost_seq": ("ost_seq", "ost", "seq_service"),
    "ldlm_canceld": ("ldlm_cancel", "ldlm_service", "lock_cancel"),
    "ldlm_cbd": ("ldlm_cbd", "ldlm_service", "lock_grant"),
}

LOCK_POOL_UNITS = {
    "granted": "locks",
    "grant": "locks",
    "cancel": "locks",
    "grant_rate": "locks/s",
    "cancel_rate": "locks/s",
    "grant_plan": "locks/s",
    "slv": "slv",
    "recalc_freed": "locks",
    "recalc_timing": "sec",
}

CLIENT_BYTES = ("read_bytes", "write_bytes")
CLIENT_TIMED = (
    "read", "write", "open", "close", "mmap", "page_fault", "page_mkwrite", "seek", "fsync", "readdir",
    "setattr", "truncate", "flock", "getattr", "fallocate", "create", "link", "unlink", "symlink", "mkdir",
    "rmdir", "mknod", "rename", "statfs", "setxattr", "getxattr", "listxattr", "removexattr",
    "inode_permission",
)
CLIENT_COUNTED = ("ioctl", "getxattr_hits")

PROC = "/proc/fs/lustre"
SYS = "/sys/fs/lustre"
DEBUG = "/sys/kernel/debug/lustre"

N = "([0-9]+)"
# ---------------------------------------------------------------------------

TARGET = {"mdt": "{fs_name}-{mdt_index}", "ost": "{fs_name}-{ost_index}"}
PLACE = {
    "mdt": "fs_name=${subpath:fs_name} mdt_index=${subpath:mdt_index}",
    "ost": "fs_name=${subpath:fs_name} ost_index=${subpath:ost_index}",
}
PLACE_PLUGIN = {
    "mdt": "${subpath:fs_name}-${subpath:mdt_index}",
    "ost": "${subpath:fs_name}-${subpath:ost_index}",
}
EXPORT_TAGS = {
    k: f"exp_client=${{subpath:{k}_exp_client}} exp_type=${{subpath:{k}_exp_type}} {PLACE[k]}" for k in ("mdt", "ost")
}
EXPORT_PLUGIN = {k: f"${{subpath:{k}_exp_client}}-${{subpath:{k}_exp_type}}" for k in ("mdt", "ost")}
EXPORT_FOLDER = {k: f"exports/{{{k}_exp_client}}@{{{k}_exp_type}}" for k in ("mdt", "ost")}
LATENCY = ("min", "max", "sum", "sumsq")


@dataclass(frozen=True)
class Release:
    """What one release of the file system has, and where."""

    name: str
    md_stats: str = PROC + "/mdt/" + TARGET["mdt"] + "/md_stats"
    md_exports: str = PROC + "/mdt/" + TARGET["mdt"]
    md_ops: tuple[str, ...] = MD_OPS
    timed: bool = False
    capacity: tuple[tuple[str, str], ...] = ()
    quota: tuple[tuple[str, tuple[str, ...]], ...] = ()
    bulk: str = PROC + "/obdfilter/" + TARGET["ost"] + "/brw_stats"
    old_block_names: bool = False
    export_bulk: bool = False
    cache_stats: bool = False
    recovery: bool = True
    mdt_jobs: tuple[str, ...] = MD_OPS + RENAME_OPS
    ost_jobs: str = "full"
    services_root: str = PROC
    ldlm_root: str = PROC
    services: tuple[str, ...] = tuple(SERVICES)
    service_stats: tuple[str, ...] = tuple(SERVICES)
    service_reset: bool = True
    locks_root: str | None = PROC
    pool_root: str | None = None
    client: bool = False
    used_capacity: bool = True


def build(r: Release) -> Definition:
    entries: list[Entry] = []
    for root, target in r.capacity:
        entries += _capacity(root, target)
    for backend, kinds in r.quota:
        entries += [e for target in ("mdt", "ost") for e in _quota(backend, target, kinds)]
    if r.recovery:
        entries += [_recovery("mdt"), _recovery("ost")]
    entries.append(Entry(r.md_stats, (_md_stats(r.md_ops, r.timed),)))
    entries.append(_export_md(r))
    if r.mdt_jobs:
        entries.append(Entry(PROC + "/mdt/" + TARGET["mdt"] + "/job_stats", (_mdt_jobs(r.mdt_jobs, r.timed),)))
    ost = PROC + "/obdfilter/" + TARGET["ost"]
    entries.append(Entry(ost + "/stats", _ost_stats(r)))
    entries.append(Entry(f"{ost}/{EXPORT_FOLDER['ost']}/stats", _export_ost(r.timed)))
    entries.append(Entry(r.bulk, _bulk("ost", r.old_block_names)))
    if r.export_bulk:
        entries.append(Entry(f"{ost}/{EXPORT_FOLDER['ost']}/brw_stats", _bulk("export", r.old_block_names)))
    if r.ost_jobs != "none":
        entries.append(Entry(ost + "/job_stats", (_ost_jobs(r.ost_jobs),)))
    entries.append(_mdc())
    for service in r.services:
        entries += _service(r, service)
    if r.locks_root:
        entries += _locks(r.locks_root, "ost", "filter") + _locks(r.locks_root, "mdt", "mdt")
    if r.pool_root:
        entries.append(_lock_pool(r.pool_root))
    if r.client:
        entries.append(_client())
    return Definition(r.name, tuple(entries), _math(r))


def _single(name: str, measurement: str, *, tags="", plugin="", plugin_instance="", type_instance="", ds_type="gauge"):
    """An item for a file that holds one number."""
    return Item(
        name=name,
        pattern="(.+)",
        captures=("number",),
        fields=(Field(1, type_instance or name, ds_type=ds_type),),
        measurement=measurement,
        tags=tags,
        plugin=plugin,
        plugin_instance=plugin_instance,
    )


def _capacity(root: str, target: str) -> list[Entry]:
    out = []
    for kind, what in (("files", ("total", "free")), ("kbytes", ("total", "free", "avail"))):
        for w in what:
            item = _single(
                f"{target}_{kind}{w}",
                f"{target}_{kind}info_{w}",
                tags=PLACE[target],
                plugin=PLACE_PLUGIN[target],
                plugin_instance=f"{kind}info",
                type_instance=f"{kind}{w}",
            )
            out.append(Entry(f"{root}/{kind}{w}", (item,)))
    return out


def _quota(backend: str, target: str, kinds: tuple[str, ...]) -> list[Entry]:
    prefix = "zfs_" if backend == "osd-zfs" else ""
    return [
        Entry(
            f"{PROC}/{backend}/{TARGET[target]}/quota_slave/acct_{kind}",
            (
                Item(
                    name=f"{prefix}{target}_acct{kind}",
                    pattern=rf"- +id: +(.+)\n  usage: +\{{ inodes: +{N}, kbytes: +{N}.+",
                    captures=("id", "usage_inodes", "usage_kbytes"),
                    fields=(Field(2, "usage_inodes"), Field(3, "usage_kbytes")),
                    measurement=f"{target}_acct{kind}_samples",
                    tags=f"optype=${{field:name}} {PLACE[target]} {kind}_id=${{content:id}}",
                    plugin=PLACE_PLUGIN[target],
                    plugin_instance=f"acct{kind}_${{content:id}}",
                ),
            ),
        )
        for kind in kinds
    ]


def _recovery(target: str) -> Entry:
    folder = "mdt" if target == "mdt" else "obdfilter"
    common = dict(
        measurement=f"{target}_recovery_status",
        tags=f"optype=${{field:name}} {PLACE[target]}",
        plugin=PLACE_PLUGIN[target],
        plugin_instance=f"{target}_recovery_status",
    )
    return Entry(
        f"{PROC}/{folder}/{TARGET[target]}/recovery_status",
        (
            Item(
                name=f"{target}_recovery_status_${{content:what}}",
                pattern=f"^({KEYS}): +{N}",
                captures=("what", "number"),
                fields=(Field(2, "${content:what}"),),
                keys=RECOVERY_NUMBERS,
                **common,
            ),
            Item(
                name=f"{target}_recovery_status_${{content:what}}",
                pattern=f"^({KEYS}): +{N}/{N}",
                captures=("what", "connected_clients", "recoverable_clients"),
                fields=(Field(2, "connected_clients"), Field(3, "recoverable_clients")),
                keys=RECOVERY_PAIRS,
                **common,
            ),
        ),
    )


def _timed_fields(names: tuple[str, ...], first: int) -> tuple[Field, ...]:
    """Sample count and its latency columns; each becomes its own measurement."""
    return tuple(
        Field(first + i, "${content:optype}", {"suffix": suffix}, "derive") for i, suffix in enumerate(names)
    )


def _md_stats(ops: tuple[str, ...], timed: bool) -> Item:
    fields = _timed_fields(("", "_min", "_max", "_sum", "_sumsq"), 2) if timed else _timed_fields(("",), 2)
    return Item(
        name="md_stats_${content:optype}",
        pattern=rf"^({KEYS}) +{N} samples \[usecs\] {N} {N} {N} {N}" if timed else f"^({KEYS}) +{N} samples .+",
        captures=("optype", "samples", *LATENCY) if timed else ("optype", "samples"),
        fields=fields,
        keys=ops,
        measurement="md_stats${field:suffix}",
        tags=f"optype=${{content:optype}} {PLACE['mdt']}",
        plugin=PLACE_PLUGIN["mdt"],
        plugin_instance="md_stats${field:suffix}",
    )


def _export_md(r: Release) -> Entry:
    suffixes = ("", "_min_latency", "_max_latency", "_sum_latency", "_sumsq_latency")
    timed = rf"^({KEYS}) +{N} samples \[usecs\] +{N} +{N} +{N} +{N}"
    item = Item(
        name="exp_md_stats_${content:optype}",
        pattern=timed if r.timed else f"^({KEYS}) +{N} samples .+",
        captures=("optype", "samples", *LATENCY) if r.timed else ("optype", "samples"),
        fields=_timed_fields(suffixes if r.timed else suffixes[:1], 2),
        keys=MD_OPS + RENAME_OPS,
        measurement="exp_md_stats${field:suffix}",
        tags=f"optype=${{content:optype}} {EXPORT_TAGS['mdt']}",
        plugin=f"{EXPORT_PLUGIN['mdt']}_{PLACE_PLUGIN['mdt']}",
        plugin_instance="stats",
    )
    return Entry(f"{r.md_exports}/{EXPORT_FOLDER['mdt']}/stats", (item,))


def _io_stats(prefix: str, measurement: str, tags: str, plugin: str) -> Item:
    return Item(
        name=f"{prefix}_${{content:optype}}",
        pattern=rf"^({KEYS})_bytes +{N} samples \[bytes\] [0-9]+ [0-9]+ {N}",
        captures=("optype", "samples", "bytes"),
        fields=(
            Field(2, "samples", {"what": "samples"}, "derive"),
            Field(3, "bytes", {"what": "bytes"}, "derive"),
        ),
        keys=("read", "write"),
        measurement=f"{measurement}_${{field:what}}",
        tags=f"optype=${{content:optype}} {tags}",
        plugin=plugin,
        plugin_instance="stats",
        type_instance="${content:optype}_${field:what}",
    )


def _op_stats(prefix: str, tags: str, plugin: str, ops: tuple[str, ...], unit: str, timed: bool) -> Item:
    suffixes = ("samples", "min_latency", "max_latency", "sum_latency", "sumsq_latency")
    columns = f" +{N} +{N} +{N} +{N}" if timed else ""
    return Item(
        name=f"{prefix}_${{content:optype}}",
        pattern=rf"^({KEYS}) +{N} samples \[{unit}\]{columns}",
        captures=("optype", "samples", *LATENCY) if timed else ("optype", "samples"),
        fields=_timed_fields(suffixes if timed else suffixes[:1], 2),
        keys=ops,
        measurement=f"{prefix}_${{field:suffix}}",
        tags=f"optype=${{content:optype}} {tags}",
        plugin=plugin,
        plugin_instance="stats",
    )


def _ost_stats(r: Release) -> tuple[Item, ...]:
    place, plugin = PLACE["ost"], PLACE_PLUGIN["ost"]
    items = [_io_stats("ost_stats", "ost_stats", place, plugin)]
    if r.cache_stats:
        for unit in ("usec", "pages"):
            ops = tuple(op for op, u in CACHE_OPS.items() if u == unit)
            items.append(_op_stats("ost_stats", place, plugin, ops, unit, False))
        failures = Item(
            name="ost_stats_get_page_failures",
            pattern=rf"^get_page failures +{N} samples \[num\]",
            captures=("samples",),
            fields=(Field(1, "get_page_failures", ds_type="derive"),),
            measurement="ost_stats_samples",
            tags=f"optype=get_page_failures {place}",
            plugin=plugin,
            plugin_instance="stats",
        )
        items.append(failures)
    items.append(_op_stats("ost_stats", place, plugin, OST_OPS, "usecs" if r.timed else "reqs", r.timed))
    return tuple(items)


def _export_ost(timed: bool) -> tuple[Item, ...]:
    tags, plugin = EXPORT_TAGS["ost"], f"{EXPORT_PLUGIN['ost']}_{PLACE_PLUGIN['ost']}"
    return (
        _io_stats("exp_ost_stats", "exp_ost_stats", tags, plugin),
        _op_stats("exp_ost_stats", tags, plugin, EXPORT_OST_OPS, "usecs" if timed else "reqs", timed),
    )


def _bulk(owner: str, old_block_names: bool) -> tuple[Item, ...]:
    prefix = "ost_brw_stats" if owner == "ost" else "exp_ost_brw_stats"
    client = "" if owner == "ost" else "exp_client=${subpath:ost_exp_client} exp_type=${subpath:ost_exp_type} "
    plugin = PLACE_PLUGIN["ost"] if owner == "ost" else f"{EXPORT_PLUGIN['ost']}-{PLACE_PLUGIN['ost']}"
    items = []
    for kind, (header, unit) in BULK_SECTIONS.items():
        if old_block_names and kind == "block_discontiguous_rpc":
            kind, unit = "blk_discontiguous_rpc", "blks"
        items.append(
            Item(
                name=f"{prefix}_{kind}",
                pattern=rf"^([0-9]+[KM]?):[ \t]+{N}[ \t]+{N}[ \t]+{N}[ \t]+\|[ \t]+{N}[ \t]+{N}[ \t]+{N}.*",
                captures=(unit, "r_sample", "r_percentage", "r_cum", "w_sample", "w_percentage", "w_cum"),
                fields=(
                    Field(2, "read_sample", {"what": "samples"}, "derive"),
                    Field(3, "read_percentage", {"what": "percentage"}),
                    Field(4, "read_cum", {"what": "cum"}),
                    Field(5, "write_sample", {"what": "samples"}, "derive"),
                    Field(6, "write_percentage", {"what": "percentage"}),
                    Field(7, "write_cum", {"what": "cum"}),
                ),
                measurement=f"{prefix}_{kind}_${{field:what}}",
                tags=f"field=${{field:name}} {client}{PLACE['ost']} size=${{content:{unit}}}_{unit}",
                plugin=plugin,
                plugin_instance=f"brw_stats_{kind}_${{content:{unit}}}_{unit}",
                region=Section(header),
            )
        )
    return tuple(items)


def _job_item(target: str, lines: list[str], captures: list[str], fields: list[Field]) -> Item:
    head = "- +job_id: +(.+)\n +snapshot_time: +.+"
    return Item(
        name=f"{target}_jobstats",
        pattern=head + "".join("\n  " + line for line in lines),
        captures=("job_id", *captures),
        fields=tuple(fields),
        measurement=f"{target}_jobstats_${{field:what}}",
        tags=f"optype=${{field:name}} {PLACE[target]} job_id=${{content:job_id}}",
        plugin=PLACE_PLUGIN[target],
        plugin_instance="jobstat_${content:job_id}",
        first_value=0.0,
    )


def _timed_job_line(op: str) -> str:
    stats = rf"samples: +{N}, unit: usecs, min: *{N}, max: *{N}, sum: *{N}, sumsq: *{N}"
    return rf"{op}: +\{{ {stats} \}}"


def _counted_job_line(op: str) -> str:
    return rf"{op}: +\{{ samples: +{N}.+"


def _timed_job_fields(op: str, first: int) -> list[Field]:
    return [Field(first + i, op, {"what": w}, "derive") for i, w in enumerate(("samples", *LATENCY))]


def _mdt_jobs(ops: tuple[str, ...], timed: bool) -> Item:
    lines, captures, fields = [], [], []
    for op in ops:
        first = len(captures) + 2
        if timed:
            lines.append(_timed_job_line(op))
            captures += [op, *(f"{w}_{op}" for w in LATENCY)]
            fields += _timed_job_fields(op, first)
        else:
            lines.append(_counted_job_line(op))
            captures.append(op)
            fields.append(Field(first, op, {"what": "samples"}, "derive"))
    return _job_item("mdt", lines, captures, fields)


def _ost_jobs(style: str) -> Item:
    """``short`` and ``sum``: total bytes only; ``full``: min, max, sum; ``timed``: latencies too."""
    lines: list[str] = []
    captures: list[str] = []
    fields: list[Field] = []
    for rw in ("read", "write"):
        first = len(captures) + 2
        fields.append(Field(first, f"{rw}_samples", {"what": "samples"}, "derive"))
        if style in ("full", "timed"):
            end = r".+ \}" if style == "timed" else r" \}"
            lines.append(rf"{rw}_bytes: +\{{ samples: +{N}, unit: bytes, min: *{N}, max: *{N}, sum: *{N}{end}")
            captures.append(f"{rw}_samples")
            for i, w in enumerate(("min", "max", "sum"), start=1):
                captures.append(f"{w}_{rw}_bytes")
                fields.append(Field(first + i, f"{w}_{rw}_bytes", {"what": "bytes"}, "derive"))
        else:
            label = f"{rw}_bytes" if style == "sum" else rw
            total = f"sum_{rw}_bytes" if style == "short_sum" else f"{rw}_bytes"
            lines.append(rf"{label}: +\{{ samples: +{N}.+, sum: +{N}.+")
            captures += [f"{rw}_samples", total]
            fields.append(Field(first + 1, total, {"what": "bytes"}, "derive"))
    ops = OST_JOB_OPS_SHORT if style in ("short", "short_sum") else OST_JOB_OPS
    for op in (("read", "write") + ops) if style == "timed" else ops:
        first = len(captures) + 2
        if style == "timed":
            lines.append(_timed_job_line(op))
            captures += [op, *(f"{w}_{op}" for w in LATENCY)]
            fields += _timed_job_fields(op, first)
        else:
            lines.append(_counted_job_line(op))
            captures.append(op)
            fields.append(Field(first, op, {"what": "samples"}, "derive"))
    return _job_item("ost", lines, captures, fields)


def _mdc() -> Entry:
    item = _single(
        "max_rpcs_in_flight",
        "max_rpcs_in_flight",
        tags=f"{PLACE['mdt']} mdc_tag=${{subpath:mdc_tag}}",
        plugin="${subpath:fs_name}-${subpath:mdt_index}-${subpath:mdc_tag}",
        plugin_instance="mdc_rpcs",
    )
    return Entry(f"{PROC}/mdc/{{fs_name}}-{{mdt_index}}-{{mdc_tag}}/max_rpcs_in_flight", (item,))


def _service(r: Release, service: str) -> list[Entry]:
    folder, timed = SERVICES[service]
    root = r.ldlm_root if folder.startswith("ldlm") else r.services_root
    out = []
    if service in r.service_stats:
        whats = ("samples", "min", "max", "sum", "sum_square")
        items = tuple(
            Item(
                name=f"{service}_stats_${{content:request}}",
                pattern=rf"^({KEYS}) +{N} samples \[{unit}\] +{N} +{N} +{N} +{N}",
                captures=("request", *whats),
                fields=tuple(Field(i, "${content:request}", {"what": w}) for i, w in enumerate(whats, start=2)),
                keys=queue + timed.get(unit, ()),
                measurement=f"{service}_stats_${{content:request}}_${{field:what}}",
                plugin=service,
                plugin_instance="stats",
                type_instance="${content:request}_${field:what}",
            )
            for unit, queue in QUEUE_STATS.items()
        )
        out.append(Entry(f"{root}/{folder}/stats", items, reset_on_read=r.service_reset))
    prefix, plugin, instance = THREADS[service]
    for what in ("max", "min", "started"):
        item = _single(
            f"{prefix}_threads_{what}",
            f"{prefix}_thread_{what}",
            plugin=plugin,
            plugin_instance=instance,
            type_instance=f"threads_{what}",
        )
        out.append(Entry(f"{root}/{folder}/threads_{what}", (item,)))
    return out


def _locks(root: str, target: str, prefix: str) -> list[Entry]:
    folder = f"{root}/ldlm/namespaces/{prefix}-{TARGET[target]}_UUID"
    return [
        Entry(
            f"{folder}/{what}",
            (
                _single(
                    f"{target}_{what}",
                    f"{target}_{what}",
                    tags=PLACE[target],
                    plugin=PLACE_PLUGIN[target],
                    plugin_instance="locksinfo",
                    type_instance=what,
                ),
            ),
        )
        for what in ("lock_count", "lock_timeouts")
    ]


def _lock_pool(root: str) -> Entry:
    lines = [f"snapshot_time +{N}.+"]
    lines += [rf"{name} +[0-9]+ samples \[{unit}\] +{N}.+" for name, unit in LOCK_POOL_UNITS.items()]
    names = ("snapshot_time", *LOCK_POOL_UNITS)
    item = Item(
        name="ost_ldlm_stats",
        pattern="\n".join(lines),
        captures=names,
        fields=tuple(Field(i, n) for i, n in enumerate(names, start=1)),
        measurement="ldlm_stats",
        tags=f"optype=${{field:name}} {PLACE['ost']}",
        plugin=PLACE_PLUGIN["ost"],
        plugin_instance="ldlm_stats_${field:name}",
    )
    return Entry(f"{root}/ldlm/namespaces/filter-{TARGET['ost']}_UUID/pool/stats", (item,))


def _client() -> Entry:
    def item(keys: tuple[str, ...], unit: str, whats: tuple[str, ...]) -> Item:
        columns = "".join(f" {N}" for _ in whats[1:])
        return Item(
            name="client_stats_${content:optype}",
            pattern=rf"^({KEYS}) +{N} samples \[{unit}\]{columns}",
            captures=("optype", *whats),
            fields=tuple(Field(i, w, {"what": w}) for i, w in enumerate(whats, start=2)),
            keys=keys,
            measurement="client_stats_${content:optype}_${field:what}",
            tags="fs_name=${subpath:fs_name} client_uuid=${subpath:client_uuid}",
            plugin="${subpath:fs_name}-${subpath:client_uuid}",
            plugin_instance="client_stats",
            type_instance="${content:optype}_${field:what}",
        )

    four = ("samples", "min", "max", "sum")
    return Entry(
        f"{DEBUG}/llite/{{fs_name}}-{{client_uuid}}/stats",
        (
            item(CLIENT_BYTES, "bytes", four),
            item(CLIENT_TIMED, "usec", four),
            item(CLIENT_COUNTED, "reqs", ("samples",)),
        ),
        reset_on_read=True,
    )


def _math(r: Release) -> tuple[MathEntry, ...]:
    out: list[MathEntry] = []
    if r.used_capacity:
        for target in ("mdt", "ost"):
            for kind in ("files", "kbytes"):
                m = f"{target}_{kind}info"
                out.append(MathEntry(f"{m}_total", "-", f"{m}_free", f"{m}_used", f"{kind}used"))
    if r.service_reset:
        for service in r.service_stats:
            requests = [q for unit, queue in QUEUE_STATS.items() for q in queue + SERVICES[service][1].get(unit, ())]
            for q in requests:
                m = f"{service}_stats_{q}"
                out.append(MathEntry(f"{m}_sum", "/", f"{m}_samples", f"{m}_mean", f"{q}_mean"))
                square = MathEntry(
                    f"{m}_sum_square", "/", f"{m}_samples", f"{m}_mean_square", f"{q}_mean_square"
                )
                out.append(square)
    if r.client:
        for q in CLIENT_TIMED:
            m = f"client_stats_{q}"
            out.append(MathEntry(f"{m}_sum", "/", f"{m}_samples", f"{m}_mean", f"{q}_mean"))
    return tuple(out)


def _both(root: str) -> tuple[tuple[str, str], ...]:
    return ((f"{root}/osd-ldiskfs/{TARGET['mdt']}", "mdt"), (f"{root}/osd-ldiskfs/{TARGET['ost']}", "ost"))


_OBD_OST = (f"{PROC}/obdfilter/{TARGET['ost']}", "ost")
_LOV_MDT = (f"{PROC}/lov/{TARGET['mdt']}-mdtlov", "mdt")
_LOD_MDT = (f"{PROC}/lod/{TARGET['mdt']}-mdtlov", "mdt")
_USERS = (("osd-ldiskfs", ("user",)),)
_ALL_QUOTA = (("osd-ldiskfs", ("user", "group", "project")), ("osd-zfs", ("user", "group", "project")))
_EARLY_SERVICES = ("mdt", "ost", "ost_io", "ost_create", "ldlm_canceld", "ldlm_cbd")
_LATE_BULK = PROC + "/osd-ldiskfs/" + TARGET["ost"] + "/brw_stats"
_EARLY = dict(
    recovery=False, services=_EARLY_SERVICES, service_stats=("ost_io",), service_reset=False, locks_root=None
)
_LATE = dict(quota=_ALL_QUOTA, services_root=DEBUG, ldlm_root=DEBUG, locks_root=SYS, pool_root=DEBUG)

RELEASES: dict[str, Release] = {
    r.name: r
    for r in (
        Release(
            "1.8.9",
            md_stats=f"{PROC}/mds/{TARGET['mdt']}/stats",
            md_exports=f"{PROC}/mds/{TARGET['mdt']}",
            capacity=((f"{PROC}/mds/{TARGET['mdt']}", "mdt"), _OBD_OST),
            old_block_names=True,
            cache_stats=True,
            mdt_jobs=(),
            ost_jobs="none",
            used_capacity=False,
            **_EARLY,
        ),
        Release(
            "2.1.6",
            capacity=(_LOV_MDT, _OBD_OST),
            export_bulk=True,
            cache_stats=True,
            mdt_jobs=(),
            ost_jobs="none",
            used_capacity=False,
            **_EARLY,
        ),
        Release(
            "2.4.2",
            capacity=(_LOD_MDT, _OBD_OST),
            cache_stats=True,
            ost_jobs="short",
            used_capacity=False,
            **_EARLY,
        ),
        Release(
            "2.5",
            md_ops=MD_OPS + RENAME_OPS,
            capacity=(_LOD_MDT, _OBD_OST),
            quota=_USERS,
            ost_jobs="sum",
            **_EARLY,
        ),
        Release("ieel-2.5", capacity=(_LOD_MDT, _OBD_OST), quota=_USERS, ost_jobs="short_sum"),
        Release("ieel-2.7", capacity=(_LOD_MDT, _OBD_OST), quota=_ALL_QUOTA, pool_root=PROC),
        Release(
            "es4-2.10",
            capacity=(_LOD_MDT, _OBD_OST),
            quota=_ALL_QUOTA,
            ldlm_root=SYS,
            locks_root=SYS,
            pool_root=SYS,
        ),
        Release("2.12", capacity=_both(PROC), bulk=_LATE_BULK, **_LATE),
        Release("es5_1", capacity=_both(PROC), bulk=_LATE_BULK, client=True, **_LATE),
        Release("2.13", capacity=_both(SYS), bulk=_LATE_BULK, client=True, **_LATE),
        Release(
            "es5_2", capacity=_both(PROC), bulk=_LATE_BULK, client=True, timed=True, ost_jobs="timed", **_LATE
        ),
        Release(
            "es6_0",
            capacity=_both(SYS),
            bulk=_LATE_BULK,
            client=True,
            timed=True,
            mdt_jobs=MD_OPS + PARALLEL_RENAME_OPS,
            ost_jobs="timed",
            **_LATE,
        ),
        Release(
            "es6_3",
            capacity=_both(SYS),
            bulk=DEBUG + "/osd-ldiskfs/" + TARGET["ost"] + "/brw_stats",
            client=True,
            timed=True,
            mdt_jobs=MD_OPS + PARALLEL_RENAME_OPS,
            ost_jobs="timed",
            **_LATE,
        ),
    )
}

#: Items that list one series per client; off unless selected, there are many.
PER_CLIENT_PREFIXES = ("exp_md_stats_", "exp_ost_stats_", "exp_ost_brw_stats_")


def definition(release: str, *, per_client: bool = False) -> Definition:
    """Definition of one release; per-client export statistics are opt-in."""
    full = build(RELEASES[release])
    if per_client:
        return full
    return full.without([n for n in full.item_names() if n.startswith(PER_CLIENT_PREFIXES)])
