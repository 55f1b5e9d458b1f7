"""GPFS performance monitor output (release 3.5)."""

from __future__ import annotations

from tallyflow.definitions import Definition, Entry, Field, Item, RunOfLines

# ---------------------------------------------------------------------------
# Markers of the output, in order, and what they count.
COUNTERS = (
    ("_br_", "bytes_read", "bytes", "read"),
    ("_bw_", "bytes_write", "bytes", "write"),
    ("_oc_", "open_count", "count", "open"),
    ("_cc_", "close_count", "count", "close"),
    ("_rdc_", "read_count", "count", "read"),
    ("_wc_", "write_count", "count", "write"),
    ("_dir_", "readdir_count", "count", "readdir"),
    ("_iu_", "inode_upate_count", "count", "inode_update"),
)
HISTOGRAM_COMMAND = "rhist on\nrhist s"
# ---------------------------------------------------------------------------


def _counters(prefix: str, head: str, names: tuple[str, ...], tags: str, plugin: str, instance: str) -> Entry:
    pattern = head + " ".join(f"{marker} (.+)" for marker, *_ in COUNTERS)
    first = len(names) + 1
    item = Item(
        name=prefix,
        pattern=pattern,
        captures=(*names, *(name for _, name, *_ in COUNTERS)),
        fields=tuple(
            Field(first + i, name, {"what": what, "optype": optype}, "derive")
            for i, (_, name, what, optype) in enumerate(COUNTERS)
        ),
        measurement=prefix.removesuffix("_s") + "_${field:what}",
        tags=f"optype=${{field:optype}} {tags}".strip(),
        plugin=plugin,
        plugin_instance=instance,
    )
    return Entry(prefix, (item,))


def _histogram(rw: str, what: str, letter: str) -> Item:
    low, high = f"{what}_minimum", f"{what}_maximum"
    return Item(
        name=f"rhist_{rw}_{what}",
        pattern=rf"^_{letter}_ (\S+) (\S+) _N{letter}_ (.+)",
        captures=(low, high, "request_number"),
        fields=(Field(3, "request_number", ds_type="derive"),),
        measurement=f"rhist_request_{what}_number",
        tags=f"optype={rw} extent=${{content:{low}}}_to_${{content:{high}}}",
        plugin=f"gpfs_rhlist_{rw}",
        plugin_instance=f"{what}_${{content:{low}}}_to_${{content:{high}}}",
        region=RunOfLines(rf"_rhist_ _n_ [^\n]+ _nn_ [^\n]+ _req_ s _rc_ [^\n]+ _t_ [^\n]+ _tu_ [^\n]+ _k_ {rw[0]}", r"_[RL]_ "),
    )


def definition() -> Definition:
    per_fs = _counters(
        "fs_io_s",
        r"_fs_io_s_ _n_ (.+) _nn_ (.+) _rc_ .+ _t_ .+ _tu_ .+ _cl_ (.+) _fs_ (.+) _d_ .+ ",
        ("IP", "hostname", "cluster", "filesystem"),
        "fs_name=${content:filesystem} cluster=${content:cluster}",
        "${content:cluster}",
        "${content:filesystem}",
    )
    per_node = _counters("io_s", r"_io_s_ _n_ (.+) _nn_ (.+) _rc_ .+ _t_ .+ _tu_ .+ ", ("IP", "hostname"), "", "", "")
    histograms = tuple(_histogram(rw, what, letter) for rw in ("write", "read") for what, letter in (("size", "R"), ("latency", "L")))
    return Definition("gpfs-3.5", (per_fs, per_node, Entry(HISTOGRAM_COMMAND, histograms)))
