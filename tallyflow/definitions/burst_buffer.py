"""Burst buffer monitor output (releases 1.1 and 1.2).

Numbers printed with a fraction keep their integer part only.
"""

from __future__ import annotations

from tallyflow.definitions import Definition, Entry, Field, Item

# ---------------------------------------------------------------------------
# Commands, labels and names of the points.
COMMANDS = {
    "1.1": ("--nvm-stat --bfs", "--frgbs | grep '[0-9]'"),
    "1.2": ("--nvm-stat --bfs | ime_monitor_bad_node_filter", "--frgbs | grep '[0-9]' | ime_monitor_bad_node_filter"),
}
DEVICE_COLUMNS = {
    "1.1": (
        ("read_IOs", "read", False), ("read_MBs", "read", True),
        ("write_IOs", "write", False), ("write_MBs", "write", True),
        ("unmap_IOs", "unmap", False),
    ),
    "1.2": (
        ("read_IOs", "read", False), ("read_Lat", "read", False), ("read_MBs", "read", True),
        ("write_IOs", "write", False), ("write_Lat", "write", False), ("write_MBs", "write", True),
        ("unmap_IOs", "unmap", False), ("unmap_Lat", "unmap", False),
    ),
}
FILE_LABELS = {
    "1.1": (
        "Read bytes", "Write bytes", "Reads", "Writes", "Opens", "Closes", "fsync", "fstat", "ftruncate",
        "ns_multi", "open errors", "close errors", "read errors", "write errors", "fsync errors",
        "fstat errors", "ftruncate errors", "ns_multi errors",
    ),
    "1.2": (
        "Read bytes", "Write bytes", "Reads", "Writes", "Creates", "Unlinks", "fsync", "fstat", "ftruncate",
        "ns_multi", "create errors", "unlink errors", "read errors", "write errors", "fsync errors",
        "fstat errors", "ftruncate errors", "ns_multi errors",
    ),
}
THRESHOLD_LABELS = {
    "1.1": ("MinFreeSpaceRatio   =", "FlushThresholdRatio ="),
    "1.2": ("Min Free Space Ratio +=", "Sync Threshold +="),
}
THRESHOLDS = (
    ("MinFreeSpaceRatio", "ime_UM_MinFreeSpaceRatio"),
    ("FlushThresholdRatio", "ime_UM_FlushThresholdRatio"),
)
CAPACITY = (("Cap_InUse", "ime_Cap_InUse"), ("Cap_Total", "ime_Cap_Total"), ("Cap_PCT_Free", "ime_PCT_Free"))
HEAP = (("AppsHeapRem", "ime_AppsHeapRem"), ("AppsHeapRsvd", "ime_AppsHeapRsvd"))
MIGRATION = (
    ("DM_PrestageQueued", "ime_DM_PrestageQueued"),
    ("DM_SyncQueued", "ime_DM_SyncQueued"),
    ("DM_Clean", "ime_DM_Clean"),
    ("DM_Pinned", "ime_DM_Pinned"),
    ("FBS_FullDirty", "ime_FBS_FullDirty"),
    ("FBS_PartialDirty", "ime_FBS_PartialDirty"),
    ("FBS_FullClean", "ime_FBS_FullClean"),
    ("FBS_PartialClean", "ime_FBS_PartialClean"),
    ("FBS_Pinned", "ime_FBS_pinned"),
)
N = "([0-9]+)"
# ---------------------------------------------------------------------------

HOST = "ime_${key:hostname}"


def _devices(release: str) -> Item:
    columns = (*DEVICE_COLUMNS[release], ("free", "", True))
    cells = "".join(rf" +\| +{N}" + (r"\.[0-9]+" if fraction else "") for _, _, fraction in columns)
    fields = [Field(i, name, {"rw": rw}) for i, (name, rw, _) in enumerate(columns, start=3)]
    return Item(
        name="nvm-stat",
        pattern=rf"\| +{N} +\| +(\S+){cells} +\|.+\|",
        captures=("ID", "name", *(name for name, *_ in columns)),
        fields=tuple(fields),
        measurement="ime_nvm_${field:name}",
        tags="host=${key:hostname} rw=${field:rw} device=${content:ID}",
        host=HOST,
        plugin="nvm-stat",
        plugin_instance="device_${content:ID}",
    )


def _files(release: str) -> Item:
    labels = FILE_LABELS[release]
    names = [label.replace(" ", "_") for label in labels]
    return Item(
        name="bfs-stat",
        pattern="\n".join(f"{label}: +{N}" for label in labels),
        captures=tuple(names),
        fields=tuple(Field(i, n, {"lower": n.lower()}, "derive") for i, n in enumerate(names, start=1)),
        measurement="ime_bfs_${field:lower}",
        host=HOST,
        plugin="bfs-stat",
    )


def _usage(release: str) -> Item:
    """The whole utilisation block; only lines that hold a digit survive the command's filter."""
    groups = [*THRESHOLDS, *CAPACITY, *(HEAP if release == "1.2" else ()), *MIGRATION]
    thresholds = r"\s+".join(f"{label} +{N}" for label in THRESHOLD_LABELS[release])
    capacity = rf"\s+{N} \|\s+{N} \|\s+{N}\.[0-9]+ \|"
    heap = rf"\s+{N}\.[0-9]+ \|\s+{N}\.[0-9]+ \|[^\n]*" if release == "1.2" else ""
    migration = "".join(rf"\s+{N} \|" for _ in MIGRATION)
    return Item(
        name="UM-stat",
        pattern=thresholds + capacity + heap + migration,
        captures=tuple(name for name, _ in groups),
        fields=tuple(Field(i, n, {"measurement": m}) for i, (n, m) in enumerate(groups, start=1)),
        measurement="${field:measurement}",
        host=HOST,
        plugin="UM-stat",
    )


def definition(release: str) -> Definition:
    devices, usage = COMMANDS[release]
    return Definition(
        f"burst-buffer-{release}",
        (Entry(devices, (_devices(release), _files(release))), Entry(usage, (_usage(release),))),
    )
