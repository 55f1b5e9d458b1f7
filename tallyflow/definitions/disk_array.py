"""Block storage array reports: virtual and physical disk counters.

A report has titled sections; a disk row looks the same in several of them, so
every item is bound to its section by literal start and end markers.
"""

from __future__ import annotations

from tallyflow.definitions import Between, Definition, Entry, Field, Item

# ---------------------------------------------------------------------------
# Section titles, column names and command names of the reports.
COMMANDS = {"vd": "show vd c all", "pd": "show pd c all"}
TITLES = {"vd": "Virtual", "pd": "Physical"}
RATE_COLUMNS = ("iops", "KiBps", "KiBpIO", "Fwd_iops", "Fwd_KiBps", "R_KiBps", "W_KiBps")
UNMAP_RATE_COLUMN = "Unmap_KiBps"
LATENCY_COLUMNS = {
    "vd": (
        "avg", "le16ms", "le32ms", "le64ms", "le128ms", "le256ms", "le512ms",
        "le1s", "le2s", "le4s", "le8s", "le16s", "gt16s",
    ),
    "pd": (
        "avg", "le4ms", "le8ms", "le16ms", "le32ms", "le64ms", "le128ms",
        "le256ms", "le512ms", "le1s", "le2s", "le4s", "gt4s",
    ),
}
SIZE_COLUMNS = (
    "le4KiB", "le8KiB", "le16KiB", "le32KiB", "le64KiB", "le128KiB",
    "le256KiB", "le512KiB", "le1MiB", "le2MiB", "le4MiB", "gt4MiB",
)
DEPTH_COLUMNS = (
    "1", "2", "3to4", "5to8", "9to16", "17to32", "33to64",
    "65to128", "129to256", "257to512", "gt512",
)
DEPTH_TITLE = "Virtual Disk Qdepth"
UNMAP_TITLE = "  Idx  Unmap Count Unmap Blocks| Unmap Count Unmap Blocks|"
N = "([0-9]+)"
# ---------------------------------------------------------------------------


def _cells(count: int) -> str:
    return "".join(f" +{N}" for _ in range(count))


def _item(name: str, kind: str, columns, pattern: str, region: Between, *, by: str, **fixed: str) -> Item:
    """A row item: the first cell is the disk, every other cell is a point."""
    others = " ".join(f"{k}={v}" for k, v in fixed.items())
    return Item(
        name=name,
        pattern=pattern,
        captures=("disk_index", *(f"c{i}" for i in range(len(columns)))),
        fields=tuple(Field(i, c, {"column": c}) for i, c in enumerate(columns, start=2)),
        measurement=kind,
        tags=f"{others} {by}=${{field:column}} disk_index=${{content:disk_index}}".strip(),
        host="${extra_tag:extrahost}",
        plugin=f"{kind}_${{content:disk_index}}",
        plugin_instance=next(iter(fixed.values()), ""),
        region=region,
    )


def _by_controller(name: str, kind: str, columns: tuple[str, ...], pattern: str, region: Between, ds="gauge") -> Item:
    """A row with one block of columns for each of the two controllers."""
    fields = tuple(
        Field(2 + c * len(columns) + i, f"controller{c}_{column}", {"controller": str(c), "column": column}, ds)
        for c in (0, 1)
        for i, column in enumerate(columns)
    )
    return Item(
        name=name,
        pattern=pattern,
        captures=("disk_index", *(f.name for f in fields)),
        fields=fields,
        measurement=kind,
        tags="type=${field:column} controller=${field:controller} disk_index=${content:disk_index}",
        host="${extra_tag:extrahost}",
        plugin=f"{kind}_${{content:disk_index}}",
        plugin_instance="controller${field:controller}",
        type_instance="${field:column}",
        region=region,
    )


def _report(kind: str, unmap: bool, depth: bool) -> Entry:
    title = TITLES[kind]
    columns = (*RATE_COLUMNS, UNMAP_RATE_COLUMN) if unmap else RATE_COLUMNS
    bar = r" *\|" if unmap else r"\|"
    rates = _by_controller(
        f"{kind}_c_rates",
        f"{kind}_rate",
        columns,
        f"^ +{N}{_cells(len(columns))}{bar}{_cells(len(columns))}{bar}",
        Between(f"{title} Disk Counters:", f"{title} Disk Read Latency"),
    )
    items = [rates]
    for rw, ends in (("Read", f"{title} Disk Write Latency"), ("Write", f"{title} Disk Read IO Size")):
        cells = LATENCY_COLUMNS[kind]
        region = Between(f"{title} Disk {rw} Latency", ends)
        pattern = f"^ +{N}{_cells(len(cells))}"
        items.append(
            _item(f"{kind}_{rw.lower()}_latency", f"{kind}_latency", cells, pattern, region, by="latency", type=rw.lower())
        )
    for rw, ends in (("Read", f"{title} Disk Write IO Size"), ("Write", DEPTH_TITLE if depth else "")):
        region = Between(f"{title} Disk {rw} IO Size", ends)
        pattern = f"^ +{N}{_cells(len(SIZE_COLUMNS))}"
        items.append(
            _item(f"{kind}_{rw.lower()}_iosize", f"{kind}_iosize", SIZE_COLUMNS, pattern, region, by="iosize", type=rw.lower())
        )
    if depth:
        # Both controllers have a section with the same title, in order.
        for controller in (0, 1):
            region = Between(DEPTH_TITLE, DEPTH_TITLE if controller == 0 else "", occurrence=controller + 1)
            pattern = f"^ +{N}{_cells(len(DEPTH_COLUMNS))}"
            name = f"vd_qdepth_controller_{controller}"
            items.append(
                _item(name, "vd_qdepth", DEPTH_COLUMNS, pattern, region, by="qdepth", controller=str(controller))
            )
    if unmap:
        items.append(
            _by_controller(
                f"{kind}_unmap",
                f"{kind}_unmap",
                ("count", "blocks"),
                rf"^ +{N}{_cells(2)}\|{_cells(2)}\|",
                Between(UNMAP_TITLE),
                ds="derive",
            )
        )
    return Entry(COMMANDS[kind], tuple(items))


RELEASES = {
    "3.0": dict(unmap=False, depth=False),
    "11.0": dict(unmap=False, depth=True),
    "11.6": dict(unmap=True, depth=True),
}


def definition(release: str) -> Definition:
    has = RELEASES[release]
    reports = (_report("vd", has["unmap"], has["depth"]), _report("pd", has["unmap"], False))
    return Definition(f"array-{release}", reports)
