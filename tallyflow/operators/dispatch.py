"""Catalogs compiled to what a scan can run quickly.

Paths go down a tree: at each step the one path segment that tells most entries
apart is compared with its constants; where several entries are left at a leaf,
their regexes decide.  All the rest of a catalog is data, not code, in three small
tables that are joined by broadcast: patterns of paths by entry, patterns of
records by item, and points by (item, field), with every template cut into
constants and numbers of slots.  So the expressions do not grow with the number
of layouts, and each stays small enough to be compiled.  A pattern that comes
from a column is compiled anew when it changes, which is once for each file and
item, as their rows follow one another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.definitions import Definition, Entry, Field, Item
from tallyflow.functions import template as TPL
from tallyflow.functions import text as X

#: Name of the row's slots: the host, tags that came with it, path variables, captured groups.
SLOTS = "_slots"


@dataclass(frozen=True)
class Source:
    """One kind of file, and the system versions that use it (none: all)."""

    versions: tuple[str, ...]
    entry: Entry


@dataclass(frozen=True)
class Layout:
    """One kind of record: ``number`` over the whole catalog, ``every`` N-th collect interval only."""

    number: int
    source: int
    entry: Entry
    item: Item
    every: int = 1


def sources(catalog: Definition | Mapping[str, Definition], select: Sequence[str] | None) -> list[Source]:
    """Entries with the versions that use them; equal entries are shared."""
    if isinstance(catalog, Definition):
        chosen = catalog if select is None else catalog.select(select)
        return [Source((), entry) for entry in chosen.entries]
    users: dict[tuple[str, str], tuple[Entry, list[str]]] = {}
    for version, definition in catalog.items():
        if select is not None:
            definition = definition.select([n for n in select if n in definition.item_names()])
        for entry in definition.entries:
            users.setdefault((entry.path, repr(entry)), (entry, []))[1].append(version)
    return [Source(tuple(versions), entry) for entry, versions in users.values()]


def layouts(found: Sequence[Source], every: Mapping[str, int]) -> list[Layout]:
    """Items numbered in order; an item whose keys are read at different rates is one layout per rate."""
    known = {n for s in found for i in s.entry.items for n in i.names()}
    if unknown := set(every) - known:
        raise ValueError(f"unknown items: {sorted(unknown)}")
    out: list[Layout] = []
    for k, source in enumerate(found):
        for item in source.entry.items:
            for rate in sorted({every.get(n, 1) for n in item.names()}):
                part = item.keep(lambda n, rate=rate: every.get(n, 1) == rate)
                out.append(Layout(len(out), k, source.entry, part, rate))
    return out


# ----------------------------------------------------------------- paths


def path_tree(found: Sequence[Source]) -> str:
    """SQL that finds the one entry a path may be of from ``_segments`` (the path, split); null if there is none."""
    segments = {k: s.entry.path.split("/") for k, s in enumerate(found)}

    def tried(numbers: Sequence[int]) -> str:
        if len(numbers) < 2:  # its own regex is looked at after the join
            return str(numbers[0]) if numbers else "CAST(NULL AS int)"
        cases = []
        for k in numbers:
            applies = f"path RLIKE {X.literal(found[k].entry.regex)}"
            if found[k].versions:
                applies = f"version IN ({', '.join(map(X.literal, found[k].versions))}) AND {applies}"
            cases.append(f"WHEN {applies} THEN {k}")
        return f"CASE {' '.join(cases)} END"

    def node(numbers: list[int], left: frozenset[int]) -> str:
        def constants(at: int) -> set[str]:
            return {segments[k][at] for k in numbers if "{" not in segments[k][at]}

        best = max(left, key=lambda at: (len(constants(at)), at), default=None)
        if len(numbers) < 2 or best is None or len(constants(best)) < 2:
            return tried(numbers)
        rest, cases = left - {best}, []
        for value in sorted(constants(best)):
            some = [k for k in numbers if segments[k][best] == value or "{" in segments[k][best]]
            cases.append(f"WHEN {X.literal(value)} THEN {node(some, rest)}")
        others = [k for k in numbers if "{" in segments[k][best]]
        return f"CASE _segments[{best}] {' '.join(cases)} ELSE {node(others, rest)} END"

    by_size: dict[int, list[int]] = {}
    for k, parts in segments.items():
        by_size.setdefault(len(parts), []).append(k)
    cases = [f"WHEN {n} THEN {node(numbers, frozenset(range(n)))}" for n, numbers in by_size.items()]
    return f"CASE size(_segments) {' '.join(cases)} END"


def source_table(spark: SparkSession, found: Sequence[Source]) -> DataFrame:
    """(_source, _versions, _path, _path_groups, _variables): what decides over a path and reads its groups."""
    rows = [
        {
            "_source": k, "_versions": list(s.versions) or None, "_path": s.entry.regex,
            "_path_groups": X.all_groups(s.entry.regex) if s.entry.variables else None, "_variables": s.entry.variables,
        }
        for k, s in enumerate(found)
    ]
    texts = pa.list_(pa.string())
    types = {"_source": pa.int32(), "_versions": texts, "_path": pa.string(), "_path_groups": pa.string(), "_variables": texts}
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(list(types.items()))))


def item_table(spark: SparkSession, all_layouts: Sequence[Layout]) -> DataFrame:
    """(_source, _layout, _every, _region, _region_group, _pattern, _record_groups): where records are and how they are read."""
    rows = [
        {
            "_source": x.source, "_layout": x.number, "_every": x.every,
            "_region": x.item.region.pattern() if x.item.region else None,
            "_region_group": x.item.region.group if x.item.region else None,
            "_pattern": x.item.regex, "_record_groups": X.all_groups(x.item.regex),
        }
        for x in all_layouts
    ]
    texts = ("_region", "_pattern", "_record_groups")
    numbers = ("_source", "_layout", "_every", "_region_group")
    types = {n: pa.int32() for n in numbers} | {n: pa.string() for n in texts}
    return spark.createDataFrame(pa.Table.from_pylist(rows, pa.schema(list(types.items()))))


# ----------------------------------------------------------------- slots


class Slots:
    """Where each variable of a layout's templates is found in the row's slots."""

    def __init__(self, all_layouts: Sequence[Layout]) -> None:
        texts = [t for x in all_layouts for t in _templates(x.item)]
        self.extra = sorted({n for t in texts for kind, n in TPL.variables(t) if kind == "extra_tag"})

    def columns(self) -> str:
        """SQL of the slots; ``_groups`` and ``_captures`` are arrays of the path's and the record's groups."""
        first = ["host", *(f"coalesce(try_element_at(extra_tags, {X.literal(n)}), host)" for n in self.extra)]
        return f"concat(array({', '.join(first)}), _groups, _captures)"

    def at(self, layout: Layout, kind: str, name: str) -> int:
        groups = 1 + len(self.extra)
        if kind == "key":
            return 0
        if kind == "extra_tag":
            return 1 + self.extra.index(name)
        if kind == "subpath":
            return groups + layout.entry.variables.index(name)
        if kind == "content":
            return groups + len(layout.entry.variables) + layout.item.captures.index(name)
        raise ValueError(f"unknown variable ${{{kind}:{name}}}")

    def environment(self, layout: Layout) -> dict[str, Callable[[str], str]]:
        kinds = ("key", "extra_tag", "subpath", "content")
        return {k: lambda name, k=k: f"get({SLOTS}, {self.at(layout, k, name)})" for k in kinds}


def _templates(item: Item) -> list[str]:
    return [item.measurement, item.host, item.tags, item.plugin, item.plugin_instance, item.type_instance, item.name]


# ----------------------------------------------------- the table of layouts

#: Parts of a point that are rendered from one template each.
RENDERED = ("measurement", "host", "plugin", "plugin_instance", "type_instance", "item", "field")


def _filled(template: str, field: Field) -> str:
    """The template with the field's own name and attributes put in."""

    def value(match: re.Match) -> str:
        return field.name if match[1] == "name" else field.attrs.get(match[1], "")

    return re.sub(r"\$\{field:([A-Za-z0-9_]+)\}", value, template)


def plain_numbers(pattern: str) -> set[int]:
    """Numbers of the groups that hold digits and nothing else."""
    found, group, k, in_class = set(), 0, 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(" and pattern[k + 1 : k + 2] != "?":
            group += 1
            if pattern.startswith("([0-9]+)", k):
                found.add(group)
        k += 1
    return found


class LayoutTable:
    """One row per point that a record of each layout gives."""

    def __init__(self, all_layouts: Sequence[Layout], slots: Slots, dropped: frozenset[str]) -> None:
        self.slots = slots
        self.width: dict[str, int] = {}
        self.tags = 0
        rows = []
        for layout in all_layouts:
            item, digits = layout.item, plain_numbers(layout.item.regex)
            kept = [f for f in item.fields if f.name not in dropped]
            lacking = any(f.attrs.get(a, "") == "" for f in kept for k, a in TPL.variables(item.tags) if k == "field" and a != "name")
            for field in kept:
                row: dict = {
                    "_layout": layout.number, "ds_type": field.ds_type, "first_value": item.first_value,
                    "interval_gauge": layout.entry.reset_on_read, "_optional": lacking, "_digits": field.index in digits,
                    "_at": 1 + len(slots.extra) + len(layout.entry.variables) + field.index - 1,
                }
                texts = dict(zip(RENDERED, (item.measurement, item.host, item.plugin, item.plugin_instance, item.type_instance, item.name, "${field:name}")))
                for name, template in texts.items():
                    self._cut(row, name, _filled(template, field), layout)
                pairs = [] if item.tags.strip() in ("", "NA") else item.tags.split()
                pairs = [p.split("=", 1) for p in pairs]
                pairs = [(k, v) for k, v in ((k, _filled(v, field)) for k, v in pairs) if v or not lacking]
                row["_keys"] = [k for k, _ in pairs]
                for j, (_, template) in enumerate(pairs):
                    self._cut(row, f"tag{j}", template, layout)
                self.tags = max(self.tags, len(pairs))
                rows.append(row)
        self.rows = rows

    def _cut(self, row: dict, name: str, template: str, layout: Layout) -> None:
        """Constants and slots of a template, in turns."""
        at, n = 0, 0
        for match in TPL._VARIABLE.finditer(template):
            row[f"_{name}_{n}"] = template[at : match.start()]
            row[f"_{name}_s{n}"] = self.slots.at(layout, *match.groups())
            at, n = match.end(), n + 1
        row[f"_{name}_{n}"] = template[at:]
        self.width[name] = max(self.width.get(name, 0), n)

    def frame(self, spark: SparkSession) -> DataFrame:
        types = {"_layout": pa.int32(), "ds_type": pa.string(), "first_value": pa.float64(), "interval_gauge": pa.bool_(),
                 "_optional": pa.bool_(), "_digits": pa.bool_(), "_at": pa.int32(), "_keys": pa.list_(pa.string())}
        for name, n in self.width.items():
            types |= {f"_{name}_{k}": pa.string() for k in range(n + 1)} | {f"_{name}_s{k}": pa.int32() for k in range(n)}
        schema = pa.schema(list(types.items()))
        return spark.createDataFrame(pa.Table.from_pylist([{c: r.get(c) for c in types} for r in self.rows], schema))

    def rendered(self, name: str) -> str:
        """SQL of one part; a row with fewer pieces than the widest has nulls behind them."""
        n = self.width.get(name, 0)
        parts = [f"_{name}_0"]
        for k in range(n):
            parts += [f"coalesce(get({SLOTS}, _{name}_s{k}), '')", f"coalesce(_{name}_{k + 1}, '')"]
        return f"concat({', '.join(parts)})" if n else parts[0]

    def tag_map(self) -> str:
        """SQL of the tags; where a field of the item lacks an attribute, tags without a value are left out."""
        if not self.tags:
            return TPL.NO_TAGS
        values = f"slice(array({', '.join(self.rendered(f'tag{j}') for j in range(self.tags))}), 1, size(_keys))"
        made = f"map_from_arrays(_keys, {values})"
        if not any(r["_optional"] for r in self.rows):
            return made
        left = [f"nullif({self.rendered(f'tag{j}')}, '')" for j in range(self.tags)]
        keys = [f"CASE WHEN {v} IS NOT NULL THEN get(_keys, {j}) END" for j, v in enumerate(left)]
        some = f"map_from_arrays(array_compact(array({', '.join(keys)})), array_compact(array({', '.join(left)})))"
        return f"CASE WHEN _optional THEN {some} ELSE {made} END"

    def value(self) -> str:
        """SQL of the number: groups of digits only need no pattern to be read."""
        text = f"get({SLOTS}, _at)"
        return f"CASE WHEN _digits AND length({text}) BETWEEN 1 AND 18 THEN CAST(CAST({text} AS bigint) AS double) ELSE {X.number(text)} END"


def numbered_case(of: str, cases: Mapping[int, str], otherwise: str = "NULL") -> Column:
    return F.expr(f"CASE {of} {' '.join(f'WHEN {n} THEN {then}' for n, then in cases.items())} ELSE {otherwise} END") if cases else F.expr(otherwise)
