"""Declarative text-to-metric definitions.

A ``Definition`` lists entries (which file), items (which records in it) and
fields (which captured group becomes which point).  It holds no data and runs
nothing: ``operators.extract`` turns it into column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

from tallyflow.functions import text as X

#: Stands in a pattern for "one of the item's keys".
KEYS = "%KEYS%"

#: Path variables and what they may match inside one path segment.
PATH_VARIABLES = {
    "fs_name": r"[^/]+",
    "mdt_index": r"MDT[0-9a-fA-F]+",
    "ost_index": r"OST[0-9a-fA-F]+",
    "mdc_tag": r"mdc[^/]+",
    "mdt_exp_client": r"[^/]+",
    "mdt_exp_type": r"[^/@]+",
    "ost_exp_client": r"[^/]+",
    "ost_exp_type": r"[^/@]+",
    "client_uuid": r"[0-9a-fA-F]+",
    "driver_type": r"[^/]+",
    "driver_index": r"[0-9]+",
    "port_number": r"[0-9]+",
}


@dataclass(frozen=True)
class Field:
    """One captured group that becomes a point (groups count from 1)."""

    index: int
    name: str
    attrs: Mapping[str, str] = field(default_factory=dict)
    ds_type: str = "gauge"


@dataclass(frozen=True)
class Between:
    """Only the text after the n-th ``start`` marker, up to ``end``."""

    start: str
    end: str = ""
    occurrence: int = 1

    group = 1

    def pattern(self) -> str:
        return X.between(self.start, self.end, self.occurrence)


@dataclass(frozen=True)
class Section:
    """Only the block under a header line, up to a blank line."""

    header: str

    group = 0

    def pattern(self) -> str:
        return X.section(self.header)


@dataclass(frozen=True)
class RunOfLines:
    """Only the lines right below a header that start with ``line``."""

    header: str
    line: str

    group = 0

    def pattern(self) -> str:
        return X.run_of_lines(self.header, self.line)


@dataclass(frozen=True)
class Item:
    """Records of one layout.

    Strings below are templates over ``${key:hostname}``, ``${subpath:x}``,
    ``${content:x}`` (captured groups by name), ``${field:x}`` (the field's name
    and attributes) and ``${extra_tag:x}``.
    """

    name: str
    pattern: str
    captures: tuple[str, ...]
    fields: tuple[Field, ...]
    measurement: str
    tags: str = ""
    host: str = "${key:hostname}"
    plugin: str = ""
    plugin_instance: str = ""
    type_instance: str = "${field:name}"
    keys: tuple[str, ...] = ()
    region: Between | Section | RunOfLines | None = None
    first_value: float | None = None

    @property
    def regex(self) -> str:
        pattern = self.pattern
        if KEYS in pattern:
            pattern = pattern.replace(KEYS, "|".join(X.quoted(k) for k in self.keys))
        return "(?m)" + pattern

    def names(self) -> list[str]:
        """Item names a user can select, one per key."""
        if not self.keys:
            return [self.name]
        return [re.sub(r"\$\{content:[^}]+\}", k, self.name) for k in self.keys]

    def keep(self, wanted: Callable[[str], bool]) -> Item | None:
        """This item cut down to the wanted names, or nothing."""
        if not self.keys:
            return self if wanted(self.name) else None
        kept = tuple(k for k, n in zip(self.keys, self.names()) if wanted(n))
        return replace(self, keys=kept) if kept else None


@dataclass(frozen=True)
class Entry:
    """One kind of file: its path template and the items found in it."""

    path: str
    items: tuple[Item, ...]
    reset_on_read: bool = False

    @property
    def variables(self) -> list[str]:
        return re.findall(r"\{([a-z_]+)\}", self.path)

    @property
    def regex(self) -> str:
        parts = re.split(r"(\{[a-z_]+\})", self.path)
        out = [
            f"({PATH_VARIABLES[p[1:-1]]})" if p.startswith("{") and p.endswith("}") else X.quoted(p)
            for p in parts
        ]
        return "^" + "".join(out) + "$"

    @property
    def prefix(self) -> str:
        """The constant start of the path."""
        return self.path.split("{", 1)[0]

    @property
    def file_name(self) -> str:
        return re.sub(r"\{[a-z_]+\}", "*", self.path.rsplit("/", 1)[-1])


@dataclass(frozen=True)
class MathEntry:
    """``output = left operation right`` between points of one host, tag set and time."""

    left: str
    operation: str
    right: str
    output: str
    type_instance: str


@dataclass(frozen=True)
class Definition:
    name: str
    entries: tuple[Entry, ...]
    math: tuple[MathEntry, ...] = ()

    def item_names(self) -> list[str]:
        return [n for e in self.entries for i in e.items for n in i.names()]

    def file_names(self) -> list[str]:
        """Distinct file name globs, to read only files the definition uses."""
        return sorted({e.file_name for e in self.entries})

    def select(self, names: Iterable[str]) -> Definition:
        """The definition with only the named items left in the plan."""
        wanted = set(names)
        unknown = wanted - set(self.item_names())
        if unknown:
            raise ValueError(f"unknown items: {sorted(unknown)}")
        return self._keep(wanted.__contains__)

    def without(self, names: Iterable[str]) -> Definition:
        dropped = set(names)
        return self._keep(lambda n: n not in dropped)

    def _keep(self, wanted: Callable[[str], bool]) -> Definition:
        entries = []
        for entry in self.entries:
            items = tuple(i for i in (item.keep(wanted) for item in entry.items) if i is not None)
            if items:
                entries.append(replace(entry, items=items))
        return replace(self, entries=tuple(entries))
