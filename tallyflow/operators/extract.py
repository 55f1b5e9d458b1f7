"""Text snapshots to tagged points.

One job, one scan: every file is matched to its entry by path, its records are
found, each record is fanned out to points.  All of it is column expressions,
one ``explode`` and broadcast joins with the catalog's own small tables, so there is
no shuffle, any file is handled by the task that read it, and the same function
runs on a stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.definitions import Definition
from tallyflow.functions import template as TPL
from tallyflow.functions import text as X
from tallyflow.functions.tags import extended_fields
from tallyflow.model import TAGS, has_column
from tallyflow.operators import dispatch as D

#: item name -> alternatives (OR) of rules (AND) of (field, regex)
Rules = Mapping[str, Sequence[Sequence[tuple[str, str]]]]


@dataclass(frozen=True)
class ExtendedParse:
    """Tags read from one captured group of an item with a second regex.

    By default every named group becomes a tag; ``tags`` may name them otherwise,
    as ``k=${extendfield:name}`` pairs.  Without a match the tags stay as they were.
    """

    item: str
    field: str
    pattern: str
    names: tuple[str, ...]
    tags: str = ""

    def tag_map(self, text: str) -> str:
        if not self.tags:
            return extended_fields(text, self.pattern, self.names)
        rx = X.literal(self.pattern)
        groups = {n: f"regexp_extract({text}, {rx}, {i})" for i, n in enumerate(self.names, start=1)}
        made = TPL.render_tags(self.tags, {"extendfield": groups.__getitem__})
        return f"CASE WHEN {text} RLIKE {rx} THEN {made} ELSE {TPL.NO_TAGS} END"


def extract(
    snapshots: DataFrame,
    catalog: Definition | Mapping[str, Definition],
    *,
    select: Sequence[str] | None = None,
    rules: Rules | None = None,
    drop_fields: Sequence[str] = (),
    extended: Sequence[ExtendedParse] = (),
    every: Mapping[str, int] | None = None,
    interval: int = 60,
) -> DataFrame:
    """Points found in the snapshots.

    ``catalog`` is one definition, or one per value of the ``version`` column
    when snapshots of mixed system versions arrive together; either way the
    input is scanned once.  ``every`` names items that are read in each N-th
    collect interval only (of ``interval`` seconds); in the others their records
    are not even looked for.
    """
    found = D.sources(catalog, select)
    layouts = D.layouts(found, every or {})
    slots = D.Slots(layouts)
    matched = _match(_with_optional_columns(snapshots), found)
    records = _find_records(matched, layouts, slots, interval)
    if rules:
        records = records.where(_rules_hold(layouts, slots, rules))
    return _fan_out(records, layouts, slots, extended, frozenset(drop_fields))


def match_path(snapshots: DataFrame, definition: Definition) -> DataFrame:
    """Snapshots a definition covers, with the path variables as ``path_tags``."""
    given = _with_optional_columns(snapshots)
    matched = _match(given, D.sources(definition, None))
    return matched.select(*given.columns, F.map_from_arrays("_variables", "_groups").alias("path_tags"))


def decimate(snapshots: DataFrame, every: int, interval: int = 60) -> DataFrame:
    """Keep only the snapshots of every N-th collect interval."""
    slot = F.floor(F.unix_seconds("collected_at") / F.lit(interval))
    return snapshots.where(slot % F.lit(every) == 0)


def as_gauges(points: DataFrame, words: Sequence[str] = ("min", "max")) -> DataFrame:
    """Treat running minima and maxima as gauges.

    The catalogs declare every column of a statistics line a counter, as the
    systems they come from do; a rate of a running minimum means nothing, so this
    is for whoever wants the reading itself.
    """
    word = "|".join(words)
    extreme = F.col("measurement").rlike(f"_({word})(_|$)") | F.col("field").rlike(f"^({word})_")
    return points.withColumn("ds_type", F.when(extreme, F.lit("gauge")).otherwise(F.col("ds_type")))


# How a command prints the time its output was produced.
PRODUCED_AT_PATTERN = r"[A-Z][a-z]{2} ([A-Z][a-z]{2} [ 0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4})"
PRODUCED_AT_FORMAT = "MMM d HH:mm:ss yyyy"


def produced_at(content: Column) -> Column:
    stamp = F.regexp_replace(F.regexp_extract(content, PRODUCED_AT_PATTERN, 1), " +", " ")
    return F.try_to_timestamp(stamp, F.lit(PRODUCED_AT_FORMAT))


def drop_stale(snapshots: DataFrame, max_age: int = 60) -> DataFrame:
    """Drop output that was produced too long before it was collected.

    Age is measured against the collection time, not against the clock, so a
    replay gives the same answer.  The first word of every line (the node the
    line came from) is dropped from what is kept.
    """
    age = F.unix_seconds("collected_at") - F.unix_seconds(produced_at(F.col("content")))
    fresh = snapshots.where(age < F.lit(max_age))
    return fresh.withColumn("content", F.regexp_replace("content", r"(?m)^[ \t]*[^ \t\n]+[ \t]*", " "))


def _with_optional_columns(snapshots: DataFrame) -> DataFrame:
    if not has_column(snapshots, "extra_tags"):
        snapshots = snapshots.withColumn("extra_tags", F.create_map().cast(TAGS))
    return snapshots


def _match(snapshots: DataFrame, found: Sequence[D.Source]) -> DataFrame:
    """Snapshots of the catalog with the number of their entry, its variables and their values."""
    split = _of_interest(snapshots, found).withColumn("_segments", F.split("path", "/"))
    routed = split.withColumn("_sources", F.expr(f"array({D.path_tree(found)})")).drop("_segments")
    routed = _unfold(routed, "_sources", "_source")
    # As many rows as the catalog has entries, whatever the data.
    joined = routed.join(F.broadcast(D.source_table(snapshots.sparkSession, found)), "_source")
    matched = joined.where("path RLIKE _path")
    if any(s.versions for s in found):
        matched = matched.where("_versions IS NULL OR array_contains(_versions, version)")
    groups = f"CASE WHEN _path_groups IS NULL THEN CAST(array() AS array<string>) ELSE {X.captured('path', '_path', '_path_groups')} END"
    return matched.withColumn("_groups", F.expr(groups))


def _of_interest(snapshots: DataFrame, found: Sequence[D.Source]) -> DataFrame:
    """Snapshots whose path starts like one of the entries'.

    A scan can use this filter, so row groups without such paths are not read.
    """
    starts = sorted({s.entry.prefix for s in found})
    shortest = [s for s in starts if not any(s != t and s.startswith(t) for t in starts)]
    return snapshots.where(F.expr(" OR ".join(f"startswith(path, {X.literal(s)})" for s in shortest)))


def _unfold(rows: DataFrame, column: str, name: str) -> DataFrame:
    """One row per element of an array column.

    The outer form followed by a null check gives the rows of the plain form, but
    keeps the optimizer from also filtering on the array's size before: that
    filter would be pushed down to the text and find every match a second time.
    What comes out is a plain column, so later steps never repeat its expression.
    """
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def _find_records(matched: DataFrame, layouts: Sequence[D.Layout], slots: D.Slots, interval: int) -> DataFrame:
    """One row per record: which layout it has, and its slots."""
    kept = ["host", "collected_at", "extra_tags", "_groups", "_layout", "_pattern", "_record_groups"]
    # As many rows as the catalog has items, whatever the data.
    read = matched.join(F.broadcast(D.item_table(matched.sparkSession, layouts)), "_source")
    if any(x.every > 1 for x in layouts):
        read = read.where(F.floor(F.unix_seconds("collected_at") / F.lit(interval)) % F.col("_every") == 0)
    scope = "content"
    if any(x.item.region for x in layouts):
        scope = "CASE WHEN _region IS NULL THEN content ELSE regexp_extract(content, _region, _region_group) END"
    found = read.select(*kept, F.expr(X.records(scope, "_pattern")).alias("_found")).transform(_unfold, "_found", "_record")
    captures = F.expr(X.captured("_record", "_pattern", "_record_groups")).alias("_captures")
    return found.select("host", "collected_at", "extra_tags", "_groups", "_layout", captures).select(
        "collected_at", "_layout", F.expr(slots.columns()).alias(D.SLOTS)
    )


def _rules_hold(layouts: Sequence[D.Layout], slots: D.Slots, rules: Rules) -> Column:
    """True for records no rule covers and for records whose rules match."""
    cases = {}
    for layout in layouts:
        env = slots.environment(layout)
        named = []
        for ruled in sorted(set(layout.item.names()) & set(rules)):
            alternatives = [
                " AND ".join(f"{env['content'](f)} RLIKE {X.literal(X.from_posix(rx))}" for f, rx in alternative)
                for alternative in rules[ruled]
            ]
            named.append(f"WHEN {X.literal(ruled)} THEN {' OR '.join(f'({a})' for a in alternatives)}")
        if named:
            cases[layout.number] = f"CASE {TPL.render(layout.item.name, env)} {' '.join(named)} ELSE true END"
    return D.numbered_case("_layout", cases, "true")


def _fan_out(
    records: DataFrame,
    layouts: Sequence[D.Layout],
    slots: D.Slots,
    extended: Sequence[ExtendedParse],
    dropped: frozenset[str],
) -> DataFrame:
    table = D.LayoutTable(layouts, slots, dropped)
    more = {}
    for layout in layouts:
        env = slots.environment(layout)
        made = [e.tag_map(env["content"](e.field)) for e in extended if e.item in layout.item.names()]
        if made:
            more[layout.number] = f"map_concat({', '.join(made)})" if len(made) > 1 else made[0]
    if more:  # once for each record, not for each of its points
        records = records.withColumn("_more", D.numbered_case("_layout", more, TPL.NO_TAGS))
    # As many rows as the catalog has fields, whatever the data.
    points = records.join(F.broadcast(table.frame(records.sparkSession)), "_layout")
    tags = F.map_concat(F.expr(table.tag_map()), "_more") if more else F.expr(table.tag_map())
    rendered = {name: F.expr(table.rendered(name)).alias(name) for name in D.RENDERED}
    out = points.select(
        rendered["measurement"],
        rendered["host"],
        tags.alias("tags"),
        F.col("collected_at").alias("ts"),
        "ds_type",
        F.expr(table.value()).alias("value"),
        rendered["plugin"],
        rendered["plugin_instance"],
        F.col("ds_type").alias("type"),
        rendered["type_instance"],
        rendered["item"],
        rendered["field"],
        "first_value",
        "interval_gauge",
    )
    out = out.where(F.col("value").isNotNull())
    return out.where(~F.col("field").isin(*sorted(dropped))) if dropped else out
