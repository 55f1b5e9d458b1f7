"""Points derived from two points of one host, tag set and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.definitions import MathEntry
from tallyflow.model import has_column, with_series


def apply_math(
    points: DataFrame,
    entries: Sequence[MathEntry],
    by: Sequence[str] | None = None,
    *,
    window: str | None = None,
) -> DataFrame:
    """Differences and ratios of measurements.

    Both operands are brought together by one conditional aggregate, not by a
    self join: a point is emitted once per output it feeds, with its side, and
    each (series, time, output) group keeps the value of either side.  One
    shuffle serves any number of entries.  An output needs both operands, and a
    ratio over zero has no value.  With ``window`` operands are aligned within
    that span instead of at equal times, which is what a stream needs.

    Where points carry their identifier, operands also agree in plugin and plugin
    instance, and the derived point is named by them and its entry's type instance.
    """
    operands = sorted({m for e in entries for m in (e.left, e.right)})
    used = points.where(F.col("measurement").isin(*operands))
    feeds = _feeds(entries)[F.col("measurement")].alias("_feeds")
    source, keys = with_series(used, list(by) if by is not None else None)
    keys = [k for k in keys if k != "measurement"]
    names = [c for c in ("plugin", "plugin_instance") if has_column(points, c) and c not in keys] if by is None else []
    keys += names
    time = F.window("ts", window).alias("at") if window else F.col("ts").alias("at")
    sides = source.select(*keys, time, "value", feeds)
    sides = sides.select(*keys, "at", "value", F.explode_outer("_feeds").alias("feed")).select(*keys, "at", "value", "feed.*")
    both = sides.groupBy(*keys, "at", "output").agg(
        F.max(F.when(F.col("side") == "left", F.col("value"))).alias("_left"),
        F.max(F.when(F.col("side") == "right", F.col("value"))).alias("_right"),
    )
    divided = F.col("output").isin(*[e.output for e in entries if e.operation == "/"])
    value = F.when(divided, F.try_divide("_left", "_right")).otherwise(F.col("_left") - F.col("_right"))
    out = both.select(
        F.col("output").alias("measurement"),
        *[F.map_from_entries(k).alias("tags") if k == "_series_tags" else F.col(k) for k in keys],
        (F.col("at.start") if window else F.col("at")).alias("ts"),
        F.lit("gauge").alias("ds_type"),
        value.alias("value"),
        *([F.lit("gauge").alias("type"), _type_instances(entries).alias("type_instance")] if names else []),
    )
    return out.where(F.col("value").isNotNull())


def with_math(points: DataFrame, entries: Sequence[MathEntry], **options) -> DataFrame:
    """The points and those derived from them, in one table; a derived point lacks what only its operands have.

    Only operands are shuffled, so the points pass by in a scan of their own.  Store text as points first.
    """
    return points.unionByName(apply_math(points, entries, **options), allowMissingColumns=True)


def _type_instances(entries: Sequence[MathEntry]) -> Column:
    named = [c for e in entries for c in (F.lit(e.output), F.lit(e.type_instance))]
    return F.create_map(*named)[F.col("output")]


def _feeds(entries: Sequence[MathEntry]) -> Column:
    """Constant map: measurement -> outputs it feeds, with the side it is on."""
    unknown = {e.operation for e in entries} - {"-", "/"}
    if unknown:
        raise ValueError(f"unknown operations: {sorted(unknown)}")
    feeds: dict[str, list[Column]] = {}
    for e in entries:
        for side, measurement in (("left", e.left), ("right", e.right)):
            struct = F.struct(F.lit(e.output).alias("output"), F.lit(side).alias("side"))
            feeds.setdefault(measurement, []).append(struct)
    parts: list[Column] = []
    for measurement, outputs in feeds.items():
        parts += [F.lit(measurement), F.array(*outputs)]
    return F.create_map(*parts)
