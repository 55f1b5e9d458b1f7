"""Counters to per-second rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyflow.model import epoch_seconds, has_column, series_hashes

#: What to do when a counter is lower than before.
RESET_POLICIES = ("keep", "null", "zero_base")


def rate_of(
    value: Column,
    at: Column,
    previous: Column,
    previous_at: Column,
    *,
    on_reset: str = "keep",
    first_value: Column | None = None,
    interval: float = 60.0,
) -> Column:
    """Rate between two readings of one counter (times in seconds)."""
    if on_reset not in RESET_POLICIES:
        raise ValueError(f"on_reset must be one of {RESET_POLICIES}")
    delta, elapsed = value - previous, at - previous_at
    rate = F.try_divide(delta, elapsed)
    if on_reset == "null":
        rate = F.when(delta >= 0, rate)
    elif on_reset == "zero_base":
        rate = F.when(delta >= 0, rate).otherwise(F.try_divide(value, elapsed))
    if first_value is not None:
        rate = F.when(previous_at.isNull(), (value - first_value) / F.lit(float(interval))).otherwise(rate)
    return rate


def counters_and_gauges(points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Points that count up, and those that pass through (none if the table does not tell)."""
    if not has_column(points, "ds_type"):
        return points, None
    is_counter = F.col("ds_type") == "derive"
    if has_column(points, "interval_gauge"):
        is_counter &= ~F.coalesce(F.col("interval_gauge"), F.lit(False))
    return points.where(is_counter), points.where(~F.coalesce(is_counter, F.lit(False)))


def rate(
    points: DataFrame,
    by: Sequence[str] | None = None,
    *,
    on_reset: str = "keep",
    first_value: float | None = None,
    interval: float = 60.0,
    chunk: int | None = 3600,
    forget_after: float | None = None,
) -> DataFrame:
    """Replace each counter value by its per-second rate.

    Only ``derive`` points are counters; gauges, and files that reset when they
    are read, pass through.  The first point of a series has no rate unless a
    first value is known (the argument, or the ``first_value`` column).

    One series may hold a large share of all points.  Points are therefore shuffled
    once by (series, time chunk) and sorted there, so a hot series spreads over as
    many tasks as it has chunks.  What a chunk cannot rate is its first point: only
    each chunk's first and last point meet again, by series, and give the seams
    their rates.  Both steps read the same shuffle, so the input is read once.
    ``chunk`` is in seconds: an hour leaves two of sixty points of the usual interval
    to the seams; take less for a hotter series, more for sparse ones.  None turns
    the split off.

    With ``forget_after`` a reading that comes so many seconds or more after the last
    one is the first of a new series.

    A series is known by 128 bits of hash of its identity, so that sorting compares
    numbers and never long tag sets.
    """
    counters, gauges = counters_and_gauges(points)
    series = ["_series", "_series_too"]
    rows = counters.select("*", *[c.alias(n) for c, n in zip(series_hashes(counters, by), series)])
    keys = [*series, "_chunk"]
    rows = rows.withColumn("_chunk", F.lit(0) if chunk is None else F.floor(F.unix_seconds("ts") / F.lit(int(chunk))))
    first = F.lit(float(first_value)) if first_value is not None else None
    if first is None and has_column(points, "first_value"):
        first = F.col("first_value")

    def rated(of: DataFrame, within: WindowSpec, wanted: Column) -> DataFrame:
        before, before_at = F.lag("value").over(within), F.lag("ts").over(within)
        known = of.select("*", before.alias("_before"), before_at.alias("_before_at")).where(wanted)
        if forget_after is not None:
            recent = epoch_seconds("ts") - epoch_seconds("_before_at") < F.lit(float(forget_after))
            known = known.withColumns({c: F.when(recent, F.col(c)) for c in ("_before", "_before_at")})
        made = rate_of(
            F.col("value"), epoch_seconds("ts"), F.col("_before"), epoch_seconds("_before_at"),
            on_reset=on_reset, first_value=first, interval=interval,
        )
        return known.withColumn("value", made).where(F.col("value").isNotNull()).select(*points.columns)

    in_chunk = Window.partitionBy(*keys).orderBy("ts", "value")
    if chunk is None:
        out = rated(rows, in_chunk, F.lit(True))
    else:
        inner = rated(rows, in_chunk, F.col("_before_at").isNotNull())
        ends = rows.select("*", F.lag("ts").over(in_chunk).isNull().alias("_first"), F.lead("ts").over(in_chunk).isNull().alias("_last"))
        ends = ends.where("_first OR _last")
        out = inner.unionByName(rated(ends, Window.partitionBy(*series).orderBy("ts", "value"), F.col("_first")))
    return out if gauges is None else out.unionByName(gauges)


def per_interval(points: DataFrame, seconds: float = 60.0, value: str = "value") -> DataFrame:
    """Amount gathered over one collect interval as a per-second value."""
    return points.withColumn(value, F.col(value) / F.lit(float(seconds)))
