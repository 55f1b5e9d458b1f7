"""Series, buckets and the tables shown beside graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.model import has_column, tag_columns, with_series

_FUNCTIONS = {
    "mean": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "last": lambda v: F.max_by(v, "ts"),
    "first": lambda v: F.min_by(v, "ts"),
}


def series(points: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Raw points split by tags, ordered by tags and time."""
    return points.select(*tag_columns(points, by), ts, value).orderBy(*by, ts)


def series_summary(points: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Average, maximum and current (newest) value of each series."""
    rows, keys = with_series(points, by)
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("avg"),
        F.max(value).alias("max"),
        F.max_by(value, ts).alias("current"),
    )


def top(
    table: DataFrame, n: int | None = None, *, column: str = "current", descending: bool = True, ties: Sequence[str] = ()
) -> DataFrame:
    """The table sorted by one column; with ``n`` only the first rows (top-k)."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    ordered = table.orderBy(key, *ties)
    return ordered if n is None else ordered.limit(n)


def latest(points: DataFrame, by: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Newest point of each series, from one hash aggregate and no sort.

    A point is known by its series and time; were there two, either may be shown.
    """
    rows, keys = with_series(points, by)
    newest = rows.groupBy(*keys).agg(F.max(ts).alias("_newest"), F.max_by(value, ts).alias("_value"))
    return newest.select(*keys, F.col("_newest").alias(ts), F.col("_value").alias(value))


def bucket(
    points: DataFrame,
    step: str,
    by: Sequence[str] = (),
    *,
    fn: str = "mean",
    fill: str | float | None = None,
    start: Column | None = None,
    end: Column | None = None,
    value: str = "value",
) -> DataFrame:
    """One value per time bucket and tag set.

    ``fill``: None leaves empty buckets out; ``"null"`` emits them without a
    value; ``"previous"`` repeats the last value; a number emits that number.
    Only buckets from the one of ``start`` to the one of ``end`` count, and empty
    ones span all of these (each series' own first and last bucket when not given).
    """
    # The bounds go to the input, so that they reach a stored table's scan.
    if start is not None:
        points = points.where(F.col("ts") >= _floor(start, step))
        if has_column(points, "date"):
            points = points.where(F.col("date") >= F.to_date(_floor(start, step)))
    if end is not None:
        after = _floor(end, step) + F.expr(f"interval {step}")
        points = points.where(F.col("ts") < after)
        if has_column(points, "date"):
            points = points.where(F.col("date") <= F.to_date(after))
    rows, keys = with_series(points, list(by))
    found = (
        rows.groupBy(F.window("ts", step).alias("w"), *keys)
        .agg(_FUNCTIONS[fn](F.col(value)).alias(value))
        .select(*keys, F.col("w.start").alias("bucket"), value)
    )
    if fill is None:
        return found
    seconds = _seconds(step)
    timed = found.select(*keys, F.unix_seconds("bucket").alias("_at"), value)
    # Without keys all buckets are one series, so its blocks are put into blocks once more.
    blocks = [FILL_BLOCK * seconds] if keys else [FILL_BLOCK * seconds, FILL_BLOCK**2 * seconds]
    following = _with_following(timed, keys, blocks)
    high = F.col("_at") if end is None else F.unix_seconds(_floor(end, step))
    spans = following.withColumn("_last", F.coalesce(F.col("_following") - seconds, high)).drop("_following")
    if start is not None:
        low = F.unix_seconds(_floor(start, step))
        before = timed.groupBy(*keys).agg(F.min("_at").alias("_first")).where(F.col("_first") > low)
        nothing = F.lit(None).cast(timed.schema[value].dataType)
        spans = spans.unionByName(before.select(*keys, low.alias("_at"), nothing.alias(value), (F.col("_first") - seconds).alias("_last")))
    # A span is unfolded in two steps, so no array is longer than a block, however long a series was silent.
    pieces = spans.select("*", F.explode(F.sequence("_at", "_last", F.lit(FILL_BLOCK * seconds))).alias("_piece"))
    upto = F.least(F.col("_last"), F.col("_piece") + (FILL_BLOCK - 1) * seconds)
    full = pieces.select(*keys, "_at", value, F.explode(F.sequence("_piece", upto, F.lit(seconds))).alias("_slot"))
    own = F.lit(True) if fill == "previous" else F.col("_slot") == F.col("_at")
    filled = F.when(own, F.col(value))
    if fill not in ("null", "previous"):
        filled = F.coalesce(filled, F.lit(float(fill)))
    return full.select(*keys, F.timestamp_seconds("_slot").alias("bucket"), filled.alias(value))


#: Steps of a block when empty buckets are filled.
FILL_BLOCK = 4096


def _with_following(rows: DataFrame, keys: Sequence[str], blocks: Sequence[int]) -> DataFrame:
    """Rows with the next row's ``_at`` in their series, null behind the last.

    A series is cut into blocks of time that are sorted on their own; what a block cannot tell is what follows its last
    row.  Only each block's first and last rows meet again, in the larger blocks that come next in ``blocks`` and at last
    by series.
    """
    if not blocks:
        return rows.withColumn("_following", F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at")))
    cut = rows.withColumn("_block", F.floor(F.col("_at") / F.lit(blocks[0])))
    w = Window.partitionBy(*keys, "_block").orderBy("_at")
    seen = cut.select("*", F.lead("_at").over(w).alias("_following"), F.lag("_at").over(w).isNull().alias("_opens")).drop("_block")
    inner = seen.where(F.col("_following").isNotNull()).select(*rows.columns, "_following")
    ends = seen.where(F.col("_following").isNull() | F.col("_opens"))
    closes = F.col("_following").isNull().alias(f"_closes{len(blocks)}")
    met = _with_following(ends.select(*rows.columns, closes), keys, blocks[1:])
    return inner.unionByName(met.where(f"_closes{len(blocks)}").select(*rows.columns, "_following"))


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _seconds(step: str) -> int:
    count, unit = step.split()
    return int(count) * _UNITS[unit.rstrip("s")]


def _floor(ts: Column, step: str) -> Column:
    """Start of the epoch-aligned step a time falls in."""
    seconds = F.lit(_seconds(step))
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def extent(
    points: DataFrame,
    by: Sequence[str],
    *,
    window: str | None = None,
    low: str = "value",
    high: str = "value",
) -> DataFrame:
    """Minimum and maximum per tag set, and per time window when one is given."""
    rows, keys = with_series(points, by)
    time = [F.window("ts", window).alias("w")] if window else []
    out = rows.groupBy(*keys, *time).agg(F.min(low).alias("min"), F.max(high).alias("max"))
    if not window:
        return out
    return out.select(*keys, F.col("w.start").alias("window_start"), "min", "max")


def stack(points: DataFrame, by: Sequence[str], series: str, *, order: Column | None = None, value: str = "value") -> DataFrame:
    """Stacked height of each series at each time.

    Points are summed per (time, series) before the running sum, so a window
    holds one row per stacked series and never raw points.
    """
    rows, keys = with_series(points, [*by, series])
    summed = rows.groupBy(*keys, "ts").agg(F.sum(value).alias(value))
    w = Window.partitionBy(*by, "ts").orderBy(order if order is not None else F.col(series))
    running = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return summed.withColumn("stacked", running)
