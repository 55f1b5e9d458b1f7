"""Points at rest: writing, selecting, naming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.model import series_key, tag
from tallyflow.session import few_files

#: Tags that get a real column on disk, so filters on them reach the scan.
HOT_TAGS = ("fs_name",)


def write_points(points: DataFrame, path: str, *, hot_tags: Sequence[str] = HOT_TAGS, mode: str = "append") -> None:
    """Write points partitioned by measurement and date.

    Rows are rebalanced on the partition columns before the write: small
    partitions are merged into few files, and one that holds a large share of
    all rows is split over several tasks instead of passing through one.
    """
    _dealt(stored_points(points, hot_tags)).sortWithinPartitions(
        "measurement", "date", *hot_tags
    ).write.mode(mode).partitionBy("measurement", "date").parquet(path)


def _dealt(rows: DataFrame) -> DataFrame:
    return few_files(rows, ["measurement", "date"], [series_key(rows)])


def stored_points(points: DataFrame, hot_tags: Sequence[str] = HOT_TAGS) -> DataFrame:
    """Points with the columns they are stored with."""
    added = [t for t in hot_tags if t not in points.columns]
    return points.select("*", *[tag(points, t).alias(t) for t in added], F.to_date("ts").alias("date"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def select_points(
    points: DataFrame,
    measurement: str,
    *,
    where: Mapping[str, str | Sequence[str]] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Points of one measurement, with tags and times as asked.

    On a stored table the measurement and the date bounds prune partitions.
    """
    return _selected(points, "ts", measurement, where, start, end)


def select_rollups(
    rollups: DataFrame,
    measurement: str,
    *,
    where: Mapping[str, str | Sequence[str]] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Windows of one rollup that start from ``start`` to before ``end``; prunes a stored table like points."""
    return _selected(rollups, "window_start", measurement, where, start, end)


def _selected(
    table: DataFrame,
    time: str,
    measurement: str,
    where: Mapping[str, str | Sequence[str]] | None,
    start: str | None,
    end: str | None,
) -> DataFrame:
    found = in_range(table.where(F.col("measurement") == measurement), time, start, end)
    for name, wanted in (where or {}).items():
        values = [wanted] if isinstance(wanted, str) else list(wanted)
        found = found.where(tag(found, name).isin(*values))
    return found


def in_range(table: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from ``start`` to before ``end``; the days of a stored table are bounded too, which prunes partitions."""
    for bound, is_start in ((start, True), (end, False)):
        if bound is None:
            continue
        at = F.lit(bound).cast("timestamp")
        table = table.where(F.col(time) >= at if is_start else F.col(time) < at)
        if "date" in table.columns:
            day = F.to_date(at)
            table = table.where(F.col("date") >= day if is_start else F.col("date") <= day)
    return table


def tag_values(
    points: DataFrame,
    measurement: str,
    key: str,
    *,
    where: Mapping[str, str] | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Distinct values of one tag, in order, as seen from ``start`` to before ``end``."""
    found = select_points(points, measurement, where=where, start=start, end=end)
    return found.select(tag(found, key).alias(key)).where(F.col(key) != "").distinct().orderBy(key)


def stored_rollups(rolled: DataFrame, hot_tags: Sequence[str] = HOT_TAGS) -> DataFrame:
    """Rollup rows with the columns they are stored with."""
    table = rolled if "tags" in rolled.columns else _with_tag_map(rolled)
    added = [t for t in hot_tags if t not in table.columns]
    return table.select("*", *[tag(table, t).alias(t) for t in added], F.to_date("window_start").alias("date"))


def read_rollups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_rollup(rolled: DataFrame, path: str, *, hot_tags: Sequence[str] = HOT_TAGS, mode: str = "append") -> None:
    """Append rollup rows to the rollup table, partitioned by measurement and date."""
    _dealt(stored_rollups(rolled, hot_tags)).sortWithinPartitions(
        "measurement", "date", *hot_tags
    ).write.mode(mode).partitionBy("measurement", "date").parquet(path)


def replace_rollup(spark: SparkSession, rolled: DataFrame, path: str, *, hot_tags: Sequence[str] = HOT_TAGS) -> None:
    """Put the rows in place of what the table has for their windows; running twice is the same.

    Only the (measurement, date) partitions of these windows are rewritten, and what those hold for other windows
    stays.  The rows are written to one side and moved at the end, so a failed run leaves the table as it was.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        write_rollup(rolled, path, hot_tags=hot_tags)
        return
    new = stored_rollups(rolled, hot_tags)
    windows = new.select("measurement", "date", "window_start").distinct()
    old = read_rollups(spark, path).select(*new.columns)
    touched = old.join(windows.select("measurement", "date").distinct(), ["measurement", "date"], "left_semi")
    others = touched.join(windows, ["measurement", "date", "window_start"], "left_anti").select(*new.columns)
    _dealt(others.unionByName(new)).sortWithinPartitions(
        "measurement", "date", *hot_tags
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("measurement", "date").parquet(path)


def upsert_rollup(spark: SparkSession, rolled: DataFrame, path: str, *, hot_tags: Sequence[str] = HOT_TAGS) -> None:
    """Append rows whose windows the table does not have yet; otherwise put them in place of what it has for them.

    Which windows it has is read from two columns of the days concerned, so new windows cost what they hold and not what
    their day holds already.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = stored_rollups(rolled, hot_tags).select("measurement", "date", "window_start").distinct()
        known = read_rollups(spark, path).select("measurement", "date", "window_start")
        if not known.join(new, ["measurement", "date", "window_start"], "left_semi").isEmpty():
            replace_rollup(spark, rolled, path, hot_tags=hot_tags)
            return
    write_rollup(rolled, path, hot_tags=hot_tags)


def _with_tag_map(rolled: DataFrame) -> DataFrame:
    names = [c for c in rolled.columns if c not in ("measurement", "window_start", "sum")]
    pairs: list[Column] = []
    for name in names:
        pairs += [F.lit(name), F.col(name)]
    return rolled.select("measurement", F.create_map(*pairs).alias("tags"), "window_start", "sum")


def metric_path(df: DataFrame, *, sep: str = "/", prefix: str = "") -> Column:
    """``host/plugin-plugin_instance/type-type_instance``; empty parts are left out.

    With a dot as separator this is the dotted form, and dots inside a part are
    replaced so that they do not add levels.
    """

    def part(*names: str) -> Column:
        present = [F.when(F.col(n) != "", F.col(n)) for n in names if n in df.columns]
        joined = F.concat_ws("-", *present)
        return F.replace(joined, F.lit("."), F.lit("_")) if sep == "." else joined

    levels = [part("host"), part("plugin", "plugin_instance"), part("type", "type_instance")]
    return F.concat(F.lit(prefix), F.concat_ws(sep, *[F.when(level != "", level) for level in levels]))


def spread(points: DataFrame, parts: int) -> DataFrame:
    """Repartition by series hash for a write or a cache that many jobs reuse."""
    return points.repartition(parts, series_key(points))
