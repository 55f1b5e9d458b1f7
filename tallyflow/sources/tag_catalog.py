"""A small table of which tag values occur, kept with the points, so that choosing from a list reads no points.

One row per (measurement, tag, value) with the first and the last day on which it was seen.  It has the size of the tags'
vocabulary, not of the points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.model import HOST_TAG, TAGS, has_column
from tallyflow.sources.keyed_table import KeyedTable

KEYS = ["measurement", "tag", "tag_value"]


def tag_days(points: DataFrame) -> DataFrame:
    """(measurement, tag, tag_value, first_day, last_day) of points; the host counts as a tag, empty values do not."""
    tags = F.coalesce(F.col("tags"), F.create_map().cast(TAGS)) if has_column(points, "tags") else F.create_map().cast(TAGS)
    if has_column(points, "host"):
        # A tag of the same name, if a point has one, stands behind the host.
        tags = F.map_concat(F.map_filter(tags, lambda k, v: k != HOST_TAG), F.create_map(F.lit(HOST_TAG), F.col("host").cast("string")))
    # Points of one tag set fold into one row before tags are taken apart.
    sets = points.groupBy("measurement", F.array_sort(F.map_entries(tags)).alias("_tags")).agg(
        F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day")
    )
    each = sets.select("measurement", F.explode("_tags").alias("t"), "first_day", "last_day")
    return _folded(each.select("measurement", F.col("t.key").alias("tag"), F.col("t.value").alias("tag_value"), "first_day", "last_day").where("tag_value <> ''"))


def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def record(points: DataFrame, path: str, *, buckets: int = 16) -> None:
    """Add the tags of points to the table at ``path``; adding the same points again changes nothing."""
    KeyedTable(points.sparkSession, path, buckets).merge(tag_days(points), KEYS, _folded)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(spark, path).read()


def listed_values(catalog: DataFrame, measurement: str, tag: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Values of a tag, in order.  With bounds: those seen on or after the day of ``start`` and on or before that of ``end``."""
    found = catalog.where((F.col("measurement") == measurement) & (F.col("tag") == tag))
    if start is not None:
        found = found.where(F.col("last_day") >= F.to_date(F.lit(start)))
    if end is not None:
        found = found.where(F.col("first_day") <= F.to_date(F.lit(end)))
    return found.select(F.col("tag_value").alias(tag)).orderBy(tag)


def listed_tags(catalog: DataFrame, where: Mapping[str, str] | None = None) -> DataFrame:
    """(measurement, tag, n_values, first_day, last_day) of all tags, or of those that ``where`` names."""
    for column, wanted in (where or {}).items():
        catalog = catalog.where(F.col(column) == wanted)
    out = catalog.groupBy("measurement", "tag").agg(
        F.count("*").alias("n_values"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")
    )
    return out.orderBy("measurement", "tag")
