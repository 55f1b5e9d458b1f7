"""Tables the operators exchange, and how a tag is read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = T.MapType(T.StringType(), T.StringType())

SNAPSHOT_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("collected_at", T.TimestampType()),
        T.StructField("content", T.StringType()),
        T.StructField("extra_tags", TAGS),
    ]
)

POINT_SCHEMA = T.StructType(
    [
        T.StructField("measurement", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("tags", TAGS),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ds_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

#: The five-part identifier that may travel beside a point.
IDENTIFIER = ("host", "plugin", "plugin_instance", "type", "type_instance")

#: The collector's host is published under this tag name.
HOST_TAG = "fqdn"


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def tag(df: DataFrame, name: str) -> Column:
    """Column for a tag: a promoted top-level column, the host, or the map.

    A tag the point does not carry reads as the empty string, so grouping by an
    absent tag gives one group and never an error.
    """
    if has_column(df, name):
        return F.col(name)
    if name == HOST_TAG and has_column(df, "host"):
        return F.coalesce(F.col("host"), F.lit(""))
    if has_column(df, "tags"):
        return F.coalesce(F.try_element_at(F.col("tags"), F.lit(name)), F.lit(""))
    raise ValueError(f"no column or tag named {name!r}")


def tag_columns(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [tag(df, name).alias(name) for name in names]


def with_series(df: DataFrame, by: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Make the columns that identify one series, and return their names.

    With ``by`` the series is those columns or tags.  Without it, it is the
    measurement, the host and the whole tag set; the map is kept comparable as
    its sorted entries, so equality is exact and no hash is trusted.
    """
    if by is not None:
        added = [name for name in by if not has_column(df, name)]
        return df.select("*", *tag_columns(df, added)), list(by)
    keys = [k for k in ("measurement", "host") if has_column(df, k)]
    entries = F.sort_array(F.map_entries(F.coalesce(F.col("tags"), F.create_map().cast(TAGS))))
    return df.withColumn("_series_tags", entries), [*keys, "_series_tags"]


def series_key(df: DataFrame) -> Column:
    """64-bit hash of a series, for spreading work only (never for equality)."""
    parts = [F.col(k) for k in ("measurement", "host") if has_column(df, k)]
    return F.xxhash64(*parts, F.sort_array(F.map_entries("tags")))


def series_hashes(df: DataFrame, by: Sequence[str] | None) -> list[Column]:
    """Two 64-bit hashes that stand for a series: those columns or tags, or the measurement, the host and all tags."""
    if by is not None:
        parts = tag_columns(df, by)
    else:
        parts = [F.col(k) for k in ("measurement", "host") if has_column(df, k)]
        parts.append(F.sort_array(F.map_entries(F.coalesce(F.col("tags"), F.create_map().cast(TAGS)))))
    # A hash skips nulls, so which parts are null is hashed too.
    nulls = F.concat(*[F.when(p.isNull(), "0").otherwise("1") for p in parts])
    return [F.xxhash64(F.lit(seed), nulls, *parts) for seed in (1, 2)]


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since the epoch with their fraction, as a double."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / F.lit(1e6)
