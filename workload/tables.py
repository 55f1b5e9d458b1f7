"""The given tables as points, and the same mapping for the SQL side.

``DIMENSIONS`` are SQL texts both engines read alike, so a query and its check
start from the same tags and differ in how they compute the answer.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.session import tune

#: tag -> expression over events (k is the number in props)
DIMENSIONS = {
    "host": "concat('node', user_id % 10)",
    "fs_name": "concat('fs', k % 2)",
    "ost_index": "concat('OST000', k % 4)",
    "mdt_index": "concat('MDT000', k % 2)",
    "job_id": "concat(event_type, '.', user_id)",
    "uid": "concat('', user_id)",
    "user_id": "concat('', user_id)",
    "exp_client": "concat('10.0.0.', user_id)",
    "optype": "CASE WHEN k < 40 THEN 'sum_read_bytes' WHEN k < 80 THEN 'sum_write_bytes' ELSE 'min_read_bytes' END",
    "direction": "CASE WHEN k % 3 = 0 THEN 'read' ELSE 'write' END",
    "usage": "CASE WHEN k < 50 THEN 'usage_kbytes' ELSE 'usage_inodes' END",
    "mdop": "CASE WHEN k < 30 THEN 'open' WHEN k < 60 THEN 'close' ELSE 'getattr' END",
    "field": "CASE WHEN k % 2 = 0 THEN 'read_sample' ELSE 'write_sample' END",
    "size": "concat(CASE WHEN value < 16 THEN '4K' WHEN value < 64 THEN '64K' WHEN value < 128 THEN '1M' ELSE '8' END, '_Bytes')",
    "controller": "concat('', user_id % 2)",
    "disk_index": "concat('', k % 5)",
    "cpu": "concat('', k % 8)",
    "k_tag": "concat('', k)",
}

EVENTS_SQL = "e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number ``k`` and a zoned timestamp."""
    table = load(spark, sf_dir, "events")
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return table.withColumn("k", number).withColumn("ts", F.col("ts").cast("timestamp"))


def points(
    spark: SparkSession,
    sf_dir: str,
    tags: Mapping[str, str] | list[str],
    *,
    measurement: str = "event_type",
    ds_type: str = "gauge",
) -> DataFrame:
    """Every event as one point; ``measurement`` is an expression over events.

    ``tags``: names of dimensions, or tag -> dimension.
    """
    named = {t: t for t in tags} if isinstance(tags, list) else dict(tags)
    table = events(spark, sf_dir)
    pairs = [c for t, d in named.items() for c in (F.lit(t), F.expr(DIMENSIONS[d]))]
    return table.select(
        F.expr(measurement).alias("measurement"),
        F.expr(DIMENSIONS["host"]).alias("host"),
        F.create_map(*pairs).alias("tags"),
        "ts",
        F.lit(ds_type).alias("ds_type"),
        "value",
    )


def points_sql(tags: Mapping[str, str] | list[str], *, measurement: str = "event_type") -> str:
    """The same points with flat tags as a chain of WITH terms named ``p``."""
    named = {t: t for t in tags} if isinstance(tags, list) else dict(tags)
    columns = ", ".join(f"{DIMENSIONS[d]} AS {t}" for t, d in named.items())
    more = f", {columns}" if columns else ""
    host = DIMENSIONS["host"]
    return (
        f"WITH {EVENTS_SQL}, p AS (SELECT {measurement} AS measurement, {host} AS host, ts, sec, value{more} FROM e)"
    )


def seconds(column: str) -> F.col:
    return F.unix_seconds(column).alias(column)
