"""Shares of a total per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.functions.tags import size_order
from tallyflow.model import with_series


def distribution(
    points: DataFrame,
    by: Sequence[str],
    bucket: str = "size",
    *,
    cumulative: bool = False,
    value: str = "value",
) -> DataFrame:
    """Percentage of the group's total in each bucket, null when the total is 0.

    Points are summed per (group, bucket) first; the window then runs over a
    group's buckets only, a few dozen rows however many points there were.
    Buckets are ordered by the size their label stands for.
    """
    rows, keys = with_series(points, [*by, bucket])
    summed = rows.groupBy(*keys).agg(F.sum(value).alias("amount"))
    whole = Window.partitionBy(*by)
    share = F.try_divide(F.lit(100.0) * F.col("amount"), F.sum("amount").over(whole))
    out = summed.withColumn("bucket_order", size_order(F.col(bucket))).withColumn("share", share)
    if cumulative:
        upto = whole.orderBy("bucket_order", bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = F.try_divide(F.lit(100.0) * F.sum("amount").over(upto), F.sum("amount").over(whole))
        out = out.withColumn("cum_share", part)
    return out
