"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Pin what results depend on and turn on runtime re-planning.

    Windows are aligned to the epoch, so the session time zone must be UTC.
    Java does not compile methods of over 8000 bytes, and extraction's stages
    generate such ones; with the limit they run as operators of small methods.
    Nothing about cluster size is set here: shuffle partitions, executor memory
    and the checkpoint folder belong to the cluster's own configuration.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for stream checkpoints and work tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    run without one, and then a fresh temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tallyflow-")


def few_files(rows: DataFrame, by: Sequence[str], within: Sequence[Column | str]) -> DataFrame:
    """Rows dealt so that each task writes to few partitions of a table partitioned ``by`` these columns.

    Rebalancing needs adaptive execution.  A stream with state has none, and there the hint does nothing: every task would
    write a file for every partition.  Such rows are dealt by ranges instead, which ``within`` lets split a large partition.
    """
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return rows.hint("rebalance", *by)
    return rows.repartitionByRange(*by, *within)
