"""What the document operators share: reading, row keys, names, checkpoints, connected components."""

from __future__ import annotations

import os
import pickle
import re
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of whole texts handed to Python at once; a batch then holds a few MB of usual texts.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in small Arrow batches, unless the session already asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def one_thread_each() -> None:
    """Keep a task's tokenizer on the task's own core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def ship(spark: SparkSession, model: Any) -> Broadcast:
    """Broadcast an object of this package, with its class, for ``received``; its size must have a proven bound."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(shared: Broadcast) -> Any:
    return pickle.loads(shared.value)


def lend(spark: SparkSession, given: Any) -> Broadcast:
    """Broadcast plain values of which each worker process makes something once, by ``made``."""
    return spark.sparkContext.broadcast({"given": given})


def made(lent: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What ``make`` gives for the lent values; a worker process keeps it from task to task, as it keeps the broadcast."""
    value = lent.value
    if "made" not in value:
        value["made"] = make(value["given"])
    return value["made"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made from these that no column of the table has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def checkpointed(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again, so that its lineage ends there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tallyflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges between two numeric columns; root is the smallest node reachable.

    Alternating large-star and small-star steps, each an aggregate and a join over the edges left; a node's
    neighbours are never gathered.  Rounds grow with the logarithm of the longest path, not with its length.
    """
    edges = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi != lo").distinct()
    edges = checkpointed(edges)
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(edges.select("lo", "hi"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("root").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("root"))
        rest = large.join(low, "hi").where("lo != root").select(F.col("lo").alias("hi"), F.col("root").alias("lo"))
        edges = checkpointed(low.select("hi", F.col("root").alias("lo")).union(rest).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


