"""Add-one word model, the plain measure that context-tree scores are reported beside.

Tokens are the words of a text in lower case (A-Z only) and one end.  Training counts are a shuffled sum.  For scoring,
words that make up at least one in ``2 ** SHARE`` training tokens (so at most 2 ** SHARE of them) are broadcast; a
document's other words leave its task as rows (row, word, times) and meet their counts in a join.  Each document's
own totals travel in one more such row, under a key that no word has, so texts are read once.

Defined cases: a null text is an empty one, whose only token is the end; null ids and repeated rows are rows of their
own; with nothing to learn from every count is zero; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import checkpointed, small_batches

SHARE = 20
#: The end of a text; no word has a blank.
END = b" "
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z and ASCII white space only


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n) over all texts, ends included."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(held: Counter) -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                held.update(words(t))
                held[END] += 1
            if len(held) >= HELD:
                yield table(held)
                held = Counter()
        if held:
            yield table(held)

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def scored(
    docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The kept (numeric) columns, n_tokens, n_known, train_tokens and base_score of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = checkpointed(counted(training, text))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = counts.where(F.col("n") * (1 << SHARE) >= F.lit(tokens)).collect()  # at most 2 ** SHARE words
    heavy = spark.sparkContext.broadcast({bytes(r["word"]): r["n"] for r in frequent})
    norm = math.log10(tokens + distinct + 1)
    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: (n, math.log10(n + 1) - norm) for w, n in heavy.value.items()}
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, word, times, n_tokens, n_known, base, own = [], [], [], [], [], [], []
            for k, t in enumerate(batch.column(len(keep)).cast(pa.binary()).to_pylist()):
                tally = Counter(words(t))
                tally[END] += 1
                total, met, value = 0, 0, 0.0
                for w, n in tally.items():
                    total += n
                    if w in known:
                        met += n
                        value += n * known[w][1]
                    else:
                        rows.append(at)
                        word.append(w)
                        times.append(n)
                rows.append(at)
                word.append(b" %d" % at)
                times.append(0)
                missing = len(rows) - 1 - len(own)
                n_tokens += [0] * missing + [total]
                n_known += [0] * missing + [met]
                base += [0.0] * missing + [value]
                own += [None] * missing + [k]
                at += 1
            index = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(word, pa.binary()), pa.array(times, pa.int64()),
                 pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                 *[batch.column(i).take(index) for i in range(len(keep))]],
                ["row", "word", "times", "n_tokens", "n_known", "base", *keep],
            )

    rows = docs.select(*keep, text).mapInArrow(
        run, f"row bigint, word binary, times bigint, n_tokens bigint, n_known bigint, base double, {kept}"
    )
    rare = counts.where(F.col("n") * (1 << SHARE) < F.lit(tokens))
    c = F.coalesce("n", F.lit(0))
    known = F.when(c > 0, F.col("times")).otherwise(0)
    joined = rows.join(rare, "word", "left")
    return (
        joined.groupBy("row")
        .agg(
            *[F.max(k).alias(k) for k in keep],
            F.sum(F.col("n_tokens")).alias("n_tokens"),
            F.sum(F.col("n_known") + known).alias("n_known"),
            F.sum(F.col("base") + F.col("times") * (F.log10(c + 1) - norm)).alias("base_score"),
        )
        .select(*keep, "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score")
    )
