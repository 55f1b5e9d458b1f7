"""From raw documents to token ids: quality rules, line dedup, near-copies, decontamination, encoding.

Every stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet into the shared folder and
reads it again as the next stage's documents.  All stages but the last return the columns of ``documents``; the last adds
``n_tokens`` and ``ids`` (columns of these names get underscores in front).  A stage handles null and empty texts, repeated rows, null ids and empty tables as the operator
that it calls; columns other than ``doc_id``, ``text`` and ``n_chars`` pass through.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import bpe, line_dedup, quality_rules, simhash_golay, templates
from tallyflow.llm.common import fresh, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality_rules.accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines; those of which no word is left go, n_chars is counted anew."""
    (removed,) = fresh(docs, "removed")
    cut = line_dedup.deduplicated(docs, removed=removed)
    cut = cut.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        cut = cut.withColumn("n_chars", F.coalesce(changed, "n_chars"))
    return cut.select(*[f"`{c}`" for c in docs.columns])


#: Words of a shingle and differing bits that link two fingerprints.
SHINGLE, RADIUS = 3, 3


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: fingerprints of three-word shingles linked at three or fewer bits."""
    return simhash_golay.first_of_each(docs, shingle=SHINGLE, radius=RADIUS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no passage in common with a benchmark item."""
    return templates.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; columns that have the results' names move to fresh ones."""
    clashing = [c for c in docs.columns if c.lower() in ("ids", "n_tokens")]
    moved = dict(zip(clashing, fresh(docs.withColumns({c: F.lit(None) for c in ("ids", "n_tokens")}), *clashing)))
    encoded = bpe.encode(docs.withColumnsRenamed(moved), bpe.read_spec(TOKENIZER))
    return encoded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_copy_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", encoding_stage),
]

#: Near-copy groups and token ids cannot be expressed in SQL; tests compare each stage with a plain version instead.
ORACLE_SQL = None


def _work_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyflow-")
    return f"{folder}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    folder = _work_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
