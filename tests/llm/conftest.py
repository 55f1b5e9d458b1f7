import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SCHEMA = "doc_id bigint, text string, m string, th int, removed int, n_chars bigint"


def sentence(seed: int, n: int) -> str:
    """Words that follow from the seed; different seeds have almost no phrase in common."""
    out, x = [], seed * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w%x" % (x >> 8 & 0xFFFF))
    return " ".join(out)


def odd_rows():
    """Null and empty texts, null ids, repeated rows, a long text without blanks, a very long one, odd characters."""
    texts = [
        None, "", " \n\t ", sentence(1, 60), sentence(1, 60), "x" * 30_000, "12 " * 5_000, sentence(2, 30_000),
        "é ñ <|endoftext|> 漢字 \x00 \U0001f600 it's", "one\n\ntwo\n", "a@b.co " * 3,
    ]
    rows = [(k, t, "m", 1, 2, 3) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, sentence(3, 40), None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def write_tables(spark, folder, docs, labels=(), benchmark=(), conversations=()):
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(list(conversations), schema).write.parquet(f"{folder}/conversations.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)
