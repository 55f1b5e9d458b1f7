"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a vector of log-weighted term counts: hashed words, hashed word shapes (which characters a word is made of)
and a few terms for the text as a whole (its length, how much of it repeats, how many lines it has).  Singular vectors
of a bounded, balanced sample of labelled texts span the latent space.  The sample's vectors are broadcast, and every
document is compared with all of them in blocks of exact cosine products; the nearest vote, weighted by similarity and
by how far their class was thinned out by balancing.

The sample takes at most ``REFERENCES`` labelled rows, half of each class, those with the least hash of their id; it is
the only thing that is ever gathered, with at most ``TERMS`` numbers a row.

Defined cases: null and empty texts are scored like any other (their whole-text terms are left); labelled rows without
a quality or without a document are not learned from; a document with both labels is an example of either, rows that
repeat an id count once, with the least of their texts; if nothing is labelled every score is 0.5; if one class is, the score is that class; null ids and repeated rows are scored row by row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import received, ship, small_batches

TERMS, RANK, REFERENCES, NEIGHBOURS = 4096, 64, 4096, 15
#: Weight of a similarity in a vote, as a power: near neighbours count for more than farther ones.
SHARPNESS = 8
REMEMBERED = 400_000
#: Terms for the text as a whole come first; the rest is shared by words (even numbers) and shapes (odd numbers).
WHOLE = 96
WHOLE_WEIGHT = 4.0


class Terms:
    """Term counts of texts; remembers the terms of words it has seen."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.pairs: list[tuple[int, int]] = []
        self.array = np.zeros((0, 2), dtype=np.int64)

    @staticmethod
    def shape(word: str) -> str:
        out = ""
        for ch in word:
            kind = "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else "x" if ch.isalpha() else ch
            if not out.endswith(kind):
                out += kind
        return out[:12]

    def add(self, word: str) -> int:
        half = (TERMS - WHOLE) // 2
        own = WHOLE + 2 * (xxhash.xxh64_intdigest(word.lower().strip(".,;:!?"), 1) % half)
        shaped = WHOLE + 2 * (xxhash.xxh64_intdigest(self.shape(word), 2) % half) + 1
        self.pairs.append((own, shaped))
        self.known[word] = len(self.pairs) - 1
        return len(self.pairs) - 1

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and their weights (before the weighting by rarity)."""
        if len(self.pairs) > REMEMBERED:
            self.__init__()
        known = self.known
        words = np.array([known[w] if w in known else self.add(w) for w in text.split()], dtype=np.int64)
        if len(self.array) < len(self.pairs):
            self.array = np.concatenate([self.array, np.array(self.pairs[len(self.array) :], dtype=np.int64)])
        terms, n = np.unique(self.array[words].ravel(), return_counts=True)
        runs = words[:-3] * 1_000_003 + words[1:-2] * 8191 + words[2:-1] * 131 + words[3:] if len(words) > 3 else words
        repeated = 1 - len(np.unique(runs)) / max(len(runs), 1)
        size, lines = len(words), text.count("\n") + 1
        whole = np.array([
            min(int(np.log2(size + 1)), 23),
            24 + min(int(repeated * 20), 19),
            48 + min(int(np.log2(lines)), 15),
            64 + min(int(np.log2(1 + 1000 * lines / (size + 1))), 15),
        ])
        weights = np.concatenate([np.full(4, WHOLE_WEIGHT), 1 + np.log(n)])
        return np.concatenate([whole, terms]), weights.astype(np.float32)


def term_counts(docs: DataFrame, text: str, keep: dict[str, Column], kinds: str) -> DataFrame:
    """The kept columns with the arrays ``terms`` and ``weights``."""

    names = [*keep, "terms", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Terms()
        for batch in batches:
            found = [counter.counts(t or "") for t in batch.column(0).to_pylist()]
            terms = pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32()))
            weights = pa.array([x[1] for x in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], terms, weights], names)

    small_batches(docs.sparkSession)
    return docs.select(text, *[c.alias(k) for k, c in keep.items()]).mapInArrow(
        run, f"{kinds}, terms array<int>, weights array<float>"
    )


@dataclass
class Model:
    """Everything has a size that does not depend on the data: TERMS x RANK and REFERENCES x RANK numbers."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray

    def project(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        weighted = weights * self.rarity[terms]
        vector = weighted @ self.axes[terms]
        return vector / max(float(np.linalg.norm(vector)), 1e-9)

    def scores(self, block: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest references of each vector of a block."""
        if not len(self.labels):
            return np.full(len(block), 0.5)
        similar = block @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(similar, near, axis=1), 1e-6) ** SHARPNESS * self.votes[near]
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "label") -> Model:
    """Learn from the documents that have a 0/1 label under their id."""
    known = docs.select(F.col(id_col).alias("id"))
    usable = labels.where(F.col(label).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"),
        F.xxhash64(F.col(id_col).cast("string")).alias("draw"),
    ).distinct().join(known, "id", "left_semi")
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = REFERENCES // 2
    drawn = [usable.where(F.col("label") == k).orderBy("draw", "id").limit(half) for k in (0, 1)]
    # Ids are drawn without texts; at most REFERENCES of them are broadcast to fetch theirs.
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(drawn[0].union(drawn[1])), "id")
    chosen = chosen.groupBy("id", "label", "draw").agg(F.min("text").alias("text"))
    rows = term_counts(
        chosen, "text", {"label": F.col("label"), "draw": F.col("draw")}, "label int, draw bigint"
    ).collect()  # at most REFERENCES rows of at most TERMS numbers
    rows.sort(key=lambda r: (r["label"], r["draw"]))
    matrix = np.zeros((len(rows), TERMS), dtype=np.float32)
    for k, r in enumerate(rows):
        matrix[k, r["terms"]] = r["weights"]
    rarity = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 0.1
    matrix *= rarity
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    draw = np.random.default_rng(7).standard_normal((TERMS, RANK + 16)).astype(np.float32)
    span = matrix.T @ (matrix @ draw)
    for _ in range(3):  # power steps on an orthonormal basis
        span = matrix.T @ (matrix @ np.linalg.qr(span)[0])
    basis = np.linalg.qr(span)[0]
    _, _, inner = np.linalg.svd(matrix @ basis, full_matrices=False)
    axes = (basis @ inner.T)[:, :RANK].astype(np.float32)
    vectors = matrix @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    labels = np.array([r["label"] for r in rows], dtype=np.float32)
    thinned = {k: sizes[k] / min(sizes[k], half) for k in sizes}
    votes = np.array([thinned[r["label"]] for r in rows], dtype=np.float32)
    return Model(rarity, axes, vectors.astype(np.float32), labels, votes)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every document, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    shared = ship(docs.sparkSession, model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counter = received(shared), Terms()
        for batch in batches:
            vectors = [model.project(*counter.counts(t or "")) for t in batch.column(1).to_pylist()]
            block = np.array(vectors, dtype=np.float32).reshape(-1, model.axes.shape[1])
            scores = pa.array(model.scores(block).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, score double")
