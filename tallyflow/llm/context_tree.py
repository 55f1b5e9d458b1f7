"""Language-model scores by context-tree weighting over bytes.

A byte is coded as eight binary decisions.  A node of the tree is a context (the last 0 to ``DEPTH`` bytes) and the bits
of the byte decided so far; its zeros and ones over the whole training corpus give a Krichevsky-Trofimov estimate.
Bottom-up, the probability that the tree gives to the corpus at a node is the even mixture of its own estimate and of
the product of its children's; what the mixture leaves to either side are the weights with which a byte's prediction is
mixed over all depths of its context.

Counting is one pass over the training texts (distinct strings of ``DEPTH`` + 1 bytes per batch, then a shuffled sum),
so it covers every byte and grows with the corpus, and every context that occurs is a node.  Nodes are never in one
place: strings whose last ``OWN`` bytes of context are equal make up a block, blocks are dealt to tasks, and what a block
gives to the contexts above it is summed.  Only contexts of fewer than ``OWN`` bytes go through the driver; there are
65,793 at most, whatever the corpus.

For scoring, strings that make up at least one in ``2 ** SHARE`` training bytes (so at most 2 ** SHARE of them) are
broadcast with their score.  A text's other strings leave its task as rows (string, times), seen in training or not, and
get their score in their block; each text's own sum travels in one more such row, so texts are read once.

Texts start after a run of line feeds and end with one, which is coded as the end.  Defined cases: null and empty texts
consist of the end alone; with nothing to learn from, every bit has probability one half; null ids are trained on (they
have no remainder) unless the caller says otherwise; repeated rows are trained on and scored as often as they occur; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallyflow.llm.common import checkpointed, received, ship, small_batches

DEPTH, SHARE = 5, 23
#: Bytes of context that the strings of a block have in common, and rows of whole blocks that are looked at together.
OWN, CHUNK = 3, 1 << 17
START = b"\n" * DEPTH
END = b"\n"
#: Bytes looked at together: longer texts are cut, shorter ones are put side by side.
SLICE = 1 << 20
#: Distinct strings that a task adds up before it hands them on.
HELD = 1 << 20


def slices(text: bytes) -> Iterator[bytes]:
    """The text and its end in pieces of at most SLICE bytes, each with the DEPTH bytes before it in front."""
    data = START + text + END
    for k in range(DEPTH, len(data), SLICE):
        yield data[k - DEPTH : k + SLICE]


def groups(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Slices of about SLICE bytes in all: the texts that they belong to, where each starts, and their bytes."""
    owners: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        for piece in slices(text):
            owners.append(k)
            held.append(piece)
            size += len(piece)
            if size >= SLICE:
                yield _group(owners, held)
                owners, held, size = [], [], 0
    if held:
        yield _group(owners, held)


def _group(owners: list[int], held: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in held], dtype=np.int64)
    return owners, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(held), dtype=np.uint8)


def grams(starts: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Every byte of a slice with the DEPTH bytes before it, as a number: the byte lowest, its latest neighbour highest."""
    own = np.ones(len(joined), dtype=bool)
    for k in range(DEPTH):
        own[starts + k] = False
    at = np.flatnonzero(own)
    out = np.zeros(len(at), dtype=np.int64)
    for k in [*range(1, DEPTH + 1), 0]:
        out = out << 8 | joined[at - k]
    return out


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(gram)
    gram, n = gram[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(gram) != 0))) if len(gram) else np.zeros(0, dtype=np.int64)
    return gram[first], np.add.reduceat(n, first) if len(gram) else n


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all texts."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1])], ["gram", "n"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for _, starts, joined in groups(texts):
                gram, n = np.unique(grams(starts, joined), return_counts=True)
                parts.append((gram, n.astype(np.int64)))
                if sum(len(p[0]) for p in parts) >= 2 * HELD:
                    parts = [_added_up(parts)]
                    if len(parts[0][0]) >= HELD:
                        yield table(parts.pop())
        if parts:
            yield table(_added_up(parts))

    return docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted to where it is accurate to about 1e-12; usual counts are looked up."""
    usual = x < len(_HALVES) / 2
    out = np.empty_like(x)
    out[usual] = _HALVES[(2 * x[usual]).astype(np.int64)]
    out[~usual] = _stirling(x[~usual])
    return out


def _stirling(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Of 0 (not used), 1/2, 1 and so on.
_HALVES = _stirling(np.maximum(np.arange(1 << 16), 1) / 2)


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth that some training byte passes: their keys in order (context, newest byte highest, then the heap
    number of the bits decided so far, 1 to 255), zeros and ones, and what their children give to them, by logarithm."""

    key: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    below: np.ndarray | None = None
    #: Set by ``grown``: the mixture's logarithm, the share that stays at a node, and each node's place among its parents.
    both: np.ndarray | None = None
    stop: np.ndarray | None = None
    parent: np.ndarray | None = None
    #: Set by ``_descend``: mixed so far, the weight still to be given away, and the probability of a one that ends here.
    mixed: np.ndarray | None = None
    left: np.ndarray | None = None
    one: np.ndarray | None = None


def _deepest(gram: np.ndarray, n: np.ndarray) -> Level:
    """The nodes of depth DEPTH on the way of these grams, which are in order and distinct."""
    keys, zeros, ones = [], [], []
    byte = gram & 255 | 256
    for bit in range(8) if len(gram) else ():
        node = gram >> 8 << 8 | byte >> (8 - bit)
        first = np.flatnonzero(np.concatenate(([True], np.diff(node) != 0)))
        keys.append(node[first])
        ones.append(np.add.reduceat(n * (byte >> (7 - bit) & 1), first))
        zeros.append(np.add.reduceat(n, first) - ones[-1])
    if not keys:
        return Level(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))
    key = np.concatenate(keys)
    order = np.argsort(key)
    return Level(key[order], *(np.concatenate(x)[order].astype(np.float64) for x in (zeros, ones)))


def _grown(level: Level, depths: int) -> list[Level]:
    """That level and those above it, ``depths`` in all, then one more that has its sums only."""
    out = [level]
    for _ in range(depths):
        own = _estimate(level.zeros, level.ones)
        if level.below is None:
            level.both, level.stop = own, np.ones(len(own))
        else:
            level.both = np.logaddexp(own, level.below) + np.log(0.5)
            level.stop = np.exp(own + np.log(0.5) - level.both)
        above, level.parent = np.unique(level.key >> 16 << 8 | level.key & 255, return_inverse=True)
        sums = [np.bincount(level.parent, weights=x, minlength=len(above)) for x in (level.zeros, level.ones, level.both)]
        level = Level(above, *(x.astype(np.float64) for x in sums))
        out.append(level)
    return out


def _descend(level: Level, mixed: np.ndarray | float, left: np.ndarray | float) -> None:
    """What a level's nodes predict, from what is mixed and left at the parent of each."""
    own = (level.ones + 0.5) / (level.zeros + level.ones + 1)
    level.mixed = mixed + left * level.stop * own
    level.left = left * (1 - level.stop)
    level.one = level.mixed + level.left * own


@dataclass
class Top:
    """Levels of the contexts of fewer than OWN bytes, longest first, in full."""

    levels: list[Level]

    @classmethod
    def of(cls, level: Level) -> Top:
        *levels, _ = _grown(level, OWN)
        _descend(levels[-1], 0.0, 1.0)
        for level, above in zip(levels[-2::-1], levels[:0:-1]):
            _descend(level, above.mixed[level.parent], above.left[level.parent])
        return cls([Level(x.key, x.zeros, x.ones, mixed=x.mixed, left=x.left, one=x.one) for x in levels])

    def over(self, gram: np.ndarray, n: np.ndarray) -> list[Level]:
        """Levels of all contexts, longest first, in the blocks of these grams."""
        *levels, above = _grown(_deepest(gram, n), DEPTH + 1 - OWN)
        at = np.searchsorted(self.levels[0].key, above.key)
        mixed, left = self.levels[0].mixed[at], self.levels[0].left[at]
        for level in reversed(levels):
            _descend(level, mixed[level.parent], left[level.parent])
            mixed, left = level.mixed, level.left
        return levels + self.levels


def _scores(gram: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram's byte: each bit's is that of the longest context that has seen the bits before."""
    total = np.zeros(len(gram))
    byte = gram & 255 | 256
    for bit in range(8):
        one = np.full(len(gram), 0.5)
        going = np.arange(len(gram))
        for k, level in enumerate(levels):
            if len(going) and len(level.key):
                key = gram[going] >> 8 * (k + 1) << 8 | byte[going] >> (8 - bit)
                at = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
                seen = level.key[at] == key
                one[going[seen]] = level.one[at[seen]]
                going = going[~seen]
        one = np.clip(one, 1e-9, 1 - 1e-9)
        total += np.log10(np.where(byte >> (7 - bit) & 1, one, 1 - one))
    return total


class Frequent:
    """Scores of frequent grams, by hash and the next free place."""

    def __init__(self, gram: np.ndarray, score: np.ndarray) -> None:
        self.bits = max(4, (2 * len(gram) - 1).bit_length())
        self.gram, self.score = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits)
        place, left = self.place(gram), np.arange(len(gram))
        while len(left):
            free = left[self.gram[place[left]] < 0]
            self.gram[place[free]] = gram[free]
            put = self.gram[place[left]] == gram[left]
            self.score[place[left[put]]] = score[left[put]]
            left = left[~put]
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def place(self, gram: np.ndarray) -> np.ndarray:
        return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each gram's score, and whether it has one."""
        place = self.place(gram)
        held = self.gram[place]
        known = held == gram
        value = np.where(known, self.score[place], 0.0)
        left = np.flatnonzero(~known & (held >= 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            held = self.gram[place[left]]
            hit = held == gram[left]
            known[left[hit]] = True
            value[left[hit]] = self.score[place[left[hit]]]
            left = left[~hit & (held >= 0)]
        return value, known


@dataclass
class Tree:
    """Counts of grams, in order within whole blocks, and what of the tree is broadcast."""

    counts: DataFrame
    top: Top
    frequent: Frequent


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of their gram to tables of whole blocks, of CHUNK rows where blocks are not larger."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= CHUNK:
            block = batch.column("gram").to_numpy() >> 8 * (DEPTH + 1 - OWN)
            other = block != held[-1].column("gram")[-1].as_py() >> 8 * (DEPTH + 1 - OWN)
            if other.any():
                cut = int(np.argmax(other))
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.shiftright("gram", 8 * (DEPTH + 1 - OWN))).sortWithinPartitions("gram")


def fit(counts: DataFrame) -> Tree:
    """The weighted tree of a (gram, n) table."""
    spark = counts.sparkSession
    counts = checkpointed(_in_blocks(counts))
    total = counts.agg(F.sum("n")).first()[0] or 0
    names = ("key", "zeros", "ones", "below")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            above = _grown(_deepest(*(chunk.column(c).to_numpy() for c in ("gram", "n"))), DEPTH + 1 - OWN)[-1]
            yield pa.RecordBatch.from_arrays([pa.array(getattr(above, c)) for c in names], names)

    # At most 256 ** (OWN - 1) contexts of 255 nodes, of which texts in UTF-8 hold a small part.
    sums = counts.mapInArrow(summed, "key bigint, zeros double, ones double, below double").groupBy("key")
    found = sums.agg(*[F.sum(c).alias(c) for c in names[1:]]).toArrow().sort_by("key")
    top = Top.of(Level(*(found.column(c).to_numpy() for c in names)))
    shared = ship(spark, top)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = received(shared)
        for chunk in _chunks(batches):
            gram, n = (chunk.column(c).to_numpy() for c in ("gram", "n"))
            often = gram[n >= least]
            score = _scores(often, top.over(gram, n))
            yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(score)], ["gram", "score"])

    least = total / (1 << SHARE)
    often = counts.mapInArrow(frequent, "gram bigint, score double").toArrow()
    return Tree(counts, top, Frequent(*(often.column(c).to_numpy() for c in ("gram", "score"))))


def score(docs: DataFrame, tree: Tree, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, ``score``: log10 of the probability that the tree gives to the text's bytes and its end, and
    ``bits_per_byte``: its code length in bits for each of these bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, over = ship(spark, tree.frequent), ship(spark, tree.top)
    numbers = ("gram", "n", "row", "value", "size")
    kept = [f"kept_{k}" for k in range(len(keep))]
    schema = StructType([StructField(c, DoubleType() if c == "value" else LongType()) for c in numbers])
    for name, column in zip(kept, keep):
        schema.add(name, docs.schema[column].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = received(shared)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or b"" for t in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            own = np.arange(len(texts))
            total, whose, gram, times = np.zeros(len(texts)), [], [], []
            for owners, starts, joined in groups(texts):
                owner = np.repeat(owners, np.diff(np.append(starts, len(joined))) - DEPTH)
                found = grams(starts, joined)
                value, known = frequent.look_up(found)
                total += np.bincount(owner, weights=value, minlength=len(texts))
                pair, n = np.unique(owner[~known] << 48 | found[~known], return_counts=True)
                whose.append(pair >> 48)
                gram.append(pair & (1 << 48) - 1)
                times.append(n)
            # A text's own row has a number below those of grams.
            more = sum(map(len, gram))
            columns = [
                np.concatenate([*gram, -1 - (at + own)]), np.concatenate([*times, own * 0]), at + np.concatenate([*whose, own]),
                np.concatenate([np.zeros(more), total]), np.concatenate([np.zeros(more, dtype=np.int64), [len(t) + 1 for t in texts]]),
            ]
            index = pa.array(np.concatenate([np.zeros(more, dtype=np.int64), own]), mask=np.arange(more + len(own)) < more)
            at += len(texts)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), *(batch.column(k).take(index) for k in range(len(keep)))], schema.names
            )

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = received(over)
        for chunk in _chunks(batches):
            gram, n, row, value = (chunk.column(c).to_numpy() for c in numbers[:4])
            counted, wanted = row < 0, (row >= 0) & (gram >= 0)
            if wanted.any():
                asked, which = np.unique(gram[wanted], return_inverse=True)
                value = value.copy()
                value[wanted] = n[wanted] * _scores(asked, top.over(gram[counted], n[counted]))[which]
            chunk = chunk.set_column(3, "value", pa.array(value)).filter(pa.array(~counted)).select(schema.names[2:])
            yield from chunk.combine_chunks().to_batches()

    # Counts are rows of no text.
    counts = tree.counts.select("gram", "n", F.lit(-1).cast("bigint").alias("row"))
    texts = docs.select(*keep, text).mapInArrow(rows, schema)
    both = _in_blocks(texts.unionByName(counts, allowMissingColumns=True))
    found = both.mapInArrow(valued, StructType(schema.fields[2:])).groupBy("row")
    total = found.agg(*[F.any_value(k, ignoreNulls=True).alias(k) for k in kept], F.sum("value").alias("score"), F.sum("size").alias("size"))
    bits = (-F.col("score") * math.log2(10) / F.col("size")).alias("bits_per_byte")
    return total.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "score", bits)
