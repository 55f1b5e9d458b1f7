"""Packing of documents into sequences by exact complements, then best fit.

What is packed are pieces: a document's tokens and an end, cut only where they are longer than a sequence.  Which pieces
share a sequence depends on their lengths alone, and there are at most ``capacity`` lengths.  So the plan is made over
counts of lengths, whatever the number of documents: a list of patterns (lengths put side by side) and how often each is
used.  A pattern opens with the longest length left.  What is missing to a full sequence is looked up among the sums of
one, two and three lengths that are still there; an exact combination is used as often as its counts allow.  Only if no
sum fits is the longest length placed that fits into the gap (best fit), and the rest of the gap looked up again.  Each
use of a pattern uses up one of its lengths, or all but too few of it, so patterns are bounded by the capacity too.

Pieces get their places without meeting: within a task they are numbered by length, tasks' counts are summed up before
them, and a piece's number among those of its length leads into the broadcast plan.

Defined cases: null and empty texts are pieces of the end alone; null ids and repeated rows are packed as rows of their
own; pieces of one length are interchangeable, ties go by task and row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from tallyflow.llm.bpe import byte_letters
from tallyflow.llm.common import checkpointed, lend, made, one_thread_each, small_batches
from tallyflow.llm.fragments import Fragments, joined

#: Characters that Python takes for white space and a normalizer's pattern does not.
NO_BLANKS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile(r"[^\x20\x09-\x0d]+")
#: Latin letters that have no other form in the normalizer than their lower case, and at most one mark behind them:
#: the splitting pattern takes the letters, then the mark.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:?!]?)")


#: Distinct words that a worker remembers.
REMEMBERED_WORDS = 1_000_000


class WordCodec:
    """Ids of texts by a BPE of words, which never makes a token across white space."""

    def __init__(self, spec: str) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))
        self.words = Fragments(lambda words: joined([self.ids(w) for w in words]), REMEMBERED_WORDS)

    def ids(self, word: str) -> list[int]:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        letters, mark = plain.groups()
        letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        tokens = self.merge(letters)
        return [t.id for t in (tokens + self.merge(mark) if mark else tokens)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if self.words.full():
            self.words.forget()
        found = [BLANKS.findall(t) if NO_BLANKS.search(t) else t.split() for t in texts]
        ids, sizes = self.words.gathered(self.words.codes(found))
        upto = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, found)])].tolist()
        for a, b in zip(upto, upto[1:]):
            yield ids[a:b]


def pieces(docs: DataFrame, spec: str, capacity: int, end: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, crc, task, nth): ``nth`` counts a task's pieces of one length, from 0.

    One pass without a shuffle; task and nth hold once the table is written.
    """
    small_batches(docs.sparkSession)
    lent = lend(docs.sparkSession, spec)  # the size of a vocabulary
    numbers = ("start", "length", "crc", "task", "nth")
    schema = StructType(
        [StructField("id", docs.schema[id_col].dataType), StructField("piece", IntegerType())]
        + [StructField(n, LongType()) for n in numbers]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread_each()
        codec, seen, task = made(lent, WordCodec), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for k, ids in enumerate(codec.encode([t or "" for t in batch.column(1).to_pylist()])):
                data = np.append(ids, end).astype("<u4")
                for piece, start in enumerate(range(0, len(data), capacity)):
                    part = data[start : start + capacity]
                    rows.append((k, piece, start, len(part), zlib.crc32(part), task, seen[len(part)]))
                    seen[len(part)] += 1
            table = np.array(rows, dtype=np.int64).reshape(-1, 7)
            columns = [batch.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(table[:, k]) for k in range(2, 7)], schema.names)

    return docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, schema)


class Stock:
    """Lengths that are left, with their counts.

    Sums are looked up through sets of bits: bit x of ``there`` is set while length x is left, and bit capacity - x of
    ``mirrored``; shifted against one another they share a bit if two lengths have the wanted sum.
    """

    def __init__(self, counts: Mapping[int, int], capacity: int) -> None:
        self.counts = {x: n for x, n in counts.items() if n}
        self.capacity = capacity
        self.there = sum(1 << x for x in self.counts)
        self.mirrored = sum(1 << capacity - x for x in self.counts)

    def longest(self, most: int) -> int:
        """The longest length left of at most so much, 0 if there is none."""
        return max((self.there & (1 << most + 1) - 1).bit_length() - 1, 0) if most > 0 else 0

    def take(self, pattern: Counter, times: int) -> None:
        for x, n in pattern.items():
            self.counts[x] -= n * times
            if not self.counts[x]:
                self.there &= ~(1 << x)
                self.mirrored &= ~(1 << self.capacity - x)

    def allows(self, pattern: Counter) -> bool:
        return all(self.counts[x] >= n for x, n in pattern.items())

    def pair(self, total: int, beside: Counter) -> tuple[int, int] | None:
        """Two lengths of this sum, the longest first; ``beside`` is in use already."""
        found = self.there & (self.mirrored << total >> self.capacity) & (1 << total) - 1
        while found:
            x = found.bit_length() - 1
            if 2 * x < total:
                return None
            if self.allows(beside + Counter((x, total - x))):
                return x, total - x
            found &= ~(1 << x)
        return None

    def triple(self, total: int, beside: Counter) -> tuple[int, int, int] | None:
        x = self.longest(total - 2)
        while 3 * x >= total:
            if self.allows(with_x := beside + Counter((x,))) and (rest := self.pair(total - x, with_x)):
                return x, *rest
            x = self.longest(x - 1)
        return None

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths of this sum, beside those in use."""
        if self.there >> gap & 1 and self.allows(used + Counter((gap,))):
            return (gap,)
        return self.pair(gap, used) or self.triple(gap, used)


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns, as lengths side by side, and how often each is used; together they use up the counts."""
    stock, out = Stock(counts, capacity), []
    while stock.there:
        lengths = [stock.longest(capacity)]
        used = Counter(lengths)
        gap = capacity - lengths[0]
        while gap:
            more = stock.exact(gap, used)
            if more is None:
                # Best fit: the longest that is left beside those in use.
                x = stock.longest(gap)
                while x and stock.counts[x] <= used[x]:
                    x = stock.longest(x - 1)
                if not x:
                    break
                more = (x,)
            lengths += more
            used.update(more)
            gap -= sum(more)
        times = min(stock.counts[x] // n for x, n in used.items())
        stock.take(used, times)
        out.append((tuple(lengths), times))
    return out


def placed(rows: DataFrame, capacity: int) -> DataFrame:
    """The written ``pieces`` with their sequence and the offset in it."""
    spark = rows.sparkSession
    by_task = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    # Counts of one length by task, as many as there are tasks, whatever a task holds.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    first = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = rows.join(first, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "task")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows

    # A slot is a length's place in a pattern: its pieces from ``first`` on go there, one a sequence.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for lengths, times in plan(counts, capacity):
        at = 0
        for x in lengths:
            slots.setdefault(x, []).append((taken[x], sequence, at))
            taken[x] += times
            at += x
        sequence += times
    shared = spark.sparkContext.broadcast({x: np.array(s, dtype=np.int64) for x, s in slots.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "nth"))
            found = np.zeros((len(nth), 2), dtype=np.int64)
            for x in np.unique(length).tolist():
                own = np.nonzero(length == x)[0]
                table = shared.value[x]
                slot = table[np.searchsorted(table[:, 0], nth[own], side="right") - 1]
                found[own, 0] = slot[:, 1] + nth[own] - slot[:, 0]
                found[own, 1] = slot[:, 2]
            columns = [*batch.columns, pa.array(found[:, 0]), pa.array(found[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "sequence_id", "offset"])

    more = [StructField(n, LongType()) for n in ("sequence_id", "offset")]
    return numbered.mapInArrow(run, StructType([*numbered.schema, *more]))


def packed(
    docs: DataFrame, spec: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(length, id, piece, start, crc, nth, sequence_id, offset) of every piece of the documents."""
    return placed(checkpointed(pieces(docs, spec, capacity, end, id_col, text)), capacity)
