"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

A group is a shortest stretch of a text whose end is the end of a token of either side.  An interval of tokens is divided
by bisect: the end nearest to its middle that the other side shares splits it in two, and both halves are divided in
turn; an interval without a shared end inside is a leaf, one group.

The outermost divisions of a text are known without a search.  A blank that follows a character from which both
vocabularies force it apart begins a token on both sides, so the piece between two such blanks is an interval of its own.
Pieces are mostly words; each distinct one is encoded and divided once a task and remembered, whatever is left of a text
without blanks is one long piece that goes through the same division.  Intervals of one depth are divided together.

How many documents hold a pair of ids linked is a shuffled sum over each document's distinct pairs.  Pairs that make up
at least one in ``2 ** SHARE`` of them (so at most 2 ** SHARE) are broadcast with their counts; a document's other pairs
leave their task as rows and meet their counts in a join.

Sides are a byte-level BPE (encodes a blank and the text) and a BPE of pieces with byte fallback (puts the blank itself).
Defined cases: null and empty texts, and texts that a side does not give back byte by byte (a literal U+2581), have no
tokens; strings of special tokens inside texts are plain text; null ids, repeated rows and ties are rows of their own; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tallyflow.llm.bpe import Codec, Decoder, blank_cut
from tallyflow.llm.common import checkpointed, lend, made, one_thread_each, small_batches
from tallyflow.llm.fragments import BlankCuts, Flat, Fragments, joined, spread

SHARE = 20
#: Distinct pieces that a worker remembers; each takes some 300 bytes with its groups and links.
REMEMBERED_PIECES = 300_000
#: Distinct pairs that a task adds up before it hands them on.
HELD = 1 << 20
#: Bits of a pair that hold the second side's id.
SECOND = 32

BLANK = "\N{LOWER ONE EIGHTH BLOCK}"


def groups(a: np.ndarray, b: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """Leaf groups, in order, of intervals of tokens that end where ``a`` and ``b`` (rising) say.

    Intervals and groups are rows (from, to) of either side, ends exclusive; an interval's last ends are equal.  All
    intervals of one depth are divided together.
    """
    leaves, open_ = [np.zeros((0, 4), dtype=np.int64)], intervals
    while len(open_):
        a0, a1, b0, b1 = open_.T
        middle, widest = (a0 + a1 - 2) // 2, (a1 - a0).max()
        cut = np.full((len(open_), 2), -1)
        left = np.nonzero((a1 - a0 > 1) & (b1 - b0 > 1))[0]
        for away in range(widest):
            for k in (middle[left] - away, middle[left] + away)[: 2 if away else 1]:
                inside = (k >= a0[left]) & (k < a1[left] - 1) & (cut[left, 0] < 0)
                at = a[np.where(inside, k, 0)]
                j = np.searchsorted(b, at)  # by bisect
                hit = inside & (b[np.minimum(j, len(b) - 1)] == at)
                cut[left[hit]] = np.stack([k[hit], j[hit]], axis=1)
            # Tokens further away than the interval reaches are no cut, so what is left is a leaf.
            left = left[(cut[left, 0] < 0) & (away + 1 < a1[left] - a0[left])]
            if not len(left):
                break
        done = cut[:, 0] < 0
        leaves.append(open_[done])
        halves, (i, j) = open_[~done], cut[~done].T + 1
        open_ = np.concatenate([np.stack([halves[:, 0], i, halves[:, 2], j], 1), np.stack([i, halves[:, 1], j, halves[:, 3]], 1)])
    found = np.concatenate(leaves)
    return found[np.argsort(found[:, 0])]


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of either side whose bytes overlap: one pair for each stretch without an end inside."""
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


#: What stands behind an id: another of its side, the other side, another group.
SEPARATORS = ",|;"


class Aligner:
    """Aligns texts; ``first`` is a byte-level tokenizer file's content, ``second`` a model of pieces."""

    def __init__(self, first: str, second: bytes) -> None:
        allowed, decoder = blank_cut(Codec(first).apart), Decoder(first)
        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        spoken = [
            bytes([int(p[3:-1], 16)]) if self.second.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_of_first, self.size_of_second = np.diff(decoder.ends), np.array([len(x) for x in spoken])
        self.bytes_of_second, self.ends_of_second = np.frombuffer(b"".join(spoken), np.uint8), np.cumsum([0, *map(len, spoken)])
        # Characters that some piece has in front of a blank of its own.
        joined_to_blank = {x for p in pieces for x, y in zip(p, p[1:]) if y == BLANK}
        self.cuts = BlankCuts(lambda c: allowed(c) and c not in joined_to_blank and c != BLANK)
        self.ids = max(len(self.size_of_first), len(pieces))
        shown = [f"{i}{x}".encode() for x in SEPARATORS for i in range(self.ids)]
        self.bytes_shown, self.ends_shown = np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)])
        self.known = Fragments(self._aligned, REMEMBERED_PIECES)
        self._forget()

    def _forget(self) -> None:
        self.known.forget()
        #: Of each piece the numbers of tokens of either side and of groups (-1: it is not given back).
        self.numbers = [Flat(), Flat(), Flat()]
        self.shown, self.shown_ends = Flat(np.uint8), Flat(np.int64, 0)

    def _second_ids(self, pieces: list[str]) -> list[list[int]]:
        # Behind nothing but its blank the model has no text to put a blank before.
        return [x or [self.second.piece_to_id(BLANK)] for x in self.second.encode(pieces)]

    def _aligned(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of pieces, each after a blank; notes how many tokens and groups they have, and the groups."""
        spaced = [" " + p for p in pieces]
        one, n_one = joined([e.ids for e in self.first.encode_batch_fast(spaced, add_special_tokens=False)])
        two, n_two = joined(self._second_ids(pieces))
        given, sizes = spread(self.bytes_of_second, self.ends_of_second, two)
        whole = [s.encode() for s in spaced]
        given_at = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n_two)))].tolist()
        given = given.tobytes()
        back = np.array([given[s:e] == w for s, e, w in zip(given_at, given_at[1:], whole)])
        # Pieces that the second side does not give back have no tokens.
        one, n_one = one[np.repeat(back, n_one)], np.where(back, n_one, 0)
        two, n_two = two[np.repeat(back, n_two)], np.where(back, n_two, 0)
        a, b = np.cumsum(self.size_of_first[one]), np.cumsum(self.size_of_second[two])
        a_upto, b_upto = np.concatenate(([0], np.cumsum(n_one))), np.concatenate(([0], np.cumsum(n_two)))
        found = groups(a, b, np.stack([a_upto[:-1], a_upto[1:], b_upto[:-1], b_upto[1:]], axis=1)[back])
        i, j = links(a, b)
        n_groups = np.diff(np.searchsorted(found[:, 1], a_upto, side="right"))
        for held, n in zip(self.numbers, (n_one, n_two, np.where(back, n_groups, -1))):
            held.extend(n)
        self._show(one, two, found, np.concatenate(([0], np.cumsum(n_groups))))
        return one[i] << SECOND | two[j], np.diff(np.searchsorted(i, a_upto))

    def _show(self, one: np.ndarray, two: np.ndarray, found: np.ndarray, groups_upto: np.ndarray) -> None:
        """The groups as text: each id with what stands behind it."""
        behind_one, behind_two = np.zeros((2, max(len(one), len(two))), dtype=np.int64)
        behind_one[found[:, 1] - 1], behind_two[found[:, 3] - 1] = 1, 2
        # A group's first ids stand behind all ids of the groups before it, its second ids behind its first ones too.
        place_one = np.arange(len(one)) + np.repeat(found[:, 2], found[:, 1] - found[:, 0])
        place_two = np.arange(len(two)) + np.repeat(found[:, 1], found[:, 3] - found[:, 2])
        codes = np.zeros(len(one) + len(two), dtype=np.int64)
        codes[place_one] = behind_one[: len(one)] * self.ids + one
        codes[place_two] = behind_two[: len(two)] * self.ids + two
        text, sizes = spread(self.bytes_shown, self.ends_shown, codes)
        last = np.concatenate(([0], found[:, 1] + found[:, 3]))[groups_upto]  # ids up to each piece's end
        self.shown_ends.extend(self.shown.n + np.concatenate(([0], np.cumsum(sizes)))[last][1:])
        self.shown.extend(text)

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
        """Of each text the numbers of tokens of either side and of groups, the groups, and all linked pairs."""
        if self.known.full():
            self._forget()
        pieces = [self.cuts.pieces(t) if t else [] for t in texts]
        every = self.known.codes(pieces)
        at = 0
        for n in map(len, pieces):
            codes = every[at : at + n]
            at += n
            numbers = np.array([x.all[codes].sum() for x in self.numbers])
            if not n or (self.numbers[2].all[codes] < 0).any():
                yield np.zeros(3, np.int64), b"", np.zeros(0, np.int64)
            else:
                shown, _ = spread(self.shown.all, self.shown_ends.all, codes)
                yield numbers, shown[:-1].tobytes(), self.known.gathered(codes)[0]


def read_model(path: str) -> bytes:
    """A model file's content, read once by the driver; it has a vocabulary's size, whatever the data."""
    with open(path, "rb") as f:
        return f.read()


FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, first: str, second: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups, pairs, times): one row per document, in one pass without a shuffle.

    ``groups`` is the text ``a1,a2|b1;...`` of its groups as SHA-256; ``pairs`` are its distinct linked pairs and
    ``times`` how often each is linked, both as little-endian 64-bit numbers.  ``row`` is unique once the table is written.
    """
    small_batches(docs.sparkSession)
    lent = lend(docs.sparkSession, (first, second))  # the size of two vocabularies
    schema = StructType(
        [StructField("row", LongType()), StructField("id", docs.schema[id_col].dataType)]
        + [StructField(n, LongType()) for n in FIELDS]
        + [StructField("groups", StringType()), StructField("pairs", BinaryType()), StructField("times", BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread_each()
        aligner = made(lent, lambda given: Aligner(*given))
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            numbers, digests, pairs, times = [], [], [], []
            for counts, shown, linked in aligner.align([t or "" for t in batch.column(1).to_pylist()]):
                numbers.append((*counts.tolist(), len(linked)))
                digests.append(hashlib.sha256(shown).hexdigest() if shown else "")
                distinct, n = np.unique(linked, return_counts=True)
                pairs.append(distinct.astype("<i8").tobytes())
                times.append(n.astype("<i8").tobytes())
            table = np.array(numbers, dtype=np.int64).reshape(-1, 4)
            columns = [pa.array(at + np.arange(len(numbers))), batch.column(0), *[pa.array(table[:, k]) for k in range(4)]]
            columns += [pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
            at += len(numbers)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, schema)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What binary cells hold, one after the other, and how many each holds."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), dtype="<i8"), np.array([len(c) // 8 for c in cells], dtype=np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its first id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        held, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            pairs, _ = _numbers(batch.column(0))
            held, where = np.unique(np.concatenate([held, pairs]), return_inverse=True)
            total = np.bincount(where, np.concatenate([total, np.ones(len(pairs), np.int64)]), len(held)).astype(np.int64)
            if len(held) >= HELD:
                yield table(held, total)
                held, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(held):
            yield table(held, total)

    counts = rows.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    # One first id has at most as many pairs as the other side has ids.
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", SECOND)))
    return counts.select("pair", "n", (F.col("n") == most).alias("best"))


def counted(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): links of each row whose pair is its first id's best, and the counts of all its links."""
    spark = rows.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    is_frequent = F.col("n") * (1 << SHARE) >= F.lit(total)
    table = counts.where(is_frequent).toArrow().sort_by("pair")  # at most 2 ** SHARE rows of 17 bytes
    heavy = spark.sparkContext.broadcast(tuple(table.column(k).to_numpy() for k in ("pair", "n", "best")))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        known, n, best = heavy.value
        for batch in batches:
            pairs, sizes = _numbers(batch.column(1))
            times, _ = _numbers(batch.column(2))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            yield batch, np.repeat(np.arange(len(sizes)), sizes), pairs, times, at, hit

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = heavy.value
        for batch, owner, _, times, at, hit in met(batches):
            sums = np.zeros((2, batch.num_rows), dtype=np.int64)
            np.add.at(sums[0], owner[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], owner[hit], times[hit] * n[at[hit]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1])], ["row", "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, owner, pairs, times, _, hit in met(batches):
            own = batch.column(0).to_numpy()[owner[~hit]]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(pairs[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])

    needed = rows.select("row", "pairs", "times")
    rare = needed.mapInArrow(others, "row bigint, pair bigint, times bigint").join(counts.where(~is_frequent), "pair")
    more = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = needed.mapInArrow(frequent, "row bigint, n_best bigint, count_sum bigint").unionByName(more)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(docs: DataFrame, first: str, second: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of every document."""
    rows = checkpointed(aligned(docs, first, second, id_col, text))
    sums = counted(rows, checkpointed(pair_counts(rows)))
    return rows.select("row", "id", *FIELDS, "groups").join(sums, "row").drop("row")
