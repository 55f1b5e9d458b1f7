"""Prefix trie of conversations from sorted longest common prefixes and a sparse table of their minima.

A conversation is a sequence of turns, a turn the 16 bytes of a hash of role and text.  Sequences are sorted by range, so
conversations with a common prefix stand side by side, and ``lcp[i]`` says how many turns a row has in common with the
row before it.  A prefix of row i and depth d belongs to the rows around i between which no lcp is under d.  A sparse
table holds the minima of all runs of 2 ** k lcps, and every candidate (i, d) searches its left and its right extent on
its own, by halving steps over that table: no stack, and no order among candidates.  A candidate counts where it is the
leftmost of its interval.

All sums over a node's subtree are sums over its interval: each member brings the characters of all its turns from the
node's depth on, each row the turns that no row before it has (the trie's nodes, each once) and whether it is the last of
a leaf.  So intervals may be cut anywhere.  A task works on blocks of bounded size; a block's first row knows its lcp with
the row before it, from the task before if need be (one number for each task is broadcast), and the parts of a node that
is cut between blocks are added up by the node's hash.

Ids of the conversations that end at a node come sorted out of the same order; where a block cuts them, their parts are
put through the hash one after the other, as a stream.

Defined cases: null roles and texts are empty; turns of equal number go by role and text; rows without a conversation's id
belong to none and are left out; repeated rows are turns of their own; a conversation may be turnless once rebuilt; an
empty table gives an empty result; other columns are not read.  Texts stay where they are numbered: past that a turn is
24 bytes.  Of a conversation GATHERED turns and one more are one row, and all of them only where another conversation
begins with the same GATHERED turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import checkpointed

#: Bytes of a turn in a sequence.
TURN = 16
#: Turns of a conversation that are gathered in any case.
GATHERED = 4096
#: Conversations and turns that a block holds (one more conversation if it is longer).
BLOCK_ROWS, BLOCK_TURNS = 4096, 1 << 18


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, chars): turns by number from 1, each as a hash of role and text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")],
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # The role's length keeps role and text apart.
    turn = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), turn.alias("turn"), F.length("text").alias("chars"))


def rebuilt(conversations: DataFrame, family: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, size), and their turns (conv_id, pos, turn, chars): the first h turns of the family's first
    conversation, then the own ones after the first h.

    A family is ``family`` ids in a row; h is crc32 of the id's decimals modulo ``shared``.
    """
    c = F.col
    turns = checkpointed(numbered(conversations))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    # At most ``family`` conversations meet a head, and a head brings at most ``shared`` - 1 turns.
    heads = turns.where((c("conv_id") % family == 0) & (c("pos") < shared)).withColumnRenamed("conv_id", "head")
    known = sizes.where(c("conv_id") % family == 0).select(c("conv_id").alias("head"), c("own").alias("head_size"))
    h = (F.crc32(c("conv_id").cast("string")) % shared).cast("int")
    convs = sizes.withColumns({"h": h, "head": c("conv_id") - c("conv_id") % family}).join(known, "head", "left")
    convs = convs.withColumn("first", F.least("h", F.coalesce("head_size", F.lit(0))).cast("int"))
    convs = checkpointed(convs.select("conv_id", "head", "h", "first", (c("first") + F.greatest(c("own") - c("h"), F.lit(0))).alias("size")))
    before = convs.join(heads, "head").where(c("pos") <= c("first")).select("conv_id", "pos", "turn", "chars")
    own = turns.join(convs, "conv_id").where(c("pos") > c("h")).select("conv_id", (c("pos") - c("h") + c("first")).alias("pos"), "turn", "chars")
    return convs.select("conv_id", "size"), before.unionByName(own)


def gathered(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (pos, turn, chars) in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "chars"))).alias("turns"))


def split(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, turns) for the trie, and the turns that are left over.

    A conversation of more than GATHERED turns whose first GATHERED no other one has branches off no later than there:
    what follows is a chain of its own.  One more turn of it goes into the trie, the others stay rows and are never
    gathered.  Only conversations that begin like another for so long are gathered as a whole.
    """
    c = F.col
    short = gathered(turns.where(c("pos") <= GATHERED + 1))
    sequences = convs.select("conv_id").join(short, "conv_id", "left")
    empty = F.array().cast(short.schema["turns"].dataType)
    sequences = sequences.select("conv_id", F.coalesce("turns", empty).alias("turns"))
    long = convs.where(c("size") > GATHERED + 1)
    if long.isEmpty():
        return sequences, turns.where("false").select("conv_id", "pos", F.lit(0).cast("bigint").alias("size"))
    sequences = checkpointed(sequences)
    start = F.sha2(F.array_join(F.transform(F.slice("turns", 1, GATHERED), lambda t: F.hex(t["turn"])), ""), 256)
    starts = sequences.where(F.size("turns") > GATHERED).select("conv_id", start.alias("start"))
    alone = starts.groupBy("start").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    chains = checkpointed(long.join(alone.select("conv_id"), "conv_id", "left_semi"))
    whole = long.join(chains.select("conv_id"), "conv_id", "left_anti").select("conv_id")
    sequences = sequences.join(whole, "conv_id", "left_anti").unionByName(gathered(turns.join(whole, "conv_id", "left_semi")))
    return sequences, turns.where(c("pos") > GATHERED).join(chains, "conv_id").select("conv_id", "pos", "size")


def sorted_sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, sequence, chars), written in the order of sequences, equal ones by id."""
    codes = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["turn"])), "")).alias("sequence")
    rows = checkpointed(convs.select("conv_id", codes, F.col("turns.chars").alias("chars")))
    # The id is part of the range, so copies of one conversation are dealt to many tasks.
    return checkpointed(rows.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // TURN


def seams(rows: DataFrame) -> dict[int, int]:
    """For each task of the sorted rows but the first with rows, the lcp of its first row with the row before it."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                last = batch.column(0)[batch.num_rows - 1].as_py()
        if first is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([first]), pa.array([last])], ["task", "first", "last"])

    # One row for each task.
    edges = rows.select("sequence").mapInArrow(ends, "task bigint, first binary, last binary")
    before = edges.select("task", "first", F.lag("last").over(Window.orderBy("task")).alias("before")).where("before IS NOT NULL")

    def lcps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([common_turns(*x) for x in both], pa.int64())], ["task", "lcp"])

    return {r["task"]: r["lcp"] for r in before.mapInArrow(lcps, "task bigint, lcp bigint").collect()}


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of every run of 2 ** k values."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def extents(lcp: np.ndarray, row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of the interval around each candidate; ``lcp[i]`` stands between rows i - 1 and i, ``lcp[0]`` ends it."""
    levels = sparse_table(lcp)
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        # To the left over lcp[left - step + 1 .. left], never over lcp[0]; to the right over lcp[right + 1 .. right + step].
        at = left - step + 1
        left = np.where((at > 0) & (level[np.clip(at, 0, len(level) - 1)] >= depth), left - step, left)
        at = right + 1
        right = np.where((at + step <= len(lcp)) & (level[np.clip(at, 0, len(level) - 1)] >= depth), right + step, right)
    return left, right


NODES = "key binary, depth bigint, parent binary, conv_id bigint, n_convs bigint, saved_tokens bigint, n_leaves bigint, ends string"
PARTS = "part bigint, ids string"


class Block:
    """Some rows in order, with the lcp of the first with the row before it (-1: none) and of the last with the next one."""

    def __init__(self, ids: np.ndarray, sequence: list[bytes], chars: list[np.ndarray], before: int, after: int) -> None:
        self.ids, self.sequence = ids, sequence
        inner = [common_turns(a, b) for a, b in zip(sequence, sequence[1:])]
        self.lcp = np.array([before, *inner], dtype=np.int64)
        self.following = np.array([*inner, after], dtype=np.int64)
        self.size = np.array([len(s) // TURN for s in sequence], dtype=np.int64)
        # Each row's turns lie one after the other behind a textless root: depth d of row i is place start[i] + d.
        self.start = np.cumsum(self.size + 1) - self.size - 1
        lengths = np.zeros(int((self.size + 1).sum()), dtype=np.int64)
        for s, c in zip(self.start.tolist(), chars):
            lengths[s + 1 : s + 1 + len(c)] = c
        self.upto = np.concatenate(([0], np.cumsum(lengths)))

    def _from(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Characters of a row's turns from a depth on."""
        end = self.start[row] + self.size[row] + 1
        return self.upto[end] - self.upto[np.minimum(self.start[row] + depth, end)]

    def keys(self) -> list[bytes]:
        """A hash for each prefix of each row, laid out as the turns are; a root's is that of no bytes."""
        out = []
        for sequence in self.sequence:
            h = hashlib.blake2b(digest_size=TURN)
            out.append(h.digest())
            for k in range(0, len(sequence), TURN):
                h.update(sequence[k : k + TURN])
                out.append(h.digest())
        return out

    def nodes(self, order: int) -> pa.RecordBatch:
        """Nodes, whole or in part, and ids in parts where a run of equal rows meets the block's edge."""
        keys = self.keys()
        row = np.repeat(np.arange(len(self.size)), self.size + 1)
        depth = np.arange(len(row)) - self.start[row]
        left, right = extents(self.lcp, row, depth)
        row, depth, right = (x[left == row] for x in (row, depth, right))
        everything = np.arange(len(self.size))
        members = np.concatenate(([0], np.cumsum(self.size + 1)))  # places up to a row
        all_from = np.zeros(len(row), dtype=np.int64)
        own = np.concatenate(([0], np.cumsum(self._from(everything, np.zeros_like(everything)))))
        # What members bring before the node's depth is the same for all: the first member's turns above it.
        above = self._from(row, np.zeros_like(row)) - self._from(row, depth)
        n = right - row + 1
        all_from = own[right + 1] - own[row] - n * above
        new = np.concatenate(([0], np.cumsum(self._from(everything, self.lcp + 1))))
        # The first row brings the node's own chain, unless an earlier block did.
        chain = self._from(row, np.maximum(depth, self.lcp[row] + 1))
        distinct = new[right + 1] - new[row + 1] + chain
        leaf = np.concatenate(([0], np.cumsum(self.following < self.size)))
        levels = sparse_table(self.ids)
        k = np.log2(n).astype(np.int64)
        width = [len(x) for x in levels]
        flat, base = np.concatenate(levels), np.concatenate(([0], np.cumsum(width)))
        least = np.minimum(flat[base[k] + row], flat[base[k] + right + 1 - (1 << k)])
        place = self.start[row] + depth
        ends, parts = self._ends(keys)
        key = [keys[p] for p in place.tolist()]
        parent = [keys[p - 1] if d else None for p, d in zip(place.tolist(), depth.tolist())]
        columns = [
            pa.array(key, pa.binary()), pa.array(depth), pa.array(parent, pa.binary()), pa.array(least), pa.array(n),
            pa.array(all_from - distinct), pa.array(leaf[right + 1] - leaf[row]),
            pa.array([ends.get(x) for x in key], pa.string()),
            pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.string()),
        ]
        names = [f.split()[0] for f in f"{NODES}, {PARTS}".split(", ")]
        found = pa.RecordBatch.from_arrays(columns, names)
        if not parts:
            return found
        empty = {x.name: pa.nulls(len(parts), x.type) for x in found.schema}
        empty |= {"key": pa.array([p[0] for p in parts], pa.binary()), "ids": pa.array([p[1] for p in parts], pa.string())}
        empty["part"] = pa.array([order] * len(parts), pa.int64())
        more = pa.RecordBatch.from_arrays([empty[x.name] for x in found.schema], names)
        return pa.Table.from_batches([found, more]).combine_chunks().to_batches()[0]

    def _ends(self, keys: list[bytes]) -> tuple[dict[bytes, str], list[tuple[bytes, str]]]:
        """SHA-256 of the ids of rows that end at a node, by node, and such ids of which other blocks may have more."""
        same = (self.lcp == self.size) & (np.concatenate(([self.lcp[0]], self.size[:-1])) == self.size)
        starts = np.nonzero(~same | (np.arange(len(same)) == 0))[0].tolist()
        ends, parts = {}, []
        for a, b in zip(starts, [*starts[1:], len(same)]):
            key = keys[int(self.start[a] + self.size[a])]
            ids = ",".join(map(str, self.ids[a:b].tolist()))
            at_edge = (a == 0 and self.lcp[0] == self.size[0]) or (b == len(same) and self.following[-1] == self.size[-1])
            if at_edge:
                parts.append((key, ids))
            else:
                ends[key] = hashlib.sha256(ids.encode()).hexdigest()
        return ends, parts


def partial_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of every block of the sorted rows, and parts of ids."""
    shared = rows.sparkSession.sparkContext.broadcast(seams(rows))  # a number for each task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        later = [t for t in shared.value if t > task]
        at_end = shared.value[min(later)] if later else -1
        before, order = shared.value.get(task, -1), task << 32
        held: list[tuple[int, bytes, np.ndarray]] = []
        turns = 0

        def block(after: int) -> pa.RecordBatch:
            ids = np.array([h[0] for h in held], dtype=np.int64)
            return Block(ids, [h[1] for h in held], [h[2] for h in held], before, after).nodes(order)

        for batch in batches:
            chars = batch.column(2)
            ends, flat = chars.offsets.to_numpy(), chars.values.to_numpy(zero_copy_only=False)
            for k, (conv, sequence) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if len(held) >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                    seam = common_turns(held[-1][1], sequence)
                    yield block(seam)
                    before, order, held, turns = seam, order + 1, [], 0
                held.append((conv, sequence, flat[ends[k] : ends[k + 1]]))
                turns += len(sequence) // TURN + 1
        if held:
            yield block(at_end)

    return rows.select("conv_id", "sequence", "chars").mapInArrow(run, f"{NODES}, {PARTS}")


def hashes_of_parts(parts: DataFrame) -> DataFrame:
    """(key, streamed): SHA-256 over a node's parts in order, comma between them; a task holds one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, h) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "streamed"])

        key = h = None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    h.update(b"," + ids.encode())
                else:
                    if h is not None:
                        yield row(key, h)
                    key, h = k, hashlib.sha256(ids.encode())
        if h is not None:
            yield row(key, h)

    ordered = parts.repartition("key").sortWithinPartitions("key", "part")
    return ordered.select("key", "ids").mapInArrow(run, "key binary, streamed string")


def trie(conversations: DataFrame, family: int = 100, shared: int = 6) -> DataFrame:
    """The nodes of the rebuilt conversations, one row each."""
    sequences, rest = split(*rebuilt(conversations, family, shared))
    made = checkpointed(partial_nodes(sorted_sequences(sequences)))
    whole = made.where("part IS NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "saved_tokens", "n_leaves")]
    # Only nodes on a block's edges come in more than one row.
    nodes = whole.groupBy("key", "depth", "parent").agg(F.min("conv_id").alias("conv_id"), *sums)
    ends = whole.where("ends IS NOT NULL").select("key", "ends")
    streamed = hashes_of_parts(made.where("part IS NOT NULL").select("key", "part", "ids"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(ends, "key", "left").join(streamed, "key", "left").join(children, "key", "left").join(parents, "parent", "left")
    nobody: Column = F.sha2(F.lit(""), 256)
    of_trie = found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends", "streamed", nobody).alias("ends_sha256"),
    )
    # A chain's first turn is in the trie as if it were its end; the rest of the chain has one member and no branch.
    opens = rest.where(F.col("pos") == GATHERED + 1).select("conv_id", F.col("pos").cast("bigint").alias("depth"), F.lit(True).alias("goes_on"))
    of_trie = of_trie.join(opens, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.when(F.col("goes_on"), F.lit(1)).otherwise(F.col("n_children")).cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.when(F.col("goes_on"), nobody).otherwise(F.col("ends_sha256")).alias("ends_sha256"),
    )
    one, none, last = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), F.col("pos") == F.col("size")
    chains = rest.where(F.col("pos") > GATHERED + 1).select(
        "conv_id", F.col("pos").cast("bigint").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nobody).alias("ends_sha256"),
    )
    return of_trie.unionByName(chains)
