"""Removal of long repeated byte strings through run-compressed Burrows-Wheeler indexes.

Every byte goes that is covered by a string of ``LENGTH`` bytes which also starts anywhere else in the corpus.

Finding what to index.  Each such string (window) has an anchor: its ``GRAM``-byte piece of least hash, the first of
equals.  Equal windows have equal anchors at equal places, so windows only need to be compared among texts around equal
anchors.  Neighbouring windows mostly share their anchor; together they make up the anchor's context, less than twice
LENGTH bytes.  Contexts are counted by hash: one that occurs twice is repeated as a whole.  If an anchor has several
different contexts, one copy of each is cut out of its text and indexed.

Indexing.  The contexts of some anchors, set apart by unique end marks, get a suffix array; their Burrows-Wheeler
transform is kept as runs, with the text places at run ends as samples.  How far a suffix agrees with its neighbour in
suffix order is looked up at the samples only; a place within a run has one less than the place before it, so the
matching statistics of all places stream from the samples in text order.  Windows with a match of LENGTH are repeated.
Blocks hold whole anchors.  An anchor with more than ``WIDE`` different contexts (a passage in a large part of all
texts) does not go into a block: its windows are cut into classes of neighbours, each with the stretch that all windows
of the class hold in the anchor's place, and go through the same steps again.  Where even such a stretch has more than
WIDE different surroundings, its few windows are counted by hash one by one, which any number of tasks can share.

Defined cases: null and shorter texts lose nothing; rows with a null id are rows like others; repeated rows repeat each
other, so they are removed where they have LENGTH bytes; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import checkpointed, small_batches

LENGTH, GRAM = 400, 32
#: Different contexts of an anchor that one block may hold, and bytes of contexts after which a block is indexed: few, so
#: that its arrays stay in a core's cache.  Only contexts of one anchor can hold equal windows, so results are the same.
WIDE, BLOCK = 1024, 1 << 16
#: Places of the windows that are compared together where an anchor has too many contexts for a block.
STEP = 23
#: Bits of a place within a piece of text that is looked at as a whole; longer texts are looked at in several pieces.
PLACE = 20
BASE = 0x9E3779B97F4A7C15
ALL = (1 << 64) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes (a power of two), by doubling."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = h[:-width] * np.uint64(base) + h[width:]
            base, width = base * base & ALL, 2 * width
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row: least to the end of a block and from the start of the next."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ALL, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    to_here = np.minimum.accumulate(blocks, axis=1).ravel()
    from_here = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_here[:n], to_here[width - 1 : width - 1 + n])


def contexts(text: bytes) -> list[tuple[int, int, int, int, int]]:
    """(hash of the anchor, hash of the context, its start, number of windows, the anchor's place in it) of every anchor
    of a text."""
    out = []
    step = (1 << PLACE) - 2 * LENGTH
    for first in range(0, len(text) - LENGTH + 1, step):
        piece = text[first : first + step + LENGTH - 1]
        hashes = gram_hashes(np.frombuffer(piece, dtype=np.uint8))
        ordered = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
        least = sliding_minimum(ordered, LENGTH - GRAM + 1)
        anchor = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.nonzero(np.diff(anchor))[0] + 1))
        counts = np.diff(np.concatenate((starts, [len(anchor)]))).tolist()
        names = hashes[anchor[starts]].view(np.int64).tolist()
        offsets = (anchor[starts] - starts).tolist()
        for name, start, count, offset in zip(names, starts.tolist(), counts, offsets):
            digest = xxhash.xxh3_64_intdigest(piece[start : start + count + LENGTH - 1], offset)
            out.append((name, digest - (1 << 64) if digest >> 63 else digest, first + start, count, offset))
    return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the symbols' end marks are unique, so it ends when no prefix that long repeats."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(5, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(5):
        key = key << 12 | padded[k : k + n]
    order = np.argsort(key)
    first = np.concatenate(([True], np.diff(key[order]) != 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
    width = 5
    while True:
        # A rank is the first place of its equals; only they are sorted again, within their places.
        equal = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
        if not len(equal):
            return order
        here = order[equal]
        ahead = np.zeros(len(here), dtype=np.int64)
        inside = here + width < n
        ahead[inside] = rank[here[inside] + width] + 1
        key = rank[here] * (n + 1) + ahead
        again = np.argsort(key)
        here, key = here[again], key[again]
        fresh = np.concatenate(([True], np.diff(key) != 0))
        order[equal], first[equal] = here, fresh
        rank[here] = equal[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        width *= 2


def agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b have in common."""
    padded = np.concatenate([symbols, np.zeros(8, dtype=np.int64)])
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    # Four symbols at a time, of 12 bits each; then what is left of the last four.
    four = padded[:-3] << 36 | padded[1:-2] << 24 | padded[2:-1] << 12 | padded[3:]
    while len(live):
        same = four[a[live] + out[live]] == four[b[live] + out[live]]
        live = live[same]
        out[live] += 4
    for _ in range(3):
        out += padded[a + out] == padded[b + out]
    return out


class RunIndex:
    """Run-compressed transform of texts set apart by unique end marks, with sampled run ends."""

    def __init__(self, texts: list[bytes]) -> None:
        # End marks are 1 to len(texts), bytes follow; together they must fit into 12 bits.
        marks = len(texts) + 1
        parts = []
        for k, text in enumerate(texts):
            parts += [np.frombuffer(text, dtype=np.uint8).astype(np.int64) + marks, np.array([k + 1])]
        self.symbols = np.concatenate(parts)
        order = suffix_array(self.symbols)
        last = self.symbols[order - 1]
        change = np.nonzero(np.diff(last))[0] + 1
        heads, tails = np.concatenate(([0], change)), np.concatenate((change - 1, [len(last) - 1]))
        #: The transform: a symbol and a length for each run.
        self.run_symbols, self.run_lengths = last[heads], tails - heads + 1
        #: Samples: places at run heads with their neighbours above, at run tails with those below.
        heads, tails = heads[heads > 0], tails[tails < len(order) - 1]
        self.above = self.sampled(order[heads], order[heads - 1])
        self.below = self.sampled(order[tails], order[tails + 1])

    def sampled(self, places: np.ndarray, neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in text order and how far each agrees with its neighbour."""
        by_place = np.argsort(places)
        places, neighbours = places[by_place], neighbours[by_place]
        return places, agreement(self.symbols, places, neighbours)

    def statistics(self) -> np.ndarray:
        """For every place the length of its longest match elsewhere, streamed from the samples before it."""
        at = np.arange(len(self.symbols))
        best = np.zeros(len(at), dtype=np.int64)
        for places, values in (self.above, self.below):
            if len(places):
                sample = np.searchsorted(places, at, side="right") - 1
                value = values[sample] - (at - places[sample])
                best = np.maximum(best, np.where(sample >= 0, value, 0))
        return best


def repeated_windows(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text the ranges (first, last) of places where a string of LENGTH starts that also is elsewhere."""
    long = RunIndex(texts).statistics() >= LENGTH
    out, start = [], 0
    for text in texts:
        own = long[start : start + len(text)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        out.append([(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])])
        start += len(text) + 1
    return out


RANGES = "array<struct<first: int, last: int>>"
_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, ch, body) rows, sorted by ah, to (ah, ch, ranges), in blocks of whole anchors."""

    def block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = repeated_windows([r[2] for r in rows])
        hit = [(r[0], r[1], [{"first": a, "last": b} for a, b in f]) for r, f in zip(rows, found) if f]
        columns = [pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.int64()),
                   pa.array([h[2] for h in hit], _RANGE)]
        return pa.RecordBatch.from_arrays(columns, ["ah", "ch", "ranges"])

    held: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[-1][0] and (size >= BLOCK or len(held) >= 2 * WIDE):
                yield block(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield block(held)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ah, ch, offset, body) rows cut up by how far windows reach to the left of the anchor, STEP places at a time.

    The windows of a class all hold one stretch of LENGTH - STEP + 1 bytes; equal windows have it in common, so it takes
    the anchor's part: the result is (ah2, ch2, ah, ch, base, body), base being the class's first place in the context.
    """
    for batch in batches:
        rows = []
        for ah, ch, offset, body in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(body) - LENGTH + 1
            # Place k reaches offset - k bytes to the left; a class ends where that is a multiple of STEP.
            base = 0
            while base < n:
                nearest = (offset - base) // STEP * STEP
                after = min(offset - nearest + 1, n)
                core = body[offset - nearest : offset - nearest - STEP + 1 + LENGTH]
                piece = body[base : after - 1 + LENGTH]
                name = xxhash.xxh3_64_intdigest(b"%d:%d:" % (ah, nearest) + core)
                digest = xxhash.xxh3_64_intdigest(piece, offset - base - nearest)
                rows.append((name, digest, ah, ch, base, piece))
                base = after
        names = ("ah2", "ch2", "ah", "ch", "base")
        hashed = [pa.array(np.array([r[k] for r in rows], dtype=np.uint64).view(np.int64)) for k in (0, 1)]
        rest = [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4)]
        yield pa.RecordBatch.from_arrays(
            [*hashed, *rest, pa.array([r[5] for r in rows], pa.binary())], [*names, "body"]
        )


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ah, ch, body in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(body) - LENGTH + 1
            digests = np.array([xxhash.xxh3_64_intdigest(body[k : k + LENGTH]) for k in range(n)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, ah)), pa.array(np.full(n, ch)), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(digests.view(np.int64))],
                ["ah", "ch", "at", "wh"],
            )


def _by_index(bodies: DataFrame) -> DataFrame:
    """(ah, ch, ranges) of contexts, whole anchors to a block."""
    # By a hash of the anchor: after a join by the anchor itself Spark leaves the repartition out as done already, and
    # may then broadcast the join's other side or split a partition, so that an anchor's rows end up in several tasks.
    sorted_ = bodies.select("ah", "ch", "body").repartition(F.xxhash64("ah")).sortWithinPartitions("ah")
    return sorted_.mapInArrow(_indexed, f"ah bigint, ch bigint, ranges {RANGES}")


def _by_class(classes: DataFrame) -> DataFrame:
    """(ah, ch, ranges) from classes of windows: counted, then indexed, then one by one."""
    c = F.col
    distinct = classes.groupBy("ah2", "ch2").agg(F.count("*").alias("times"), F.min("body").alias("body"))
    shapes = distinct.groupBy("ah2").agg(F.count("*").alias("shapes"))
    known = distinct.join(shapes, "ah2").withColumnsRenamed({"ah2": "ah", "ch2": "ch"})
    last = (F.length("body") - LENGTH).cast("int")
    whole = known.where("times > 1").select(
        "ah", "ch", F.array(F.struct(F.lit(0).alias("first"), last.alias("last"))).alias("ranges")
    )
    indexed = _by_index(known.where((c("shapes") > 1) & (c("shapes") <= WIDE)))
    windows = known.where(c("shapes") > WIDE).select("ah", "ch", "body").mapInArrow(
        _window_hashes, "ah bigint, ch bigint, at int, wh bigint"
    )
    twice = windows.groupBy("wh").agg(F.count("*").alias("times")).where("times > 1").select("wh")
    counted = windows.join(twice, "wh").groupBy("ah", "ch").agg(
        F.collect_list(F.struct(c("at").alias("first"), c("at").alias("last"))).alias("ranges")
    )
    hit = whole.unionByName(indexed).unionByName(counted).withColumnsRenamed({"ah": "ah2", "ch": "ch2"})
    moved = F.transform(
        "ranges",
        lambda r: F.struct(
            (r["first"] + c("base")).cast("int").alias("first"), (r["last"] + c("base")).cast("int").alias("last")
        ),
    )
    found = classes.select("ah2", "ch2", "ah", "ch", "base").join(hit, ["ah2", "ch2"])
    return found.groupBy("ah", "ch").agg(F.flatten(F.collect_list(moved)).alias("ranges"))


def marks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, start, ranges): contexts with repeated windows, once for each place where they occur."""
    c = F.col
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lo in range(0, len(texts), 64):
                found = [(lo + k, *x) for k, t in enumerate(texts[lo : lo + 64]) for x in contexts(t or b"")]
                take = pa.array([x[0] for x in found], pa.int64())
                rest = [pa.array([x[k] for x in found], pa.int64()) for k in (1, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), *rest],
                    ["id", "th", "ah", "ch", "start", "n", "off"],
                )

    keyed = docs.select(c(id_col).alias("id"), F.xxhash64(text).alias("th"), c(text).alias("t")).where("t is not null")
    found = checkpointed(
        keyed.mapInArrow(anchors, f"id {kind}, th bigint, ah bigint, ch bigint, start bigint, n bigint, off bigint")
    )
    place = F.struct(c("id").isNull().alias("none"), "id", "th", "start", "n", "off")
    distinct = found.groupBy("ah", "ch").agg(F.count("*").alias("times"), F.min(place).alias("rep"))
    distinct = checkpointed(distinct.select("ah", "ch", "times", "rep.id", "rep.th", "rep.start", "rep.n", "rep.off"))
    shapes = distinct.groupBy("ah").agg(F.count("*").alias("shapes")).where("shapes > 1")
    several = distinct.join(shapes, "ah")

    # One copy of each of several contexts is cut out of its text.
    wanted = several.groupBy(c("id").alias("rid"), c("th").alias("rth")).agg(
        F.collect_list(F.struct("ah", "ch", "shapes", "start", "n", "off")).alias("cuts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, cuts in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                body = [t[x["start"] : x["start"] + x["n"] + LENGTH - 1] for x in cuts]
                numbers = [pa.array([x[k] for x in cuts], pa.int64()) for k in ("ah", "ch", "shapes", "off")]
                names = ["ah", "ch", "shapes", "off", "body"]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(body, pa.binary())], names)

    same = c("id").eqNullSafe(c("rid")) & (c("th") == c("rth"))
    bodies = keyed.join(wanted, same).select("t", "cuts").mapInArrow(
        cut, "ah bigint, ch bigint, shapes bigint, off bigint, body binary"
    )
    bodies = checkpointed(bodies)
    by_index = _by_index(bodies.where(c("shapes") <= WIDE))
    classes = bodies.where(c("shapes") > WIDE).select("ah", "ch", "off", "body").mapInArrow(
        _classes, "ah2 bigint, ch2 bigint, ah bigint, ch bigint, base bigint, body binary"
    )
    by_class = _by_class(checkpointed(classes))
    whole = distinct.where("times > 1").select(
        "ah", "ch", F.array(F.struct(F.lit(0).alias("first"), (c("n") - 1).cast("int").alias("last"))).alias("ranges")
    )
    hit = whole.unionByName(by_index).unionByName(by_class)
    return found.join(hit, ["ah", "ch"]).select("id", "th", "start", "ranges")


def removed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): spans are the removed byte ranges (first, after) in order, kept the bytes left."""
    c = F.col
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = marks(docs, id_col, text).select("id", "th", "start", F.explode("ranges").alias("r"))
    spans = pieces.groupBy(c("id").alias("rid"), c("th").alias("rth")).agg(
        F.collect_list(F.struct((c("start") + c("r.first")).alias("a"), (c("start") + c("r.last") + LENGTH).alias("b"))).alias("s")
    )
    keyed = docs.select(c(id_col).alias("id"), F.xxhash64(text).alias("th"), c(text).alias("t"))
    joined = keyed.join(spans, c("id").eqNullSafe(c("rid")) & (c("th") == c("rth")), "left").select("id", "t", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
        for batch in batches:
            sizes, merged, kept = [], [], []
            for t, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                t = t or b""
                out: list[list[int]] = []
                for a, b in sorted({(x["a"], x["b"]) for x in s or []}):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                edges = [0, *(x for pair in out for x in pair), len(t)]
                sizes.append(len(t))
                merged.append([{"first": a, "after": b} for a, b in out])
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(
        run, f"id {kind}, n_bytes bigint, spans array<struct<first: bigint, after: bigint>>, kept binary"
    )
