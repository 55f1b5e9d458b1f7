"""Benchmark decontamination through template windows, so that re-parameterised questions are caught too.

Tokens are the blank-separated parts of a text without outer punctuation, lower-cased; characters of scripts written without
blanks are tokens of their own.  Numbers, units and names become
typed placeholders (``slots``), everything else stays a plain word.  A name is a capitalised word (not one in capitals
throughout) that does not start a sentence; as an item may begin in the midst of a document's sentence, windows of documents
are also looked up with a name in their first place read as a plain word.  Every benchmark item is cut into windows of ``WINDOW`` tokens (an item with fewer is one window), every
document too, and windows with equal templates are joined by hash.  Joined windows on one diagonal (document place less
item place) form a passage; it counts if its slots are consistent: wherever the item repeats a value, the document
repeats the value that it has instead.  Windows whose slot values are the item's own count in any passage, and windows with
few plain words only if they are.

Documents are hashed in place and only windows that may match leave a task: a bitmap of fixed size, made from all
benchmark windows by an aggregate, lets through every matching window and few others.

Defined cases: null and empty texts have no windows; an item of fewer than ``PLAIN`` tokens
counts only where all its tokens are equal; a null id is an id like any other; rows of a document with equal id and text are
one document; items repeated under several ids are all reported; an empty table on either side gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import fresh, small_batches

#: Tokens of a window.
WINDOW = 10
#: Plain words that a window must have for other slot values to be accepted.
PLAIN = 5
#: Bits of the bitmap, as a power of two: 2 MB whatever the benchmark's size.
BITMAP = 24
#: Bytes of benchmark windows up to which they are broadcast.
BROADCAST = 1 << 23
#: Distinct tokens a task remembers before it starts anew; only speed depends on it.
REMEMBERED = 400_000

# Number words and units that become placeholders.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty hundred thousand million"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters "
    "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees"
)

PLAIN_WORD, NUMBER, UNIT, NAME, NOTHING = range(5)
NUMERIC = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
MEASURE = re.compile(r"[+-]?\d[\d.,]*(" + "|".join(UNITS.split()) + ")")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+") + "“”‘’«»¿¡…–—、。〈〉《》「」『』【】・！（），：；？～"
#: Characters of scripts without blanks between words: Thai, Lao, Burmese, Khmer, kana and Han.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3001-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff！（），：；？～]")
BASE = np.uint64(0x9E3779B97F4A7C15)


class Lexicon:
    """Numbers the tokens seen so far; per token its kind, its surface and its template's hash."""

    def __init__(self) -> None:
        self.units, self.numbers = set(UNITS.split()), set(NUMBER_WORDS.split())
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.surface: list[str] = []
        #: By token: hash and kind within a sentence, hash and kind at its start, whether it ends a sentence.
        self.rows: list[tuple[int, int, int, int, bool]] = []
        self.arrays = [np.zeros(0, dtype=np.uint64 if k in (0, 2) else np.int64) for k in range(5)]

    def add(self, raw: str) -> int:
        core = raw.strip(EDGE)
        low = core.lower()
        if not core:
            kind = NOTHING
        elif NUMERIC.fullmatch(low) or low in self.numbers or MEASURE.fullmatch(low):
            kind = NUMBER
        elif low in self.units:
            kind = UNIT
        else:
            kind = PLAIN_WORD
        own = self.template(kind, low)
        within = (self.template(NAME, low), NAME) if kind == PLAIN_WORD and core[0].isupper() and not core.isupper() else (own, kind)
        self.known[raw] = len(self.rows)
        self.rows.append((*within, own, kind, raw.rstrip("\"')]»”")[-1:] in {".", "!", "?", ":", "…"}))
        self.surface.append(low)
        return self.known[raw]

    def columns(self) -> list[np.ndarray]:
        fresh_rows = self.rows[len(self.arrays[0]) :]
        if fresh_rows:
            new = [np.array([r[k] for r in fresh_rows], dtype=a.dtype) for k, a in enumerate(self.arrays)]
            self.arrays = [np.concatenate(pair) for pair in zip(self.arrays, new)]
        return self.arrays

    @staticmethod
    def template(kind: int, word: str) -> int:
        return xxhash.xxh64_intdigest(word if kind == PLAIN_WORD else f"<{kind}>", kind)

    def tokens(self, text: str) -> np.ndarray:
        known = self.known
        parts = text.split() if text.isascii() else SPACELESS.sub(r" \g<0> ", text).split()
        return np.array([known[t] if t in known else self.add(t) for t in parts], dtype=np.int64)


class Windows:
    """Template windows of many texts at once."""

    def __init__(self, lexicon: Lexicon, texts: list[str | None]) -> None:
        self.lexicon = lexicon
        if len(lexicon.rows) > REMEMBERED:
            lexicon.clear()
        parts = [lexicon.tokens(t or "") for t in texts]
        token = np.concatenate([*parts, np.zeros(0, dtype=np.int64)])
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        columns = lexicon.columns()
        opens = np.ones(len(token), dtype=bool)
        opens[1:] = (owner[1:] != owner[:-1]) | (columns[4][token[:-1]] == 1)
        kind = np.where(opens, columns[3][token], columns[1][token])
        hashed = np.where(opens, columns[2][token], columns[0][token])
        real = kind != NOTHING
        self.token, self.owner, self.kind, self.hash = token[real], owner[real], kind[real], hashed[real]
        #: Hashes of the tokens as they are at the start of a sentence.
        self.opening = columns[2][self.token]
        counts = np.bincount(self.owner, minlength=len(parts))
        self.count, self.start = counts, np.cumsum(counts) - counts

    def hashes(self, length: int) -> np.ndarray:
        """A hash for each place where a window of this length fits into the text; windows of other lengths differ."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return self._hashed(length, [self.hash[k : k + n] for k in range(length)])

    def opened(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows that a name begins, and their hashes with it as a plain word."""
        n = max(len(self.hash) - length + 1, 0)
        at = np.nonzero((self.kind[:n] == NAME) & self.inside(length))[0]
        return at, self._hashed(length, [self.opening[at], *[self.hash[at + k] for k in range(1, length)]])

    @staticmethod
    def _hashed(length: int, columns: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = np.full(len(columns[0]), length, dtype=np.uint64)
            for column in columns:
                h = (h ^ column) * BASE
                h ^= h >> np.uint64(29)
        return h

    def inside(self, length: int) -> np.ndarray:
        n = max(len(self.hash) - length + 1, 0)
        return self.owner[:n] == self.owner[length - 1 : length - 1 + n]

    def slots(self, at: int, length: int) -> list[str]:
        return [
            f"{self.kind[k]}:{self.lexicon.surface[self.token[k]]}"
            for k in range(at, at + length)
            if self.kind[k] != PLAIN_WORD
        ]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Windows(Lexicon(), batch.column(1).to_pylist())
        rows: list[tuple] = []
        lengths = np.minimum(found.count, WINDOW)
        for length in sorted({int(x) for x in lengths if x}):
            h, inside = found.hashes(length), found.inside(length)
            for at in np.nonzero(inside & (lengths[found.owner[: len(h)]] == length))[0]:
                plain = int((found.kind[at : at + length] == PLAIN_WORD).sum())
                rows.append((found.owner[at], at - found.start[found.owner[at]], length, int(h[at].view(np.int64)),
                             plain, found.slots(at, length)))
        ids = batch.column(0).take(pa.array([int(r[0]) for r in rows], pa.int64()))
        columns = [pa.array([int(r[k]) for r in rows], pa.int64()) for k in (1, 2, 3, 4)]
        yield pa.RecordBatch.from_arrays(
            [ids, *columns, pa.array([r[5] for r in rows], pa.list_(pa.string()))],
            ["item_id", "item_at", "length", "wh", "plain", "item_slots"],
        )


def item_windows(items: DataFrame, id_col: str = "item_id", text: str = "text") -> DataFrame:
    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col), text).mapInArrow(
        _item_windows,
        f"item_id {kind}, item_at bigint, length bigint, wh bigint, plain bigint, item_slots array<string>",
    )


def _bitmap(windows: DataFrame) -> bytes:
    """Bit k is set if k are the top bits of any window's hash; at most 2 ** (BITMAP - 6) numbers reach the driver."""
    top = F.shiftrightunsigned("wh", 64 - BITMAP)
    words = windows.groupBy(F.shiftright(top, 6).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (top % 64).cast("int"))).alias("bits")
    )
    bitmap = np.zeros(1 << (BITMAP - 6), dtype=np.int64)
    for word, bits in words.collect():
        bitmap[word] = bits
    return bitmap.tobytes()


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, th, item_id, n_windows, item_windows, exact): every document and item with a consistent common passage.

    th is the 64-bit hash of the document's text, n_windows counts the item's windows that the document holds in
    consistent passages or with the item's own values, exact says that some passage has those values throughout.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = item_windows(items, item_id, item_text)
    # A window is about 96 bytes, its slots and its item's id.  Spark would go by the size of the items' files, which is far
    # less for a benchmark that compresses well, so it is not left to choose what is broadcast.
    held = F.octet_length(F.concat_ws("", "item_slots", F.col("item_id").cast("string")))
    size = F.lit(96).cast("bigint") + 16 * F.size("item_slots") + held
    sized = dict(windows.groupBy("length").agg(F.sum(size)).collect())
    lengths = sorted(map(int, sized))  # WINDOW at most
    shared = spark.sparkContext.broadcast(_bitmap(windows))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, dtype=np.uint64)
        lexicon = Lexicon()
        for batch in batches:
            found = Windows(lexicon, batch.column(2).to_pylist())
            rows: list[tuple] = []
            for length in lengths:
                inside = np.nonzero(found.inside(length))[0]
                for first, (places, h) in enumerate(((inside, found.hashes(length)[inside]), found.opened(length))):
                    top = (h >> np.uint64(64 - BITMAP)).astype(np.int64)
                    may = (bitmap[top >> 6] >> (top & 63).astype(np.uint64)) & np.uint64(1)
                    for k in np.nonzero(may)[0]:
                        at = places[k]
                        rows.append((found.owner[at], at - found.start[found.owner[at]], int(h[k].view(np.int64)),
                                     found.slots(at + first, length - first)))
            take = pa.array([int(r[0]) for r in rows], pa.int64())
            numbers = [pa.array([int(r[k]) for r in rows], pa.int64()) for k in (1, 2)]
            slots = pa.array([r[3] for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *numbers, slots],
                ["id", "th", "at", "wh", "slots"],
            )

    hits = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text).mapInArrow(
        run, f"id {kind}, th bigint, at bigint, wh bigint, slots array<string>"
    )
    same = F.col("slots") == F.col("item_slots")
    looked_up = windows.hint("broadcast" if sum(sized.values()) <= BROADCAST else "merge")
    joined = hits.join(looked_up, "wh").where(same | ((F.col("plain") >= PLAIN) & (F.size("slots") == F.size("item_slots"))))
    passage = joined.groupBy("id", "th", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(
        F.collect_set("item_at").alias("places"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("pairs"),
        F.collect_set(F.when(same, F.col("item_at"))).alias("equal"),
        F.bool_and(same).alias("exact"),
    )
    consistent = F.size(F.array_distinct("pairs.item_slots")) == F.size("pairs")
    sizes = windows.groupBy("item_id").agg(F.count("*").alias("item_windows"))
    # Of an inconsistent passage the windows with the item's own values are left.
    left = passage.withColumns({"places": F.when(consistent, F.col("places")).otherwise(F.col("equal")),
                                "exact": F.col("exact") | ~consistent}).where(F.size("places") > 0)
    found = left.groupBy("id", "th", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_windows"),
        F.bool_or("exact").alias("exact"),
    )
    on = found["item_id"].eqNullSafe(sizes["item_id"])
    return found.join(sizes, on).select("id", "th", found["item_id"], "n_windows", "item_windows", "exact")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, that have no passage in common with an item."""
    rid, rth, th = fresh(docs, "rid", "rth", "th")
    found = matches(docs, items, id_col, text).select(F.col("id").alias(rid), F.col("th").alias(rth)).distinct()
    marked = docs.withColumn(th, F.xxhash64(text))
    on = F.col(id_col).eqNullSafe(F.col(rid)) & (F.col(th) == F.col(rth))
    return marked.join(found, on, "left_anti").drop(th)
