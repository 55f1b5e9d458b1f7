"""SimHash near-duplicates found through the binary Golay code.

The [23, 12] Golay code is perfect: every 23-bit word lies within 3 bits of exactly one of 4,096 codewords.  A
fingerprint of 64 bits is cut into three segments (22, 21 and 21 bits).  If two fingerprints differ in at most 3 bits,
then by the pigeonhole principle the two segments with the fewest errors have at most one each.  A fingerprint is
indexed, for each of the three pairs of segments, by the codewords of both; it is looked up by the codewords of both
and of every word one flipped bit away.  So no link is missed, each pair of segments gives a 24-bit key, and candidates
are verified inside the join by the bits that really differ.  Equal fingerprints are one row before any of this.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and are linked like any other; a
null id never is a component's name, unless all ids of the component are null; repeated rows come out once each; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyflow.llm.common import checkpointed, fresh, small_batches, star_components

#: Fixed by the contract of the fingerprint.
SEED = 42
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Bits of each segment of a fingerprint, lowest bits first.
SEGMENTS = (22, 21, 21)
#: Differing bits that link two fingerprints; the pigeonhole argument above holds up to this.
RADIUS = 3


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Maps arrays of 23-bit words to the index (0 to 4,095) of the one codeword within 3 bits."""

    def __init__(self) -> None:
        self.syndrome = np.array([_remainder(1 << b) for b in range(23)], dtype=np.uint32)
        self.error = np.zeros(1 << 11, dtype=np.uint32)
        for i in range(23):
            for j in range(i + 1):
                for k in range(j + 1):
                    e = 1 << i | 1 << j | 1 << k  # equal positions give the errors of one and two bits
                    self.error[_remainder(e)] = e

    def index(self, words: np.ndarray) -> np.ndarray:
        words = words.astype(np.uint32)
        syndrome = np.zeros_like(words)
        for b in range(23):
            syndrome ^= np.where(words >> np.uint32(b) & np.uint32(1), self.syndrome[b], np.uint32(0))
        return (words ^ self.error[syndrome]) >> np.uint32(11)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """XXH64 of every n-word shingle, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - n] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist())]
    return np.array(hashes, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        block = hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(bits.view(">i8")[0])


def text_hash(text: str) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, th, fp): one row per document with its text's hash, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *(StructField(n, LongType()) for n in ("th", "fp"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = [majority(shingle_hashes(t or b"", shingle)) for t in texts]
            columns = [batch.column(0), batch.column(2), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "th", "fp"])

    return docs.select(F.col(id_col).alias("id"), text, text_hash(text).alias("th")).mapInArrow(run, schema)


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    out, shift = [], 0
    for width in SEGMENTS:
        out.append((fps.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        shift += width
    return out


PAIRS = ((0, 1), (0, 2), (1, 2))


def _index_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        own = [code.index(s).astype(np.int64) for s in _segments(fps)]
        for k, (i, j) in enumerate(PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(k << 24 | own[i] << 12 | own[j]), pa.array(fps)], ["key", "fp"])


def _probe_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            near = []
            for segment, width in zip(_segments(fps), SEGMENTS):
                flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.uint64)
                found = np.sort(code.index(segment[:, None] ^ flips).astype(np.int64), axis=1)
                first = np.ones(found.shape, dtype=bool)
                first[:, 1:] = found[:, 1:] != found[:, :-1]
                near.append((found, first))
            for k, (i, j) in enumerate(PAIRS):
                (a, a_first), (b, b_first) = near[i], near[j]
                row, x, y = np.nonzero(a_first[:, :, None] & b_first[:, None, :])
                keys = k << 24 | a[row, x] << 12 | b[row, y]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[row])], ["key", "fp"])


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of the given distinct fingerprints (column fp) that differ in at most ``radius`` bits."""
    if radius > RADIUS:
        raise ValueError(f"the keys find fingerprints up to {RADIUS} differing bits")
    spread = distinct_fps.select("fp").repartition("fp")
    index = spread.mapInArrow(_index_keys, "key bigint, a bigint")
    probe = spread.mapInArrow(_probe_keys, "key bigint, b bigint")
    near = (F.col("a") < F.col("b")) & (differing(F.col("a"), F.col("b")) <= radius)
    # A fingerprint has three rows here and up to 108 there.  Spark takes both for as large as the fingerprints and would
    # broadcast either; merged, neither side has to fit anywhere.
    return index.hint("merge").join(probe, (index["key"] == probe["key"]) & near).select("a", "b").distinct()


def _rooted(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root): the smallest id of each fingerprint, and one root for all fingerprints that links reach."""
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    stars = star_components(links(nodes, radius), "a", "b")
    return nodes.join(stars, nodes["fp"] == stars["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """(id, fp, component): the smallest id that links of at most ``radius`` differing bits reach, itself included."""
    fps = checkpointed(fingerprints(docs, id_col, text, shingle))
    rooted = _rooted(fps, radius)
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = rooted.join(names, "root").select("fp", "component")
    # Merged, as repeated rows take next to nothing in the files by which Spark sizes the fingerprints.
    return fps.join(by_fp.hint("merge"), "fp").select("id", "fp", "component")


def first_of_each(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS
) -> DataFrame:
    """The documents, with their own columns, of which one stays of each component: the one of the smallest id.

    Null ids come after all others; of rows with the same id the one of the smallest text hash stays, and of repeated
    rows (same id and text) one.
    """
    c = F.col
    th, rid, rth, times = fresh(docs, "th", "rid", "rth", "times")
    fps = checkpointed(fingerprints(docs, id_col, text, shingle))
    # Two joins are merged, as repeated rows take next to nothing in the files by which Spark sizes documents and fingerprints.
    rooted = fps.join(_rooted(fps, radius).select("fp", "root").hint("merge"), "fp")
    found = checkpointed(rooted.groupBy("root", "id", "th").agg(F.count("*").alias("times")))
    one = F.struct(c("id").isNull().alias("none"), "id", "th", "times")
    stays = found.groupBy("root").agg(F.min(one).alias("s")).select("root", "s.*")
    gone = found.join(stays.select("root", c("id").alias("i"), c("th").alias("h")), "root").where(
        ~(c("id").eqNullSafe(c("i")) & (c("th") == c("h")))
    )
    marks = gone.select(c("id").alias(rid), c("th").alias(rth), F.lit(0).cast("bigint").alias(times)).union(
        stays.where("times > 1").select("id", "th", "times")
    )
    own = [f"`{x}`" for x in docs.columns]
    hashed, on = docs.withColumn(th, text_hash(text)), c(id_col).eqNullSafe(c(rid)) & (c(th) == c(rth))
    once = hashed.join(marks, on, "left").where(c(times).isNull()).select(*own)
    # Rows that repeat id and text are few; only they are brought together.
    repeated = hashed.join(marks.where(c(times) > 1).hint("merge"), on)
    return once.union(repeated.dropDuplicates([id_col, th]).select(*own))
