"""Byte-pair encoding with forced boundaries, and decoding.

Merging never makes a token that is not in the vocabulary.  So if two neighbouring bytes never stand side by side
inside any token, no merge ever crosses them: the place between them is a certain cut, what lies on either side can be
encoded alone, and the pieces' ids are concatenated.  Two kinds of cuts are used:

* In a text, before a blank that follows a byte from which blanks are forced apart, where the byte ends a character
  that is not white space.  The splitting pattern never runs across such a place either, so the fragments (mostly words)
  are encoded once each and remembered for the task.
* Inside a fragment, after the splitting pattern, wherever the pair of bytes is forced apart.

Defined cases: a null text is an empty one and has no ids; a null id, repeated rows and ties come out as they went in;
an empty table gives an empty result; other columns of the input pass through under their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tallyflow.llm.common import lend, made, small_batches
from tallyflow.llm.fragments import BlankCuts, Fragments, joined, spread


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others in order for the letters from U+0100 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def blank_cut(apart: set[int]) -> Callable[[str], bool]:
    """Whether a blank behind a character may be cut off from it, given the bytes that blanks are forced apart from."""
    return lambda c: not c.isspace() and c.encode("utf-8", "surrogatepass")[-1] in apart


class Codec:
    """Encodes with one tokenizer file of the byte-level kind, given by its content."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        kinds = (parsed["model"]["type"], (parsed["pre_tokenizer"] or {}).get("type"), parsed["normalizer"])
        if kinds != ("BPE", "ByteLevel", None) or parsed["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix blank is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in parsed["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        tokenizer = Tokenizer.from_str(spec)
        self.split, self.merge = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize
        vocabulary = parsed["model"]["vocab"]
        #: Pairs of neighbouring letters of any token; all others are forced apart.
        self.joined = {token[k : k + 2] for token in vocabulary for k in range(len(token) - 1)}
        letters = byte_letters()
        self.blank = letters[0x20]
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        whole = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.added_pattern = re.compile("(" + "|".join(whole) + ")") if whole else None
        #: Letters that a blank is forced apart from, as bytes.
        self.apart = {b for b in range(256) if letters[b] + self.blank not in self.joined}
        self.cuts = BlankCuts(blank_cut(self.apart))
        self.first = Fragments(lambda pieces: joined([self.start(p) for p in pieces]))
        self.later = Fragments(lambda pieces: joined([self.fragment(" " + p) for p in pieces]))

    def parts(self, text: str) -> list[str]:
        """What the splitting pattern makes of a fragment, in the vocabulary's letters."""
        if text[:1] == " " and text.isascii():
            # A blank, ASCII letters and at most one of these marks: the pattern takes all letters, then the mark.
            if text[1:].isalpha():
                return [self.blank + text[1:]]
            if text[-1] in ".,;:?!" and text[1:-1].isalpha():
                return [self.blank + text[1:-1], text[-1]]
        return [word for word, _ in self.split(text)]

    def fragment(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        for word in self.parts(text):
            start = 0
            if not self.joined.issuperset(map(add, word, word[1:])):
                for k in range(1, len(word)):
                    if word[k - 1 : k + 1] not in self.joined:
                        ids.extend([t.id for t in self.merge(word[start:k])])
                        start = k
            ids.extend([t.id for t in self.merge(word[start:])])
        return tuple(ids)

    def start(self, piece: str) -> list[int] | tuple[int, ...]:
        """Ids of a text's first piece, or of an added token behind a zero (no text's piece holds an added token)."""
        token = self.added.get(piece[1:]) if piece[:1] == "\0" else None
        return self.fragment(piece) if token is None else [token]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        for held in (self.first, self.later):
            if held.full():
                held.forget()
        firsts, laters, parts_of = [], [], []
        for text in texts:
            parts = self.added_pattern.split(text) if self.added_pattern else [text]
            n = 0
            for part in filter(None, parts):
                head, *rest = ["\0" + part] if part in self.added else self.cuts.pieces(part)
                firsts.append(head)
                laters.append(rest)
                n += 1
            parts_of.append(n)
        sizes = np.fromiter(map(len, laters), dtype=np.int64, count=len(laters)) + 1
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at_first = np.zeros(upto[-1], dtype=bool)
        at_first[upto[:-1]] = True
        # Later pieces' codes come before first pieces' in the table that ids are taken from.
        of = np.zeros(upto[-1], dtype=np.int64)
        of[~at_first] = self.later.codes(laters)
        of[at_first] = self.first.codes([firsts]) + self.later.ends.n - 1
        later, first = self.later.values_of_all, self.first.values_of_all
        ends = np.concatenate([self.later.ends.all, self.first.ends.all[1:] + later.n])
        ids, each = spread(np.concatenate([later.all, first.all]), ends, of)
        ids_upto = np.concatenate(([0], np.cumsum(each)))[upto]
        return ids, np.diff(ids_upto[np.concatenate(([0], np.cumsum(parts_of, dtype=np.int64)))])


class Decoder:
    """Gives back the text of token ids; bytes that make no character become replacement characters."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        tokens = {i: bytes(value[x] for x in token) for token, i in parsed["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
        each = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        self.ends = np.cumsum([0, *map(len, each)], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(each), dtype=np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other."""
        data, lengths = spread(self.bytes, self.ends, ids.astype(np.int64))
        upto = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", errors="replace") for a, b in zip(upto, upto[1:])]


def read_spec(path: str) -> str:
    """A tokenizer file's content.  The driver reads it once; it has a vocabulary's size, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The table with a column of token ids, in one pass without a shuffle."""
    if ids in docs.columns:
        raise ValueError(f"the table has a column {ids} already")
    small_batches(docs.sparkSession)
    lent = lend(docs.sparkSession, spec)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = made(lent, Codec)
        for batch in batches:
            flat, sizes = codec.encode([t or "" for t in batch.column(at).to_pylist()])
            ends = np.concatenate(([0], np.cumsum(sizes)))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, ids])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(ids, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, spec: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The table with the text of its token ids (null ids: empty), special tokens kept."""
    if text in encoded.columns:
        raise ValueError(f"the table has a column {text} already")
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(spec)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            column = batch.column(at)
            ends = column.offsets.to_numpy()  # a null row has no ids either
            values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
            texts = decoder.decode(values, np.diff(ends))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField(text, StringType())]))
