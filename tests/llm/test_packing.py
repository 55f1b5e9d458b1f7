"""Pieces against the library's ids, and plans against what packing must keep and what a plain search finds."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from conftest import odd_rows, write_tables
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyflow.llm import bpe, packing
from tallyflow.llm import queries as Q

SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(Q.WORDS)


def plain_pieces(docs):
    out = collections.Counter()
    for k, t in docs:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], dtype="<u4")
            out[k, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def check_layout(rows):
    """Every sequence is gapless from 0 and holds at most 4096 tokens; gives the number of sequences."""
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence)


@pytest.mark.parametrize("source", ["sf0.001", "sf0.01", "odd"])
def test_pieces_and_sequences(spark, tmp_path, source):
    folder = write_tables(spark, tmp_path, spark.createDataFrame([r[:2] for r in odd_rows()], "doc_id bigint, text string")) if source == "odd" else f"/root/testdata/{source}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = Q.op11_packing(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == plain_pieces(docs)
    total = sum(r.length for r in rows)
    assert check_layout(rows) == -(-total // 4096)  # no packing has fewer


def test_no_document_no_sequence(spark, tmp_path, none):
    assert Q.op11_packing(spark, write_tables(spark, tmp_path, none)).count() == 0


CODEC = packing.WordCodec(bpe.read_spec(Q.WORDS))
BLANK = [chr(c) for c in range(0x3001) if chr(c).isspace()]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(BLANK + list("aB's1.<|\u0301\u03a3\u00e9\u0130\u6f22")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_give_the_ids_of_whole_texts(text):
    for t in (text, text + "<|endoftext|>" + text):
        (ids,) = CODEC.encode([t])
        assert ids.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """The fewest sequences, by trying every place for every piece."""
    best = len(lengths)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for i in {r: i for i, r in enumerate(room) if r >= lengths[k]}.values():
            place(k + 1, [r - lengths[k] * (i == j) for j, r in enumerate(room)])
        place(k + 1, [*room, capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_use_every_piece_once_and_hardly_more_than_the_fewest_sequences(lengths):
    made = packing.plan(collections.Counter(lengths), 20)
    assert all(sum(p) <= 20 and n > 0 for p, n in made)
    assert collections.Counter(itertools.chain.from_iterable(p * n for p, n in made)) == collections.Counter(lengths)
    assert sum(n for _, n in made) <= fewest(sorted(lengths, reverse=True), 20) + 1


def test_exact_complements_come_before_best_fit():
    # A best fit of 60 puts 30 beside it; the exact complement is 21 + 19.
    made = packing.plan({60: 1, 39: 1, 21: 1, 19: 1, 61: 1}, 100)
    assert sorted(map(sorted, (p for p, _ in made))) == [[19, 21, 60], [39, 61]]
    assert packing.plan({50: 7}, 100) == [((50, 50), 3), ((50,), 1)]


def test_plans_do_not_grow_with_the_number_of_pieces():
    rng = random.Random(1)
    counts = {x: rng.randrange(1, 10**12 // x) for x in range(1, 4097)}
    made = packing.plan(counts, 4096)
    total = sum(x * n for x, n in counts.items())
    assert len(made) < 3 * 4096 and sum(n for _, n in made) <= -(-total // 4096) * 1.001


def test_every_plain_letter_gives_the_ids_of_the_library():
    letters = [chr(c) for c in range(0x41, 0x250) if packing.PLAIN.fullmatch(chr(c))]
    words = [a + b + m for a, b in zip(letters, letters[7:] + letters[:7]) for m in ("", ".", "!")] + letters
    assert len(letters) > 400
    assert all(CODEC.ids(w) == LIBRARY.encode(w, add_special_tokens=False).ids for w in words)
