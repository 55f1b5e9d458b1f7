"""Groups, links and counts against a plain alignment of whole texts."""

import bisect
import collections
import hashlib

import numpy as np
import pytest
import sentencepiece
from conftest import odd_rows, sentence, write_tables
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyflow.llm import alignment, bpe
from tallyflow.llm import queries as Q

SF = "/root/testdata/sf0.001"
FIRST = Tokenizer.from_file(Q.TOKENIZER)
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=Q.PIECES)
LETTERS = bpe.byte_letters()


def ends(parts):
    out = [0]
    for p in parts:
        out.append(out[-1] + len(p))
    return out


def plain(text):
    """Ids of both sides, groups as text and all linked pairs, by comparing byte ranges one with another."""
    if not text:
        return [], [], [], []
    a = FIRST.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.encode(text)
    a_bytes = [bytes(LETTERS.index(c) for c in FIRST.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if SECOND.is_byte(i) else p.replace("\u2581", " ").encode() for i in b for p in [SECOND.id_to_piece(i)]]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], [], [], []
    x, y = ends(a_bytes), ends(b_bytes)
    shared = sorted(set(x[1:]) & set(y[1:]))
    shown, linked, i, j = [], [], 0, 0
    for cut in shared:
        k, m = bisect.bisect_left(x, cut), bisect.bisect_left(y, cut)
        shown.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
        linked += [(a[p], b[q]) for p in range(i, k) for q in range(j, m) if x[p] < y[q + 1] and y[q] < x[p + 1]]
        i, j = k, m
    return a, b, shown, linked


def plain_rows(docs):
    found = [(k, *plain(t)) for k, t in docs]
    counts = collections.Counter(p for *_, linked in found for p in set(linked))
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    rows = []
    for k, a, b, shown, linked in found:
        digest = hashlib.sha256(";".join(shown).encode()).hexdigest() if shown else ""
        best = sum(counts[p] == most[p[0]] for p in linked)
        rows.append((k, len(a), len(b), len(shown), len(linked), best, sum(counts[p] for p in linked), digest))
    return collections.Counter(rows)


EXTRA = [
    "a ", " a", "  ", " ", "\n", "x  y \n z\t w", "lower \u2581 block", "<|endoftext|> and <s> are text", "\u6f22\u5b57" * 40,
    "na\u00efve \u0301 caf\u00e9\u00a0x", "\u200b \u3000 end \u2003x", "\x00 \x1c y", "\U0001f600 \U0001f600", "don't you'll",
]


@pytest.mark.parametrize("share", [alignment.SHARE, 5])
def test_rows_equal_a_plain_alignment(spark, tmp_path, monkeypatch, share):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 2_500]
    docs += [(10_000 + k, t) for k, t in enumerate(EXTRA)] + [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 2_500]
    folder = write_tables(spark, tmp_path, spark.createDataFrame(docs, "doc_id bigint, text string"))
    monkeypatch.setattr(alignment, "SHARE", share)  # all pairs broadcast, or some
    got = collections.Counter(map(tuple, Q.op13_alignment(spark, folder).collect()))
    assert got == plain_rows(docs)


ALIGNER = alignment.Aligner(bpe.read_spec(Q.TOKENIZER), alignment.read_model(Q.PIECES))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab ,.'\n\t1\u00e9\u6f22\u2581<|\u00a0"), max_size=30), min_size=1, max_size=4))
def test_pieces_between_blanks_give_what_whole_texts_give(texts):
    for text, (counts, shown, linked) in zip(texts, ALIGNER.align(texts)):
        a, b, groups, pairs = plain(text)
        assert counts.tolist() == [len(a), len(b), len(groups)] and shown.decode() == ";".join(groups)
        assert [(p >> alignment.SECOND, p & (1 << alignment.SECOND) - 1) for p in linked.tolist()] == pairs


@given(st.sets(st.integers(1, 60), min_size=1), st.sets(st.integers(1, 60), min_size=1))
def test_division_ends_at_every_shared_end(x, y):
    a, b = sorted(x | {61}), sorted(y | {61})
    found = alignment.groups(np.array(a), np.array(b), np.array([[0, len(a), 0, len(b)]])).tolist()
    assert [a[g[1] - 1] for g in found] == sorted((x & y) | {61}) == [b[g[3] - 1] for g in found]
    assert [g[0] for g in found] == [0] + [g[1] for g in found[:-1]] and [g[2] for g in found] == [0] + [g[3] for g in found[:-1]]


def test_a_long_text_without_blanks_is_divided():
    (counts, _, _), = ALIGNER.align(["ab1," * 20_000])
    assert counts[2] > 1000
