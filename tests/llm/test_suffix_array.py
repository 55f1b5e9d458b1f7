"""Suffix arrays of the run-compressed index."""

import random

import numpy as np
import pytest

from tallyflow.llm import bwt_dedup


def symbols_of(texts):
    marks = len(texts) + 1
    return np.concatenate([np.array([*(b + marks for b in t), k + 1], dtype=np.int64) for k, t in enumerate(texts)])


ODD = {
    "one": [b"a"], "empty": [b"", b""], "copies": [b"abcabc" * 90, b"abcabc" * 90, b"bcabca" * 20],
    "one byte": [b"\xff" * 700, b"\xff" * 300, b"\0" * 50], "mixed": [bytes(random.Random(k).choices(b"ab", k=200)) for k in range(9)],
}


@pytest.mark.parametrize("texts", ODD.values(), ids=ODD)
def test_suffixes_are_in_order(texts):
    symbols = symbols_of(texts)
    got = bwt_dedup.suffix_array(symbols).tolist()
    assert got == sorted(range(len(symbols)), key=lambda k: symbols[k:].tolist())


def test_only_equal_prefixes_are_sorted_again(monkeypatch):
    rng = random.Random(1)
    repeat = rng.randbytes(600)
    symbols = symbols_of([rng.randbytes(20_000) + repeat + b"x", rng.randbytes(20_000) + repeat + b"y"])
    sizes = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *args, **more: sizes.append(len(a)) or argsort(a, *args, **more))
    bwt_dedup.suffix_array(symbols)
    assert sizes[0] == len(symbols) and max(sizes[1:]) < 2_000
