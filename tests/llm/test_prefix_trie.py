"""Nodes against a trie of dictionaries, with blocks of every size and partitions that cut nodes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyflow.llm import prefix_trie
from tallyflow.llm import queries as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chars int, pos int, head string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_nodes(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(full) + 1):
            members[full[:d]].append(c)
        ends[full].append(c)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return collections.Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def made(rows, seed=0):
    rng = random.Random(seed)
    rows = [(*r, 7, 7, "x") for r in rows]
    rng.shuffle(rows)
    return rows


def few_words(seed, n, most):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(("user", "bot")), rng.choice(("a", "bé", "")) * rng.randrange(1, 3))
        for c in rng.sample(range(3 * n), n) for t in range(rng.randrange(1, most))
    ]


CASES = {
    "few words": few_words(1, 300, 7),
    "copies": [(c, t, "user", f"turn {t}") for c in range(250) for t in range(3)] + [(c, 0, "s", "one") for c in range(300, 420)],
    "long": [(c, t, "user", f"{t}" if c < 5 or t < 40 * c else f"{c} {t}") for c in range(1, 9) for t in range(300)],
    "odd": [
        (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "bot", None), (None, 1, "user", "lost"),
        (100, 0, "ab", "c"), (101, 0, "a", "bc"), (102, None, "", ""), (103, 5, "user", "\U0001f600" * 3), (-7, 1, "u", "t"),
    ],
    "one": [(100, 0, "user", "x")],
    "none": [],
}


@pytest.mark.parametrize("block, most", [(1, 2), (3, 40), (3, 0), (prefix_trie.BLOCK_ROWS, prefix_trie.GATHERED)])
@pytest.mark.parametrize("case", CASES)
def test_nodes(spark, tmp_path, monkeypatch, case, block, most):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix_trie, "GATHERED", most)
    if block > 3:
        monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 50)
    rows = made(CASES[case])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    df = Q.op12_prefix_trie(spark, str(tmp_path))
    assert df.columns == list(FIELDS) and set(dict(df.dtypes).values()) == {"bigint", "string"}
    assert collections.Counter(map(tuple, df.collect())) == plain_nodes(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_table(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert collections.Counter(map(tuple, Q.op12_prefix_trie(spark, f"/root/testdata/{sf}").collect())) == plain_nodes(rows)


def test_extents_are_those_of_a_plain_walk():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 64, 100):
        lcp = rng.integers(0, 5, n)
        row, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(7)))
        left, right = prefix_trie.extents(lcp, row, depth)
        for i, d, a, b in zip(row, depth, left, right):
            while i > a and lcp[i] >= d:
                i -= 1
            assert i == a and (a == 0 or lcp[a] < d) and (lcp[a + 1 : b + 1] >= d).all() and (b == n - 1 or lcp[b + 1] < d)
