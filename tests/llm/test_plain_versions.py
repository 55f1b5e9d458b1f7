"""Votes, template windows and tree scores against plain versions."""

import collections
import math
import re

import numpy as np
import pytest
from conftest import sentence, write_tables

from tallyflow.llm import context_tree, lsa_vote, templates
from tallyflow.llm import queries as Q

SF = "/root/testdata/sf0.001"


def test_votes_are_those_of_a_plain_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").withColumnRenamed("quality", "label")
    model = lsa_vote.fit(docs, labels)
    got = {r.id: r.score for r in lsa_vote.score(docs, model).collect()}
    counter = lsa_vote.Terms()
    for r in docs.collect():
        terms, weights = counter.counts(r.text or "")
        vector = sum((w * model.rarity[t] * model.axes[t].astype(float) for t, w in zip(terms, weights)), np.zeros(model.axes.shape[1]))
        length = math.sqrt(sum(x * x for x in vector)) or 1.0
        cosines = [sum(a * b for a, b in zip(vector / length, v)) for v in model.vectors]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: lsa_vote.NEIGHBOURS]
        weight = {k: max(cosines[k], 1e-6) ** lsa_vote.SHARPNESS * model.votes[k] for k in near}
        want = sum(w * model.labels[k] for k, w in weight.items()) / sum(weight.values())
        assert got[r.doc_id] == pytest.approx(want, abs=2e-3)


def plain_tokens(text):
    """(kind, lower-case core, kind as if it opened a sentence) of every token that has a core."""
    out, opens = [], True
    for raw in templates.SPACELESS.sub(r" \g<0> ", text or "").split():
        core = raw.strip(templates.EDGE)
        low = core.lower()
        if not core:
            kind = None
        elif templates.NUMERIC.fullmatch(low) or low in templates.NUMBER_WORDS.split() or templates.MEASURE.fullmatch(low):
            kind = "number"
        elif low in templates.UNITS.split():
            kind = "unit"
        else:
            kind = "plain"
        named = kind == "plain" and core[0].isupper() and not core.isupper() and not opens
        if kind:
            out.append(("name" if named else kind, low, kind))
        opens = re.search(r"[.!?:…][\"')\]»”]*$", raw) is not None
    return out


def plain_windows(tokens, length, opened=False):
    for k in range(len(tokens) - length + 1):
        window = [t[:2] for t in tokens[k : k + length]]
        if opened:
            if window[0][0] != "name":
                continue
            window[0] = (tokens[k][2], window[0][1])
        shape = tuple(w if kind == "plain" else f"<{kind}>" for kind, w in window)
        yield k, shape, tuple((kind, w) for kind, w in window if kind != "plain")


def plain_matches(docs, items):
    out = {}
    for item_id, item in items:
        tokens = plain_tokens(item)
        length = min(len(tokens), templates.WINDOW)
        if not length:
            continue
        own = list(plain_windows(tokens, length))
        by_shape = collections.defaultdict(list)
        for at, shape, slots in own:
            by_shape[shape].append((at, slots, sum(not w.startswith("<") for w in shape)))
        for doc_id, text in docs:
            there, passages = plain_tokens(text), collections.defaultdict(set)
            for opened in (False, True):
                for at, shape, slots in plain_windows(there, length, opened):
                    for item_at, item_slots, n_plain in by_shape.get(shape, ()):
                        if slots == item_slots or n_plain >= templates.PLAIN:
                            passages[at - item_at].add((item_at, item_slots, slots))
            places, exact = set(), False
            for found in passages.values():
                pairs = {p for _, a, b in found for p in zip(a, b)}
                same = {at for at, a, b in found if a == b}
                if len({a for a, _ in pairs}) == len(pairs):
                    places |= {at for at, _, _ in found}
                    exact |= all(a == b for _, a, b in found)
                elif same:
                    places, exact = places | same, True
            if places:
                out[doc_id, item_id] = (len(places), len(own), exact)
    return out


def test_template_windows_are_those_of_a_plain_search(spark, tmp_path):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(9001, "Every morning Tom packs 12 red apples into the old wooden cart before Tom walks 3 miles to town"), (9002, "What is the capital of France?")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text) < 8_000]
    docs += [
        (9001, items[-2][1].replace("Tom", "Ann").replace("12", "45")), (9002, items[-2][1].replace("Tom walks", "Bob walks")),
        (9003, f"- Q12 {items[-1][1]} {sentence(4, 20)}"), (9004, f"{sentence(5, 30)}. " + items[0][1][:200]), (9005, None), (9006, ""),
    ]
    folder = write_tables(spark, tmp_path, spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark=items)
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.exact) for r in Q.op9_templates(spark, folder).collect()}
    want = plain_matches(docs, items)
    assert got == want and len(got) > 5 and {e for *_, e in got.values()} == {True, False}


def plain_tree_score(training, text):
    depth = context_tree.DEPTH
    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(data):
        for k in range(depth, len(data)):
            bits = f"{data[k]:08b}"
            for b in range(8):
                yield data[k - depth : k], bits[:b], int(bits[b])

    framed = lambda t: b"\n" * depth + t + b"\n"
    for t in training:
        for context, prefix, bit in decisions(framed(t)):
            for d in range(depth + 1):
                counts[context[depth - d :], prefix][bit] += 1
    contexts = {c for c, _ in counts}
    children = collections.defaultdict(set)
    for c in contexts:
        if c:
            children[c[1:]].add(c)
    lgamma = math.lgamma
    estimate = lambda n: lgamma(n[0] + 0.5) + lgamma(n[1] + 0.5) - lgamma(n[0] + n[1] + 1) - math.log(math.pi)
    known = {}

    def weighted(context, prefix):
        if (context, prefix) not in known:
            own = estimate(counts.get((context, prefix), [0, 0]))
            below = sum(weighted(c, prefix) for c in children[context])
            both = np.logaddexp(own, below) + math.log(0.5) if children[context] else own
            known[context, prefix] = both
        return known[context, prefix]

    total = 0.0
    for context, prefix, bit in decisions(framed(text)):
        p, left, one = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            node = context[depth - d :]
            if node not in contexts:
                break
            n = counts.get((node, prefix), [0, 0])
            one = (n[1] + 0.5) / (sum(n) + 1) if sum(n) else one
            stop = math.exp(estimate(n) + math.log(0.5) - weighted(node, prefix)) if children[node] else 1.0
            p += left * stop * one
            left *= 1 - stop
        p = min(max(p + left * one, 1e-9), 1 - 1e-9)
        total += math.log10(p if bit else 1 - p)
    return total


def test_tree_scores_are_those_of_a_plain_tree(spark):
    training = ["the cat sat on the mat", "the dog sat", "a cat, a dog; é", "", "\n\n"]
    texts = [*training, "the cat", "zebra Z", "é", None]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    tree = context_tree.fit(context_tree.counted(frame(training)))
    got = {r.doc_id: r.score for r in context_tree.score(frame(texts), tree).collect()}
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_tree_score([x.encode() for x in training], (t or "").encode()), rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("share, chunk", [(0, 1), (3, 1), (3, 1 << 17)])
def test_rare_contexts_are_nodes_of_the_tree(spark, monkeypatch, share, chunk):
    monkeypatch.setattr(context_tree, "SHARE", share)  # hardly any string is broadcast
    monkeypatch.setattr(context_tree, "CHUNK", chunk, raising=False)
    training = ["the cat sat on the mat", "the dog sat", None, "a cat, a dog; é", "the cat sat on the mat", "\n\n"]
    texts = [*training, "the cat", "zebra Z", "é", "日本", "", "the cat sat " * 40]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    tree = context_tree.fit(context_tree.counted(frame(training)))
    rows = context_tree.score(frame(texts), tree).collect()
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(plain_tree_score([(x or "").encode() for x in training], (t or "").encode()), rel=1e-9)


def test_scores_with_nothing_to_learn_from(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    tree = context_tree.fit(context_tree.counted(frame([])))
    got = context_tree.score(frame([(None, "ab"), (None, None)]), tree).collect()
    assert sorted(r.score for r in got) == pytest.approx([-24 * math.log10(2), -8 * math.log10(2)])
    assert context_tree.score(frame([]), tree).count() == 0
