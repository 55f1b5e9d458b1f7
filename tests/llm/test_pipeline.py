"""Each stage against a plain version over its own input, and on odd and empty tables."""

import collections

import pytest
import xxhash
from conftest import SCHEMA, sentence, write_tables  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from tallyflow.llm import quality_rules, simhash_golay, templates

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order():
    assert [name.split("_")[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "line", "simhash", "benchmark", "bpe"]


def test_policies_and_ablation(spark, docs):
    entries = quality_rules.ledger(docs).cache()
    rows = entries.collect()
    for policy, rules in quality_rules.POLICIES.items():
        mask = quality_rules.mask(rules)
        kept = {r.doc_id for r in rows if not r.failed & mask}
        assert {r.doc_id for r in quality_rules.accepted(docs, policy).collect()} == kept
        for r in quality_rules.ablation(entries, policy).collect():
            bit = quality_rules.mask((r.rule,))
            hits = [x.failed & mask for x in rows]
            assert r.n_failed == sum(bool(h & bit) for h in hits) and r.n_failed_alone == sum(h == bit for h in hits)
            assert r.n_kept_without == sum(not h & ~bit for h in hits)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs):
    """Smallest id reachable over links of three or fewer bits, by comparing all with all."""
    fps, group = {k: plain_fingerprint(t) for k, t in docs.items()}, {}
    for start in sorted(docs):
        reached = [] if start in group else [start]
        while reached:
            k = reached.pop()
            group[k] = start
            reached += [j for j in docs if j not in group and (fps[j] ^ fps[k]).bit_count() <= 3 and not group.update({j: start})]
    return fps, group


@pytest.fixture(scope="session")
def near(spark, docs):
    base = sentence(5, 400).split()
    rows = {100_000 + k: " ".join(w if j % 397 != 3 * k else "other" for j, w in enumerate(base)) for k in range(20)}
    return {r.doc_id: r.text for r in docs.collect()} | rows | {200_000: None, 200_001: "", 200_002: "one two"}


def test_near_copies_are_grouped_as_by_all_pairs(spark, near):
    df = spark.createDataFrame(list(near.items()), "doc_id bigint, text string")
    fps, group = plain_components(near)
    assert len(set(group.values())) < len(near) - 10
    signed = lambda f: f - 2**64 if f >> 63 else f
    got = {r.id: (r.fp, r.component) for r in simhash_golay.components(df).collect()}
    assert got == {k: (signed(fps[k]), group[k]) for k in near}
    assert sorted(r.doc_id for r in STAGE["simhash_near_dedup"](spark, df, SF).collect()) == sorted(set(group.values()))


def test_every_link_of_three_bits_is_found(spark):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ 1 << k for k in range(0, 64, 5)} | {base ^ 7 << k for k in range(0, 60, 7)}
    fps |= {base ^ 1 << k ^ 1 << (k + 25) % 64 ^ 1 << (k + 47) % 64 for k in range(0, 64, 3)} | {base * k % 2**64 for k in range(2, 60)}
    signed = sorted(f - 2**64 if f >> 63 else f for f in fps)
    got = {(r.a, r.b) for r in simhash_golay.links(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(a, b) for a in signed for b in signed if a < b and bits(a, b) <= 3} and len(got) > 50


def test_components_chain(spark):
    from tallyflow.llm.common import star_components

    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1002, 1001), (5, 5)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_changed_numbers_and_names_are_caught(spark):
    item = "Every morning Tom packs 12 red apples into the old wooden cart before Tom walks 3 miles to town"
    other = "Every morning Ann packs 45 red apples into the old wooden cart before Ann walks 9 miles to town"
    mixed = "Every morning Ann packs 45 red apples into the old wooden cart before Bob walks 9 miles to town"
    plain = "Every evening two boys carry many green pears out of a new barn and walk home"
    docs = [(1, sentence(1, 30) + ". " + item + ". " + sentence(2, 30)), (2, other), (3, mixed), (4, plain), (5, None), (6, item[:40])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id bigint, text string")
    got = {r.id: (r.item_id, r.exact) for r in templates.matches(frame, items).collect()}
    assert got[1] == (7, True) and got[2] == (7, False) and not {4, 5, 6} & got.keys()
    full = {r.id: r.n_windows for r in templates.matches(frame, items).collect()}
    assert full[1] == full[2] and full.get(3, 0) < full[2]
    assert sorted(r.doc_id for r in templates.decontaminated(frame, items).collect())[-3:] == [4, 5, 6]


def test_stages_keep_columns_and_rows(spark, tmp_path, odd, none):
    folder = write_tables(spark, tmp_path, odd, benchmark=[(1, sentence(3, 30))])
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.count() <= docs.count()
    near = collections.Counter((r.doc_id, r.text) for r in STAGE["simhash_near_dedup"](spark, odd, folder).collect())
    assert max(near.values()) == 1 and near[3, sentence(1, 60)] == 1 and (4, sentence(1, 60)) not in near
    left = [r.doc_id for r in STAGE["benchmark_decontamination"](spark, odd, folder).collect()]
    assert len(left) == odd.count() - 1


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    assert 0 < len(rows) < 200 and len({r.text for r in rows}) == len(rows)
    for r in rows:
        assert list(r.ids) == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
