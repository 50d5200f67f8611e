from __future__ import annotations

import random

import corpus_pipeline
import pytest
from tests.llm.test_simhash import groups
from tidewright.llm import common, near_copies, simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or (len(a & b) >= 0.8 * len(a | b) if a and b else False)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    out = [None, "", " \t", "one", "One", "a b c d", "A B c d", "a b c d e"]
    for k in range(25):
        base = [draw.choice(words) for _ in range(draw.randint(40, 300))]
        out.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.04):
            other = base[:]
            for _ in range(max(1, int(share * len(base)))):
                other[draw.randrange(len(other))] = draw.choice(words)
            out.append(" ".join(other))
        out.append(" ".join(base[: int(0.84 * len(base))]))
    return out


def test_groups_against_all_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingles(t) for t in texts]
    roots = groups(sets, similar)
    assert 30 < len(set(roots)) < len(texts) - 60
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs).collect()}
    assert got == dict(enumerate(roots))


def test_stage_keeps_one_of_each_group(spark, texts):
    """A copy with one sentence in ten less goes, which four differing bits of a fingerprint don't find; so does a copy without an id."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    docs = docs.unionByName(docs.where("doc_id in (0, 9)")).unionByName(docs.where("doc_id = 9").selectExpr("cast(null as long) as doc_id", "text"))
    roots = groups([shingles(t) for t in texts], similar)
    left = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(x for x in left if x is not None) == sorted(set(roots)) and left.count(None) == 0


def test_chain_in_one_bucket(spark):
    """Members that only a third one links, and empty tables."""
    words = [f"w{k}" for k in range(240)]
    texts = [" ".join(words[k : k + 200]) for k in range(0, 41, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_copies.near_duplicates(docs).collect()} == {0}
    assert near_copies.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize(("kind", "most"), [("long", 1_000_000), ("string", 0)])
def test_no_text_is_lost(spark, kind, most, monkeypatch):
    """One id on several texts, repeated rows and null ids: every group keeps exactly one row; keys broadcast or shuffled."""
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    text = {c: " ".join(f"{c}{k}" for k in range(30)) for c in "abcd"}
    rows = [(1, "a"), (5, "a"), (5, "b"), (7, "c"), (9, "c"), (9, "b"), (5, "b"), (1, "a"), (None, "d"), (None, "d"), (None, "a"), (3, None), (None, None), (4, "")]
    docs = spark.createDataFrame([(k, text.get(c, c)) for k, c in rows], "doc_id long, text string").selectExpr(f"cast(doc_id as {kind}) as doc_id", "text").repartition(3)
    for found in (simhash.representatives(docs), simhash.one_of_each(docs, near_copies.near_duplicates(docs), near_copies.set_hash)):
        left = [tuple(r) for r in found.collect()]
        assert sorted(left, key=str) == sorted([(x if x is None else (str(x) if kind == "string" else x), text.get(c, c)) for x, c in [(1, "a"), (5, "b"), (7, "c"), (None, "d"), (3, None)]], key=str)


def test_hot_texts_and_components(spark, monkeypatch):
    """Texts with many copies are joined by a broadcast; a large component has one name."""
    monkeypatch.setattr(common, "HOT_SHARE", 0.0)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60)] + [None] * 10_050
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs).collect()}
    assert {got[k] for k in range(60)} == {0} and {got[k] for k in range(60, len(texts))} == {60} and len(got) == len(texts)
    assert simhash.one_of_each(docs, near_copies.near_duplicates(docs), near_copies.set_hash).count() == 2


def test_pairs_meet_first_in_one_bucket():
    """Of all buckets that two fingerprints share, exactly one counts; without one they are further apart in every block."""
    import numpy as np

    draw, masks = np.random.default_rng(3), [0, *(1 << k for k in range(near_copies.BLOCK_BITS))]
    buckets = lambda x: {(b << near_copies.BLOCK_BITS) + (int(v) ^ m) for b, v in enumerate(x) for m in masks}
    for _ in range(60):
        x = draw.integers(0, 1 << near_copies.BLOCK_BITS, near_copies.BLOCKS)
        y = x.copy()
        for b in range(near_copies.BLOCKS):
            for bit in draw.choice(near_copies.BLOCK_BITS, int(draw.integers(0, 6)), replace=False):
                y[b] ^= 1 << int(bit)
        shared = buckets(x) & buckets(y)
        for a, c in ((x, y), (y, x)):
            assert sum(bool(near_copies._first_met(k, a, c[None])[0]) for k in shared) == min(1, len(shared))
