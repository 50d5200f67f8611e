from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from tidewright.llm import simhash
from tidewright.operators.graph import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = WORD.findall((text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, linked):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(values))]


def test_documents_against_all_pairs(spark):
    draw = random.Random(1)
    words = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(60)]
    texts = [None, "", " \t", "one", "One", "a b c d", "a b c d", "A B C D", "x " * 50_000]
    for _ in range(12):
        base = [draw.choice(words) for _ in range(draw.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(5):
            other = base[:]
            other[draw.randrange(len(other))] = draw.choice(words)
            texts.append(" ".join(other))
    docs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(4)
    wanted = [fingerprint(t) for t in texts]
    roots = groups(wanted, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id").collect()}
    assert got == {k: (f, r) for k, (f, r) in enumerate(zip(wanted, roots))}
    left = simhash.representatives(docs.union(docs.where("doc_id in (0, 7, 20)")))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({r for r in roots})
    assert left.columns == docs.columns


@pytest.mark.parametrize("most", [4096, 3])
def test_fingerprints_against_all_pairs(spark, most):
    """A chain, a dense cluster and far ones; with most=3 the cluster takes the whole 64-bit ball."""
    draw = random.Random(2)
    values, x = [], draw.getrandbits(64)
    for _ in range(20):
        values.append(x)
        for b in draw.sample(range(64), 4):
            x ^= 1 << b
    centre = draw.getrandbits(64)
    values += [centre ^ 1 << a ^ 1 << b for a in range(0, 30, 3) for b in range(1, 30, 4)] + [draw.getrandbits(64) for _ in range(60)]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = groups(values, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["node"]: r["root"] for r in connected(simhash.links(fps, most)).collect()}
    found = {}
    for v, r in zip(signed, roots):
        found.setdefault(r, []).append(v)
    for members in found.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (None, 3)], "u long, v long")
    assert {r["root"] for r in connected(path).collect()} == {0}
    assert connected(path.where("false")).count() == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
