from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from tidewright.llm import ngram_lm
from tidewright.llm.elias_fano import U64, EliasFano


@pytest.mark.parametrize("top", [1, 50, 10**6, 2**63 - 1])
def test_elias_fano_against_sorted_array(top):
    draw = np.random.default_rng(top % 97)
    values = np.unique(draw.integers(0, top, 3000, endpoint=True).astype(U64))
    x = EliasFano(EliasFano.parts(values))
    assert (x.get(np.arange(len(values))) == values).all()
    asked = np.unique(np.r_[values[::3], draw.integers(0, top, 500, endpoint=True).astype(U64), U64(0), U64(top)])
    place = np.searchsorted(values, asked)
    there = (place < len(values)) & (values[np.minimum(place, len(values) - 1)] == asked)
    assert (x.find(asked) == np.where(there, place, -1)).all()


def test_monotone_with_repeats():
    values = np.array([0, 0, 0, 3, 3, 9], U64)
    assert (EliasFano(EliasFano.parts(values)).get(np.arange(6)) == values).all()


def brute(train, texts, d=0.75, least=2):
    split = lambda t: [*(t or "").encode().lower().split(), None]
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        w = split(t)
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    kept2, kept3 = {k: c for k, c in two.items() if c >= least}, {k: c for k, c in three.items() if c >= least}
    left1, left2 = Counter(), Counter()
    for (a, _), c in kept2.items():
        left1[a] += c - d
    for (a, b, _), c in kept3.items():
        left2[a, b] += c - d
    p1 = lambda w: (one[w] + 1) / (n + v + 1)

    def p2(a, w):
        if a not in left1:
            return p1(w)
        back = 1 - left1[a] / one[a]
        return max(0, kept2.get((a, w), 0) - d) / one[a] + back * p1(w)

    def p3(a, b, w):
        if (a, b) not in kept2 or (a, b) not in left2:
            return p2(b, w)
        back = 1 - left2[a, b] / kept2[a, b]
        return max(0, kept3.get((a, b, w), 0) - d) / kept2[a, b] + back * p2(b, w)

    out = []
    for t in texts:
        w = split(t)
        score = sum(math.log10(p1(w[0]) if i == 0 else p2(w[0], w[1]) if i == 1 else p3(w[i - 2], w[i - 1], w[i])) for i in range(len(w)))
        out.append((len(w), sum(one[x] > 0 for x in w), sum(math.log10(p1(x)) for x in w), score))
    return n, out


def test_shards_of_very_many_words():
    """Shards are cut where contexts times successors would pass 63 bits; what is routed to a shard has a key of its own there."""
    words = 4 * 10**12
    bounds = ngram_lm.Bounds.of({(10, 0), (10, 7), (11, 0)}, words, words)
    first, behind = (np.array([f(k) for k in range(len(bounds.contexts))], object) for f in (bounds.first, bounds.behind))
    assert all((behind - first) * words < 1 << 63) and len(first) > 10**6
    draw = np.random.default_rng(5)
    c, s = (np.r_[draw.integers(0, words, 1000), edge] for edge in ([10, 10, 10, 11, words - 1, 0], [6, 7, words - 1, 0, words - 1, words - 1]))
    shard = bounds.route(c, s)
    assert all((first[shard] <= c) & (c < behind[shard]))
    assert shard[1000:1004].tolist() == [1, 2, 2, 3]


@pytest.mark.parametrize(("rows", "least", "keys"), [(300, 1, ngram_lm.KEYS), (300, 2, 200), (1, 1, ngram_lm.KEYS)])
def test_scores_against_counts_in_dictionaries(spark, rows, least, keys, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 40)
    monkeypatch.setattr(ngram_lm, "KEYS", keys)
    monkeypatch.setattr(ngram_lm, "HELD", 30)
    draw = np.random.default_rng(3)
    vocabulary = ["The", "a", "né", "x", "straße", *(f"w{k}" for k in range(40))]
    texts = [" ".join(draw.choice(vocabulary, draw.integers(0, 30), p=np.r_[[0.12] * 5, [0.01] * 40])) for _ in range(rows)]
    texts += [None, "", " \n\t", texts[0], "never seen words", "a " * 3000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    train = docs.where("doc_id % 5 != 2")
    model = ngram_lm.train(train, least_count=least)
    n, wanted = brute([t for k, t in enumerate(texts) if k % 5 != 2], texts, least=least)
    assert model.tokens == n
    got = {r["doc_id"]: r for r in ngram_lm.scored(docs, model).collect()}
    for k, (tokens, known, base, score) in enumerate(wanted):
        r = got[k]
        assert (r["n_tokens"], r["n_known"]) == (tokens, known)
        assert r["base_score"] == pytest.approx(base, abs=1e-9 * tokens)
        assert r["score"] == pytest.approx(score, abs=tokens * 2 / ngram_lm.STEPS)


def test_single_occurrences_count(spark):
    """Pairs and triples that the training texts have once are kept."""
    texts = ["the cat sat on a mat", "the dog sat on a mat", "the cat sat on a chair", "a dog ran", None]
    docs = spark.createDataFrame([(k, t, k == 2) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    found, _ = ngram_lm.trained_and_scored(docs, "held_out")
    _, wanted = brute([t for k, t in enumerate(texts) if k != 2], texts, least=1)
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    for k, (tokens, _, _, score) in enumerate(wanted):
        assert got[k] == pytest.approx(score, abs=tokens * 2 / ngram_lm.STEPS)


def test_no_training_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = ngram_lm.train(docs.where("false"))
    got = sorted(map(tuple, ngram_lm.scored(docs, model).collect()))
    assert got == [(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]


def test_hashes_of_blocks_and_long_words(monkeypatch):
    """Equal words have equal hashes wherever they stand, over any blocks."""
    texts = [b"the cat \xc3\xa9", b"", b" \n\t", b"THE  cat", b"x" * 5000 + b" the", b"cat"]
    whole, starts = ngram_lm.word_hashes(texts)
    monkeypatch.setattr(ngram_lm, "BLOCK", 8)
    cut, same = ngram_lm.word_hashes(texts)
    assert (whole == cut).all() and starts.tolist() == same.tolist() == [0, 4, 5, 6, 9, 12, 14]
    words = [None if t is None else w for t in texts for w in [*t.lower().split(), b""]]
    of = {}
    for w, h in zip(words, whole.tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_ranks_of_distinct_values_and_rows_of_shards():
    draw = np.random.default_rng(2)
    for most, n in ((5, 1000), (2**40, 1000), (2**62, 1000), (7, 1), (7, 0)):
        x = draw.integers(0, most, n, endpoint=True)
        x[: n // 2] = x[n // 2 :][: n // 2]
        wanted, rank = np.unique(x, return_inverse=True)
        got, same = ngram_lm.distinct(x, most)
        assert got.tolist() == wanted.tolist() and same.tolist() == rank.tolist()
    for shard in (np.array([], np.int64), np.array([0, 0, 3, 3, 9]), np.array([3, 0, 9, 3, 0])):
        for shards in (10, 1 << 20):
            found = {k: np.arange(len(shard))[own].tolist() for k, own in ngram_lm._by_shard(shard, shards)}
            assert found == {k: np.flatnonzero(shard == k).tolist() for k in np.unique(shard).tolist()}


def test_a_slice_asks_for_each_ngram_once_and_in_order(spark, monkeypatch):
    """However often pairs and triples stand in the texts of a slice, a level is searched for each one once."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 40)
    draw = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in draw.integers(0, 12, 40)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = ngram_lm.train(docs)
    asked, find = [], ngram_lm.Level.find
    monkeypatch.setattr(ngram_lm.Level, "find", lambda self, c, s: (asked.append(list(zip(c.tolist(), s.tolist()))), find(self, c, s))[1])
    hashes, starts = ngram_lm.word_hashes([t.encode() for t in texts])
    model.scores(model.numbers(hashes), starts)
    assert len(asked) == 2 and all(x == sorted(set(x)) for x in asked) and len(asked[1]) < 60 * 38
