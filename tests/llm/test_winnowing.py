"""Winnowing against a plain loop over words, its guarantee, and the pairing of rows in order of their keys."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidewright.llm import winnowing


def selected(text: str, k: int = winnowing.K, window: int = winnowing.WINDOW) -> list[tuple[int, int]]:
    codes = [zlib.crc32(x.encode()) % winnowing.MODULUS for x in re.findall(winnowing.WORD, text)]
    grams = []
    for i in range(max(1, len(codes) - k + 1) if codes else 0):
        x = 0
        for c in codes[i : i + k]:
            x = (x * winnowing.BASE + c) % winnowing.MODULUS
        grams.append(x)
    found = set()
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        own = grams[i : i + window]
        found.add(i + max(j for j, x in enumerate(own) if x == min(own)))
    return [(i, grams[i]) for i in sorted(found)]


def jaccard(a, b) -> float:
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def shown(fingerprint) -> str:
    return " ".join(f"{i}:{h:x}" for i, h in fingerprint)


def wanted(rows: list[tuple]) -> list[tuple]:
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for j, (key, text) in enumerate(order):
        after = order[(j + 1) % len(order)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        a, b, c = selected(text), selected(new), selected(after)
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(a), shown(b), jaccard(a, b), jaccard(a, c)))
    return out


WORDS = "one two three four five six seven eight nine ten ärger straße 語".split()
TEXT = st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(WORDS), max_size=40).map(" ".join))


@pytest.mark.parametrize("range_bytes", [1, 32_000_000])
def test_pairs_against_a_loop(spark, range_bytes):
    """Null, empty, long and repeated texts; repeated and null keys; several ranges."""
    rows = [(k * 3 % 101, " ".join(WORDS[(j * k) % 13] for j in range(k))) for k in range(100)]
    rows += [(None, "a text without a key"), (None, None), (7, "a b c d e f g h"), (7, "a b c d e f g h"), (200, ""), (201, None), (202, "x" * 3000), (-5, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__key", winnowing.F.lit("clash")).repartition(5)
    got = [tuple(r) for r in winnowing.edited(docs, range_bytes=range_bytes).collect()]
    assert sorted(got, key=str) == sorted(wanted(rows), key=str)


@pytest.mark.parametrize("rows", [[(1, "alone here")], [(None, "b c"), (None, "a")], [(5, None)], []])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, winnowing.edited(docs).collect()), key=str) == sorted(wanted(rows), key=str)


@settings(max_examples=8, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=30), st.integers(1, 5), st.integers(1, 6))
def test_selection_against_a_loop(spark, texts, k, window):
    docs = spark.createDataFrame([(j, t, 0) for j, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    for r in winnowing.fingerprinted(docs, k=k, window=window).collect():
        assert [tuple(x) for x in r["fingerprint"]] == selected(texts[r["doc_id"]] or "", k, window) and r["n_chars"] == len(texts[r["doc_id"]] or "")


def test_guarantee(spark):
    """Texts that share window + k - 1 consecutive words share a selected hash."""
    run = [f"shared{j}" for j in range(winnowing.WINDOW + winnowing.K - 1)]
    texts = [" ".join([f"a{s}x{j}" for j in range(s)] + run + [f"b{s}x{j}" for j in range(9)]) for s in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = [{x["hash"] for x in r["fingerprint"]} for r in winnowing.fingerprinted(docs).collect()]
    assert all(a & b for a in hashes for b in hashes)
