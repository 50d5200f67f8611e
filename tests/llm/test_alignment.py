"""Cross-tokenizer alignment against whole-text encodings and a plain loop over tokens."""

from __future__ import annotations

import functools
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from tidewright.llm import alignment, common, entry

ODD = ["", None, " ", "  two  spaces ", "a\n b\r\nc\td", "don't I'll 'tis", "▁ piece mark", "<|endoftext|> <s> </s> <unk> <0x41>", "tab\t\tend \n", "語 のテキスト é́", "a b 　 c\x85", "x" * 3000, "\x00\x01 control"]


@functools.cache
def tool() -> alignment.Aligner:
    return alignment.Aligner(*alignment.default_tokenizers())


def plain(text: str | None):
    """(a ids, b ids, links, groups) of a text by the contract; None without tokens."""
    if not text:
        return None
    t, whole = tool(), (" " + text).encode()
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    sizes = []
    for ids, own in ((a, t.a_bytes), (b, t.b_bytes)):
        if b"".join(own[i] for i in ids) != whole:
            return None
        at, ranges = 0, []
        for i in ids:
            ranges.append((at, at + len(own[i])))
            at += len(own[i])
        sizes.append(ranges)
    links = [(a[i], b[j]) for i, x in enumerate(sizes[0]) for j, y in enumerate(sizes[1]) if max(x[0], y[0]) < min(x[1], y[1])] if len(a) < 500 else None
    groups, i, j = [], 0, 0
    for end in sorted({y for _, y in sizes[0]} & {y for _, y in sizes[1]}):
        p, q = i, j
        while i < len(a) and sizes[0][i][1] <= end:
            i += 1
        while j < len(b) and sizes[1][j][1] <= end:
            j += 1
        groups.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
    return a, b, links, groups


def wanted(texts: list[str | None]) -> list[tuple]:
    found = [plain(t) for t in texts]
    n = Counter(link for f in found if f for link in f[2])
    most = defaultdict(int)
    for (_, b), k in n.items():
        most[b] = max(most[b], k)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, links, groups = f
            out.append((len(a), len(b), len(groups), len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def test_words_against_whole_texts():
    draw, letters = random.Random(4), "ab A1.,'é語\n\t \r\x0b\x85   　▁\x1c<>s|0x "
    texts = [x or "" for x in ODD] + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 16))) for _ in range(3000)]
    got = tool().of(texts)
    for text, counts, digest in zip(texts, got.counts.tolist(), got.digests, strict=True):
        f = plain(text)
        if f is None:
            assert counts == [0, 0, 0, 0] and digest == "", text
        else:
            assert counts[:3] == [len(f[0]), len(f[1]), len(f[3])] and digest == hashlib.sha256(";".join(f[3]).encode()).hexdigest(), text
            assert f[2] is None or counts[3] == len(f[2])


@pytest.mark.parametrize(("most", "held"), [(1_000_000, 1_000_000), (0, 3)])
def test_documents(spark, most, held, monkeypatch):
    """Copies, odd texts, null keys, clashing columns; pair counts broadcast or shuffled, summed in one go or in parts."""
    monkeypatch.setattr(alignment, "MOST_BROADCAST", most)
    monkeypatch.setattr(alignment, "PAIRS_HELD", held)
    monkeypatch.setattr(common, "HOT_SHARE", 0.0)
    words = "the best token alignment über straße tokenization isn't 12345 unbelievable".split()
    draw = random.Random(9)
    texts = [t for t in ODD if t is None or len(t) < 500] + [" ".join(draw.choices(words, k=draw.randint(1, 30))) for _ in range(40)]
    texts += [texts[-1]] * 25
    rows = [(k if k != 3 else None, t, "x", "y") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, lang string").repartition(4)
    out = alignment.aligned_documents(docs)
    assert out.columns == ["doc_id", "lang", *alignment.MEASURES]
    got = sorted(((r["doc_id"], *(r[c] for c in alignment.MEASURES)) for r in out.collect()), key=str)
    assert got == sorted(((k, *w) for (k, *_), w in zip(rows, wanted(texts), strict=True)), key=str)
    assert alignment.aligned_documents(docs.where("false")).collect() == []


def test_other_tokenizers_take_whole_texts():
    assert alignment.words_at(alignment.default_tokenizers()[0], ["▁a", "b▁c"]) is None
    assert alignment.words_at(alignment.default_tokenizers()[0], ["x\n"]).findall(" a\nb c") == [" a\nb", " c"]
    import public_tokenizers

    assert alignment.words_at(str(public_tokenizers.path("word_bpe_49k.json")), ["▁a"]) is None


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in entry.op12_alignment(spark, folder).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        f, r = plain(text), got[key]
        assert (r["n_a"], r["n_b"], r["n_groups"]) == ((len(f[0]), len(f[1]), len(f[3])) if f else (0, 0, 0))
        assert r["groups_sha256"] == (hashlib.sha256(";".join(f[3]).encode()).hexdigest() if f else "")
    assert sum(r["n_best"] for r in got.values()) > 0 and all(r["n_best"] <= r["n_links"] <= r["count_sum"] for r in got.values())
