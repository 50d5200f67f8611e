"""The pipeline's rows against plain Python on a small fixture with planted cases."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.test_documents import WORD, kept_lines, leaks, repeated
from tests.llm.test_near_copies import shingles, similar
from tests.llm.test_simhash import groups
from tidewright.llm import packing, quality_rules


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    draw, folder = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    words = [*quality_rules.STOP_WORDS["en"], *(f"word{k}" for k in range(400))]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [prose(draw.randint(25, 400)) for _ in range(120)]
    passage = prose(40)
    texts += [texts[3], texts[3], texts[5] + " more", f"{prose(50)}\n{passage}\n{prose(50)}", passage, "short one", prose(30) + " %#$ " * 20, (prose(10) + "\n") * 6, prose(6000), None, ""]
    rows = [(k, t if k % 2 or t is None else f"Site menu of this\n{t}", "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    items = [(7, passage), (8, prose(20)), (9, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def cut(text, items):
    spans, words = [], [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    low = [text[a:b].lower() for a, b in words]
    hit = set()
    for _, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        for k in range(len(w) - 9):
            hit |= {j for i in range(len(low) - 9) if low[i : i + 10] == w[k : k + 10] for j in range(i, i + 10)}
    for j in sorted(hit):
        if j - 1 in hit:
            spans[-1][1] = words[j][1]
        else:
            spans.append(list(words[j]))
    at, out = 0, ""
    for a, b in spans:
        out, at = out + text[at:a], b
    return out + text[at:], len(hit), len(words)


def test_rows(spark, tables):
    folder, rows, items = tables
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judged(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "kept").collect()}
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        assert not judged[k] or not (len(w) < 20 or 100 * repeated(w) > 30 * len(w))
    left = [r for r in rows if judged[r[0]]]
    assert not judged[125] and not judged[126] and not judged[127] and judged[0] and len(left) > 115
    texts = kept_lines([(r[3], r[1]) for r in left], 0.01, 5, True, 0.5)
    assert not any("Site menu" in t for t in texts)
    roots = groups([shingles(t) for t in texts], similar)
    kept = [(left[k][0], t) for k, t in enumerate(texts) if roots[k] == k]
    assert {120, 121, 122}.isdisjoint(k for k, _ in kept)
    clean = {}
    for k, t in kept:
        text, hit, n = cut(t, items)
        if not hit or hit < n:
            clean[k] = text
    assert 123 in clean and 124 not in clean
    ids = packing.Ids(packing.default_tokenizer())
    wanted = set()
    for k, t in clean.items():
        data = next(ids.of([t.encode()])) + b"\1\0\0\0"
        wanted |= {(k, p, zlib.crc32(data[a : a + 4 * 4096])) for p, a in enumerate(range(0, len(data), 4 * 4096))}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in got} == wanted and len(got) == len(wanted)
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096 and len(fill) == int(np.ceil(sum(fill.values()) / 4096))
    assert list(leaks([t for t in clean.values()], [(str(i), t) for i, t in items]))


def test_stage_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).columns == docs.columns
        assert stage(spark, docs.where("false"), tables[0]).count() == 0
