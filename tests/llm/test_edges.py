"""Empty tables, null keys, repeated rows and clashing columns for every operator; link-graph ranks by plain Python."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest
from tidewright.llm import decontaminate, entry, line_dedup, near_copies, ngram_lm, packing, quality_rules, secrets, simhash, token_counts, toxicity, url_filter

CLASH = "n_words string, kept string, fp string, component_id string, secret_spans string, score string, piece string, offset string, sequence_id string, tokens string, n_lines string, host string, verdict string, n_hit string, items string"
SCHEMA = f"doc_id long, text string, source string, {CLASH}"
ROWS = [(1, "some words here and there", "a"), (1, "some words here and there", "a"), (None, "a text without a key", None), (2, None, "b"), (3, "", "b"), (4, "long " * 30_000, "a")]

OPERATORS = {
    "quality_rules": lambda s, d: quality_rules.judged(d),
    "passing": lambda s, d: quality_rules.passing(d, min_words=0, max_repeat_percent=100, rules=()),
    "secrets": lambda s, d: secrets.scanned(d),
    "decontaminate": lambda s, d: decontaminate.searched(d, s.createDataFrame([(1, "words here"), (None, None)], "item_id long, text string")),
    "no_items": lambda s, d: decontaminate.searched(d, s.createDataFrame([], "item_id long, text string")),
    "line_dedup": lambda s, d: line_dedup.deduplicated(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "packing": lambda s, d: packing.packed(d.where("doc_id is null or doc_id != 4")),
    "token_counts": lambda s, d: token_counts.counted(d),
    "ngram_lm": lambda s, d: ngram_lm.scored(d, ngram_lm.train(d)),
    "url_filter": lambda s, d: url_filter.judged(d, url="text", html="source"),
    "near_copies": lambda s, d: near_copies.near_duplicates(d),
    "one_of_each": lambda s, d: simhash.representatives(d),
    "toxicity": lambda s, d: toxicity.scored(d, toxicity.learned(d, s.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1)], "doc_id long, toxic int"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(spark, name):
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASH.split(", "))) for r in ROWS], SCHEMA)
    out = OPERATORS[name](spark, docs)
    assert len(out.columns) == len(set(out.columns))
    assert len(out.collect()) == len(ROWS) - {"packing": 1, "one_of_each": 2}.get(name, 0)
    assert OPERATORS[name](spark, docs.where("false")).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def test_urls(spark):
    rows = ["http://Sub.ORG/x?y", "https://org#z", "https://a.example.org/en/19?q", "HTTP://example.org/es/", "http://x.com/fr/1", "http://notcom/de/1", "no url", None, "://", "http://u:p@h.com:80/de/a#b"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judged(pages(spark, [(u, None) for u in rows])).collect()}
    assert [got[k] for k in range(10)] == [
        ("sub.org", "/x", "org/"), ("org", "", None), ("a.example.org", "/en/19", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"), ("x.com", "/fr/1", "com/fr/"),
        ("notcom", "/de/1", None), ("", "", None), ("", "", None), ("", "", None), ("u:p@h.com:80", "/de/a", None),
    ]


def test_trust_and_distrust_follow_links(spark, tmp_path):
    a = lambda *urls: "".join(f"<a HREF = '{u}'>x</a>" for u in urls)
    rows = [
        ("http://good.org/", a("http://friend.net/1", "/own")), ("http://friend.net/1", a("//Second.net/x")), ("http://second.net/", None),
        ("http://bad.com/de/1", a("http://second.net/")), ("http://farm.net/", a("http://bad.com/de/1", "http://bad.com/de/2")), ("http://lone.net/", ""), (None, a("http://bad.com/")),
    ]
    docs = pages(spark, rows)
    got = {r["url"]: r for r in url_filter.judged(docs).collect()}
    assert got["http://farm.net/"]["verdict"] == "block" and got["http://farm.net/"]["distrust"] > 0
    assert got["http://friend.net/1"]["verdict"] == "allow" and got["http://friend.net/1"]["trust"] > got["http://second.net/"]["trust"] > 0
    assert got["http://lone.net/"]["verdict"] == "allow" and got["http://bad.com/de/1"]["verdict"] == "block"
    docs.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cursor = con.execute(entry.oracle_sql()["op6_url_filter"])
    names = [c[0] for c in cursor.description]
    wanted = {r[names.index("page_id")]: dict(zip(names, r, strict=True)) for r in cursor.fetchall()}
    for r in entry.op6_url_filter(spark, str(tmp_path)).collect():
        w = wanted[r["page_id"]]
        assert (r["verdict"], r["rule"], r["host"]) == (w["verdict"] , w["rule"], w["host"] or "")
        assert r["trust"] == pytest.approx(w["trust"], abs=1e-9) and r["distrust"] == pytest.approx(w["distrust"], abs=1e-9)
    assert url_filter.judged(docs.where("false")).count() == 0


def test_ranks_against_plain_iteration(spark):
    """Loops, hosts without links and several links, against hundreds of rounds of the plain formula."""
    links = [("a", "b", 2), ("a", "a", 3), ("b", "c", 1), ("b", "d", 1), ("c", "a", 1), ("e", "c", 4), ("e", "e", 1), ("d", "d", 2), ("f", "g", 1), ("d", "h", 1)]
    seeds = {"a": (3, 0), "b": (1, 0), "c": (0, 2), "g": (0, 1), "x": (1, 0)}
    hosts = sorted({h for a, b, _ in links for h in (a, b)} | seeds.keys())

    def plain(flows, weight):
        start = {h: weight.get(h, 0) / sum(weight.values()) for h in hosts}
        rank = dict(start)
        for _ in range(500):
            out = {h: sum(n for a, _, n in flows if a == h) for h in hosts}
            lost = sum(rank[h] for h in hosts if not out[h])
            rank = {h: 0.15 * start[h] + 0.85 * (lost * start[h] + sum(rank[a] * n / out[a] for a, b, n in flows if b == h)) for h in hosts}
        return rank

    trust = plain(links, {h: t for h, (t, _) in seeds.items()})
    distrust = plain([(b, a, n) for a, b, n in links], {h: d for h, (_, d) in seeds.items()})
    found = url_filter.ranks(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame([(h, *x) for h, x in seeds.items()], "host string, trusted long, blocked long"))
    got = {r["host"]: (r["trust"], r["distrust"]) for r in found.collect()}
    for h in hosts:
        assert got.get(h, (0, 0)) == pytest.approx((trust[h], distrust[h]), abs=1e-9)


STAGES = {
    "passing": lambda s, d: quality_rules.passing(d, min_words=0, max_repeat_percent=100, rules=()),
    "cleaned": lambda s, d: decontaminate.cleaned(d, s.createDataFrame([(1, "words here")], "item_id long, text string")),
}


@pytest.mark.parametrize("name", [*STAGES, *(n for n, _ in corpus_pipeline.STAGES[:-1])])
def test_stages_keep_columns_of_any_name(spark, name):
    """Columns named like a measure keep their values and types."""
    names = dict.fromkeys([*quality_rules.MEASURES, "n_dropped", "n_hit", "items", "removal_spans", "fp", "first", "copies", "key", "component_id", "N_Words2"])
    words = "the quick brown fox is in a house and the dog sleeps on that mat by it while of us was to be"
    rows = [(k, f"{words} {k} {'alpha beta' if k else 'gamma'} words here at last", "en", "a", *[f"{c}{k}" for c in names]) for k in range(6)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {', '.join(f'`{c}` string' for c in names)}")
    run = STAGES.get(name) or dict(corpus_pipeline.STAGES)[name]
    out = run(spark, docs) if name in STAGES else run(spark, docs, "/root/testdata/sf0.001")
    assert out.dtypes == docs.dtypes
    left = out.collect()
    assert left and all(r[c] == f"{c}{r['doc_id']}" for r in left for c in names)
