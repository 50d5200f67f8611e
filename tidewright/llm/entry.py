"""Queries of the training-data operators over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, line_dedup, ngram_lm, packing, quality_rules, secrets, simhash, token_counts, toxicity, url_filter, whitening, winnowing
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(toxicity.in_fold("doc_id", 7, 2), F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out)
    found, model = ngram_lm.trained_and_scored(docs, "held_out")
    found = found.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), count_texts=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.searched(docs, table(spark, sf_dir, "benchmark")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judged(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 10).alias("trust"), F.round("distrust", 10).alias("distrust"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~toxicity.in_fold("doc_id", 5, 0))
    found = toxicity.scored(docs, toxicity.learned(docs, labels))
    return found.select("doc_id", F.coalesce(toxicity.in_fold("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_ngram_lm, op3_line_dedup, op4_decontaminate, op5_secrets, op6_url_filter, op7_simhash, op8_toxicity, op9_packing, op10_quality_rules, op11_whitening, op12_alignment, op13_fingerprints)}


def _op10_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({v for words in quality_rules.STOP_WORDS.values() for w in words for v in (w, w.capitalize())}))
    ratio = {
        "mean_word_length": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_word_ratio": "n_stop / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "bullet_line_ratio": "n_bullets / greatest(n_lines, 1)",
    }
    fails = " OR ".join(f"({ratio[r.measure]}) {'<' if r.comparison == 'min' else '>'} {r.bound}" for r in quality_rules.RULES)
    return rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (SELECT rid, i, words[i:i+7] AS w FROM d, unnest(range(1, greatest(len(words) - 6, 1))) AS u(i)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•|]'))) AS n_bullets
  FROM d LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({fails}) AS kept
FROM b"""


_OP3_SQL = r"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM documents),
p AS (SELECT rid, source, text FROM d WHERE text IS NOT NULL),
q AS (SELECT DISTINCT source, text FROM p),
l AS (SELECT DISTINCT source, text, trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM q, unnest(string_split(text, chr(10))) AS u(x)),
n AS (SELECT source, count(*) AS pages FROM q GROUP BY 1),
bad AS (SELECT l.source, line FROM l JOIN n ON n.source IS NOT DISTINCT FROM l.source WHERE line <> '' GROUP BY l.source, line, pages HAVING count(*) >= 2 AND count(*) > 0.01 * pages),
x AS (SELECT rid, source, i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
      FROM (SELECT rid, source, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS u(i)),
m AS (SELECT x.*, bad.line IS NOT NULL AS drop FROM x LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM x.source AND bad.line = x.body),
r AS (SELECT rid, count(*) FILTER (body <> '') AS n_lines, count(*) FILTER (drop) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop), '') AS text FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(r.text) AS text_sha256 FROM d LEFT JOIN r USING (rid)"""

_OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(words), 10) AS size, words[k:k + least(len(words), 10) - 1] AS phrase FROM b, unnest(range(1, greatest(len(words) - 8, 2))) AS u(k) WHERE len(words) > 0),
s AS (SELECT DISTINCT size FROM w),
o AS (SELECT rid, size, i, words[i:i + size - 1] AS phrase FROM d, s, unnest(range(1, greatest(len(words) - size + 2, 1))) AS u(i)),
f AS (SELECT rid, item_id, o.size, i FROM o JOIN w ON w.size = o.size AND w.phrase = o.phrase),
h AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM f, unnest(range(0, size)) AS u(k) GROUP BY rid),
g AS (SELECT rid, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM f GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN g USING (rid)"""


def _op6_sql(damping: float = 0.85, rounds: int = 400) -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(url_filter.RULES, key=lambda r: (len(r.prefix), r.prefix), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.prefix}'" for r in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN rule = '{r.prefix}' THEN '{r.verdict}'" for r in ordered) + " END"
    return rf"""
WITH RECURSIVE q AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM q),
p AS (SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT *, {rule} AS rule FROM p),
k AS (SELECT *, {said} AS said FROM j),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) AS x FROM p),
e AS (SELECT src, coalesce(translate(CASE WHEN contains(x, '://') THEN regexp_extract(x, '://([^/?#]*)', 1) WHEN starts_with(x, '//') THEN regexp_extract(x, '^//([^/?#]*)', 1) END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), src) AS dst, count(*) AS n FROM l GROUP BY 1, 2),
w AS (SELECT 0 AS side, src AS a, dst AS b, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
m AS (SELECT side, a, b, {damping} * n / sum(n) OVER (PARTITION BY side, a) AS share FROM w),
o AS (SELECT side, a, 1 / (1 - share) AS own FROM m WHERE a = b),
v AS (SELECT m.side, m.a, m.b, share * coalesce(own, 1) AS share FROM m LEFT JOIN o ON o.side = m.side AND o.a = m.b WHERE m.a <> m.b),
c AS (SELECT 0 AS side, host AS a, count(*) FILTER (said = 'allow') AS n FROM k GROUP BY host UNION ALL SELECT 1, host, count(*) FILTER (said = 'block') FROM k GROUP BY host),
s AS (SELECT c.side, c.a, {1 - damping!r} * coalesce(own, 1) * n / sum(n) OVER (PARTITION BY c.side) AS r FROM c LEFT JOIN o ON o.side = c.side AND o.a = c.a WHERE n > 0),
f AS (SELECT 0 AS step, side, a, r FROM s
      UNION ALL SELECT f.step + 1, v.side, v.b, sum(f.r * v.share) FROM f JOIN v ON v.side = f.side AND v.a = f.a WHERE f.step < {rounds} AND f.r > 1e-30 GROUP BY f.step, v.side, v.b),
g AS (SELECT side, a, sum(r) AS r FROM f GROUP BY 1, 2),
i AS (SELECT side, a, r / sum(r) OVER (PARTITION BY side) AS r FROM g),
t AS (SELECT a AS host, coalesce(sum(r) FILTER (side = 0), 0) AS trust, coalesce(sum(r) FILTER (side = 1), 0) AS distrust FROM i GROUP BY 1)
SELECT page_id, k.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 10) AS trust, round(coalesce(distrust, 0), 10) AS distrust
FROM k LEFT JOIN t ON t.host = k.host"""


def _op13_sql(k: int = winnowing.K, window: int = winnowing.WINDOW) -> str:
    """Words are hashed once each: CRC-32 bit by bit. The first row in order follows the last."""
    base, modulus, top = winnowing.BASE, winnowing.MODULUS, (1 << 31) - 1
    step = lambda a, b: f"(({a}) * {base} + ({b})) % {modulus}"
    gram = "code"
    for j in range(1, k):
        gram = step(gram, f"lead(code, {j}) OVER own")
    return rf"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rid FROM documents),
f AS (SELECT *, coalesce(lead(text) OVER (ORDER BY rid), first_value(text) OVER (ORDER BY rid)) AS following, coalesce(lead(rid) OVER (ORDER BY rid), 1) AS next_rid FROM o),
e AS (SELECT doc_id, rid, next_rid, text, length(text) AS n, substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM f),
t AS (SELECT rid, 0 AS kind, text FROM e UNION ALL SELECT rid, 1, edited FROM e),
w AS (SELECT rid, kind, i - 1 AS place, words[i] AS word, len(words) AS n
      FROM (SELECT rid, kind, regexp_extract_all(text, '{winnowing.WORD}') AS words FROM t), unnest(range(1, len(words) + 1)) AS u(i)),
c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(bytes) // 2), lambda j: ('0x' || substr(bytes, 2 * j + 1, 2))::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % {modulus} AS code
      FROM (SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM w))),
g AS (SELECT rid, kind, place, n, code, {gram} AS hash FROM w JOIN c USING (word) WINDOW own AS (PARTITION BY rid, kind ORDER BY place)),
s AS (SELECT rid, kind, 0 AS place, list_reduce(list_prepend(0::BIGINT, list(code ORDER BY place)), lambda a, b: {step("a", "b")}) AS hash FROM g WHERE n < {k} GROUP BY rid, kind),
h AS (SELECT rid, kind, place, n - {k - 1} AS grams, hash FROM g WHERE place <= n - {k} UNION ALL SELECT rid, kind, place, 1, hash FROM s),
m AS (SELECT rid, kind, place, grams, min((hash << 31) + ({top} - place)) OVER (PARTITION BY rid, kind ORDER BY place ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS least FROM h),
p AS (SELECT DISTINCT rid, kind, {top} - (least & {top}) AS place, least >> 31 AS hash FROM m WHERE place <= greatest(grams - {window}, 0)),
q AS (SELECT rid, kind, string_agg(place || ':' || lower(hex(hash)), ' ' ORDER BY place) AS shown, list(DISTINCT hash) AS hashes FROM p GROUP BY rid, kind),
a AS (SELECT e.*, coalesce(x.shown, '') AS fingerprint, coalesce(y.shown, '') AS edited_fingerprint, coalesce(x.hashes, []) AS h0, coalesce(y.hashes, []) AS h1, coalesce(z.hashes, []) AS h2
      FROM e LEFT JOIN q x ON x.rid = e.rid AND x.kind = 0 LEFT JOIN q y ON y.rid = e.rid AND y.kind = 1 LEFT JOIN q z ON z.rid = e.next_rid AND z.kind = 0),
b AS (SELECT *, len(list_intersect(h0, h1)) AS c1, len(list_intersect(h0, h2)) AS c2 FROM a)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(h0) + len(h1) = 0 THEN 1 ELSE c1 / (len(h0) + len(h1) - c1) END AS near_edited, CASE WHEN len(h0) + len(h2) = 0 THEN 1 ELSE c2 / (len(h0) + len(h2) - c2) END AS near_next
FROM b"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3_SQL, "op4_decontaminate": _OP4_SQL, "op6_url_filter": _op6_sql(), "op10_quality_rules": _op10_sql(), "op13_fingerprints": _op13_sql()}
