"""Line dedup by site-relative frequency.

For each host, the pages that hold a line are divided by the host's pages, and lines above a ratio are boilerplate,
dropped wherever that host has them. Lines are trimmed; blank ones are never counted or dropped. A line of one page only is
no boilerplate (`min_pages`). As options, pages of equal text count once (`count_texts`), so that mirrored pages do not
turn their own lines into boilerplate, and a page that would lose more than a share of its lines stays as it is
(`most_dropped`): it is a copy, which is near-duplicate detection's to remove.

Counting shuffles 16-byte line digests, counted in each task first. The boilerplate of all hosts is written to the shared
folder and counted. A host has no more of it than its mean lines a page divided by the ratio, so up to `most_broadcast` lines in all
are broadcast as a list for each host; beyond that they are joined by (host, line), lines of very many pages by a broadcast.

A null host is a host of its own. Null texts stay null and are no page, empty ones stay empty. A very long text is one row of
digests. A ratio equal to the bound keeps the line. Repeated rows are pages of their own. An empty table gives no
rows. Other columns are passed through; input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, stored


def _lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits of the trimmed line, 0 bytes for a blank one."""
    body = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(body == "", F.lit(b"")).otherwise(F.unhex(F.md5(body)))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.01, min_pages: int = 2, count_texts: bool = False) -> DataFrame:
    """(host, line, pages, of): digests of the lines on more than `ratio` of a host's pages and on `min_pages` or more."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text")).where("text is not null")
    own = rows.select("host", *([F.unhex(F.md5("text")).alias("page")] if count_texts else []), F.array_distinct(F.transform(_lines("text"), _digest)).alias("lines"))
    held = own.select(*(c for c in own.columns if c != "lines"), F.explode("lines").alias("line")).where(F.length("line") > 0)
    totals = rows.select("host", F.unhex(F.md5("text")).alias("page")) if count_texts else rows.select("host")
    if count_texts:
        held, totals = held.distinct(), totals.distinct()
    counted = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = totals.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    joined = counted.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return joined.where(F.col("pages") > ratio * F.col("of")).select("host", "line", "pages", "of")


def deduplicated(
    pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.01, min_pages: int = 2, count_texts: bool = False, most_dropped: float = 1.0, most_broadcast: int = 100_000
) -> DataFrame:
    """pages with boilerplate lines taken out of the text, and n_lines (with a word) and n_dropped."""
    bad = stored(boilerplate(pages, host, text, ratio, min_pages, count_texts))
    kept = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    docs = pages.select(*kept)
    if bad.count() <= most_broadcast:
        listed = F.broadcast(bad.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__bad")))
        out = docs.join(listed, F.col(host).eqNullSafe(F.col("__host")), "left")
    else:
        marked = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
        lines = marked.select("__row", F.col(host).alias("__h"), F.explode(F.array_distinct(F.transform(_lines(text), _digest))).alias("__line"))
        hot = bad.agg(F.sum("pages")).first()[0] * HOT_SHARE
        of = lambda some: F.col("__h").eqNullSafe(some["host"]) & (F.col("__line") == some["line"])
        wide, rest = F.broadcast(bad.where(F.col("pages") > hot)), bad.where(F.col("pages") <= hot)
        found = lines.join(wide, of(wide), "left_semi").union(lines.join(wide, of(wide), "left_anti").join(rest, of(rest), "left_semi"))
        out = marked.join(found.groupBy("__row").agg(F.collect_set("__line").alias("__bad")), "__row", "left")
    bads = F.coalesce("__bad", F.array().cast("array<binary>"))
    good = F.filter(_lines(text), lambda x: ~F.array_contains(bads, _digest(x)))
    cut = F.when(F.size(bads) > 0, F.array_join(good, "\n")).otherwise(F.col(text))
    with_word = lambda c: F.coalesce(F.size(F.filter(_lines(c), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long")
    out = out.withColumn("__cut", cut)
    of = lambda c: with_word(F.coalesce(F.col(c), F.lit("")))
    if most_dropped < 1:
        out = out.withColumn("__cut", F.when(of(text) - of("__cut") > most_dropped * of(text), F.col(text)).otherwise(F.col("__cut")))
    counts = [of(text).alias("n_lines"), (of(text) - of("__cut")).alias("n_dropped")]
    return out.select(*[F.col("__cut").alias(c) if c == text else F.col(c) for c in kept], *counts)
