"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts.

Rules are written host/path; a rule fits its host and all subdomains where the path starts with the rule's, and the
longest fitting rule wins. For all other urls, personalised PageRank runs from trusted hosts (those with pages that a
rule allows, by their number) along links, and distrust runs from blocked hosts against the links: who links to bad
hosts is suspect. A host is blocked where distrust exceeds `threshold` times trust. Edges are (from, to) host pairs with link counts,
aggregated before any join; a link that stays on its host keeps that host's rank there, which is solved for rather than
iterated. Each round moves what the last one brought, and rounds end once that is less than `tolerance` of the whole, which
falls by the damping factor at least, so 1e-14 takes 200 rounds at most; more than `most_rounds` raise. What hosts without
links would keep goes back to the seeds: that scales all ranks alike, so ranks are divided by their sum. Where no host is a
seed, all ranks are 0. The state is written to the shared folder every few rounds.

A null url or one without :// has empty host and path and no rule; its host is the empty one, which no page links to.
Null html has no links; a very long one is read as a whole. Hosts that neither rank reaches are allowed, and so are those
whose ranks are equal at a threshold of 1. Among fitting rules of equal length the one that is last in order wins. Repeated
rows are each judged. An empty table gives no rows. Input columns named like a result are replaced, others passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    prefix: str

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.partition("/")[2]


RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substring(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    out = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    out = out.withColumn("__host", host)
    path = F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), r"^[^?#]*", 0)
    return out.withColumns({"host": F.translate("__host", _UPPER, _LOWER), "path": path}).drop("__rest", "__host")


def fitting_rule(rules: tuple[UrlRule, ...] = RULES) -> Column:
    """(verdict, prefix) of the longest rule that fits host and path, null if none does."""
    host, path = F.col("host"), F.col("path")
    found = F.lit(None).cast("struct<verdict:string,prefix:string>")
    for r in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.prefix).alias("prefix"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): links from pages of src to dst, with host set on pages; relative links stay on their host."""
    links = F.expr(f"regexp_extract_all(coalesce(`{html}`, ''), '(?i)href\\\\s*=\\\\s*[\"'']?([^\"''\\\\s>]+)', 1)")
    to = F.explode(F.transform(links, lambda x: F.when(x.contains("://"), F.regexp_extract(x, r"://([^/?#]*)", 1)).when(x.startswith("//"), F.regexp_extract(x, r"^//([^/?#]*)", 1)))).alias("to")
    out = pages.select(F.col("host").alias("src"), to)
    return out.select("src", F.coalesce(F.translate("to", _UPPER, _LOWER), "src").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-14, most_rounds: int = 400, store_every: int = 4) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trusted, blocked)."""
    flows = edges.select(F.lit(0).alias("side"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(
        edges.select(F.lit(1).alias("side"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    )
    out = flows.groupBy("side", "a").agg(F.sum("n").alias("all"))
    shares = stored(flows.join(out, ["side", "a"]).select("side", "a", "b", (damping * F.col("n") / F.col("all")).alias("share")))
    kept = shares.where("a = b").select("side", F.col("a").alias("b"), (1 / (1 - F.col("share"))).alias("own"))
    moves = stored(shares.where("a != b").join(kept, ["side", "b"], "left").select("side", "a", "b", (F.col("share") * F.coalesce("own", F.lit(1.0))).alias("share")))
    sides = seeds.select(F.lit(0).alias("side"), F.col("host").alias("b"), F.col("trusted").alias("w")).union(
        seeds.select(F.lit(1).alias("side"), F.col("host").alias("b"), F.col("blocked").alias("w"))
    )
    sums = sides.groupBy("side").agg(F.sum("w").alias("all"))
    start = sides.where("w > 0").join(F.broadcast(sums), "side").join(kept, ["side", "b"], "left")
    moved = stored(start.select("side", F.col("b").alias("a"), ((1 - damping) * F.coalesce("own", F.lit(1.0)) * F.col("w") / F.col("all")).alias("r")))
    ranked, rounds = moved, 0
    while moves.take(1) and (moved.agg(F.sum("r")).first()[0] or 0) > tolerance:
        if rounds >= most_rounds:
            raise RuntimeError(f"ranks still move after {most_rounds} rounds")
        some = []
        for _ in range(store_every):
            moved = moved.join(moves, ["side", "a"]).select("side", F.col("b").alias("a"), (F.col("r") * F.col("share")).alias("r")).groupBy("side", "a").agg(F.sum("r").alias("r"))
            some.append(moved)
        steps = some[0].withColumn("step", F.lit(1))
        for k, x in enumerate(some[1:], 2):
            steps = steps.union(x.withColumn("step", F.lit(k)))
        steps = stored(steps)
        moved = steps.where(F.col("step") == store_every).drop("step")
        ranked = stored(ranked.union(steps.drop("step")).groupBy("side", "a").agg(F.sum("r").alias("r")))
        rounds += store_every
    total = ranked.groupBy("side").agg(F.sum("r").alias("whole"))
    even = ranked.join(F.broadcast(total), "side").withColumn("r", F.col("r") / F.col("whole"))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("r"))), F.lit(0.0))
    return even.groupBy(F.col("a").alias("host")).agg(side(0).alias("trust"), side(1).alias("distrust"))


def judged(pages: DataFrame, url: str = "url", html: str = "html", rules: tuple[UrlRule, ...] = RULES, threshold: float = 1.0, **how) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust."""
    parts = with_parts(pages.drop("rule", "verdict", "trust", "distrust"), url).withColumn("__rule", fitting_rule(rules))
    is_ = lambda v: F.count(F.when(F.col("__rule.verdict") == v, 1)).alias(v)
    hosts = stored(parts.groupBy("host").agg(is_("allow"), is_("block"), F.count(F.lit(1)).alias("__pages")))
    seeds = hosts.select("host", F.col("allow").alias("trusted"), F.col("block").alias("blocked"))
    found = ranks(stored(host_edges(parts, html)), seeds, **how)
    found = stored(hosts.select("host", "__pages").join(found, "host", "left"))
    out = joined(parts, found, "host", "__pages").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    method = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("__rule.prefix"), "verdict": F.coalesce(F.col("__rule.verdict"), method)}).drop("__rule")
