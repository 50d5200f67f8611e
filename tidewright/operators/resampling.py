"""Resampling tests by weights: a resample is a count for each distinct value, never a copy of the rows.

Rows become distinct values with their counts, sorted into chunks of about `chunk` values for each class. How many of a resample's
draws fall into each chunk is drawn from (class, resample) alone, so every task knows it for all chunks; how they spread over
its own values a task draws from (class, resample, chunk). A resample's ranks, medians and distribution functions then follow from
the counts before a chunk, which are known, and those in it. A task sends one number for each resample, so what is shuffled
is the distinct values once and `resamples` rows a chunk, and no class meets in one task.

Draws are multinomial with replacement (bootstrap), hypergeometric without (permutation). They depend on the seed, the class's
name and the chunks, not on the order of rows. Null values drop out; a class without values has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import settled

CHUNK = 50_000


def _chunked(values: DataFrame, by: str, counts: Sequence[str], chunk: int) -> DataFrame:
    """(by, chunk, v, counts, totals) of distinct values (by, v, counts): totals has the sums of all chunks of the class, in order."""
    values = settled(values)
    sizes = values.groupBy(by).agg(F.count(F.lit(1)).alias("k"))
    most = sizes.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    parts = max(1, -(-most // chunk))
    if parts > 1:
        shares = [j / parts for j in range(1, parts)]
        cuts = values.groupBy(F.col(by).alias("__by")).agg(F.array_distinct(F.percentile_approx("v", F.lit(shares), F.lit(20 * parts))).alias("__cuts"))
        placed = values.join(cuts, F.col(by).eqNullSafe(F.col("__by"))).withColumn("chunk", F.size(F.filter("__cuts", lambda c: c < F.col("v"))).cast("int")).drop("__cuts", "__by")
        placed = settled(placed)
    else:
        placed = values.withColumn("chunk", F.lit(0))
    sums = placed.groupBy(by, "chunk").agg(*(F.sum(c).alias(c) for c in counts))
    totals = sums.groupBy(F.col(by).alias("__by")).agg(F.array_sort(F.collect_list(F.struct("chunk", *counts))).alias("totals"))
    return placed.join(totals, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")


def _each_chunk(placed: DataFrame, by: str, counts: Sequence[str], schema: str, work: Callable) -> DataFrame:
    """work(name, own chunk's place, v, counts of the values, counts of all chunks) gives columns behind `by`."""
    kind = placed.schema[by].dataType.simpleString()
    types = dict(x.split(" ") for x in schema.split(", "))

    def run(group, table):
        import zlib

        import numpy as np
        import pyarrow as pa

        order = np.argsort(table.column("v").to_numpy(), kind="stable")
        v = table.column("v").to_numpy()[order]
        own = [table.column(c).to_numpy()[order] for c in counts]
        totals = table.column("totals")[0].as_py()
        place = [t["chunk"] for t in totals].index(group[1].as_py())
        name = zlib.crc32(repr(group[0].as_py()).encode())
        out = work(name, place, v, own, [np.array([t[c] for t in totals], np.int64) for c in counts])
        columns = {c: pa.array(x, pa.float64() if types[c] == "double" else pa.int32()) for c, x in zip(types, out, strict=True)}
        return pa.table({by: pa.array([group[0].as_py()] * len(out[0]), table.schema.field(by).type), **columns})

    return placed.groupBy(by, "chunk").applyInArrow(run, f"`{by}` {kind}, {schema}")


def _random(seed: int, *of: int):
    import numpy as np

    return np.random.default_rng([seed, *of])


def bootstrap(df: DataFrame, by: str, measure: str, stat: str = "median", resamples: int = 1000, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(by, resample, value): the median, mean or sum of rows drawn with replacement within each class."""
    if stat not in ("median", "mean", "sum"):
        raise ValueError("stat is median, mean or sum")
    values = df.select(by, F.col(measure).cast("double").alias("v")).where("v is not null").groupBy(by, "v").agg(F.count(F.lit(1)).alias("n"))

    def work(name, place, v, own, totals):
        import numpy as np

        (n,), (all_n,) = own, totals
        whole = int(all_n.sum())
        found = ([], [])
        for r in range(1, resamples + 1):
            dealt = _random(seed, name, r).multinomial(whole, all_n / whole)
            before, here = int(dealt[:place].sum()), int(dealt[place])
            if not here:
                continue
            weight = _random(seed, name, r, place + 1).multinomial(here, n / n.sum())
            if stat == "median":
                upto = np.cumsum(weight)
                part = sum(float(v[np.searchsorted(upto, k - before, "right")]) / 2 for k in ((whole - 1) // 2, whole // 2) if before <= k < before + here)
                if not any(before <= k < before + here for k in ((whole - 1) // 2, whole // 2)):
                    continue
            else:
                part = float(weight @ v) / (whole if stat == "mean" else 1)
            found[0].append(r)
            found[1].append(part)
        return found

    drawn = _each_chunk(_chunked(values, by, ["n"], chunk), by, ["n"], "resample int, value double", work)
    return drawn.groupBy(by, "resample").agg(F.sum("value").alias("value"))


def _two_sided_counts(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, v, x, y): distinct values with how often they are in a and in b."""
    side = lambda c, x, y: df.select(by, F.col(c).cast("double").alias("v"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    return side(a, 1, 0).unionByName(side(b, 0, 1)).where("v is not null").groupBy(by, "v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def bootstrap_ks(df: DataFrame, by: str, a: str, b: str, resamples: int = 1000, seed: int = 42, side: str = "both", chunk: int = CHUNK) -> DataFrame:
    """(by, d, p): Kolmogorov-Smirnov distance of a and b, and the share of pooled resamples that reach it.

    side: both, or above (a's share up to a value exceeds b's) or below alone. A class with one side only has no rows.
    """
    if side not in ("both", "above", "below"):
        raise ValueError("side is both, above or below")

    def work(name, place, v, own, totals):
        import numpy as np

        (x, y), (all_x, all_y) = own, totals
        n_x, n_y, pooled, here = int(all_x.sum()), int(all_y.sum()), all_x + all_y, x + y
        if not n_x or not n_y:
            return [], []

        def gap(dealt_x, dealt_y, own_x, own_y) -> float:
            d = (dealt_x[:place].sum() + np.cumsum(own_x)) / n_x - (dealt_y[:place].sum() + np.cumsum(own_y)) / n_y
            return float(np.abs(d).max() if side == "both" else d.max() if side == "above" else (-d).max())

        found = [gap(all_x, all_y, x, y)]
        for r in range(1, resamples + 1):
            draw, mine = _random(seed, name, r), _random(seed, name, r, place + 1)
            dealt = [draw.multinomial(k, pooled / pooled.sum()) for k in (n_x, n_y)]
            found.append(gap(*dealt, *(mine.multinomial(int(k[place]), here / here.sum()) for k in dealt)))
        return list(range(resamples + 1)), found

    each = _each_chunk(_chunked(_two_sided_counts(df, by, a, b), by, ["x", "y"], chunk), by, ["x", "y"], "resample int, d double", work)
    largest = each.groupBy(by, "resample").agg(F.max("d").alias("d"))
    observed = F.max(F.when(F.col("resample") == 0, F.col("d")))
    listed = largest.groupBy(by).agg(observed.alias("d"), F.collect_list(F.when(F.col("resample") > 0, F.col("d"))).alias("ds"))
    return listed.select(by, "d", ((F.size(F.filter("ds", lambda s: s >= F.col("d"))) + 1) / (resamples + 1)).alias("p"))


def permutation_test(df: DataFrame, by: str, a: str, b: str, shuffles: int = 1000, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(by, u, p_greater, p_less): Mann-Whitney U of a over b with p-values from shuffled labels. Rows with a null on either side drop out.

    Among values of which t are equal, a shuffle's labels are a hypergeometric count (numpy's draws: below 10^9 values a class).
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def work(name, place, v, own, totals):
        import numpy as np

        (x, y), (all_x, all_y) = own, totals
        n, pooled, here = int(all_x.sum()), all_x + all_y, x + y
        ranks = pooled[:place].sum() + np.cumsum(here) - (here - 1) / 2
        found = [float(x @ ranks)]
        for r in range(1, shuffles + 1):
            dealt = _random(seed, name, r).multivariate_hypergeometric(pooled, n, method="marginals")
            found.append(float(_random(seed, name, r, place + 1).multivariate_hypergeometric(here, int(dealt[place]), method="marginals") @ ranks))
        return list(range(shuffles + 1)), found

    counted = _chunked(_two_sided_counts(pairs, by, a, b), by, ["x", "y"], chunk)
    sums = _each_chunk(counted, by, ["x", "y"], "shuffle int, rank_sum double", work).groupBy(by, "shuffle").agg(F.sum("rank_sum").alias("w"))
    listed = sums.groupBy(by).agg(F.max(F.when(F.col("shuffle") == 0, F.col("w"))).alias("w"), F.collect_list(F.when(F.col("shuffle") > 0, F.col("w"))).alias("ws"))
    sizes = pairs.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda test: (F.size(F.filter("ws", test)) + 1) / (shuffles + 1)
    out = listed.join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    return out.select(by, (F.col("w") - F.col("n") * (F.col("n") + 1) / 2).alias("u"), share(lambda s: s >= F.col("w")).alias("p_greater"), share(lambda s: s <= F.col("w")).alias("p_less"))
