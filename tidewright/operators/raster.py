"""Raster operators on pixel tables: one row for each pixel (and period) with row, col and bands."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import edges
from ..functions.scalars import awei, is_clear
from .graph import connected, settled
from .spatial import points_in_shapes

LATTICE = ["row", "col"]


def centres(pixels: DataFrame, gt: Sequence[float]) -> DataFrame:
    """x and y of pixel centres by a geotransform."""
    x = gt[0] + (F.col("col") + 0.5) * gt[1] + (F.col("row") + 0.5) * gt[2]
    y = gt[3] + (F.col("col") + 0.5) * gt[4] + (F.col("row") + 0.5) * gt[5]
    return pixels.withColumns({"x": x, "y": y})


def pixel_area(gt: Sequence[float]) -> float:
    return abs(gt[1] * gt[5])


def cropped(pixels: DataFrame, gt: Sequence[float], x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Pixels of a map extent, as a range filter on row and col."""
    c1, c2 = int((x1 - gt[0]) / gt[1]), int((x2 - gt[0]) / gt[1])
    r1, r2 = int((y2 - gt[3]) / gt[5]), int((y1 - gt[3]) / gt[5])
    return pixels.where(F.col("col").between(c1, c2 - 1) & F.col("row").between(r1, r2 - 1))


def from_tiles(tiles: DataFrame, data: str = "data", tile: int = 512) -> DataFrame:
    """Pixels of tiles (tile_r, tile_c, data: array of rows)."""
    out = tiles.select("*", F.posexplode(data).alias("r", "__line")).select("*", F.posexplode("__line").alias("c", "value"))
    return out.select((F.col("tile_r") * tile + F.col("r")).alias("row"), (F.col("tile_c") * tile + F.col("c")).alias("col"), "value")


def binarised(pixels: DataFrame, band: str, threshold: float | None = None, value: float | None = None) -> DataFrame:
    """water: band at or above a threshold, or equal to a value (1 by default)."""
    if threshold is not None and value is not None:
        raise ValueError("give a threshold or a value")
    return pixels.withColumn("water", F.col(band) >= threshold if threshold is not None else F.col(band) == (1 if value is None else value))


def zoned(pixels: DataFrame, shapes: DataFrame, size: float, key: str = "zone", order: str = "draw_order") -> DataFrame:
    """Pixels (with x, y) with the shape that covers their centre: the one drawn last, -1 outside."""
    where = points_in_shapes(pixels.select(*LATTICE, "x", "y").distinct(), shapes.select(key, order, "rings"), size)
    last = where.groupBy(*LATTICE).agg(F.max_by(key, order).alias(key))
    return pixels.join(last, LATTICE, "left").withColumn(key, F.coalesce(key, F.lit(-1)))


#: Columns of a span's piece, by which it meets the pixels of its row.
SPAN = 256


def spans(shapes: DataFrame, gt: Sequence[float], keep: Sequence[str], rings: str = "rings", all_touched: bool = False) -> DataFrame:
    """(keep, row, first, last): the pixels of each shape as runs of columns, row by row, for a geotransform without rotation.

    An edge is looked at once for each row it passes: it crosses the row's middle line at one column at most, and between the odd and
    the even crossings of a row lie the pixels whose centre is inside or on the boundary. all_touched adds the pixels whose
    inside an edge passes through, however little of them is covered. Runs may overlap.
    """
    x, y = lambda c: (c - gt[0]) / gt[1], lambda c: (c - gt[3]) / gt[5]
    each = shapes.select(*keep, F.col(rings).alias("__rings")).withColumn("__shape", F.monotonically_increasing_id())
    each = each.select(*keep, "__shape", F.explode(edges(F.col("__rings"))).alias("e"))
    each = settled(each.select(*keep, "__shape", *(f(F.col(f"e.{c}")).alias(c) for c, f in (("x1", x), ("y1", y), ("x2", x), ("y2", y)))))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = each.withColumn("row", F.explode(F.sequence(F.floor(low), F.floor(high))))
    middle = F.col("row") + 0.5
    # The same comparisons as of a point with the edge in the plane: an end on the line counts for the edge that leaves it downwards.
    crossing = rows.where((F.col("y1") < middle) != (F.col("y2") < middle))
    along = lambda v: F.try_divide((F.col("x2") - F.col("x1")) * (v - F.col("y1")), F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = crossing.groupBy(*keep, "__shape", "row").agg(F.array_sort(F.collect_list(along(middle))).alias("at"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("at") - 2, F.lit(2)), lambda k: F.struct(F.get("at", k).alias("a"), F.get("at", k + 1).alias("b")))
    inside = crossed.select(*keep, "row", F.explode(pairs).alias("p")).select(*keep, "row", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    flat = rows.where((F.col("y1") == middle) & (F.col("y2") == middle)).select(*keep, "row", F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"))
    ends = rows.where(F.col("y1") == middle).select(*keep, "row", F.col("x1").alias("a"), F.col("x1").alias("b"))
    centre = inside.unionByName(flat).unionByName(ends).select(*keep, "row", F.ceil(F.col("a") - 0.5).alias("first"), F.floor(F.col("b") - 0.5).alias("last"))
    if not all_touched:
        return centre.where("first <= last")
    level = F.col("y1") == F.col("y2")
    # Where the edge enters and leaves the row; its own ends are taken as they are.
    enter = F.when(low >= F.col("row"), F.when(F.col("y1") <= F.col("y2"), F.col("x1")).otherwise(F.col("x2"))).otherwise(along(F.col("row")))
    leave = F.when(high <= F.col("row") + 1, F.when(F.col("y1") <= F.col("y2"), F.col("x2")).otherwise(F.col("x1"))).otherwise(along(F.col("row") + 1))
    passed = rows.where(F.when(level, F.col("y1") != F.col("row")).otherwise((low < F.col("row") + 1) & (high > F.col("row"))))
    passed = passed.select(*keep, "row", F.when(level, F.least("x1", "x2")).otherwise(F.least(enter, leave)).alias("a"), F.when(level, F.greatest("x1", "x2")).otherwise(F.greatest(enter, leave)).alias("b"))
    last = F.when((F.col("a") == F.col("b")) & (F.floor("a") != F.col("a")), F.floor("a")).otherwise(F.ceil("b") - 1)
    touched = passed.select(*keep, "row", F.floor("a").alias("first"), last.alias("last"))
    return centre.unionByName(touched).where("first <= last")


def scanned(pixels: DataFrame, shapes: DataFrame, gt: Sequence[float], key: str = "zone", order: str = "draw_order", all_touched: bool = False) -> DataFrame:
    """Pixels with the shape drawn last over them, -1 outside, as `zoned`, by runs of columns in place of a test of every pixel with every shape."""
    runs = spans(shapes, gt, [key, order], all_touched=all_touched)
    block = F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN)))
    runs = runs.select(F.col("row").cast("long").alias("row"), block.alias("__block"), "first", "last", key, order)
    place = pixels.select(*(F.col(c).cast("long").alias(c) for c in LATTICE)).distinct().withColumn("__block", F.floor(F.col("col") / SPAN))
    held = place.join(runs, ["row", "__block"]).where(F.col("col").between(F.col("first"), F.col("last")))
    last = held.groupBy(*LATTICE).agg(F.max_by(key, order).alias(key))
    return pixels.join(last, LATTICE, "left").withColumn(key, F.coalesce(key, F.lit(-1)))


def zone_areas(zones: DataFrame, pixels: DataFrame, water: Column, area: float, key: str = "zone", by: Sequence[str] = ()) -> DataFrame:
    """Water area of every zone, and of every period of its pixels if given; a zone without water has 0."""
    sums = pixels.where(F.col(key) != -1).groupBy(key, *by).agg(F.sum(F.when(water, area).otherwise(0.0)).alias("area"))
    return zones.select(key).distinct().join(sums, key, "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def zone_means(pixels: DataFrame, measures: Sequence[str], area: float, key: str = "zone", by: Sequence[str] = ()) -> DataFrame:
    """Mean of each measure and its sum times the cell area."""
    aggs = [f for m in measures for f in (F.avg(m).alias(f"{m}_mean"), (F.sum(m) * area).alias(f"{m}_volume"))]
    return pixels.where(F.col(key) != -1).groupBy(key, *by).agg(*aggs)


def comasked_areas(pixels: DataFrame, products: Sequence[str], area: float, by: Sequence[str] = (), no_data: int = 0, water: int = 2) -> DataFrame:
    """For every pair of products, both water areas where both have data, in one pass; and valid and missing area of each."""
    aggs = []
    valid = {p: F.coalesce(F.col(p) != no_data, F.lit(False)) for p in products}
    for i, a in enumerate(products):
        aggs += [(F.count_if(valid[a]) * area).alias(f"{a}_valid"), (F.count_if(~valid[a]) * area).alias(f"{a}_missing")]
        for b in products[i + 1 :]:
            both = valid[a] & valid[b]
            aggs += [(F.count_if(both & (F.col(p) == water)) * area).alias(f"{a}_{b}_{p}_water") for p in (a, b)]
    return pixels.groupBy(*by).agg(*aggs)


def aligned(left: DataFrame, right: DataFrame, by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Two rasters on one lattice."""
    return left.join(right, [*LATTICE, *by], how)


def resampled(
    pixels: DataFrame, source: Sequence[float], target: DataFrame, target_gt: Sequence[float], band: str, how: str = "nearest", to_source: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """Values of a raster at the pixels of another lattice: nearest, or bilinear over the neighbours that exist.

    to_source maps the target's (x, y) to the source's, where their coordinate systems differ (`geometry.between`); both lattices
    meet by an equi-join on the source's row and column, so nothing but those pixels is shuffled.
    """
    at = centres(target.select(*LATTICE), target_gt)
    if to_source is not None:
        at = at.withColumn("__s", to_source(F.col("x"), F.col("y"))).select(*LATTICE, F.col("__s.x").alias("x"), F.col("__s.y").alias("y"))
    fc, fr = (F.col("x") - source[0]) / source[1], (F.col("y") - source[3]) / source[5]
    own = pixels.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(band).alias("v"))
    if how == "nearest":
        out = at.withColumns({"sr": F.floor(fr), "sc": F.floor(fc)}).join(own, ["sr", "sc"], "left")
        return out.select(*LATTICE, F.col("v").alias(band))
    near = at.withColumns({"fr": fr - 0.5, "fc": fc - 0.5}).withColumn("o", F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)))))
    near = near.withColumns({"sr": F.floor("fr") + F.col("o.dr"), "sc": F.floor("fc") + F.col("o.dc")})
    w = (1 - F.abs(F.col("fr") - F.col("sr"))) * (1 - F.abs(F.col("fc") - F.col("sc")))
    return near.withColumn("w", w).join(own, ["sr", "sc"], "left").groupBy(*LATTICE).agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum(F.when(F.col("v").isNotNull(), F.col("w")))).alias(band))


def monthly_composite(daily: DataFrame, bands: Sequence[str], qa: str, day: str = "day") -> DataFrame:
    """Median of clear observations by pixel and month; a pixel seen but never clear has 0. coverage tells which were."""
    clear = is_clear(qa)
    agg = [F.coalesce(F.median(F.when(clear, F.col(b))), F.lit(0.0)).alias(b) for b in bands]
    return daily.groupBy(*LATTICE, F.trunc(day, "MM").alias("period")).agg(*agg, (F.count_if(clear) > 0).alias("coverage"))


def with_index(pixels: DataFrame, green: str, nir: str, swir1: str, swir2: str) -> DataFrame:
    return pixels.withColumn("awei", awei(green, nir, swir1, swir2))


def window_positions(spark, height: int, width: int, window: int, overlap: int) -> DataFrame:
    """(xoff, yoff) of the full windows of a raster."""
    step = window - overlap
    ny, nx = max(0, (height - window) // step + 1), max(0, (width - window) // step + 1)
    return spark.range(nx * ny).select((F.floor(F.col("id") / nx) * step).cast("int").alias("yoff"), (F.col("id") % nx * step).cast("int").alias("xoff"))


def windows(pixels: DataFrame, height: int, width: int, window: int, overlap: int, bands: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of pixels in every window they belong to, by arithmetic on their position: xoff, yoff, r, c, bands, and by."""
    step = window - overlap
    first = lambda v: F.greatest(F.lit(0), F.ceil((F.col(v) - window + 1) / step)).cast("int")
    last = lambda v, n: F.least(F.lit((n - window) // step), F.floor(F.col(v) / step)).cast("int")
    each = lambda v, n: F.explode(F.when(first(v) <= last(v, n), F.sequence(first(v), last(v, n))).otherwise(F.array().cast("array<int>")))
    out = pixels.withColumn("yoff", each("row", height)).withColumn("xoff", each("col", width))
    out = out.withColumns({c: F.col(c) * step for c in ("yoff", "xoff")})
    return out.select("xoff", "yoff", (F.col("row") - F.col("yoff")).alias("r"), (F.col("col") - F.col("xoff")).alias("c"), *bands, *by)


def patches(cells: DataFrame, band: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each window with its band as an array of rows."""
    lines = cells.groupBy(*by, "xoff", "yoff", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", band))), lambda s: s[band]).alias("line"))
    return lines.groupBy(*by, "xoff", "yoff").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]).alias(band))


def reassembled(cells: DataFrame, lattice: DataFrame, band: str) -> DataFrame:
    """Mean of overlapping windows at every pixel of a lattice, 0 where none lies."""
    mean = cells.groupBy((F.col("yoff") + F.col("r")).alias("row"), (F.col("xoff") + F.col("c")).alias("col")).agg(F.avg(band).alias(band))
    return lattice.select(*LATTICE).join(mean, LATTICE, "left").fillna(0.0, [band])


def valid_patches(p: DataFrame, band: str, limit: float = 99_999) -> DataFrame:
    return p.where(F.aggregate(F.flatten(band), F.lit(0.0), lambda s, x: s + x) < limit)


def thinned(p: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Patches kept with a ratio, by the hash of their place, so that the same ones are kept each time."""
    place = F.pmod(F.xxhash64(*(c for c in p.columns if p.schema[c].dataType.typeName() not in ("array", "map", "struct")), F.lit(seed)), F.lit(1 << 32))
    return p.where(place < int(ratio * (1 << 32)))


def scored_patches(p: DataFrame, predict: Callable, band: str, scale: float = 1.0, threshold: float = 0.5, batch_size: int = 64) -> DataFrame:
    """patches with mask: predict(batch of arrays) > threshold. predict runs once for each Arrow batch in the tasks."""
    schema = p.withColumn("mask", F.lit(None).cast("array<array<int>>")).schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, batch_size):
                part = batch.slice(k, batch_size)
                out = np.asarray(predict(np.array(part.column(band).to_pylist(), float) * scale)) > threshold
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out.astype(np.int32).tolist(), pa.list_(pa.list_(pa.int32())))], schema.names)

    return p.mapInArrow(run, schema)


def store_model(spark, layers: Sequence[tuple[Sequence, Sequence]], path: str) -> None:
    """A small convolutional model as a table, a row for each layer: kernels (out, in, k, k), flat with their shape, and biases."""
    rows = [(j, list(map(int, np.shape(w))), np.ravel(w).astype(float).tolist(), np.ravel(b).astype(float).tolist()) for j, (w, b) in enumerate(layers)]
    spark.createDataFrame(rows, "layer int, shape array<int>, kernels array<double>, biases array<double>").coalesce(1).write.parquet(path)


def loaded_model(spark, path: str) -> Callable:
    """A function that makes the model's predict(batch of patches) in a worker. The weights are the model's own size and nothing else comes to the driver.

    Layers are convolutions that keep the size, with zeros beyond the border; ReLU between them, a logistic at the end.
    """
    layers = [(np.array(r["kernels"]).reshape(r["shape"]), np.array(r["biases"])) for r in spark.read.parquet(path).orderBy("layer").collect()]

    def make():
        def predict(batch):
            x = np.asarray(batch, float)[:, None]
            for j, (w, b) in enumerate(layers):
                k = w.shape[-1] // 2
                seen = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (k, k), (k, k))), w.shape[-2:], (2, 3))
                x = np.einsum("nihwkl,oikl->nohw", seen, w, optimize=True) + b[None, :, None, None]
                x = np.maximum(x, 0) if j + 1 < len(layers) else 1 / (1 + np.exp(-np.clip(x, -60, 60)))
            return x[:, 0]

        return predict

    return make


def predicted_patches(p: DataFrame, model: Callable, band: str, height: int, width: int, border: int = 0, threshold: float = 0.5, batch_size: int = 64) -> DataFrame:
    """patches with mask: model() > threshold without a border of so many pixels, where a patch does not see all it needs.

    The model is made once a worker and predicts batches of patches of one size; a patch of another size, or with a null pixel, has
    a null mask.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make():
        predict = model()
        return lambda flat: predict(flat).reshape(len(flat), -1)

    flat = F.flatten(band)
    whole = (F.size(flat) == height * width) & ~F.exists(flat, lambda v: v.isNull())
    scores = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[height, width]])
    filled = F.when(whole, flat.cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), height * width))
    lines = F.transform(F.sequence(F.lit(border), F.lit(height - border - 1)), lambda r: F.transform(F.slice("__score", r * width + border + 1, width - 2 * border), lambda v: (v > threshold).cast("int")))
    return p.withColumn("__score", scores(filled)).withColumn("mask", F.when(whole, lines)).drop("__score")


def mosaic(tiles: DataFrame, order: str, band: str, by: Sequence[str] = ()) -> DataFrame:
    """Later tiles over earlier ones."""
    return tiles.groupBy(*LATTICE, *by).agg(F.max_by(band, order).alias(band))


def gap_filled(pixels: DataFrame, main: str, *others: str, threshold: float = 0.5) -> DataFrame:
    """1 where the first product that has the pixel is above the threshold, else 0."""
    first = F.coalesce(*(F.when(F.col(c).isNotNull(), F.col(c) > threshold) for c in (main, *others)), F.lit(False))
    return pixels.withColumn("filled", first.cast("int"))


def constrained(pixels: DataFrame, water: str, extent: str) -> DataFrame:
    return pixels.withColumn(water, F.col(water) & F.coalesce(F.col(extent), F.lit(False)))


def fused(a: DataFrame, b: DataFrame, band_a: str, band_b: str, by: Sequence[str] = (), no_data: int = 0, water: int = 2) -> DataFrame:
    """1 where either has water, 0 where either has data, -1 elsewhere."""
    pair = a.select(*LATTICE, *by, F.col(band_a).alias("__a")).join(b.select(*LATTICE, *by, F.col(band_b).alias("__b")), [*LATTICE, *by], "full")
    known = lambda c: F.coalesce(F.col(c) != no_data, F.lit(False))
    wet = lambda c: F.coalesce(F.col(c) == water, F.lit(False))
    return pair.withColumn("fused", F.when(wet("__a") | wet("__b"), 1).when(known("__a") | known("__b"), 0).otherwise(-1)).drop("__a", "__b")


def months_as_bands(pixels: DataFrame, band: str, periods: Sequence[str], pattern: str = "water") -> DataFrame:
    named = pixels.withColumn("__name", F.concat(F.lit(f"{pattern}_"), F.date_format("period", "yyyy-MM-dd")))
    return named.groupBy(*LATTICE).pivot("__name", [f"{pattern}_{p}" for p in periods]).agg(F.max(band))


def neighbourhoods(pixels: DataFrame, samples: DataFrame, k: int, bands: Sequence[str]) -> DataFrame:
    """Sampled pixels with their k by k windows as arrays in row-major order; pixels at the edge have fewer."""
    h = k // 2
    step = F.sequence(F.lit(-h), F.lit(h))
    around = samples.select(F.col("row").alias("r0"), F.col("col").alias("c0")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    around = around.withColumns({"row": F.col("r0") + F.col("dr"), "col": F.col("c0") + F.col("dc")})
    found = around.join(pixels.select(*LATTICE, *bands), LATTICE)
    return found.groupBy("r0", "c0").agg(F.sort_array(F.collect_list(F.struct("dr", "dc", *bands))).alias("window"))


def drawn(pixels: DataFrame, n: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """n pixels of each stratum by hashed position."""
    h = F.xxhash64(*LATTICE, F.lit(seed))
    if not by:
        return pixels.orderBy(h, *LATTICE).limit(n)
    return pixels.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(h, *LATTICE))).where(F.col("__k") <= n).drop("__k")


def _labelled(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, first) of pixels sorted by row and col: the number of the connected part a pixel is in, and each part's first pixel.

    Runs of neighbours in a row are joined to the runs below that share a column.
    """
    new = np.r_[True, (np.diff(rows) != 0) | (np.diff(cols) > 1)]
    run, start = np.cumsum(new) - 1, np.flatnonzero(new)
    end = np.r_[start[1:], len(rows)] - 1
    wide = np.int64(cols.max() - cols.min() + 2)
    at = lambda k, down: (rows[k] - rows[0] + down) * wide + cols[k] - cols.min()
    low = np.searchsorted(at(end, 0), at(start, 1))
    high = np.searchsorted(at(start, 0), at(end, 1), "right")
    root = list(range(len(start)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, (i, j) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        for other in range(i, j):
            x, y = find(k), find(other)
            root[max(x, y)] = min(x, y)
    parts, label = np.unique([find(k) for k in range(len(start))], return_inverse=True)
    return label[run], start[parts]


def bodies(pixels: DataFrame, water: Column, width: int, area: float = 1.0, by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """(by, row, col, body, area): connected water by four neighbours within each group; a body is named by its smallest
    row * width + col. Pixels without row or col are left out; repeated ones count each time.

    Two levels: a task labels the parts of a tile's water, tile * tile pixels at most but for repeats, and rounds of
    components see only the parts that meet across tile borders. A part has as many pixels as a tile, so no body,
    however large, is one key of a join.
    """
    own = pixels.where(water).where("row is not null and col is not null")
    own = own.select(*by, *LATTICE, *(F.expr(f"{c} - pmod({c}, {tile})").alias(f"__{c}") for c in LATTICE))
    schema = T.StructType([*own.select(*by, *LATTICE).schema.fields, T.StructField("__part", T.LongType()), T.StructField("__n", T.LongType())])

    def label(table):
        import pyarrow as pa

        table = table.select([*by, *LATTICE]).sort_by([(c, "ascending") for c in LATTICE])
        rows, cols = (table.column(c).to_numpy().astype(np.int64) for c in LATTICE)
        which, first = _labelled(rows, cols)
        for name, values in (("__part", (rows[first] * width + cols[first])[which]), ("__n", np.bincount(which)[which])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    parts = settled(own.groupBy(*by, "__row", "__col").applyInArrow(label, schema))
    node = F.struct(*by, "__part") if by else F.col("__part")
    place = F.struct(*by, *(F.col(c).cast("long").alias(c) for c in LATTICE))
    borders = parts.select(*LATTICE, node.alias("v"), place.alias("at"))
    pairs = []
    for c in LATTICE:
        beyond = [F.col(k).cast("long") + (1 if k == c else 0) for k in LATTICE]
        ends = parts.where(f"pmod({c}, {tile}) = {tile - 1}").where(F.lit(c == "row") | (F.col("col") + 1 < width))
        ends = ends.select(node.alias("u"), F.struct(*by, *(k.alias(n) for k, n in zip(beyond, LATTICE, strict=True))).alias("at"))
        pairs.append(ends.join(borders.where(f"pmod({c}, {tile}) = 0"), "at").select("u", "v"))
    found = connected(pairs[0].union(pairs[1]).distinct())
    firsts = parts.where(F.col("row").cast("long") * width + F.col("col") == F.col("__part")).select(node.alias("node"), "__n").distinct()
    firsts = firsts.join(found, "node", "left").select("node", "__n", F.coalesce("root", "node").alias("root"))
    firsts = firsts.join(firsts.groupBy("root").agg((F.sum("__n") * area).alias("area")), "root")
    out = parts.select(*by, *LATTICE, node.alias("node")).join(firsts, "node")
    return out.select(*by, *LATTICE, (F.col("root.__part") if by else F.col("root")).alias("body"), "area")


def body_areas(
    found: DataFrame, shapes: DataFrame, gt: Sequence[float], size: float, key: str = "zone", order: str = "draw_order", by: Sequence[str] = (), zeros: bool = False
) -> DataFrame:
    """(by, key, area): every body goes to the first shape that holds its centroid.

    Without groups each shape has a row. With groups a shape without a body in a group has none, unless zeros asks for
    a 0 in each group that has bodies: groups times shapes rows.
    """
    middle = centres(found, gt).groupBy(*by, "body").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.first("area").alias("area"))
    given = points_in_shapes(middle, shapes.select(key, order, "rings"), size).groupBy(*by, "body").agg(F.min_by(key, order).alias(key), F.first("area").alias("area"))
    sums = given.groupBy(*by, key).agg(F.sum("area").alias("area"))
    if not by:
        return shapes.select(key).join(sums, key, "left").fillna(0.0, ["area"])
    if not zeros:
        return sums
    none = found.select(*by).distinct().crossJoin(shapes.select(key)).select(*by, key, F.lit(0.0).alias("area"))
    return none.union(sums.select(*by, key, "area")).groupBy(*by, key).agg(F.sum("area").alias("area"))


def basin_balance(cells: DataFrame, key: str, cell_area: float, measures: Sequence[str] = ("runoff", "evaporation", "precipitation"), flags: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each basin and period: sums times the cell area, and the areas of flagged cells."""
    aggs = [(F.sum(m) * cell_area).alias(m) for m in measures] + [(F.count_if(c) * cell_area).alias(n) for n, c in (flags or {}).items()]
    return cells.groupBy(key, "period").agg(*aggs)
