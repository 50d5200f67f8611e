"""Raster tables in Morton order: space is partitioned once, at write, and every later crop reads a few row groups.

The key interleaves the bits of row and column, so pixels that are near each other mostly have near keys. A table is
range-partitioned and sorted by it, which gives each Parquet row group a narrow range of keys in its statistics. A crop is a
rectangle; it is cut along the quadtree into at most `pieces` key ranges, which the scan compares with these statistics, and the
exact test on row and column follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a row or column number.
BITS = 31
MORTON = "morton"


def _spread(v: Column) -> Column:
    """The low 31 bits of v, each followed by an empty one: halves move apart, then their halves, and so on."""
    v = v.cast("long").bitwiseAND(F.lit((1 << BITS) - 1))
    for step in (16, 8, 4, 2, 1):
        mask = sum(((1 << step) - 1) << at for at in range(0, 64, 2 * step))
        v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask & ((1 << 63) - 1)))
    return v


def morton(row: Column, col: Column) -> Column:
    return F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))


def _key(row: int, col: int) -> int:
    return sum(((row >> k) & 1) << (2 * k + 1) | ((col >> k) & 1) << (2 * k) for k in range(BITS))


def ranges(r1: int, r2: int, c1: int, c2: int, pieces: int = 64) -> list[tuple[int, int]]:
    """Key ranges (both ends in) that cover the pixels from (r1, c1) to (r2, c2); the fewest blocks are refined first, the rest may reach beyond."""
    if r1 > r2 or c1 > c2:
        return []
    done, edge = [], [(0, 0, BITS)]
    while edge and len(done) + len(edge) <= pieces:
        edge.sort(key=lambda b: -b[2])
        r, c, bits = edge.pop(0)
        size = 1 << bits
        if r > r2 or c > c2 or r + size <= r1 or c + size <= c1:
            continue
        if bits == 0 or (r >= r1 and c >= c1 and r + size - 1 <= r2 and c + size - 1 <= c2):
            done.append((r, c, bits))
        else:
            half = size // 2
            edge += [(r, c, bits - 1), (r, c + half, bits - 1), (r + half, c, bits - 1), (r + half, c + half, bits - 1)]
    out: list[tuple[int, int]] = []
    for low, high in sorted((_key(r, c), _key(r, c) + (1 << 2 * bits) - 1) for r, c, bits in done + edge if not (r > r2 or c > c2 or r + (1 << bits) <= r1 or c + (1 << bits) <= c1)):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def write(pixels: DataFrame, path: str, parts: int | None = None, row_group_bytes: int = 8_000_000) -> None:
    """The pixels (row, col below 2^31 and not negative, and any other columns) as a table in Morton order."""
    keyed = pixels.withColumn(MORTON, morton(F.col("row"), F.col("col")))
    dealt = keyed.repartitionByRange(parts, MORTON) if parts else keyed.repartitionByRange(MORTON)
    dealt.sortWithinPartitions(MORTON).write.option("parquet.block.size", row_group_bytes).parquet(path)


def read(spark: SparkSession, path: str, r1: int | None = None, r2: int | None = None, c1: int | None = None, c2: int | None = None, pieces: int = 64) -> DataFrame:
    """The table, or its pixels in rows r1 to r2 and columns c1 to c2."""
    out = spark.read.parquet(path)
    if r1 is not None:
        near = F.lit(False)
        for low, high in ranges(max(0, r1), r2, max(0, c1), c2, pieces):
            near = near | F.col(MORTON).between(low, high)
        out = out.where(near).where(F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    return out.drop(MORTON)


def crop(spark: SparkSession, path: str, gt, x1: float, y1: float, x2: float, y2: float, pieces: int = 64) -> DataFrame:
    """The pixels of a map extent, as `raster.cropped` takes them."""
    c1, c2 = int((x1 - gt[0]) / gt[1]), int((x2 - gt[0]) / gt[1])
    r1, r2 = int((y2 - gt[3]) / gt[5]), int((y1 - gt[3]) / gt[5])
    return read(spark, path, r1, r2 - 1, c1, c2 - 1, pieces)
