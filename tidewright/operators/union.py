"""Union of polygons by key: overlaps count once.

Parts are dealt to the grid cells that their bounds touch, and each (key, cell) is worked on by itself, so a key with very many
parts is no single task. In a cell the parts' sides are cut where they cross or touch another one and at the cell's borders;
a piece with parts on one side only is boundary and goes out once, from the cell that holds its middle, with the covered side on
its left. Area follows from the pieces without more ado; rings are put together for each key from its own boundary.

Parts may have holes (even-odd) and may touch or repeat. Null and degenerate parts have no sides. `grain` is the distance below
which points count as one; cells should be far larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import covered


def _inside(rings, x, y):
    """Even-odd, of arrays of points."""
    import numpy as np

    out = np.zeros(len(x), bool)
    for r in rings:
        x1, y1 = r[:, 0], r[:, 1]
        x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
        for a, b, c, d in zip(x1.tolist(), y1.tolist(), x2.tolist(), y2.tolist()):
            if b != d:
                out ^= ((b > y) != (d > y)) & (x < (c - a) * (y - b) / (d - b) + a)
    return out


def _pieces(p, q, low, high, grain):
    """(a, b): the sides p to q cut at their common points and at the borders low and high, inside the cell, without repeats."""
    import numpy as np

    d = q - p
    cuts = [[0.0, 1.0] for _ in range(len(p))]
    points = [{0.0: tuple(a), 1.0: tuple(b)} for a, b in zip(p.tolist(), q.tolist())]

    def cut(i, t, point):
        near = [s for s in cuts[i] if abs(s - t) * lengths[i] <= grain]
        if not near:
            cuts[i].append(t)
            points[i][t] = point

    lengths = np.hypot(d[:, 0], d[:, 1]).tolist()
    left, right = np.minimum(p, q), np.maximum(p, q)
    order = np.argsort(left[:, 0], kind="stable")
    starts = left[order, 0]
    for k, i in enumerate(order.tolist()):
        for axis in (0, 1):
            for line in (low[axis], high[axis]):
                if left[i, axis] < line < right[i, axis]:
                    t = (line - p[i, axis]) / d[i, axis]
                    other = p[i, 1 - axis] + t * d[i, 1 - axis]
                    cut(i, float(t), (float(line), float(other)) if axis == 0 else (float(other), float(line)))
        j = order[k + 1 : np.searchsorted(starts, right[i, 0] + grain, "right")]
        j = j[(left[j, 1] <= right[i, 1] + grain) & (right[j, 1] >= left[i, 1] - grain)]
        if not len(j):
            continue
        gap, cross = p[j] - p[i], d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        offset = gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]
        slanted = np.abs(cross) > 1e-12 * lengths[i] * np.array([lengths[m] for m in j])
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / cross, offset / cross
        for m, s, a, b, far in zip(j.tolist(), slanted.tolist(), t.tolist(), u.tolist(), (np.abs(offset) / max(lengths[i], 1e-300)).tolist()):
            if s:
                ta, tb = grain / lengths[i], grain / lengths[m]
                if -ta <= a <= 1 + ta and -tb <= b <= 1 + tb:
                    # An end that lies on the other side stays as it is; a crossing is one point for both.
                    ends = [points[i][e] for e in (0.0, 1.0) if abs(a - e) <= ta] + [points[m][e] for e in (0.0, 1.0) if abs(b - e) <= tb]
                    at = ends[0] if ends else (float(p[i, 0] + a * d[i, 0]), float(p[i, 1] + a * d[i, 1]))
                    cut(i, a, at)
                    cut(m, b, at)
            elif far <= grain:
                for x, y in ((i, m), (m, i)):
                    for e in (0.0, 1.0):
                        v = ((points[y][e][0] - p[x, 0]) * d[x, 0] + (points[y][e][1] - p[x, 1]) * d[x, 1]) / lengths[x] ** 2
                        if 0 < v < 1:
                            cut(x, float(v), points[y][e])
    found = {}
    for i, own in enumerate(cuts):
        own = sorted(own)
        for s, e in zip(own[:-1], own[1:]):
            a, b = points[i][s], points[i][e]
            name = tuple(sorted((tuple(round(c / grain) for c in a), tuple(round(c / grain) for c in b))))
            if name[0] != name[1]:
                found.setdefault(name, (a, b))
    return np.array([a for a, _ in found.values()]).reshape(-1, 2), np.array([b for _, b in found.values()]).reshape(-1, 2)


def boundary(parts: DataFrame, key: str, size: float, rings: str = "rings", grain: float = 1e-9) -> DataFrame:
    """(key, x1, y1, x2, y2): the pieces of each key's boundary, covered on their left."""
    dealt = covered(parts.select(key, F.col(rings).alias("__rings")).where(F.col("__rings").isNotNull() & (F.size("__rings") > 0)), "__rings", size).drop("b")
    schema = f"`{key}` {parts.schema[key].dataType.simpleString()}, x1 double, y1 double, x2 double, y2 double"

    def run(group, table):
        import numpy as np
        import pyarrow as pa

        name, cx, cy = (k.as_py() for k in group)
        low, high = np.array([cx, cy]) * size, np.array([cx + 1, cy + 1]) * size
        shapes = [[np.array([(c["x"], c["y"]) for c in r], float) for r in shape if len(r) > 2] for shape in table.column("__rings").to_pylist()]
        sides = [(r, np.roll(r, -1, 0)) for shape in shapes for r in shape]
        p = np.concatenate([a for a, _ in sides]) if sides else np.empty((0, 2))
        q = np.concatenate([b for _, b in sides]) if sides else np.empty((0, 2))
        # One direction for every side, so that all cells cut it at the same points.
        turn = (q[:, 0] < p[:, 0]) | ((q[:, 0] == p[:, 0]) & (q[:, 1] < p[:, 1]))
        p, q = np.where(turn[:, None], q, p), np.where(turn[:, None], p, q)
        here = (np.maximum(p, q) >= low).all(1) & (np.minimum(p, q) <= high).all(1) & (np.hypot(*(q - p).T) > grain)
        a, b = _pieces(p[here], q[here], low, high, grain)
        middle = (a + b) / 2
        own = (np.floor(middle / size) == [cx, cy]).all(1) if len(a) else np.zeros(0, bool)
        a, b, middle = a[own], b[own], middle[own]
        aside = np.stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0]], 1)
        aside *= 4 * grain / np.maximum(np.hypot(*aside.T), 1e-300)[:, None]
        sided = []
        for way in (1, -1):
            at, on = middle + way * aside, np.zeros(len(a), bool)
            for shape in shapes:
                left = np.flatnonzero(~on)
                if shape and len(left):
                    least, most = np.min([r.min(0) for r in shape], 0), np.max([r.max(0) for r in shape], 0)
                    left = left[(at[left] >= least).all(1) & (at[left] <= most).all(1)]
                    on[left] = _inside(shape, at[left, 0], at[left, 1])
            sided.append(on)
        ahead, back = sided[0] & ~sided[1], sided[1] & ~sided[0]
        a, b = np.concatenate([a[ahead], b[back]]), np.concatenate([b[ahead], a[back]])
        return pa.table({key: pa.array([name] * len(a), table.schema.field(key).type), "x1": a[:, 0], "y1": a[:, 1], "x2": b[:, 0], "y2": b[:, 1]})

    return dealt.groupBy(key, "cx", "cy").applyInArrow(run, schema)


def united_areas(pieces: DataFrame, key: str) -> DataFrame:
    """(key, area) from the boundary pieces, taken about a corner of their own to keep digits."""
    base = pieces.groupBy(key).agg(F.min("x1").alias("__x"), F.min("y1").alias("__y"))
    x = lambda c: F.col(c) - F.col("__x")
    y = lambda c: F.col(c) - F.col("__y")
    both = pieces.withColumnRenamed(key, "__key").join(base, F.col("__key").eqNullSafe(F.col(key)))
    return both.groupBy(key).agg((F.sum(x("x1") * y("y2") - x("x2") * y("y1")) / 2).alias("area"))


def united(parts: DataFrame, key: str, size: float, rings: str = "rings", grain: float = 1e-9) -> DataFrame:
    """(key, rings): the union of each key's parts; outer rings run counter-clockwise, holes clockwise."""
    pieces = boundary(parts, key, size, rings, grain)
    schema = f"`{key}` {parts.schema[key].dataType.simpleString()}, rings array<array<struct<x:double,y:double>>>"

    def run(group, table):
        import math
        from collections import defaultdict

        import pyarrow as pa

        rows = list(zip(*(table.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2")), strict=True))
        node = lambda x, y: (round(x / grain), round(y / grain))
        out = defaultdict(list)
        for k, (x1, y1, _, _) in enumerate(rows):
            out[node(x1, y1)].append(k)
        left, found = set(range(len(rows))), []
        for first in range(len(rows)):
            if first not in left:
                continue
            ring, k = [], first
            while True:
                left.discard(k)
                x1, y1, x2, y2 = rows[k]
                ring.append((x1, y1))
                back = math.atan2(y1 - y2, x1 - x2)
                onward = [j for j in out[node(x2, y2)] if j in left or j == first]
                # Of several ways on the first one clockwise from the way back: rings that touch stay apart.
                k = first if not onward else min(onward, key=lambda j: (back - math.atan2(rows[j][3] - rows[j][1], rows[j][2] - rows[j][0])) % (2 * math.pi) or 2 * math.pi)
                if k == first:
                    break
            bent = []
            for i, (x, y) in enumerate(ring):
                (ax, ay), (bx, by) = ring[i - 1], ring[(i + 1) % len(ring)]
                if abs((x - ax) * (by - y) - (y - ay) * (bx - x)) > 1e-12 * math.hypot(x - ax, y - ay) * math.hypot(bx - x, by - y):
                    bent.append({"x": x, "y": y})
            if len(bent) > 2:
                found.append(bent)
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.table({key: pa.array([group[0].as_py()], table.schema.field(key).type), "rings": pa.array([found], kind)})

    return pieces.groupBy(key).applyInArrow(run, schema)
