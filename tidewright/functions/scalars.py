"""Scalar column functions: bit fields, classes, hydrology formulas, coordinates, the normal tail."""

from __future__ import annotations

import functools

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_if_nan(x: C) -> Column:
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def bit_field(value: C, low: int, high: int) -> Column:
    """Bits low to high of an integer."""
    return F.shiftright(col(value), low).bitwiseAND((1 << (high - low + 1)) - 1)


def is_clear(qa: C) -> Column:
    """Quality word with cloud state, shadow and cirrus all zero."""
    return (bit_field(qa, 0, 1) == 0) & (bit_field(qa, 2, 2) == 0) & (bit_field(qa, 8, 9) == 0)


def awei(green: C, nir: C, swir1: C, swir2: C) -> Column:
    """Water extraction index."""
    return 4 * (col(green) - col(swir1)) - (0.25 * col(nir) + 2.75 * col(swir2))


def recode_class(code: C, missing: int = 999_999) -> Column:
    """0 is missing; other classes move down by one."""
    return F.when(col(code) == 0, missing).otherwise(col(code) - 1)


#: Mean depth by area class: upper area in km2 (exclusive), intercept, area exponent, slope exponent, correction (fixed values).
DEPTH_CLASSES = (
    (1.0, 0.3826, 0.1512, 0.4820, 0.0678),
    (10.0, 0.1801, 0.2985, 0.8473, 0.0689),
    (100.0, 0.0379, 0.2445, 1.1517, 0.0692),
    (None, 0.0123, 0.2664, 1.1474, 0.1094),
)


def mean_depth(area: C, slope: C, classes: Sequence[tuple] = DEPTH_CLASSES) -> Column:
    """log10 depth is linear in log10 area and log10 slope, by area class; no area, no depth."""
    out = None
    for upper, intercept, by_area, by_slope, correction in classes:
        depth = F.pow(F.lit(10.0), intercept + by_area * F.log10(col(area)) + by_slope * F.log10(col(slope)) + correction)
        case = F.lit(True) if upper is None else col(area) < upper
        out = F.when(case, depth) if out is None else out.when(case, depth)
    return F.when(col(area) == 0, 0.0).otherwise(out)


def volume(area: C, slope: C) -> Column:
    return mean_depth(area, slope) * col(area)


def level(area: C, a: C, b: C, scale: float = 1.0) -> Column:
    """Inverse of the power law area = a * level^b."""
    return F.pow(col(area) * scale / col(a), 1 / col(b))


def buffer_distance(area: C, slope: C, area_range: tuple[float, float], slope_low: C, slope_high: C, low: float = 90.0, high: float = 2250.0, clamp: bool = True) -> Column:
    """Wider for large areas and flat surroundings; a slope of -1 is unknown and takes half of its part."""
    share = (col(area) - area_range[0]) / (area_range[1] - area_range[0])
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) if clamp else share
    flat = F.when(col(slope) == -1, 0.5).otherwise(F.try_divide(col(slope_high) - col(slope), col(slope_high) - col(slope_low)))
    return (low + share * (high - low)) * (1 + flat)


def longitude(x: C) -> Column:
    return F.when(col(x) > 180, col(x) - 360).otherwise(col(x))


def month_of(day: C) -> Column:
    return F.trunc(col(day), "MM")


def split_of(period: C, first_year: int, folds: int = 3) -> Column:
    """Train, eval or test by (month + year - first year) mod folds."""
    return F.element_at(F.array(F.lit("train"), F.lit("eval"), F.lit("test")), (F.pmod(F.month(col(period)) + F.year(col(period)) - first_year, F.lit(folds)) + 1).cast("int"))


def binned(x: C, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin (edges[k], edges[k+1]]; null outside."""
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((col(x) > low) & (col(x) <= high), name).otherwise(out)
    return out


def mapped(x: C, names: Mapping) -> Column:
    """Label of a code, null for others."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return F.create_map(*pairs)[col(x)]


def cell_index(x: C, y: C, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Row-major index over two lists of left edges; values are clamped, rows run from high y to low."""
    at = lambda v, edges: F.greatest(F.lit(0), sum((F.when(col(v) >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1)
    return (len(ys) - 1 - at(y, ys)) * len(xs) + at(x, xs)


def quadrant(x: C, y: C, x_middle: C, y_middle: C) -> Column:
    """ur, lr, ul or ll about a middle; null on it."""
    x, y, a, b = map(col, (x, y, x_middle, y_middle))
    return F.when((x > a) & (y > b), "ur").when((x > a) & (y < b), "lr").when((x < a) & (y > b), "ul").when((x < a) & (y < b), "ll")


def row_mean(*columns: C) -> Column:
    """Mean of the columns of a row; one null makes it null."""
    return sum((col(c) for c in columns[1:]), col(columns[0])) / len(columns)


def seasonality_share(seasonal: C, other: C) -> Column:
    """Percent of the variation that is seasonal; 66.7 is twice the rest."""
    return F.try_divide(col(seasonal), col(seasonal) + col(other)) * 100


def low_water_share(deviation: C, trend: C, years: int = 23, amplitude: C | None = None) -> Column:
    """Percent of the largest low against the whole trend (and seasonal amplitude)."""
    total = F.abs(col(trend)) * years + F.abs(col(deviation)) + (col(amplitude) if amplitude is not None else 0)
    return F.try_divide(col(deviation), total) * 100


def humidity_class(aridity: C, threshold: float = 0.65, scale: float = 0.01) -> Column:
    """humid above the threshold, else arid, also where it is unknown."""
    return F.when(col(aridity) * scale > threshold, "humid").otherwise("arid")


#: Numerator, denominator and far fraction of the upper normal tail, good to 15 digits (Hart's approximation, fixed values).
TAIL_ABOVE = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
TAIL_FAR, ROOT_TWO_PI = 7.07106781186547, 2.506628274631


def two_sided_p(z: C) -> Column:
    """1 - erf(|z| / sqrt 2): a ratio of polynomials, and a continued fraction far out."""
    x = F.abs(col(z))
    horner = lambda parts: functools.reduce(lambda a, c: a * x + c, parts[1:], F.lit(parts[0]))
    fraction = functools.reduce(lambda a, k: x + k / a, (4, 3, 2, 1), x + 0.65)
    tail = F.exp(-x * x / 2) * F.when(x < TAIL_FAR, horner(TAIL_ABOVE) / horner(TAIL_BELOW)).otherwise(1 / (fraction * ROOT_TWO_PI))
    return 2 * tail


def _tail_sql() -> str:
    horner = lambda parts: functools.reduce(lambda a, c: f"({a} * abs({{z}}) + {c!r}::DOUBLE)", parts[1:], f"{parts[0]!r}::DOUBLE")
    fraction = functools.reduce(lambda a, k: f"(abs({{z}}) + {k} / {a})", (4, 3, 2, 1), "(abs({z}) + 0.65::DOUBLE)")
    near, far = f"{horner(TAIL_ABOVE)} / {horner(TAIL_BELOW)}", f"1 / ({fraction} * {ROOT_TWO_PI!r}::DOUBLE)"
    return f"(2 * exp(-abs({{z}}) * abs({{z}}) / 2) * CASE WHEN abs({{z}}) < {TAIL_FAR!r} THEN {near} ELSE {far} END)"


#: The same over an expression {z}.
TWO_SIDED_P_SQL = _tail_sql()


def guarded_slope(y: C, x: C) -> Column:
    """Least-squares slope, null if any y is null."""
    return F.when(F.count(col(y)) == F.count(F.lit(1)), F.regr_slope(col(y), col(x)))
