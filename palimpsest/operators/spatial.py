"""Box joins by bins, grids of cells, and polygon kernels as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, DoubleType, StringType

BOX = ["west", "south", "east", "north"]


def box_join(left: DataFrame, right: DataFrame, bin_x: float, bin_y: float, closed: bool = False, most_bins: int = 1_000_000) -> DataFrame:
    """Pairs of boxes that share area (or, closed, touch), as an equi-join on bins.

    Both sides have west, south, east, north; the right side's are prefixed ``r_``
    in the result. A pair is reported in the one bin that holds the lower left
    corner of its overlap, so nothing has to be made distinct afterwards.
    """
    right = right.select(*(F.col(c).alias(f"r_{c}") if c in BOX else F.col(c) for c in right.columns))

    def bins(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi, size: F.sequence(F.floor(F.col(p + lo) / size), F.floor(F.col(p + hi) / size))
        return df.withColumn(p + "bx", F.explode(span("west", "east", bin_x))).withColumn(p + "by", F.explode(span("south", "north", bin_y)))

    low_x, low_y = F.greatest("west", "r_west"), F.greatest("south", "r_south")
    high_x, high_y = F.least("east", "r_east"), F.least("north", "r_north")
    meet = (high_x >= low_x) & (high_y >= low_y) if closed else (high_x > low_x) & (high_y > low_y)
    here = (F.floor(low_x / bin_x) == F.col("bx")) & (F.floor(low_y / bin_y) == F.col("by"))
    joined = bins(left, "").join(bins(right, "r_"), (F.col("bx") == F.col("r_bx")) & (F.col("by") == F.col("r_by")) & meet & here)
    return joined.drop("bx", "by", "r_bx", "r_by")


def bbox(df: DataFrame, ring: str) -> DataFrame:
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return df.withColumns({"west": F.array_min(x), "south": F.array_min(y), "east": F.array_max(x), "north": F.array_max(y)})


def grid_cells(df: DataFrame, step: float = 0.125, origin_x: float = -180.0, origin_y: float = -90.0) -> DataFrame:
    """Cells that a box meets: ids ``q7p5-i-j``, corners and counter-clockwise ring."""
    span = lambda lo, hi, o: F.sequence(F.floor((F.col(lo) - o) / step), F.ceil((F.col(hi) - o) / step) - 1)
    out = df.withColumn("i", F.explode(span("west", "east", origin_x))).withColumn("j", F.explode(span("south", "north", origin_y)))
    w, s = F.round(F.col("i") * step + origin_x, 6), F.round(F.col("j") * step + origin_y, 6)
    e, n = F.round(w + step, 6), F.round(s + step, 6)
    ring = F.array(*(F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))))
    return out.withColumns({"area_id": F.concat_ws("-", F.lit("q7p5"), "i", "j"), "ring": ring})


def area_of(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Part of a ring inside a box: each edge of the box cuts in turn."""
    out = [tuple(p) for p in (ring[:-1] if len(ring) > 1 and np.array_equal(ring[0], ring[-1]) else ring)]
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        points, out = out, []
        for a, b in zip(points, points[1:] + points[:1], strict=True):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if (da > 0 > db) or (da < 0 < db):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return np.array(out).reshape(-1, 2)


def inside(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against one ring."""
    hit = np.zeros(np.broadcast(x, y).shape, bool)
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
        if y1 != y2:
            hit ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return hit


def crossing(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two lines of points meet, touching included."""

    def side(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    def on(p, q, r):
        return min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    for p, q in zip(a[:-1], a[1:], strict=True):
        for r, s in zip(b[:-1], b[1:], strict=True):
            d = side(p, q, r), side(p, q, s), side(r, s, p), side(r, s, q)
            if d[0] != d[1] and d[2] != d[3]:
                return True
            if any(v == 0 and on(*o) for v, o in zip(d, ((p, q, r), (p, q, s), (r, s, p), (r, s, q)), strict=True)):
                return True
    return False


def invalid_reason(ring: np.ndarray) -> str | None:
    if len(ring) < 4:
        return "fewer than four positions"
    if not np.array_equal(ring[0], ring[-1]):
        return "not closed"
    if abs(area_of(ring[:-1])) == 0:
        return "no area"
    edges = list(zip(ring[:-1], ring[1:], strict=True))
    for i in range(len(edges)):
        for j in range(i + 2, len(edges)):
            if not (i == 0 and j == len(edges) - 1) and crossing(np.array(edges[i]), np.array(edges[j])):
                return "crosses itself"
    return None


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return float(max(d.min(axis=1).max(), d.min(axis=0).max()))


def _ring(value) -> np.ndarray:
    return np.array([list(p) for p in value], float).reshape(-1, 2)


@pandas_udf(DoubleType())
def clipped_area(ring: pd.Series, west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.Series:
    """Area that a ring shares with a box."""
    out = [abs(area_of(c)) if len(c := clip_ring(_ring(r), b)) > 2 else 0.0 for r, *b in zip(ring, west, south, east, north, strict=True)]
    return pd.Series(out, dtype=float)


@pandas_udf(BooleanType())
def ring_holds(ring: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([bool(inside(np.array(a), np.array(b), _ring(r))) for r, a, b in zip(ring, x, y, strict=True)])


@pandas_udf(BooleanType())
def rings_meet(a: pd.Series, b: pd.Series) -> pd.Series:
    """Closed intersection: a shared point is enough."""
    out = []
    for p, q in zip(a, b, strict=True):
        p, q = _ring(p), _ring(q)
        out.append(crossing(p, q) or bool(inside(*p[0], q)) or bool(inside(*q[0], p)))
    return pd.Series(out)


@pandas_udf(StringType())
def ring_problem(ring: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else invalid_reason(_ring(r)) for r in ring])


def common_box(df: DataFrame, keys: list[str]) -> DataFrame:
    """Footprint that all boxes of a group share; null bounds where they do not."""
    out = df.groupBy(*keys).agg(F.max("west").alias("west"), F.max("south").alias("south"), F.min("east").alias("east"), F.min("north").alias("north"))
    some = (F.col("west") < F.col("east")) & (F.col("south") < F.col("north"))
    return out.select(*keys, *(F.when(some, F.col(c)).alias(c) for c in BOX))


def fit_affine(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares affine map (col, row) -> (x, y) of each group, by its normal equations.

    Sums are combined before the shuffle, so a group of any size is one row.
    """
    s = lambda e: F.sum(F.expr(e))
    sums = points.groupBy(*keys).agg(
        F.count("*").alias("n"), s("col").alias("c"), s("row").alias("r"), s("col*col").alias("cc"), s("row*row").alias("rr"), s("col*row").alias("cr"),
        s("x").alias("x"), s("col*x").alias("cx"), s("row*x").alias("rx"), s("y").alias("y"), s("col*y").alias("cy"), s("row*y").alias("ry"),
    )
    det = F.expr("cc*(rr*n - r*r) - cr*(cr*n - c*r) + c*(cr*r - rr*c)")

    def solved(v: str) -> list:
        a = F.expr(f"c{v}*(rr*n - r*r) - cr*(r{v}*n - r*{v}) + c*(r{v}*r - rr*{v})") / det
        b = F.expr(f"cc*(r{v}*n - r*{v}) - c{v}*(cr*n - c*r) + c*(cr*{v} - r{v}*c)") / det
        return [a, b, (F.col(v) - a * F.col("c") - b * F.col("r")) / F.col("n")]

    return sums.where((F.col("n") >= 3) & (det != 0)).select(*keys, "n", F.array(*solved("x"), *solved("y")).alias("transform"))
