"""Column functions on rings: arrays of (x, y) structs in a local plane, first corner not repeated."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .geo import EARTH_KM, haversine_km

BOX = StructType([StructField(c, DoubleType()) for c in ("length", "width", "hull_area", "cx", "cy", "ux", "uy")])


def sides(ring: Column) -> Column:
    """Array of (a, b): each corner and the next, around the ring."""
    return F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _cross(side: Column) -> Column:
    return side["a"]["x"] * side["b"]["y"] - side["b"]["x"] * side["a"]["y"]


def area(ring: Column) -> Column:
    """Shoelace area, positive if the corners run counter-clockwise."""
    return _total(F.transform(sides(ring), _cross)) / 2


def perimeter(ring: Column) -> Column:
    return _total(F.transform(sides(ring), lambda s: F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of the area; null for rings without area."""
    twice = F.when(area(ring) != 0, 6 * area(ring))
    along = lambda c: _total(F.transform(sides(ring), lambda s: (s["a"][c] + s["b"][c]) * _cross(s))) / twice
    return along("x"), along("y")


def compactness(ring: Column) -> Column:
    """1 for a circle."""
    return 4 * np.pi * F.abs(area(ring)) / F.greatest(F.pow(perimeter(ring), F.lit(2)), F.lit(1e-9))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with a ray to the right."""
    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(sides(ring), crossed)) % 2 == 1


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance to the nearest point of the outline; null for an empty ring."""
    def off(s: Column) -> Column:
        a, dx, dy = s["a"], s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        t = ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-12))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.array_min(F.transform(sides(ring), off))


def distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance to the polygon: 0 inside."""
    return F.when(contains(ring, x, y), 0.0).otherwise(edge_distance(ring, x, y))


def sphere_area_km2(ring: Column) -> Column:
    """Area of a ring of (lon, lat) corners in x and y, in degrees."""
    term = lambda s: F.radians(s["b"]["x"] - s["a"]["x"]) * (2 + F.sin(F.radians(s["a"]["y"])) + F.sin(F.radians(s["b"]["y"])))
    return F.abs(_total(F.transform(sides(ring), term))) * EARTH_KM * EARTH_KM / 2


def sphere_perimeter_km(ring: Column) -> Column:
    return _total(F.transform(sides(ring), lambda s: haversine_km(s["a"]["y"], s["a"]["x"], s["b"]["y"], s["b"]["x"])))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows

    def chain(rows: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in rows:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(rows) + chain(rows[::-1]))


def _box(corners: list | None) -> tuple[float, ...] | None:
    if corners is None or len(corners) == 0:
        return None
    hull = _hull(np.array([(p["x"], p["y"]) for p in corners], float))
    steps = np.roll(hull, -1, axis=0) - hull
    size = np.hypot(*steps.T)
    along = steps[size > 0] / size[size > 0, None] if (size > 0).any() else np.array([[1.0, 0.0]])
    u, v = hull @ along.T, hull @ np.stack([-along[:, 1], along[:, 0]])
    wide, high = np.ptp(u, axis=0), np.ptp(v, axis=0)
    k = int(np.argmin(wide * high))
    cu, cv = (u[:, k].max() + u[:, k].min()) / 2, (v[:, k].max() + v[:, k].min()) / 2
    axis = along[k] if wide[k] >= high[k] else np.array([-along[k, 1], along[k, 0]])
    centre = cu * along[k] + cv * np.array([-along[k, 1], along[k, 0]])
    covered = abs(float(hull[:, 0] @ np.roll(hull[:, 1], -1) - hull[:, 1] @ np.roll(hull[:, 0], -1))) / 2
    return max(wide[k], high[k]), min(wide[k], high[k]), covered, *centre, *axis


@F.pandas_udf(BOX)
def bounding_rectangle(rings: pd.Series) -> pd.DataFrame:
    """Smallest rectangle in any direction around each ring: sides, hull area, centre, direction of the long side."""
    rows = [_box(r) or (None,) * len(BOX) for r in rings]
    return pd.DataFrame(rows, columns=BOX.names, dtype=float)


def equal_area(ring: Column) -> Column:
    """A ring of (lon, lat) degrees in a plane (km) that keeps areas of the sphere."""
    return F.transform(ring, lambda p: F.struct((EARTH_KM * F.radians(p["x"])).alias("x"), (EARTH_KM * F.sin(F.radians(p["y"]))).alias("y")))


def _spans(ring: Column) -> Column:
    """Sides that aren't upright, from left to right: + 1 where the inside of a counter-clockwise ring is below."""

    def span(s: Column) -> Column:
        a, b = s["a"], s["b"]
        right = a["x"] < b["x"]
        return F.struct(
            F.when(right, a["x"]).otherwise(b["x"]).alias("l"), F.when(right, b["x"]).otherwise(a["x"]).alias("r"), F.when(right, a["y"]).otherwise(b["y"]).alias("y"),
            ((b["y"] - a["y"]) / F.when(a["x"] != b["x"], b["x"] - a["x"])).alias("k"), F.when(right, -1.0).otherwise(1.0).alias("up"),
        )

    return F.filter(F.transform(sides(ring), span), lambda s: s["l"] < s["r"])


def _below_both(e: Column, f: Column, base: Column) -> Column:
    """Area above `base` and below both sides, over the stretch of x that they share."""
    l, r = F.greatest(e["l"], f["l"]), F.least(e["r"], f["r"])
    at = lambda s, x: s["y"] + s["k"] * (x - s["l"])
    d0, d1 = at(e, l) - at(f, l), at(e, r) - at(f, r)
    level = (at(e, l) + at(f, l) + at(e, r) + at(f, r)) / 4 - base
    both = F.abs(d0) + F.abs(d1)
    # mean distance of the sides; they cross where the ends have different signs
    apart = F.when(d0 * d1 >= 0, both / 2).otherwise((d0 * d0 + d1 * d1) / (2 * both))
    return F.when(l < r, (r - l) * (level - apart / 2)).otherwise(0.0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def intersection_area(a: Column, b: Column) -> Column:
    """Area that two simple rings share, convex or not, in either direction.

    A ring is the signed sum of the strips below its sides, so the shared area is the signed sum over pairs of
    sides of the area below both: every pair of sides is looked at once. Null if a ring is; 0 without area, and
    below a billionth of the smaller ring, which is rounding.
    """
    low = lambda ring: F.array_min(F.transform(ring, lambda p: p["y"]))

    def shared(x: Column) -> Column:
        total = F.aggregate(x["a"], F.lit(0.0), lambda s, e: s + F.aggregate(x["b"], F.lit(0.0), lambda t, f: t + e["up"] * f["up"] * _below_both(e, f, x["base"])))
        return x["turns"] * total

    smaller = F.least(F.abs(area(a)), F.abs(area(b)))
    parts = F.struct(_spans(a).alias("a"), _spans(b).alias("b"), F.least(low(a), low(b)).alias("base"), (F.signum(area(a)) * F.signum(area(b))).alias("turns"))
    found = bound(F.struct(bound(parts, shared).alias("x"), smaller.alias("most")), lambda v: F.when(v["x"] <= 1e-9 * v["most"], 0.0).otherwise(F.least(v["x"], v["most"])))
    return F.when(a.isNotNull() & b.isNotNull(), found)


def union_area(a: Column, b: Column) -> Column:
    return F.abs(area(a)) + F.abs(area(b)) - intersection_area(a, b)


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether the boxes around two rings overlap."""
    end = lambda ring, c, f: f(F.transform(ring, lambda p: p[c]))
    return F.reduce(F.array(*(end(p, c, F.array_min) < end(q, c, F.array_max) for c in "xy" for p, q in ((a, b), (b, a)))), F.lit(True), lambda s, x: s & x)


def _half(axis: str, limit: float, above: bool) -> Callable[[Column], Column]:
    """Gives the part of a ring on one side of an axis-parallel line: kept corners and crossings, in order."""
    other = "y" if axis == "x" else "x"
    inside = lambda p: p[axis] >= limit if above else p[axis] <= limit

    def kept(s: Column) -> Column:
        a, b = s["a"], s["b"]
        cut = a[other] + (b[other] - a[other]) * (limit - a[axis]) / F.when(a[axis] != b[axis], b[axis] - a[axis])
        crossing = F.struct(*(F.lit(float(limit)).alias(c) if c == axis else cut.alias(c) for c in "xy"))
        start = F.struct(a["x"].alias("x"), a["y"].alias("y"))
        return F.filter(F.array(F.when(inside(a), start), F.when(inside(a) != inside(b), crossing)), lambda p: p.isNotNull())

    return lambda ring: F.flatten(F.transform(sides(ring), kept))


def clipped(ring: Column, west: float, south: float, east: float, north: float) -> Column:
    """The part of a ring in a box: an empty array if there is none. Parts of a ring that isn't convex stay joined along the box."""
    for axis, limit, above in (("x", west, True), ("x", east, False), ("y", south, True), ("y", north, False)):
        ring = bound(ring, _half(axis, limit, above))
    return ring
