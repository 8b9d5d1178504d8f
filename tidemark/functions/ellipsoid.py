"""Distances, azimuths and local projections on the WGS84 ellipsoid, as column functions.

Distance and azimuth come from the iteration on the auxiliary sphere (Vincenty 1975), a fixed number of steps, which
settles far below a millimetre up to some 19,900 km; nearly antipodal points don't settle and give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .polygon import bound

#: WGS84: half axis (m) and flattening.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR = AXIS * (1 - FLATTENING)
STEPS = 12


def _series(square: Column) -> tuple[Column, Column]:
    a = 1 + square / 16384 * (4096 + square * (-768 + square * (320 - 175 * square)))
    b = square / 1024 * (256 + square * (-128 + square * (74 - 47 * square)))
    return a, b


def _correction(b: Column, sin: Column, cos: Column, middle: Column) -> Column:
    inner = cos * (-1 + 2 * middle * middle) - b / 6 * middle * (-3 + 4 * sin * sin) * (-3 + 4 * middle * middle)
    return b * sin * (middle + b / 4 * inner)


def _reduced(lat: Column) -> Column:
    return F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))


def inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """struct(metres, azimuth): from the first point to the second; azimuth 0 to 360, 0 between equal points."""
    fixed = F.struct(_reduced(lat1).alias("u"), _reduced(lat2).alias("v"), F.radians(lon2 - lon1).alias("l"))

    def solve(p: Column) -> Column:
        su, cu, sv, cv = F.sin(p["u"]), F.cos(p["u"]), F.sin(p["v"]), F.cos(p["v"])

        def state(lam: Column) -> Column:
            """What follows from a longitude on the sphere."""
            x, y = cv * F.sin(lam), cu * sv - su * cv * F.cos(lam)
            sin, cos = F.hypot(x, y), su * sv + cu * cv * F.cos(lam)
            alpha = F.when(sin != 0, cu * cv * F.sin(lam) / sin).otherwise(0.0)

            def rest(q: Column) -> Column:
                flat = 1 - q["alpha"] * q["alpha"]
                middle = F.when(flat > 1e-14, q["cos"] - 2 * su * sv / flat).otherwise(0.0)
                c = FLATTENING / 16 * flat * (4 + FLATTENING * (4 - 3 * flat))
                return F.struct(q["lam"].alias("lam"), q["x"].alias("x"), q["y"].alias("y"), q["sin"].alias("sin"), q["cos"].alias("cos"), q["sigma"].alias("sigma"), q["alpha"].alias("alpha"), flat.alias("flat"), middle.alias("middle"), c.alias("c"))

            return bound(F.struct(lam.alias("lam"), x.alias("x"), y.alias("y"), sin.alias("sin"), cos.alias("cos"), F.atan2(sin, cos).alias("sigma"), alpha.alias("alpha")), rest)

        def step(s: Column, _: Column) -> Column:
            more = s["sigma"] + s["c"] * s["sin"] * (s["middle"] + s["c"] * s["cos"] * (-1 + 2 * s["middle"] * s["middle"]))
            return bound(p["l"] + (1 - s["c"]) * FLATTENING * s["alpha"] * more, state)

        def length(s: Column) -> Column:
            a, b = _series(s["flat"] * (AXIS * AXIS - MINOR * MINOR) / (MINOR * MINOR))
            metres = MINOR * a * (s["sigma"] - _correction(b, s["sin"], s["cos"], s["middle"]))
            again = p["l"] + (1 - s["c"]) * FLATTENING * s["alpha"] * (s["sigma"] + s["c"] * s["sin"] * (s["middle"] + s["c"] * s["cos"] * (-1 + 2 * s["middle"] * s["middle"])))
            settled = F.abs(again - s["lam"]) < 1e-11
            azimuth = F.pmod(F.degrees(F.atan2(s["x"], s["y"])) + 360, F.lit(360.0))
            return F.when(settled, F.struct(metres.alias("metres"), azimuth.alias("azimuth")))

        return bound(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), bound(p["l"], state), step), length)

    return bound(fixed, solve)


def forward(lon: Column, lat: Column, azimuth: Column, metres: Column) -> Column:
    """struct(lon, lat): where one gets from a point in a direction; longitude from -180 to 180."""
    fixed = F.struct(_reduced(lat).alias("u"), F.radians(azimuth).alias("az"), metres.cast("double").alias("s"), lon.cast("double").alias("lon"))

    def solve(p: Column) -> Column:
        su, cu = F.sin(p["u"]), F.cos(p["u"])
        alpha = cu * F.sin(p["az"])
        flat = 1 - alpha * alpha
        a, b = _series(flat * (AXIS * AXIS - MINOR * MINOR) / (MINOR * MINOR))
        start = F.struct((p["s"] / (MINOR * a)).alias("plain"), b.alias("b"), F.atan2(F.tan(p["u"]), F.cos(p["az"])).alias("near"), alpha.alias("alpha"), flat.alias("flat"))

        def rest(q: Column) -> Column:
            step = lambda s, _: q["plain"] + _correction(q["b"], F.sin(s), F.cos(s), F.cos(2 * q["near"] + s))
            sigma = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), q["plain"], step)

            def end(s: Column) -> Column:
                sin, cos, middle = F.sin(s), F.cos(s), F.cos(2 * q["near"] + s)
                across = su * sin - cu * cos * F.cos(p["az"])
                to = F.atan2(su * cos + cu * sin * F.cos(p["az"]), (1 - FLATTENING) * F.hypot(q["alpha"], across))
                lam = F.atan2(sin * F.sin(p["az"]), cu * cos - su * sin * F.cos(p["az"]))
                c = FLATTENING / 16 * q["flat"] * (4 + FLATTENING * (4 - 3 * q["flat"]))
                off = lam - (1 - c) * FLATTENING * q["alpha"] * (s + c * sin * (middle + c * cos * (-1 + 2 * middle * middle)))
                return F.struct((F.pmod(p["lon"] + F.degrees(off) + 540, F.lit(360.0)) - 180).alias("lon"), F.degrees(to).alias("lat"))

            return bound(sigma, end)

        return bound(start, rest)

    return bound(fixed, solve)


def to_plane(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """struct(x, y) in metres of the azimuthal equidistant projection around (lon0, lat0)."""
    return bound(inverse(lon0, lat0, lon, lat), lambda g: F.struct((g["metres"] * F.sin(F.radians(g["azimuth"]))).alias("x"), (g["metres"] * F.cos(F.radians(g["azimuth"]))).alias("y")))


def from_plane(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    """struct(lon, lat) of a place in that projection."""
    return forward(lon0, lat0, F.degrees(F.atan2(x, y)), F.hypot(x, y))


def affine(terms: Column, row: Column, col: Column, centre: bool = True) -> tuple[Column, Column]:
    """(x, y) of a pixel's centre, or its first corner, by six terms (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    k = 0.5 if centre else 0.0
    t = lambda i: F.get(terms, F.lit(i))
    return t(0) * (col + k) + t(1) * (row + k) + t(2), t(3) * (col + k) + t(4) * (row + k) + t(5)
