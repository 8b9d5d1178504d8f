"""Rasters to a longitude-latitude grid by control points: a second-order polynomial a scene, then a gather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import written

TERMS = 6
#: Pixels of the largest grid that is accepted.
MOST_PIXELS = 60_000_000


def _terms(x: Column, y: Column) -> list[Column]:
    return [F.lit(1.0), x, y, x * y, x * x, y * y]


def fitted(points: DataFrame) -> DataFrame:
    """Control points (scene, row, col, lon, lat) -> a row a scene: the polynomials that give row and col of a place.

    `scene, n, lon0, lat0, span, row_k, col_k`: least squares in (lon - lon0) / span and (lat - lat0) / span. Spark adds
    up the normal equations, one row a scene; what is solved is a 6 x 6 system a scene, many at once. Scenes whose
    points don't settle all six terms (fewer than six, or on a line) have null coefficients.
    """
    whole = points.filter("row is not null and col is not null and lon is not null and lat is not null")
    middle = whole.groupBy("scene").agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"), F.greatest(F.max("lon") - F.min("lon"), F.max("lat") - F.min("lat"), F.lit(1e-9)).alias("span"))
    rows = whole.join(middle.hint("merge"), "scene").withColumns({"x": (F.col("lon") - F.col("lon0")) / F.col("span"), "y": (F.col("lat") - F.col("lat0")) / F.col("span")})
    rows = rows.select("scene", "lon0", "lat0", "span", "row", "col", *(t.alias(f"t{i}") for i, t in enumerate(_terms(F.col("x"), F.col("y")))))
    squares = [F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i in range(TERMS) for j in range(TERMS)]
    sides = [F.sum(F.col(f"t{i}") * F.col(c)) for c in ("row", "col") for i in range(TERMS)]
    sums = rows.groupBy("scene", "lon0", "lat0", "span").agg(F.count(F.lit(1)).alias("n"), F.array(*squares).alias("a"), F.array(*sides).alias("b"))
    kinds = sums.select("scene").schema["scene"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("a").flatten().to_numpy().reshape(-1, TERMS, TERMS)
            b = batch.column("b").flatten().to_numpy().reshape(-1, 2, TERMS).transpose(0, 2, 1)
            sure = np.linalg.matrix_rank(a, tol=1e-10 * np.abs(a).max(axis=(1, 2), initial=1)) == TERMS if len(a) else np.zeros(0, bool)
            found = np.linalg.solve(np.where(sure[:, None, None], a, np.eye(TERMS)), b)
            lists = [pa.array([x.tolist() if s else None for x, s in zip(found[:, :, k], sure, strict=True)], pa.list_(pa.float64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scene", "n", "lon0", "lat0", "span")), *lists], ["scene", "n", "lon0", "lat0", "span", "row_k", "col_k"])

    return sums.mapInArrow(run, f"scene {kinds}, n long, lon0 double, lat0 double, span double, row_k array<double>, col_k array<double>")


def _placed(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(row, col) of a place by the fit's columns."""
    terms = _terms((lon - F.col("lon0")) / F.col("span"), (lat - F.col("lat0")) / F.col("span"))
    value = lambda k: sum((F.get(k, F.lit(i)) * t for i, t in enumerate(terms)), F.lit(0.0))
    return value("row_k"), value("col_k")


def residuals(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Points with their distance in pixels from where the fit puts them: row_off, col_off."""
    row, col = _placed(F.col("lon"), F.col("lat"))
    return points.join(fits.hint("merge"), "scene").withColumns({"row_off": row - F.col("row"), "col_off": col - F.col("col")}).select(*points.columns, "row_off", "col_off")


def gridded(areas: DataFrame, pixel_m: float) -> DataFrame:
    """Areas (scene, w, s, e, n) with the width and height of a grid of such pixels; `accepted` is false for empty
    areas and grids over the limit, which no one should resample."""
    mid = F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    rows = areas.withColumns({"width": F.round((F.col("e") - F.col("w")) * 111320.0 * mid / pixel_m).cast("long"), "height": F.round((F.col("n") - F.col("s")) * 111320.0 / pixel_m).cast("long")})
    size = F.col("width") * F.col("height")
    return rows.withColumn("accepted", (F.col("width") > 0) & (F.col("height") > 0) & (size <= MOST_PIXELS))


def resampled(pixels: DataFrame, fits: DataFrame, grids: DataFrame, nodata: float = 0.0) -> DataFrame:
    """Pixels (scene, r, c, v) on the accepted grids (scene, w, s, e, n, width, height, accepted): scene, gr, gc, v.

    For the centre of each pixel of a grid the fit gives a place in the scene, and the four pixels around it meet
    in a join; their mean is weighted by nearness. Missing pixels and `nodata` don't count; without any there is no row.
    """
    rows = grids.filter("accepted").join(fits.filter("row_k is not null").drop("n").hint("merge"), "scene")  # n is a grid's north
    rows = rows.withColumn("gr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1))).repartition("scene", "gr")
    rows = rows.withColumn("gc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))
    lon = F.col("w") + (F.col("gc") + 0.5) * (F.col("e") - F.col("w")) / F.col("width")
    lat = F.col("n") - (F.col("gr") + 0.5) * (F.col("n") - F.col("s")) / F.col("height")
    row, col = _placed(lon, lat)
    # control points count from the corner of the first pixel, pixels from its centre
    at = rows.select("scene", "gr", "gc", (row - 0.5).alias("y"), (col - 0.5).alias("x"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    at = at.withColumn("k", corner).withColumns({"r": (F.floor("y") + F.col("k.i")).cast("int"), "c": (F.floor("x") + F.col("k.j")).cast("int")})
    near = lambda p, i: F.when(F.col(i) == 1, F.col(p) - F.floor(p)).otherwise(1 - F.col(p) + F.floor(p))
    at = at.select("scene", "gr", "gc", "r", "c", (near("y", "k.i") * near("x", "k.j")).alias("weight")).filter("weight > 1e-9")
    there = pixels.select("scene", "r", "c", "v").filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") != nodata))
    met = at.join(there.hint("merge"), ["scene", "r", "c"]).groupBy("scene", "gr", "gc")
    return met.agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))


def warped(pixels: DataFrame, points: DataFrame, areas: DataFrame, pixel_m: float) -> DataFrame:
    """The whole way: control points to a fit, areas to grids, pixels to the grids."""
    return resampled(pixels, written(fitted(points), "fits"), gridded(areas, pixel_m))
