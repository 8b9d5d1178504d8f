"""Scenes, grids, fields and samples: catalogue search, georeference, tiles, forcing, calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import spread


def found_scenes(scenes: DataFrame, bbox: tuple[float, float, float, float], mode: str = "IW", polarisation: str = "VV") -> DataFrame:
    """Scenes (scene, t, mode, polarisations, w, s, e, n) that touch the box, newest first, with the share of it they cover."""
    w, s, e, n = bbox
    wide = F.greatest(F.lit(0.0), F.least(F.col("e"), F.lit(e)) - F.greatest(F.col("w"), F.lit(w)))
    high = F.greatest(F.lit(0.0), F.least(F.col("n"), F.lit(n)) - F.greatest(F.col("s"), F.lit(s)))
    rows = scenes.filter((F.col("mode") == mode) & F.array_contains("polarisations", polarisation))
    return rows.withColumn("coverage", wide * high / ((e - w) * (n - s))).filter("coverage > 0").select("scene", "t", "coverage").orderBy(F.desc("t"), "scene")


def clipped(requests: DataFrame) -> DataFrame:
    """Requests (rid, w, s, e, n) against scene bounds (fw, fs, fe, fn): under 5 % an error, over 95 % as asked, else the overlap."""
    lo = {k: F.greatest(F.col(k), F.col(f"f{k}")) for k in ("w", "s")}
    hi = {k: F.least(F.col(k), F.col(f"f{k}")) for k in ("e", "n")}
    share = F.greatest(F.lit(0.0), hi["e"] - lo["w"]) * F.greatest(F.lit(0.0), hi["n"] - lo["s"]) / ((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")))
    rows = requests.withColumn("share", share)
    verdict = F.when(F.col("share") < 0.05, "outside").when(F.col("share") > 0.95, "whole").otherwise("clipped")
    return rows.withColumns({"verdict": verdict, **{f"o{k}": F.when(verdict == "clipped", v).otherwise(F.col(k)) for k, v in (lo | hi).items()}}).select("rid", "share", "verdict", "ow", "os", "oe", "on")


def georeferenced(images: DataFrame) -> DataFrame:
    """Affine of images (image, width, height, w, s, e, n): pixel sizes in degrees and metres, and grid size at 10 m."""
    mid = F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    dx, dy = (F.col("e") - F.col("w")) / F.col("width"), (F.col("n") - F.col("s")) / F.col("height")
    rows = images.filter("w < e and s < n and w >= -180 and e <= 180 and s >= -90 and n <= 90")
    metres = (dx * 111320.0 * mid + dy * 111320.0) / 2
    size = lambda span, k: F.ceil(span * 111320.0 * k / 10.0)
    return rows.select("image", dx.alias("dx"), (-dy).alias("dy"), metres.alias("pixel_m"), size(F.col("e") - F.col("w"), mid).alias("columns"), size(F.col("n") - F.col("s"), F.lit(1.0)).alias("rows"))


def release_offsets(offsets: Column, least: Column) -> Column:
    """Offsets of at least `least` hours; all of them if none is."""
    kept = F.filter(offsets, lambda h: h >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(offsets)


def drift_reach(speeds: DataFrame, cap: float = 0.5) -> DataFrame:
    """Reach in degrees a day of each area from its 95th percentile speed: at least 0.15, at most `cap`."""
    return speeds.groupBy("area").agg(F.percentile("speed", 0.95).alias("p95")).select("area", "p95", F.least(F.lit(cap), F.greatest(F.lit(0.15), 1.3 * F.col("p95"))).alias("reach"))


def forcing(spark, hours: int, nx: int, ny: int) -> DataFrame:
    """A synthetic field (it, iy, ix, u, v): a mean flow, a meander, a half-daily tide and a daily wind, in closed form."""
    n = F.col("id")
    cells = spark.range(hours * ny * nx).select(F.floor(n / (nx * ny)).cast("int").alias("it"), (F.floor(n / nx) % ny).cast("int").alias("iy"), (n % nx).cast("int").alias("ix"))
    tide, day = F.sin(F.col("it") * (2 * math.pi / 12.42)), F.sin(F.col("it") * (2 * math.pi / 24))
    u = 0.3 + 0.1 * F.sin(F.col("ix") * 0.5 + F.col("iy") * 0.25) + 0.15 * tide
    v = -0.1 + 0.1 * F.cos(F.col("iy") * 0.5) + 0.05 * day
    return cells.select("it", "iy", "ix", u.alias("u"), v.alias("v"))


def merged_tiles(scores: DataFrame, size: int) -> DataFrame:
    """Overlapping tile scores (scene, r, c, tr, tc, z) to one a pixel: Hann-weighted mean, then sigmoid."""
    hann = lambda i: F.greatest(F.lit(1e-3), 0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1)))
    w = hann(F.col("r") - F.col("tr")) * hann(F.col("c") - F.col("tc"))
    rows = scores.groupBy("scene", "r", "c").agg((F.sum(w * F.col("z")) / F.sum(w)).alias("z"))
    return rows.select("scene", "r", "c", (1 / (1 + F.exp(-F.col("z")))).alias("probability"))


def best_settings(trials: DataFrame, penalty: float = 4.0) -> DataFrame:
    """Of each scene the setting with the largest recall less `penalty` times the false-positive share."""
    value = F.col("recall") - penalty * F.col("false_positive")
    return trials.groupBy("scene").agg(F.min_by(F.struct("setting", "recall", "false_positive"), F.struct(-F.round(value, 9), F.col("setting"))).alias("b")).select("scene", "b.*")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows by a seeded hash of the key: the same on every run and partitioning."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def points_within(rings: DataFrame, per_ring: int) -> DataFrame:
    """Evenly spread points inside rings (ring, corners: array of x, y): a low-discrepancy sequence over each box, kept by ray parity."""
    box = lambda f, k: f(F.transform("corners", lambda p: p[k]))
    rows = spread(rings).withColumns({"x0": box(F.array_min, "x"), "x1": box(F.array_max, "x"), "y0": box(F.array_min, "y"), "y1": box(F.array_max, "y")})
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_ring))))
    part = lambda k: F.col("i") * k - F.floor(F.col("i") * k)
    rows = rows.withColumns({"x": F.col("x0") + part(0.7548776662466927) * (F.col("x1") - F.col("x0")), "y": F.col("y0") + part(0.5698402909980532) * (F.col("y1") - F.col("y0"))})
    n = F.size("corners")
    crosses = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ((F.get("corners", k)["y"] > F.col("y")) != (F.get("corners", (k + 1) % n)["y"] > F.col("y"))) & (F.col("x") < (F.get("corners", (k + 1) % n)["x"] - F.get("corners", k)["x"]) * (F.col("y") - F.get("corners", k)["y"]) / (F.get("corners", (k + 1) % n)["y"] - F.get("corners", k)["y"]) + F.get("corners", k)["x"]))
    return rows.filter(F.size(crosses) % 2 == 1).select("ring", "i", "x", "y")


def with_nearest_target(components: DataFrame, targets: DataFrame, link_km: float = 1.0) -> DataFrame:
    """Nearest target (scene, x, y) of each component's box (scene, component_id, x0, y0, x1, y1) within three link distances.

    Boxes and targets meet in cells of the padded size, then by exact distance to the box; equal boxes, and equal targets,
    meet once.
    """
    pad = 3 * link_km
    cell = 4 * pad
    span = lambda a, b: F.sequence(F.floor((F.col(a) - pad) / cell), F.floor((F.col(b) + pad) / cell))
    keys = ["scene", "x0", "y0", "x1", "y1"]
    boxes = components.select(*keys).distinct().withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    points = targets.select("scene", "x", "y").distinct().withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    away = lambda p, a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(p), F.col(p) - F.col(b))
    rows = boxes.join(points.hint("merge"), ["scene", "cx", "cy"]).withColumn("target_km", F.sqrt(F.pow(away("x", "x0", "x1"), F.lit(2)) + F.pow(away("y", "y0", "y1"), F.lit(2))))
    best = rows.filter(F.col("target_km") <= pad).groupBy(*keys).agg(F.min("target_km").alias("target_km"))
    return components.join(best.hint("merge"), keys, "left").select("scene", "component_id", "target_km")
