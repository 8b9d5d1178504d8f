"""From pixels to ranked slicks, each step on what the one before computed: labels, contrast, outline, shape, target, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import written
from ..functions import polygon
from . import land, outlines, raster, scoring


def outer_rings(labels: DataFrame, pixel_km: float) -> DataFrame:
    """(scene, component_id, ring): the largest outline of each component, corners in km, x to the right and y up.

    A component's outline is one row, as long as its outline; the scene bounds it.
    """
    sides = outlines.traced(labels)
    corner = F.struct("seq", (F.col("c") * pixel_km).alias("x"), (-F.col("r") * pixel_km).alias("y"))
    rings = sides.groupBy("scene", "label", "ring").agg(F.array_sort(F.collect_list(corner)).alias("all"))
    rings = rings.select("scene", F.col("label").alias("component_id"), "ring", F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("corners"))
    size = F.struct(F.abs(polygon.area(F.col("corners"))), F.col("ring"))
    return rings.groupBy("scene", "component_id").agg(F.max_by("corners", size).alias("ring"))


def nearest_targets(shapes: DataFrame, targets: DataFrame, link_km: float) -> DataFrame:
    """(scene, component_id, target_km, end_km): the target (scene, x, y) nearest to each ring, and how far it is from
    the nearer end of the ring's long axis. Targets farther than three link distances from a ring's box don't count;
    of equally near ones the first by place does.
    """
    pad, cell = 3 * link_km, 12 * link_km
    end = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    boxes = shapes.select("scene", "component_id", "ring", *((end(c, f) + s * pad).alias(f"{c}{i}") for c in "xy" for i, f, s in ((0, F.array_min, -1), (1, F.array_max, 1))))
    for c in "xy":
        boxes = boxes.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell))))
    points = targets.select("scene", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    pairs = boxes.join(points.hint("merge"), ["scene", "cx", "cy"]).filter("x between x0 and x1 and y between y0 and y1").select("scene", "component_id", "ring", "x", "y")
    best = land.trail_ends(pairs).groupBy("scene", "component_id").agg(F.min(F.struct("slick_km", "x", "y", "end_km")).alias("n"))
    return best.select("scene", "component_id", F.col("n.slick_km").alias("target_km"), F.col("n.end_km").alias("end_km"))


def described_slicks(pixels: DataFrame, targets: DataFrame, pixel_km: float, db_per_level: float, link_km: float = 1.0) -> DataFrame:
    """Dark components of pixels (scene, r, c, v, m, sea, probability) with what triage asks: contrast against the sea
    around, elongation, solidity, length and area of the outline, nearest target, mean probability.

    targets: scene, x, y in km, as `outer_rings` counts them. Pixels with m = 1 are dark; components touch along sides.
    """
    labels = written(raster.labelled(pixels, eight=False), "labels")
    contrast = outlines.band_contrast(labels, pixels, 3, 10, db_per_level).withColumnRenamed("label", "component_id")
    rings = written(outer_rings(labels, pixel_km), "rings")
    shapes = land.described(rings).select("scene", "component_id", "elongation", "solidity", "length_km", "area_km2")
    sure = labels.join(pixels.hint("merge"), ["scene", "r", "c"]).groupBy("scene", F.col("label").alias("component_id")).agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("probability").alias("probability"))
    keys = ["scene", "component_id"]
    return shapes.join(contrast.hint("merge"), keys).join(sure.hint("merge"), keys).join(nearest_targets(rings, targets, link_km).hint("merge"), keys, "left")


def triaged(pixels: DataFrame, targets: DataFrame, pixel_km: float, db_per_level: float, wind_ms: float | None, link_km: float = 1.0) -> DataFrame:
    """The whole chain: components with label, points, score and rank in their scene."""
    return scoring.triage(written(described_slicks(pixels, targets, pixel_km, db_per_level, link_km), "slicks"), wind_ms)
