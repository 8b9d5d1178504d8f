"""Space-time joins of vessels with a particle cloud and source regions.

A range predicate would be planned as a nested loop; both sides are put in cells of the search radius
instead and meet in an equi-join on time and cell, where the vessel looks into the nine cells around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import polygon
from ..functions.geo import plane_km
from .sightings import one_to_one


def in_plane(positions: DataFrame, lat0: float, lon0: float) -> DataFrame:
    x, y = plane_km(F.col("lat"), F.col("lon"), lat0, lon0)
    return positions.withColumns({"x": x, "y": y})


def _pairs(positions: DataFrame, cloud: DataFrame, radius_km: float) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / radius_km)
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy"))))))
    asked = positions.withColumn("cell", around).select("mmsi", "tq", "x", "y", "cell.cx", "cell.cy")
    held = cloud.select("tq", "px", "py", cell("px").alias("cx"), cell("py").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2)))
    return asked.join(held, ["tq", "cx", "cy"]).withColumn("d_km", d).filter(F.col("d_km") <= radius_km)


def nearest_particles(positions: DataFrame, cloud: DataFrame, radius_km: float) -> DataFrame:
    """(mmsi, tq, d_km, n_near, fraction): nearest particle and share of the cloud within the radius."""
    sizes = cloud.groupBy("tq").agg(F.count(F.lit(1)).alias("n"))
    found = _pairs(positions, cloud, radius_km).groupBy("mmsi", "tq").agg(F.min("d_km").alias("d_km"), F.count(F.lit(1)).alias("n_near"))
    return found.join(sizes, "tq").select("mmsi", "tq", "d_km", "n_near", (F.col("n_near") / F.col("n")).alias("fraction"))


def region_distances(positions: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """(mmsi, tq, d_region_km) to a polygon of tens of corners: 0 inside, by ray parity.

    The outline is a constant that each row folds, so no row is copied and nothing is exchanged.
    """
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners))
    return positions.select("mmsi", "tq", polygon.distance(ring, F.col("x"), F.col("y")).alias("d_region_km"))


def candidates(nearest: DataFrame, regions: DataFrame, corridor_km: float = 10.0, source_km: float = 20.0) -> DataFrame:
    """Best of each vessel over time, and whether it is near enough to the source or the drifting oil."""
    best = nearest.groupBy("mmsi").agg(F.min("d_km").alias("min_d_st_km"), F.min_by("tq", F.struct("d_km", "tq")).alias("t_best_st"), F.max("fraction").alias("max_fraction"))
    source = regions.groupBy("mmsi").agg(F.min("d_region_km").alias("min_d_region_km"), F.min_by("tq", F.struct("d_region_km", "tq")).alias("t_best_region"))
    rows = source.join(best, "mmsi", "left")
    near = (F.col("min_d_region_km") <= source_km) | F.coalesce(F.col("min_d_st_km") <= corridor_km, F.lit(False))
    reason = F.when(near, "candidate").otherwise(F.concat(F.lit("never within "), F.lit(f"{source_km:g} km of the source or {corridor_km:g} km of the oil")))
    return rows.withColumns({"candidate": near, "reason": reason})


def cloud_at(cloud: DataFrame, times: DataFrame, step_s: float) -> DataFrame:
    """Particles at arbitrary times between regular outputs: an equi-join with the step before and after."""
    a = times.withColumn("k", F.floor(F.col("tq") / step_s) * step_s)
    now = cloud.select(F.col("tq").alias("k"), "pid", F.col("px").alias("x0"), F.col("py").alias("y0"))
    then = cloud.select((F.col("tq") - step_s).alias("k"), "pid", F.col("px").alias("x1"), F.col("py").alias("y1"))
    w = (F.col("tq") - F.col("k")) / step_s
    rows = a.join(now, "k").join(then, ["k", "pid"], "left")
    lerp = lambda p, q: F.col(p) + w * (F.coalesce(F.col(q), F.col(p)) - F.col(p))
    return rows.select("tq", "pid", lerp("x0", "x1").alias("px"), lerp("y0", "y1").alias("py"))


def nearest_frame(queries: DataFrame, start: float, step_s: float, steps: int) -> DataFrame:
    """Regular output frame nearest to each time, the earlier one on ties: arithmetic instead of a join."""
    i = F.ceil((F.col("tq") - start) / step_s - 0.5)
    return queries.withColumn("frame", F.greatest(F.lit(0), F.least(F.lit(steps - 1), i)).cast("int"))


def greedy_pairs(detections: DataFrame, positions: DataFrame, radius_km: float) -> DataFrame:
    """One-to-one pairs (scene, det_id, mmsi, d_km): detections in order take the nearest free vessel.

    Candidates within the radius come from a cell join and are settled in rounds.
    """
    cell = lambda c: F.floor(F.col(c) / radius_km)
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((cell("dx") + i).alias("cx"), (cell("dy") + j).alias("cy"))))))
    asked = detections.withColumn("cell", around).select("scene", "det_id", "dx", "dy", "cell.cx", "cell.cy")
    held = positions.select("scene", "mmsi", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("dx"), F.lit(2)) + F.pow(F.col("y") - F.col("dy"), F.lit(2)))
    pairs = asked.join(held, ["scene", "cx", "cy"]).withColumn("d_km", d).filter(F.col("d_km") <= radius_km).select("scene", "det_id", "mmsi", "d_km")
    return one_to_one(pairs)
