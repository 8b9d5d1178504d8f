"""Polygons against points: land, shores and slicks. Polygon tables have (ring): an array of (x, y) in the local plane (km)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import spread
from ..functions import polygon


def _cells(low: Column, high: Column, cell_km: float) -> Column:
    return F.explode(F.sequence(F.floor(low / cell_km), F.floor(high / cell_km)))


def on_land(points: DataFrame, land: DataFrame, buffer_km: float, cell_km: float = 10.0) -> DataFrame:
    """Points (px, py) with `hit`: inside a polygon or within the buffer of its outline; false where there is no land.

    Each grid cell lists the polygons whose box, widened by the buffer, meets it, so a point looks at
    those of its own cell and keeps one row whatever it hits.
    """
    reach = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    near = land.filter(F.size("ring") > 2).withColumn("cx", _cells(reach("x", F.array_min) - buffer_km, reach("x", F.array_max) + buffer_km, cell_km))
    near = near.withColumn("cy", _cells(reach("y", F.array_min) - buffer_km, reach("y", F.array_max) + buffer_km, cell_km))
    near = near.groupBy("cx", "cy").agg(F.collect_list("ring").alias("rings"))
    x, y = F.col("px"), F.col("py")
    hit = F.exists("rings", lambda ring: polygon.contains(ring, x, y) | (polygon.edge_distance(ring, x, y) <= buffer_km))
    rows = points.withColumns({"cx": F.floor(x / cell_km), "cy": F.floor(y / cell_km)}).join(near, ["cx", "cy"], "left")
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("cx", "cy", "rings")


def beaching(hits: DataFrame, least: float = 0.01) -> DataFrame:
    """For each scene the first frame (tq) in which at least that share of the first frame's particles is ashore, and the last share."""
    frames = hits.groupBy("scene", "tq").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("ashore"), F.avg(F.when(F.col("hit"), F.col("px"))).alias("x"), F.avg(F.when(F.col("hit"), F.col("py"))).alias("y"))
    first = frames.groupBy("scene").agg(F.min_by("n", "tq").alias("n0"))
    rows = frames.join(first, "scene").withColumn("share", F.col("ashore") / F.greatest("n0", F.lit(1)))
    contact = F.min(F.when(F.col("share") >= least, F.struct("tq", "share", "x", "y")))
    found = rows.groupBy("scene").agg(contact.alias("c"), F.max_by("share", "tq").alias("share_end"), F.min("tq").alias("t0"))
    return found.select("scene", ((F.col("c.tq") - F.col("t0")) / 3600).alias("eta_h"), F.col("c.share").alias("share_at_contact"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), "share_end")


def outside_share(points: DataFrame, half_km: float) -> DataFrame:
    """For each scene the share of positions outside the square domain."""
    out = (F.abs("px") > half_km) | (F.abs("py") > half_km)
    return points.groupBy("scene").agg(F.avg(out.cast("double")).alias("outside"))


def sized_domain(points: DataFrame, half_km: float, grow: float = 1.6, most: float = 2.0, tolerance: float = 0.001) -> DataFrame:
    """Half size of each scene's domain: enlarged once, up to `most` times, if more positions than the tolerance leave it.

    `settled` tells whether the domain then holds the positions.
    """
    wide = half_km * min(grow, most)
    out = lambda h: F.avg(((F.abs("px") > h) | (F.abs("py") > h)).cast("double"))
    rows = points.groupBy("scene").agg(out(half_km).alias("a"), out(wide).alias("b"))
    kept = F.col("a") <= tolerance
    return rows.select("scene", F.when(kept, half_km).otherwise(wide).alias("half_km"), F.when(kept, F.col("a")).otherwise(F.col("b")).alias("outside"), (kept | (F.col("b") <= tolerance)).alias("settled"))


def described(shapes: DataFrame) -> DataFrame:
    """Rings with centroid, area, perimeter, elongation, compactness, solidity, length and width."""
    box, (x, y) = F.col("box"), polygon.centroid(F.col("ring"))
    size = F.abs(polygon.area(F.col("ring")))
    rows = spread(shapes).withColumn("box", polygon.bounding_rectangle("ring"))
    return rows.withColumns({
        "x": x, "y": y, "area_km2": size, "perimeter_km": polygon.perimeter(F.col("ring")), "length_km": box["length"], "width_km": box["width"],
        "elongation": box["length"] / F.greatest(box["width"], F.lit(1e-9)), "compactness": polygon.compactness(F.col("ring")), "solidity": size / F.greatest(box["hull_area"], F.lit(1e-9)),
    }).drop("box")


def trail_ends(pairs: DataFrame) -> DataFrame:
    """Pairs of a ring and a point (x, y) with the distance to the nearer end of the ring's long axis, and to the polygon."""
    rows = spread(pairs).withColumn("box", polygon.bounding_rectangle("ring"))
    box, half = F.col("box"), F.col("box.length") / 2
    end = lambda sign: F.hypot(F.col("x") - box["cx"] - sign * half * box["ux"], F.col("y") - box["cy"] - sign * half * box["uy"])
    return rows.withColumns({"end_km": F.least(end(1), end(-1)), "slick_km": polygon.distance(F.col("ring"), F.col("x"), F.col("y"))}).drop("box")


def attached_vessels(slicks: DataFrame, matches: DataFrame, link_km: float) -> DataFrame:
    """Vessels (scene, mmsi) whose matched detection (x, y) lies within the distance of the scene's slick; slicks have one row a scene."""
    d = polygon.distance(F.col("ring"), F.col("x"), F.col("y"))
    near = matches.join(slicks.select("scene", "ring"), "scene").withColumn("target_km", d).filter(F.col("target_km") <= link_km)
    return near.groupBy("scene", "mmsi").agg(F.min("target_km").alias("target_km"))


def _crossed_cells(rows: DataFrame, cell_km: float) -> DataFrame:
    """Segments (x1, y1, x2, y2) once for each grid cell (cx, cy) they cross: by columns, then by their rows in each."""
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    rows = rows.withColumn("cx", F.explode(F.sequence(F.floor(left / cell_km), F.floor(right / cell_km))))
    slope = (F.col("y2") - F.col("y1")) / F.when(F.col("x1") != F.col("x2"), F.col("x2") - F.col("x1"))
    at = lambda x: F.coalesce(F.col("y1") + slope * (x - F.col("x1")), F.col("y1"))
    a, b = at(F.greatest(left, F.col("cx") * cell_km)), at(F.least(right, (F.col("cx") + 1) * cell_km))
    upright = F.col("x1") == F.col("x2")
    low = F.when(upright, F.least("y1", "y2")).otherwise(F.least(a, b)) - 1e-9
    high = F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest(a, b)) + 1e-9
    return rows.withColumn("cy", F.explode(F.sequence(F.floor(low / cell_km), F.floor(high / cell_km))))


def landfall(rays: DataFrame, land: DataFrame, max_km: float = 400.0, cell_km: float = 10.0) -> DataFrame:
    """Where each ray (id, px, py, bearing_deg, speed_kmh) first meets land, within `max_km`: distance, place, hours.

    A ray is listed in the cells it crosses, a shore side in those it crosses, and those of one cell are
    intersected exactly. A ray that begins on land has distance 0; one without landfall has nulls; without
    speed there is no time. Ids are unique.
    """
    turn = F.radians("bearing_deg")
    ends = rays.select("id", F.col("px").alias("x1"), F.col("py").alias("y1"), (F.col("px") + max_km * F.sin(turn)).alias("x2"), (F.col("py") + max_km * F.cos(turn)).alias("y2"))
    shore = land.select(F.explode(polygon.sides(F.col("ring"))).alias("s")).select(*(F.col(f"s.{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in "xy"))
    shore = _crossed_cells(shore, cell_km).select("cx", "cy", *(F.col(c).alias(f"s{c}") for c in ("x1", "y1", "x2", "y2")))
    rows = _crossed_cells(ends, cell_km).join(shore, ["cx", "cy"])
    dx, dy, ex, ey = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("sx2") - F.col("sx1"), F.col("sy2") - F.col("sy1")
    wx, wy = F.col("sx1") - F.col("x1"), F.col("sy1") - F.col("y1")
    cross = dx * ey - dy * ex
    along, beside = (wx * ey - wy * ex) / F.when(cross != 0, cross), (wx * dy - wy * dx) / F.when(cross != 0, cross)
    met = rows.withColumns({"along": along, "beside": beside}).filter("along between 0 and 1 and beside between 0 and 1")
    first = met.groupBy("id").agg((F.min("along") * max_km).alias("shore_km"))
    ashore = on_land(rays.select("id", "px", "py"), land, 0.0, cell_km).select("id", "hit")
    d = F.when(F.col("hit"), 0.0).otherwise(F.col("shore_km"))
    out = rays.join(ashore, "id").join(first, "id", "left").withColumn("landfall_km", d)
    eta = F.when(F.col("speed_kmh") > 0, F.col("landfall_km") / F.col("speed_kmh"))
    return out.select("id", "landfall_km", (F.col("px") + F.col("landfall_km") * F.sin(turn)).alias("x"), (F.col("py") + F.col("landfall_km") * F.cos(turn)).alias("y"), eta.alias("eta_h"))


def extrapolated_landfall(points: DataFrame, land: DataFrame, max_km: float = 400.0) -> DataFrame:
    """For each scene of a drifting cloud (scene, tq, px, py): its last centre, the speed and course between its first
    and last frame, and where it would reach land going on like that, in hours after the last frame."""
    frames = points.groupBy("scene", "tq").agg(F.avg("px").alias("px"), F.avg("py").alias("py"))
    at = frames.groupBy("scene").agg(F.min_by(F.struct("tq", "px", "py"), "tq").alias("a"), F.max_by(F.struct("tq", "px", "py"), "tq").alias("b"))
    dx, dy = F.col("b.px") - F.col("a.px"), F.col("b.py") - F.col("a.py")
    hours = (F.col("b.tq") - F.col("a.tq")) / 3600
    rays = at.select(F.col("scene").alias("id"), F.col("b.px").alias("px"), F.col("b.py").alias("py"), F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)).alias("bearing_deg"), F.when(hours > 0, F.hypot(dx, dy) / hours).otherwise(0.0).alias("speed_kmh"))
    found = landfall(rays, land, max_km)
    return rays.select(F.col("id"), "bearing_deg", "speed_kmh").join(found, "id").withColumnRenamed("id", "scene")
