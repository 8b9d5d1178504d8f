"""Where oil goes and what it meets: ports ahead, places, sites, severity, actions, manifests, comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import spread
from ..functions.domain import SEVERITY_WEIGHTS, basin, basins_connect, clamp, persistence, response_tier, severity_level, weighted
from ..functions.geo import bearing_deg, haversine_km, plane_distance_bearing


def last_leg(fixes: DataFrame) -> DataFrame:
    """Last fix of each vessel with course and speed since the latest fix an hour and a kilometre before it, else the first."""
    w = Window.partitionBy("mmsi")
    rows = fixes.withColumns({"t1": F.max("t").over(w), "at": F.max_by(F.struct("lat", "lon"), "t").over(w)})
    d, b = plane_distance_bearing(F.col("lon"), F.col("lat"), F.col("at.lon"), F.col("at.lat"))
    rows = rows.withColumns({"d": d, "b": b}).filter("t < t1")
    far = (F.col("t1") - F.col("t") >= 3600) & (F.col("d") >= 1)
    start = F.coalesce(F.max_by(F.struct("t", "d", "b"), F.when(far, F.col("t"))), F.min_by(F.struct("t", "d", "b"), F.col("t")))
    out = rows.groupBy("mmsi", "t1", "at").agg(start.alias("s"))
    return out.select("mmsi", F.col("t1").alias("t"), F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), F.col("s.b").alias("course_deg"), (F.col("s.d") / ((F.col("t1") - F.col("s.t")) / 3600) / 1.852).alias("speed_kn"))


#: Places of a list that every row is compared with; longer ones need a spatial join.
SHORT = 1000


def listed(places: DataFrame) -> Column:
    """A short list of places as a constant array, so that rows meet it without a join."""
    rows = places.limit(SHORT + 1).collect()
    if len(rows) > SHORT:
        raise ValueError(f"more than {SHORT} places; join them by cells instead")
    kinds = dict(places.dtypes)
    structs = [F.struct(*(F.lit(r[c]).cast(t).alias(c) for c, t in kinds.items())) for r in rows]
    return F.array(*structs).cast("array<struct<" + ", ".join(f"{c}: {t}" for c, t in kinds.items()) + ">>")


def next_ports(legs: DataFrame, ports: DataFrame) -> DataFrame:
    """Nearest port within 40 degrees of the course in a connected basin, with its time; ports are a short list."""
    here = basin(F.col("lon"), F.col("lat"))

    def seen(p: Column) -> Column:
        d, b = plane_distance_bearing(F.col("lon"), F.col("lat"), p["lon"], p["lat"])
        off = F.abs(F.pmod(b - F.col("course_deg") + 540, F.lit(360.0)) - 180)
        return F.struct(d.alias("d"), p["port"].alias("port"), off.alias("off"), basins_connect(here, basin(p["lon"], p["lat"])).alias("open"))

    rows = legs.withColumn("all", F.transform(listed(ports.select("port", "lon", "lat")), seen))
    rows = rows.withColumn("n", F.array_min(F.filter("all", lambda p: p["open"] & (p["off"] <= 40) & (p["d"] <= 2000))))
    named = (F.col("speed_kn") > 0.5) & F.col("n").isNotNull()
    return rows.select("mmsi", "course_deg", "speed_kn", F.array_min("all")["port"].alias("nearest_port"), F.when(named, F.col("n.port")).alias("port"), F.when(named, F.col("n.d")).alias("distance_km"), F.when(named, F.col("n.off")).alias("offset_deg"), F.when(named, F.col("n.d") / (F.col("speed_kn") * 1.852)).alias("eta_hours"))


def arrivals(ports: DataFrame, legs: DataFrame, now: float) -> DataFrame:
    """Rows of next_ports with when the vessel gets there (`arrives`, seconds) and how long it has been silent
    (`silent_h`, from its last report t in legs): `note` is en_route, due (should be there by now) or no_port."""
    rows = ports.join(legs.select("mmsi", "t"), "mmsi")
    arrives = F.col("t") + F.col("eta_hours") * 3600
    note = F.when(F.col("port").isNull(), "no_port").when(arrives <= now, "due").otherwise("en_route")
    return rows.select(*ports.columns, arrives.alias("arrives"), ((now - F.col("t")) / 3600).alias("silent_h"), note.alias("note"))


def nearest_places(points: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place, d_km): nearest of a short list of places to each point (id, lat, lon)."""
    away = lambda p: F.struct(haversine_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("d_km"), p["place"].alias("place"))
    rows = points.withColumn("n", F.array_min(F.transform(listed(places.select("place", "lat", "lon")), away)))
    return rows.select("id", "n.place", "n.d_km")


def threatened_sites(spills: DataFrame, sites: DataFrame, keep: int = 12) -> DataFrame:
    """Sites within 400 km of a spill (spill_id, lat, lon, radius_km, speed_kmh, bearing_deg): on it, on its path, or near.

    A site within 15 km of the extrapolated path gets its arrival; exposure is weight times exp(-eta / 96 h).
    """
    s = listed(sites.select("site", "kind", "weight", F.col("radius_km").alias("site_km"), F.col("lat").alias("slat"), F.col("lon").alias("slon")))
    d, b = plane_distance_bearing(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    rows = spread(spills).select("*", F.inline(s)).withColumns({"centre_km": d, "to_deg": b})
    rows = rows.withColumn("d_now_km", F.greatest(F.lit(0.0), F.col("centre_km") - F.col("radius_km") - F.col("site_km"))).filter("d_now_km <= 400")
    off = F.radians(F.col("to_deg") - F.col("bearing_deg"))
    reach = F.col("speed_kmh") * 240
    along = F.greatest(F.lit(0.0), F.least(reach, F.col("centre_km") * F.cos(off)))
    away = F.sqrt(F.pow(F.col("centre_km") * F.cos(off) - along, F.lit(2)) + F.pow(F.col("centre_km") * F.sin(off), F.lit(2)))
    eta = F.when(F.col("d_now_km") <= 5, 0.0).when((F.col("speed_kmh") > 0) & (F.greatest(F.lit(0.0), away - F.col("site_km")) <= 15), along / F.col("speed_kmh"))
    rows = rows.withColumn("eta_hours", eta).filter("eta_hours is not null or d_now_km <= 60")
    rows = rows.withColumn("exposure", F.when(F.col("eta_hours").isNull(), 0.0).otherwise(F.col("weight") / 10 * F.exp(-F.col("eta_hours") / 96)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("spill_id").orderBy(F.desc(F.round("exposure", 9)), F.round("d_now_km", 9), "site"))).filter(F.col("rank") <= keep)
    return rows.select("spill_id", "site", "kind", "d_now_km", "eta_hours", "exposure", (F.coalesce(F.col("eta_hours"), F.lit(1e9)) <= 240).alias("threatened"), "rank")


def severity(spills: DataFrame) -> DataFrame:
    """Severity index of spills (spill_id, area_m2, coast_km, beach_eta_h, modelled, exposure, n_threatened, oil_type, wind_ms)."""
    km2 = F.greatest(F.lit(1e-6), F.col("area_m2") / 1e6)
    parts = {
        "size": clamp(F.log10(km2 / 0.05) / math.log10(100 / 0.05)),
        "coast": F.coalesce(F.exp(-F.col("coast_km") / 25), F.lit(0.0)),
        "beaching": F.when(F.col("beach_eta_h").isNull(), 0.0).otherwise(F.when(F.col("modelled"), 1.0).otherwise(0.85) * F.exp(-F.greatest(F.lit(0.0), F.col("beach_eta_h") - 24) / 72)),
        "sensitivity": F.when(F.col("n_threatened") > 0, F.least(F.lit(1.0), F.col("exposure") + 0.05 * (F.col("n_threatened") - 1))).otherwise(0.0),
        "persistence": persistence(F.col("oil_type"), F.col("wind_ms")),
    }
    rows = spills.select("spill_id", "area_m2", *(v.alias(k) for k, v in parts.items()))
    rows = rows.withColumn("score", weighted({k: F.col(k) for k in SEVERITY_WEIGHTS}, SEVERITY_WEIGHTS))
    tonnes = lambda um: F.col("area_m2") * um * 1e-6 * 0.9
    return rows.withColumns({"level": severity_level(F.col("score")), "tonnes": tonnes(5.0), "tier_low": response_tier(tonnes(0.3)), "tier": response_tier(tonnes(5.0)), "tier_high": response_tier(tonnes(50.0))}).drop("area_m2")


def actions(scores: DataFrame) -> DataFrame:
    """Planned actions of each spill by rule: an array of rules, those that hold become rows."""
    rules = [
        (1, "notify", 1.0, F.lit(True)), (1, "activate_tier_3", 2.0, F.col("tier_high") == "Tier 3"), (1, "close_intakes", 6.0, F.col("sensitivity") >= 0.5),
        (2, "boom_sites", 12.0, F.col("sensitivity") > 0), (2, "shoreline_teams", 24.0, F.col("beaching") >= 0.5), (2, "aerial_survey", 6.0, F.col("size") >= 0.5),
        (3, "dispersant_assessment", 12.0, (F.col("coast") < 0.5) & (F.col("size") >= 0.3)), (3, "sampling", 24.0, F.col("persistence") >= 0.7), (4, "monitor", 48.0, F.col("level").isin("LOW", "MODERATE")),
    ]
    listed = F.array(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(a).alias("action"), F.lit(h).alias("deadline_h"))) for p, a, h, c in rules))
    rows = scores.select("spill_id", F.explode(F.filter(listed, lambda a: a.isNotNull())).alias("a")).select("spill_id", "a.*")
    return rows.withColumn("step", F.row_number().over(Window.partitionBy("spill_id").orderBy("priority", "deadline_h", "action"))).filter("step <= 14")


def manifest_roots(files: DataFrame) -> DataFrame:
    """(bundle, root, n) of files (bundle, path, sha256): hash of the sorted `path:sha256` lines."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256")))
    return files.groupBy("bundle").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("root"), F.count(F.lit(1)).alias("n"))


def chained(roots: DataFrame, case: str) -> DataFrame:
    """roots (case, bundle, root) -> each bundle's chain value: hash of the previous root of its case (empty for
    the first), a bar and its own root."""
    before = F.lag("root").over(Window.partitionBy(case).orderBy("bundle"))
    return roots.select(case, "bundle", F.sha2(F.concat_ws("|", F.coalesce(before, F.lit("")), "root"), 256).alias("chain"))


def verified(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """Full outer join of a manifest with what is there: modified, missing, added or ok."""
    rows = recorded.select("bundle", "path", F.col("sha256").alias("was")).join(present.select("bundle", "path", F.col("sha256").alias("now")), ["bundle", "path"], "full_outer")
    return rows.withColumn("status", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "modified").otherwise("ok")).select("bundle", "path", "status")


def associated(spills: DataFrame, max_kmh: float = 3.0, horizon_h: float = 72.0) -> DataFrame:
    """Pairs of observations (id, t, lat, lon, half, area_m2) of one spill: later, and overlapping or near enough.

    Pairs meet by time buckets of the horizon, so nothing is compared across the whole table.
    """
    bucket = F.floor(F.col("t") / (horizon_h * 3600))
    a = spills.select(*(F.col(c).alias(f"{c}_a") for c in spills.columns), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = spills.select(*(F.col(c).alias(f"{c}_b") for c in spills.columns), bucket.alias("bucket"))
    hours = (F.col("t_b") - F.col("t_a")) / 3600
    rows = a.join(b, "bucket").withColumn("hours", hours).filter((F.col("hours") > 0) & (F.col("hours") <= horizon_h))
    width = lambda x: F.least(F.col(f"{x}_a") + F.col("half_a"), F.col(f"{x}_b") + F.col("half_b")) - F.greatest(F.col(f"{x}_a") - F.col("half_a"), F.col(f"{x}_b") - F.col("half_b"))
    inter = F.greatest(F.lit(0.0), width("lat")) * F.greatest(F.lit(0.0), width("lon"))
    rows = rows.withColumns({"d_km": haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), "inter": inter})
    rows = rows.filter((F.col("inter") > 0) | (F.col("d_km") <= max_kmh * F.col("hours")))
    union = 4 * F.col("half_a") * F.col("half_a") + 4 * F.col("half_b") * F.col("half_b") - F.col("inter")
    return rows.select("id_a", "id_b", "hours", "d_km", bearing_deg(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("direction_deg"), (F.col("d_km") / F.col("hours")).alias("speed_kmh"), (F.col("area_m2_b") - F.col("area_m2_a")).alias("area_change_m2"), (F.col("inter") / union).alias("iou"))
