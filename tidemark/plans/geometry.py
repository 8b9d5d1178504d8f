"""Queries on outlines that meet, levels of the sea and rays to the shore, with the SQL that gives their rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..checkpoint import folder, written
from ..functions import domain, ellipsoid
from ..operators import background, detection, impact, land, overlap, response, scoring, sightings, spatial, tiles, warp
from ..sources.keyed import KeyedTable
from ..sources.tables import WINDOW_START, ingest_day, scan_days, sites, table
from ..streaming.gaps import sessions
from .areas import ORACLES as AREAS
from .areas import BOXES, CROSSED, DRIFT, OFF, T, TILES, _drift, _islands, _tiles
from .oracles import BRG, DIST, RAW, SCORED, SITE, SPILL, bearing, haversine
from .queries import _features, _spills, fixes, rounded


def _observations(s, d):
    """An observation an order, every two hours: convex outlines of five to eight corners, in degrees."""
    k = F.col("o_orderkey")
    lat, lon, half, n = 18.0 + (k % 7) * 0.2 + (k % 97) * 0.0013, 71.0 + (k % 5) * 0.3 + (k % 89) * 0.0017, 0.05 + (k % 3) * 0.05, 5 + k % 4

    def corner(i):
        turn = i * 2 * F.pi() / n + (k % 13) * 0.1
        return F.struct((lon + half * F.cos(turn)).alias("x"), (lat + 0.8 * half * F.sin(turn)).alias("y"))

    drifted = lambda x, step: F.when(k % 3 != 0, x + step)
    return table(s, d, "orders").select(
        k.alias("id"), (WINDOW_START + k * 7200.0).alias("t"), lat.alias("lat"), lon.alias("lon"), F.col("o_totalprice").alias("area_m2"),
        F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), corner).alias("ring"), drifted(lat, (k % 5) * 0.01).alias("pred_lat"), drifted(lon, (k % 4) * 0.02).alias("pred_lon"),
    )


def spill_overlap(s, d):
    rows = overlap.compared(_observations(s, d))
    exact = ("spreading_m2_h", "area_change_m2")  # one operation on given numbers
    others = [c for c, t in rows.dtypes if t == "double" and c not in exact]
    return rounded(rounded(rows, "shared_km2", "iou", digits=4), *others)


def clipped_outlines(s, d):
    from ..functions import polygon

    rows = overlap.cut_to_box(_observations(s, d).select("id", "ring"), 71.2, 18.15, 72.0, 19.05)
    return rounded(rows.select("id", (polygon.area(F.col("ring")) * 1e4).alias("area")), digits=3)


def sea_anomaly(s, d):
    pixels = _tiles(s, d).select("scene", "r", "c", (F.col("v") / 8).alias("v"), "sea")
    return rounded(rounded(background.anomalies(pixels, 8, 0.6, 3), "deviation", digits=4), "background", "anomaly")


def _rays(s, d):
    k = F.col("pid")
    return _drift(s, d).select(k.alias("id"), "px", "py", (k * 7 % 360 + 0.37).alias("bearing_deg"), (k % 5 * 0.7).alias("speed_kmh"))


def ray_landfall(s, d):
    return rounded(land.landfall(_rays(s, d), _islands(s, d), 60.0))


def extrapolated_landfall(s, d):
    return rounded(land.extrapolated_landfall(_drift(s, d), _islands(s, d)))


def land_pairs(s, d):
    """Twenty times as many points in one corner as elsewhere."""
    k = F.col("id")
    dense = k % 21 != 0
    points = _drift(s, d).select(F.col("pid").alias("id"), "px", "py").withColumns({"px": F.when(dense, F.col("px") / 10 + 30).otherwise(F.col("px")), "py": F.when(dense, F.col("py") / 10 - 20).otherwise(F.col("py"))})
    shapes = _islands(s, d).select(F.xxhash64("ring").alias("shape_id"), "ring")
    return rounded(spatial.within(points, shapes, 0.5, limit=500).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("distance")))


def stored_states(s, d):
    """The keyed table after two upserts of events: the later half of the rows first."""
    rows = table(s, d, "events").select("user_id", "event_id", "event_type", "value")
    stored = KeyedTable(s, folder(s, "states"), ["user_id"], ["event_id"], buckets=16)
    stored.upsert(rows.filter("event_id % 2 = 1"))
    stored.upsert(rows.filter("event_id % 2 = 0"))
    return stored.read()


def _control(s, d):
    """Twenty-five control points a scene, on a polynomial of the second order: a part a scene."""
    k, i = F.col("p_partkey"), F.explode(F.sequence(F.lit(0), F.lit(24)))
    rows = table(s, d, "part").select((k - 1).cast("int").alias("scene"), i.alias("i"))
    x, y = (F.col("i") % 5) / 4.0, F.floor(F.col("i") / 5) / 4.0
    row = 70.0 - 66.0 * y + 3.0 * x + 1.5 * x * y - 0.75 * x * x + 0.5 * y * y
    col = -2.0 + 68.0 * x + 2.0 * y - 1.25 * x * y + 0.25 * x * x + F.col("scene") % 4
    return rows.select("scene", row.alias("row"), col.alias("col"), (70.0 + x).alias("lon"), (15.0 + y).alias("lat"))


def control_residuals(s, d):
    points = _control(s, d).withColumn("row", F.col("row") + F.col("scene") / 8)
    found = warp.residuals(points, warp.fitted(points))
    return found.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("row_off")), 6).alias("row_off"), F.round(F.max(F.abs("col_off")), 6).alias("col_off"))


def resampled_scenes(s, d):
    areas = _tiles(s, d).select("scene").distinct().select("scene", F.lit(70.2).alias("w"), F.lit(15.15).alias("s"), F.lit(70.8).alias("e"), F.lit(15.75).alias("n"))
    pixels = _tiles(s, d).withColumn("v", F.when(F.col("sea"), F.col("v") + 1).otherwise(0.0))
    return rounded(warp.warped(pixels, _control(s, d), areas, 2500.0), digits=5)


def tile_probabilities(s, d):
    """With a scorer of single pixels overlapping tiles give what one formula gives."""
    pixels = _tiles(s, d).select("scene", "r", "c", (F.col("v") / 8).alias("v"))
    found = tiles.probabilities(pixels, lambda: lambda cells: cells / 4 - 1.5, 24, 8)
    return rounded(found.join(pixels.select("scene", "r", "c"), ["scene", "r", "c"], "left_semi"))


def ellipsoid_round_trip(s, d):
    """From a supplier's place so many metres in a direction, and what the way back measures."""
    k = F.col("s_suppkey")
    rows = table(s, d, "supplier").select(k.alias("id"), (k * 7 % 360 - 179.5).alias("lon"), (k * 11 % 170 - 84.5).alias("lat"), (k * 13 % 360 + 0.25).alias("azimuth"), (1000.0 + k * 7919.0 % 4000000).alias("metres"))
    there = rows.withColumn("to", ellipsoid.forward(F.col("lon"), F.col("lat"), F.col("azimuth"), F.col("metres")))
    back = there.withColumn("g", ellipsoid.inverse(F.col("lon"), F.col("lat"), F.col("to.lon"), F.col("to.lat")))
    return back.select("id", F.round("g.metres", 3).alias("metres"), F.round("g.azimuth", 6).alias("azimuth"))


def _scenes(s, d):
    k = F.col("s_suppkey")
    return table(s, d, "supplier").select(k.alias("scene"), (WINDOW_START + k * 37 % 48 * 3600.0).alias("t"), (70.9 + k % 3 * 0.1).alias("w"), (17.6 + k % 4 * 0.1).alias("s"), (72.2 + k % 3 * 0.1).alias("e"), (19.4 + k % 4 * 0.1).alias("n"))


def _radar(s, d):
    k = F.col("o_orderkey")
    return table(s, d, "orders").select((k % 60).alias("scene"), k.alias("det_id"), (17.6 + k * 7 % 211 / 100.0).alias("lat"), (70.9 + k * 11 % 157 / 100.0).alias("lon"))


def radar_and_reports(s, d):
    """Detections, an order each, against vessels within two hours of the scene (they report rarely)."""
    return rounded(sightings.compared(_radar(s, d), fixes(s, d), _scenes(s, d), 8.0, 7200.0))


def response_plan(s, d):
    k = F.col("o_orderkey")
    orders = table(s, d, "orders")
    at = orders.select(k.alias("spill_id"), (8.0 + k * 5 % 14).alias("lat"), (70.0 + k * 7 % 22).alias("lon"), (1.0 + k % 5).alias("radius_km"), (k % 6 * 0.5).alias("speed_kmh"), (k * 47 % 360).cast("double").alias("bearing_deg"), (k % 4 - 1).alias("n_dark"))
    own = _spills(orders).select("spill_id", "coast_km", "beach_eta_h", "wind_ms").join(impact.severity(_spills(orders)).select("spill_id", "level", "tier"), "spill_id").join(at, "spill_id")
    threats = impact.threatened_sites(at, sites(s)).join(F.broadcast(sites(s).select("site", "weight")), "site")
    ranks = F.slice(F.array(*(F.lit(j) for j in range(1, 5))), 1, (k % 3 * 2).cast("int"))  # none, two or four vessels
    suspects = orders.select(k.alias("spill_id"), F.explode(ranks).alias("rank")).withColumns({"mmsi": (F.col("spill_id") * 4 + F.col("rank")).cast("string"), "score": (90.0 - F.col("rank") * 10 - F.col("spill_id") % 37), "port": F.when(F.col("spill_id") % 2 == 0, "Mumbai"), "name": F.when(F.col("rank") % 2 == 1, F.concat(F.lit("V"), F.col("rank").cast("string")))})
    return rounded(response.planned(own, threats, suspects))


def slick_triage(s, d):
    """Dark components of the tiles against their brightest pixels, half a kilometre a pixel."""
    pixels = _tiles(s, d).withColumn("probability", F.col("v") / 128)
    targets = pixels.filter("v = 100").select("scene", ((F.col("c") + 0.5) * 0.5).alias("x"), (-(F.col("r") + 0.5) * 0.5).alias("y"))
    found = detection.triaged(pixels, targets, 0.5, 0.25, 7.0)
    return rounded(found.select("scene", "component_id", "contrast_db", "elongation", "solidity", "area_km2", "target_km", "label", "oil_points", "lookalike_points", "ship_trail", F.round("triage_score", 3).alias("triage_score"), "triage_rank"), digits=5)


def day_scan(s, d):
    """A raw day-first file of the events, ingested by day and read again for a box and nine days."""
    k, u = F.col("event_id"), F.col("user_id")
    raw = table(s, d, "events").select(
        F.when(u % 5 == 0, "Base Station").when(u % 2 == 0, "Class B").otherwise("Class A").alias("Type of mobile"), F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("# Timestamp"),
        F.when(u % 7 == 3, "no number").otherwise((F.lit(419000000) + u).cast("string")).alias("MMSI"), (17 + k % 400 / 100.0).cast("string").alias("Latitude"), (70 + k % 700 / 100.0).cast("string").alias("Longitude"), F.when(k % 9 == 0, "Unknown").otherwise("A").alias("Name"),
    )
    at = folder(s, "days")
    ingest_day(raw, at)
    found = scan_days(s, at, (71.0, 17.5, 74.5, 20.25), "2024-01-05 06:00:00", "2024-01-13 18:30:00")
    return found.select("mmsi", F.unix_seconds("timestamp").alias("t"), "lat", "lon", "vessel_name")


def voyages(s, d):
    """Reports of a vessel without a pause of twelve hours."""
    found = sessions(table(s, d, "events").select(F.col("user_id").cast("string").alias("mmsi"), F.col("ts").cast("timestamp").alias("timestamp")), 720)
    return found.select("mmsi", F.unix_micros("start").alias("start_us"), "n")


def monsoon_regimes(s, d):
    return table(s, d, "orders").select("o_orderkey", domain.monsoon_regime(F.month("o_orderdate")).alias("regime"))


def evidence_attached(s, d):
    """Evidence with the link that was seen: a vessel matched with a radar target at the slick of the scene."""
    met = written(sightings.matched(_radar(s, d), fixes(s, d), _scenes(s, d), 8.0, 7200.0), "matches")
    places = met.join(_radar(s, d), ["scene", "det_id"]).select("scene", "mmsi", (F.col("lon") - 71.7).alias("x"), (F.col("lat") - 18.6).alias("y"))
    corner = lambda i: F.struct((0.5 * F.cos(i * F.pi() / 3 + F.col("s_suppkey") % 5)).alias("x"), (0.4 * F.sin(i * F.pi() / 3 + F.col("s_suppkey") % 5)).alias("y"))
    slicks = table(s, d, "supplier").select(F.col("s_suppkey").alias("scene"), F.transform(F.sequence(F.lit(0), F.lit(5)), corner).alias("ring"))
    seen = land.attached_vessels(slicks, places, 0.05).select("mmsi").distinct().withColumn("sar_attached", F.lit(True))
    features = _features(s, d).drop("sar_attached").join(seen, "mmsi", "left")
    return rounded(scoring.factor_scores(features).select("mmsi", "sar_attached", "score"), digits=5)


QUERIES = {f.__name__: f for f in (spill_overlap, clipped_outlines, sea_anomaly, ray_landfall, extrapolated_landfall, land_pairs, stored_states, control_residuals, resampled_scenes, tile_probabilities, ellipsoid_round_trip, radar_and_reports, response_plan, slick_triage, day_scan, voyages, monsoon_regimes, evidence_attached)}

CORNERS = """ob AS (SELECT o_orderkey AS id, 1704844800e0 + o_orderkey * 7200e0 AS t, 18e0 + (o_orderkey % 7) * 0.2e0 + (o_orderkey % 97) * 0.0013e0 AS lat, 71e0 + (o_orderkey % 5) * 0.3e0 + (o_orderkey % 89) * 0.0017e0 AS lon,
  0.05e0 + (o_orderkey % 3) * 0.05e0 AS half, 5 + o_orderkey % 4 AS n, CAST(o_totalprice AS DOUBLE) AS area FROM orders),
cn AS (SELECT id, i, n, lon + half * cos(i * 2 * pi() / n + (id % 13) * 0.1e0) AS lo, lat + 0.8e0 * half * sin(i * 2 * pi() / n + (id % 13) * 0.1e0) AS la FROM ob, range(8) q(i) WHERE i < n)"""


def _convex_shares(corners: str, pairs: str) -> str:
    """Shared area of pairs (a, b) of convex rings (id, i, n, x, y): corners inside the other and crossings of sides, around their middle."""
    return f"""sd AS (SELECT p.id, p.i, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM {corners} p JOIN {corners} q ON p.id = q.id AND q.i = (p.i + 1) % p.n),
va AS (SELECT a, b, p.x, p.y FROM {pairs} JOIN {corners} p ON p.id = a JOIN sd s ON s.id = b GROUP BY a, b, p.i, p.x, p.y HAVING min((s.bx - s.ax) * (p.y - s.ay) - (s.b_y - s.ay) * (p.x - s.ax)) >= 0),
vb AS (SELECT a, b, p.x, p.y FROM {pairs} JOIN {corners} p ON p.id = b JOIN sd s ON s.id = a GROUP BY a, b, p.i, p.x, p.y HAVING min((s.bx - s.ax) * (p.y - s.ay) - (s.b_y - s.ay) * (p.x - s.ax)) >= 0),
cs AS (SELECT a, b, s.ax, s.ay, s.bx, s.b_y, (s.bx - s.ax) * (u.b_y - u.ay) - (s.b_y - s.ay) * (u.bx - u.ax) AS c, ((u.ax - s.ax) * (u.b_y - u.ay) - (u.ay - s.ay) * (u.bx - u.ax)) AS m, ((u.ax - s.ax) * (s.b_y - s.ay) - (u.ay - s.ay) * (s.bx - s.ax)) AS o FROM {pairs} JOIN sd s ON s.id = a JOIN sd u ON u.id = b),
cr AS (SELECT a, b, ax + (bx - ax) * m / c AS x, ay + (b_y - ay) * m / c AS y FROM cs WHERE c <> 0 AND m / c BETWEEN 0 AND 1 AND o / c BETWEEN 0 AND 1),
al AS (SELECT * FROM va UNION ALL SELECT * FROM vb UNION ALL SELECT * FROM cr),
an AS (SELECT a, b, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM al WINDOW w AS (PARTITION BY a, b)),
od AS (SELECT a, b, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM an WINDOW w AS (PARTITION BY a, b ORDER BY atan2(y, x) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sh AS (SELECT a, b, abs(sum(x * ny - nx * y)) / 2 AS shared FROM od GROUP BY a, b)"""


_LEVEL = "(SELECT arg_min(v.level, struct_pack(d := pow(v.br - g.br, 2) + pow(v.bc - g.bc, 2), r := v.br, c := v.bc)) FROM lv v WHERE v.scene = g.scene AND v.level IS NOT NULL)"
ORACLES = {
    "spill_overlap": f"""WITH {CORNERS}, pt AS (SELECT id, i, n, 6371.0088e0 * radians(lo) AS x, 6371.0088e0 * sin(radians(la)) AS y FROM cn),
ar AS (SELECT p.id, sum(p.x * q.y - q.x * p.y) / 2 AS size FROM pt p JOIN pt q ON p.id = q.id AND q.i = (p.i + 1) % p.n GROUP BY p.id),
pr AS (SELECT a.id AS a, b.id AS b, (b.t - a.t) / 3600 AS hours, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d, {bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dir, b.area - a.area AS da, abs(a.lat - b.lat) < a.half + b.half AND abs(a.lon - b.lon) < a.half + b.half AS near,
  CASE WHEN a.id % 3 <> 0 THEN a.lat + (a.id % 5) * 0.01e0 END AS pla, CASE WHEN a.id % 3 <> 0 THEN a.lon + (a.id % 4) * 0.02e0 END AS plo, a.lat AS la, a.lon AS lo, b.lat AS lb, b.lon AS ob FROM ob a JOIN ob b ON b.t > a.t AND b.t - a.t <= 259200),
np AS (SELECT a, b FROM pr WHERE near), {_convex_shares('pt', 'np')}
SELECT a AS id_a, b AS id_b, round(hours, 6) AS hours, round(d, 6) AS d_km, coalesce(shared, 0) > 0 AS overlap, round(dir, 6) AS direction_deg, round(d / hours, 6) AS speed_kmh, da AS area_change_m2, da / hours AS spreading_m2_h,
  round(coalesce(shared, 0e0), 4) AS shared_km2, round(coalesce(shared, 0e0) / (x.size + y.size - coalesce(shared, 0)), 4) AS iou, round({haversine('la', 'lo', 'pla', 'plo')}, 6) AS modelled_km, round({haversine('pla', 'plo', 'lb', 'ob')}, 6) AS drift_error_km
FROM pr LEFT JOIN sh USING (a, b) JOIN ar x ON x.id = a JOIN ar y ON y.id = b WHERE coalesce(shared, 0) > 0 OR d <= 3 * hours""",
    "clipped_outlines": f"""WITH {CORNERS}, pt AS (SELECT id, i, n, lo AS x, la AS y FROM cn UNION ALL SELECT -1, i, 4, [71.2e0, 72e0, 72e0, 71.2e0][i + 1], [18.15e0, 18.15e0, 19.05e0, 19.05e0][i + 1] FROM range(4) q(i)),
np AS (SELECT id AS a, -1 AS b FROM ob), {_convex_shares('pt', 'np')} SELECT a AS id, round(shared * 1e4, 3) AS area FROM sh WHERE shared > 0""",
    "sea_anomaly": f"""WITH {TILES}, px AS (SELECT scene, r, c, v / 8 AS v, sea FROM tl), b0 AS (SELECT scene, r // 8 AS br, c // 8 AS bc, CASE WHEN count(*) FILTER (sea) >= 16 THEN quantile_cont(v, 0.6) FILTER (sea) END AS level FROM px GROUP BY ALL),
sz AS (SELECT scene, max(br) + 1 AS nr, max(bc) + 1 AS nc FROM b0 GROUP BY scene), gr AS (SELECT scene, i AS br, j AS bc, nr, nc FROM sz, range(8) a(i), range(8) b(j) WHERE i < nr AND j < nc),
lv AS (SELECT gr.*, level FROM gr LEFT JOIN b0 USING (scene, br, bc)), fl AS (SELECT scene, br, bc, nr, nc, coalesce(level, {_LEVEL}) AS level FROM lv g),
sm AS (SELECT g.scene, g.br, g.bc, g.nr, g.nc, list_sort(list(f.level))[5] AS level FROM gr g, range(-1, 2) a(i), range(-1, 2) b(j), fl f WHERE f.scene = g.scene AND f.br = greatest(0, least(g.nr - 1, g.br + i)) AND f.bc = greatest(0, least(g.nc - 1, g.bc + j)) GROUP BY ALL),
pa AS (SELECT px.*, nr, nc, CASE WHEN nr > 1 THEN r * (nr - 1) / (nr * 8 - 1e0) ELSE 0e0 END AS y, CASE WHEN nc > 1 THEN c * (nc - 1) / (nc * 8 - 1e0) ELSE 0e0 END AS x FROM px JOIN sz USING (scene)),
bg AS (SELECT pa.scene, r, c, v, sea, (p.level * (1 - x + floor(x)) + q.level * (x - floor(x))) * (1 - y + floor(y)) + (s.level * (1 - x + floor(x)) + t.level * (x - floor(x))) * (y - floor(y)) AS background FROM pa
  JOIN sm p ON p.scene = pa.scene AND p.br = floor(y) AND p.bc = floor(x) JOIN sm q ON q.scene = pa.scene AND q.br = floor(y) AND q.bc = least(floor(x) + 1, pa.nc - 1)
  JOIN sm s ON s.scene = pa.scene AND s.br = least(floor(y) + 1, pa.nr - 1) AND s.bc = floor(x) JOIN sm t ON t.scene = pa.scene AND t.br = least(floor(y) + 1, pa.nr - 1) AND t.bc = least(floor(x) + 1, pa.nc - 1)),
co AS (SELECT scene, v - background AS a FROM bg WHERE sea AND v - background > -3), md AS (SELECT scene, quantile_cont(round(a * 1000), 0.5) / 1000 AS m FROM co GROUP BY scene),
de AS (SELECT scene, greatest(0.3e0, 1.4826e0 * quantile_cont(round(abs(a - m) * 1000), 0.5) / 1000) AS deviation FROM co JOIN md USING (scene) GROUP BY scene)
SELECT scene, r, c, round(background, 6) AS background, CASE WHEN sea THEN round(v - background, 6) ELSE 0e0 END AS anomaly, CASE WHEN sea THEN CAST(floor(least(255e0, greatest(0e0, 150 + (v - background) * 40 / deviation))) AS INT) ELSE 150 END AS grey, round(deviation, 4) AS deviation FROM bg JOIN de USING (scene)""",
}

_ISLANDS = """ic AS (SELECT n_nationkey AS k, i, n_nationkey * 11 % 100 - 50 + (3 + n_nationkey % 4) * cos(pi() * i / 3) AS x, n_nationkey * 29 % 90 - 45 + (2 + n_nationkey % 3) * sin(pi() * i / 3) AS y FROM nation, range(6) q(i)),
il AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM ic a JOIN ic b ON a.k = b.k AND b.i = (a.i + 1) % 6)"""


def _landfall_sql(rays: str, most: float) -> str:
    return f"""ry AS ({rays}), rd AS (SELECT *, {most}e0 * sin(radians(bearing_deg)) AS dx, {most}e0 * cos(radians(bearing_deg)) AS dy FROM ry),
pv AS (SELECT id, bool_or(o) AS hit FROM (SELECT id, k, count(*) FILTER ({CROSSED}) % 2 = 1 AS o FROM rd, il GROUP BY id, k) GROUP BY id),
ct AS (SELECT id, dx * (b_y - ay) - dy * (bx - ax) AS c, (ax - x) * (b_y - ay) - (ay - y) * (bx - ax) AS m, (ax - x) * dy - (ay - y) * dx AS o FROM rd, il),
ft AS (SELECT id, min(m / c) * {most} AS s FROM ct WHERE c <> 0 AND m / c BETWEEN 0 AND 1 AND o / c BETWEEN 0 AND 1 GROUP BY id),
lf AS (SELECT rd.*, CASE WHEN hit THEN 0e0 ELSE s END AS l FROM rd JOIN pv USING (id) LEFT JOIN ft USING (id))"""


_FALL = "round(l, 6) AS landfall_km, round(x + l * sin(radians(bearing_deg)), 6) AS x, round(y + l * cos(radians(bearing_deg)), 6) AS y, CASE WHEN speed_kmh > 0 THEN round(l / speed_kmh, 6) END AS eta_h"
_DRIFTED = """SELECT scene AS id, b.x AS x, b.y AS y, CASE WHEN degrees(atan2(b.x - a.x, b.y - a.y)) < 0 THEN degrees(atan2(b.x - a.x, b.y - a.y)) + 360 ELSE degrees(atan2(b.x - a.x, b.y - a.y)) END AS bearing_deg,
  CASE WHEN b.tq > a.tq THEN sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) / ((b.tq - a.tq) / 3600) ELSE 0e0 END AS speed_kmh
FROM (SELECT scene, arg_min(struct_pack(tq, x, y), tq) AS a, arg_max(struct_pack(tq, x, y), tq) AS b FROM (SELECT scene, tq, avg(x) AS x, avg(y) AS y FROM dp GROUP BY ALL) GROUP BY scene)"""
ORACLES |= {
    "ray_landfall": f"WITH {DRIFT}, {_ISLANDS}, {_landfall_sql('SELECT pid AS id, x, y, pid * 7 % 360 + 0.37e0 AS bearing_deg, pid % 5 * 0.7e0 AS speed_kmh FROM dp', 60)} SELECT id, {_FALL} FROM lf",
    "extrapolated_landfall": f"WITH {DRIFT}, {_ISLANDS}, {_landfall_sql(_DRIFTED, 400)} SELECT id AS scene, round(bearing_deg, 6) AS bearing_deg, round(speed_kmh, 6) AS speed_kmh, {_FALL} FROM lf",
}
ORACLES |= {
    "land_pairs": f"""WITH {DRIFT}, {_ISLANDS}, dq AS (SELECT pid, CASE WHEN pid % 21 <> 0 THEN x / 10 + 30 ELSE x END AS x, CASE WHEN pid % 21 <> 0 THEN y / 10 - 20 ELSE y END AS y FROM dp),
pr AS (SELECT pid, k, CASE WHEN count(*) FILTER ({CROSSED}) % 2 = 1 THEN 0e0 ELSE min({OFF}) END AS d FROM (SELECT *, {T} FROM dq, il) GROUP BY pid, k)
SELECT pid AS id, count(*) AS n, round(min(d), 6) AS distance FROM pr WHERE d <= 0.5 GROUP BY pid""",
    "stored_states": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
}
_PLACE = "70 - 66 * y + 3 * x + 1.5 * x * y - 0.75 * x * x + 0.5 * y * y - 0.5 AS sy, -2 + 68 * x + 2 * y - 1.25 * x * y + 0.25 * x * x + scene % 4 - 0.5 AS sx"
ORACLES |= {
    "control_residuals": "SELECT CAST(p_partkey - 1 AS INT) AS scene, CAST(25 AS BIGINT) AS n, 0e0 AS row_off, 0e0 AS col_off FROM part",
    "resampled_scenes": f"""WITH {TILES}, px AS (SELECT scene, r, c, v + 1 AS v FROM tl WHERE sea), sz AS (SELECT round(0.6e0 * 111320 * cos(radians((15.15e0 + 15.75e0) / 2)) / 2500) AS wd, round(0.6e0 * 111320 / 2500) AS ht),
gd AS (SELECT CAST(p_partkey - 1 AS INT) AS scene, CAST(i AS BIGINT) AS gr, CAST(j AS BIGINT) AS gc, 0.2e0 + (j + 0.5e0) * 0.6e0 / wd AS x, 0.75e0 - (i + 0.5e0) * 0.6e0 / ht AS y FROM part, sz, range(64) a(i), range(64) b(j) WHERE p_partkey - 1 IN (SELECT scene FROM tl) AND i < ht AND j < wd),
sp AS (SELECT scene, gr, gc, {_PLACE} FROM gd), nb AS (SELECT scene, gr, gc, CAST(floor(sy) + i AS INT) AS r, CAST(floor(sx) + j AS INT) AS c, (CASE WHEN i = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN j = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM sp, range(2) a(i), range(2) b(j))
SELECT scene, gr, gc, round(sum(w * v) / sum(w), 5) AS v FROM nb JOIN px USING (scene, r, c) WHERE w > 1e-9 GROUP BY ALL""",
    "tile_probabilities": f"WITH {TILES} SELECT scene, r, c, round(1 / (1 + exp(-(v / 8 / 4 - 1.5e0))), 6) AS probability FROM tl",
    "ellipsoid_round_trip": "SELECT s_suppkey AS id, 1000e0 + s_suppkey * 7919 % 4000000 AS metres, s_suppkey * 13 % 360 + 0.25e0 AS azimuth FROM supplier",
}
_THREAT = f"""slicks AS (SELECT o_orderkey AS spill_id, CAST(8 + o_orderkey * 5 % 14 AS DOUBLE) AS lat, CAST(70 + o_orderkey * 7 % 22 AS DOUBLE) AS lon, CAST(1 + o_orderkey % 5 AS DOUBLE) AS radius_km, (o_orderkey % 6) * 0.5e0 AS speed_kmh, CAST(o_orderkey * 47 % 360 AS DOUBLE) AS bearing_deg FROM orders),
ta AS (SELECT s.spill_id, s.radius_km AS sr, speed_kmh, s.bearing_deg, t.site, t.kind, t.weight, t.radius_km AS tr, {DIST('s.lon', 's.lat', 't.lon', 't.lat')} AS cd, {BRG('s.lon', 's.lat', 't.lon', 't.lat')} AS b FROM slicks s, sites t),
tb AS (SELECT *, greatest(0e0, cd - sr - tr) AS d_now, radians(b - bearing_deg) AS off FROM ta), tc AS (SELECT *, greatest(0e0, least(speed_kmh * 240, cd * cos(off))) AS along FROM tb WHERE d_now <= 400),
td AS (SELECT *, CASE WHEN d_now <= 5 THEN 0e0 WHEN speed_kmh > 0 AND greatest(0e0, sqrt(pow(cd * cos(off) - along, 2) + pow(cd * sin(off), 2)) - tr) <= 15 THEN along / speed_kmh END AS eta FROM tc),
te AS (SELECT *, CASE WHEN eta IS NULL THEN 0e0 ELSE weight / 10e0 * exp(-eta / 96) END AS ex FROM td WHERE eta IS NOT NULL OR d_now <= 60),
th AS (SELECT spill_id, site, kind, weight, d_now, eta, coalesce(eta, 1e9) <= 240 AS threatened, row_number() OVER (PARTITION BY spill_id ORDER BY round(ex, 9) DESC, round(d_now, 9), site) AS rank FROM te QUALIFY rank <= 12),
nr AS (SELECT spill_id, count(*) FILTER (threatened) AS nt, count(*) FILTER (weight >= 8 AND d_now < 30) AS ns FROM th GROUP BY spill_id)"""
_ICG = "Indian Coast Guard"
_CENTRE = "CASE WHEN lon >= 91 THEN 'MRCC Port Blair' WHEN lon < 77.6 OR (lat < 8.3 AND lon < 78.5) THEN 'MRCC Mumbai' ELSE 'MRCC Chennai' END"
_RULES = (
    ("true", 1, "'P1'", "1e0", f"'{_ICG} — ' || {_CENTRE}", f"'Report the detection to ' || {_CENTRE}", "notify"),
    ("true", 2, "'P1'", "3e0", f"'{_ICG} (aerial / surface unit)'", "'Confirm the slick on scene'", "verify"),
    ("true", 3, "'P1'", "6e0", f"'{_ICG} / pollution response team'", "'Collect oil samples for fingerprinting'", "evidence"),
    ("eta IS NOT NULL AND nt = 0", 20, "CASE WHEN eta <= 24 THEN 'P1' ELSE 'P2' END", "greatest(eta - 6, 1e0)", "'Coastal State/UT · District administration'", "'Prepare shoreline response'", "protect"),
    ("wind > 10", 30, "'P2'", "6e0", f"'{_ICG}'", "'Defer boom containment; monitor'", "contain"),
    ("coalesce(wind, 0) <= 10", 30, "CASE WHEN level IN ('HIGH', 'CRITICAL') THEN 'P1' ELSE 'P2' END", "6e0", f"'{_ICG} (Pollution Response vessel)'", "'Contain and recover at sea'", "contain"),
    ("coast_km > 20 AND ns = 0", 31, "'P3'", "12e0", f"'{_ICG} (approval authority)'", "'Consider dispersants only with approval'", "contain"),
    ("coalesce(coast_km, 0) <= 20 OR ns > 0", 31, "'P2'", "6e0", f"'{_ICG}'", "'Do not use dispersants here'", "contain"),
    ("dark > 0", 50, "'P2'", "12e0", f"'{_ICG} / Navy (MDA)'", "'Identify ' || dark || ' SAR-only vessel(s) without AIS'", "enforce"),
    ("true", 60, "'P2'", "12e0", "'INCOIS / ICG'", "'Update the forecast with the next satellite pass'", "monitor"),
    ("tier <> 'Tier 1'", 70, "'P1'", "2e0", f"'{_ICG} (Central Coordinating Authority)'", "'Activate ' || tier || ' response'", "notify"),
)
ORACLES |= {
    "radar_and_reports": f"""WITH RECURSIVE {RAW}, sc AS (SELECT s_suppkey AS scene, 1704844800e0 + s_suppkey * 37 % 48 * 3600e0 AS ts, 70.9e0 + s_suppkey % 3 * 0.1e0 AS w, 17.6e0 + s_suppkey % 4 * 0.1e0 AS s, 72.2e0 + s_suppkey % 3 * 0.1e0 AS e, 19.4e0 + s_suppkey % 4 * 0.1e0 AS n FROM supplier),
o AS (SELECT sc.*, mmsi, t - ts AS o, lat, lon FROM sc JOIN fixes ON t BETWEEN ts - 14400 AND ts + 14400),
v0 AS (SELECT scene, mmsi, w, s, e, n, arg_max(struct_pack(o, lat, lon), o) FILTER (o <= 0) AS a, arg_min(struct_pack(o, lat, lon), o) FILTER (o >= 0) AS b, arg_min(struct_pack(o, lat, lon), struct_pack(x := abs(o), y := o)) AS r FROM o GROUP BY ALL),
v1 AS (SELECT *, CASE WHEN b.o > a.o THEN -a.o / (b.o - a.o) ELSE 0e0 END AS f, coalesce(b.o - a.o <= 14400, false) AS near FROM v0 WHERE abs(r.o) <= 7200),
v AS (SELECT scene, mmsi, r.o AS offset_s, CASE WHEN near THEN a.lat + f * (b.lat - a.lat) ELSE r.lat END AS lat, CASE WHEN near THEN a.lon + f * (b.lon - a.lon) ELSE r.lon END AS lon, w, s, e, n FROM v1),
vs AS (SELECT * FROM v WHERE lon BETWEEN w AND e AND lat BETWEEN s AND n),
dt AS (SELECT o_orderkey % 60 AS scene, o_orderkey AS det_id, 17.6e0 + o_orderkey * 7 % 211 / 100e0 AS lat, 70.9e0 + o_orderkey * 11 % 157 / 100e0 AS lon FROM orders),
pr AS (SELECT * FROM (SELECT scene, det_id, mmsi, offset_s, {haversine('dt.lat', 'dt.lon', 'vs.lat', 'vs.lon')} AS d FROM dt JOIN vs USING (scene)) WHERE d <= 8),
oq AS (SELECT scene, det_id, row_number() OVER (PARTITION BY scene ORDER BY det_id) AS k, list(struct_pack(mmsi, d, offset_s) ORDER BY d, mmsi) AS c FROM pr GROUP BY scene, det_id),
g AS (SELECT DISTINCT scene, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS STRUCT(mmsi VARCHAR, d DOUBLE, offset_s DOUBLE)) AS p FROM oq
  UNION ALL SELECT scene, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.mmsi) END, det_id, p FROM (SELECT g.scene, oq.k, g.used, oq.det_id, list_filter(oq.c, lambda x: NOT list_contains(g.used, x.mmsi))[1] AS p FROM g JOIN oq ON oq.scene = g.scene AND oq.k = g.k + 1)),
m AS (SELECT scene, det_id, p.mmsi AS mmsi, p.d AS d, p.offset_s AS offset_s FROM g WHERE p IS NOT NULL)
SELECT scene, det_id, mmsi, round(d, 6) AS d_km, round(offset_s, 6) AS offset_s, 'matched' AS status FROM m UNION ALL SELECT scene, det_id, NULL, NULL, NULL, 'radar_only' FROM dt WHERE det_id NOT IN (SELECT det_id FROM m)
UNION ALL SELECT scene, NULL, mmsi, NULL, round(offset_s, 6), 'reports_only' FROM vs WHERE (scene, mmsi) NOT IN (SELECT (scene, mmsi) FROM m)""",
    "response_plan": f"""WITH {SPILL}, {SITE}, {_THREAT}, al AS (SELECT sp.spill_id, coast_km, eta, wind, level, tier, lat, lon, spill_id % 4 - 1 AS dark, coalesce(nr.nt, 0) AS nt, coalesce(nr.ns, 0) AS ns FROM sp JOIN sev USING (spill_id) JOIN slicks USING (spill_id) LEFT JOIN nr USING (spill_id)),
ac AS ("""
    + " UNION ALL ".join(f"SELECT spill_id, {p} AS priority, {h} AS deadline_h, {a} AS agency, {t} AS title, '{kd}' AS kind, {o} AS ord FROM al WHERE {c}" for c, o, p, h, a, t, kd in _RULES)
    + """ UNION ALL SELECT spill_id, CASE WHEN eta <= 24 THEN 'P1' WHEN eta <= 72 THEN 'P2' ELSE 'P3' END, greatest(eta - 6, 1e0), CASE kind WHEN 'intake' THEN 'Plant operator / NPCIL · ICG' WHEN 'port' THEN 'Port authority (Tier 1 resources) · ICG' WHEN 'fishing' THEN 'State fisheries / tourism department · District administration' WHEN 'tourism' THEN 'State fisheries / tourism department · District administration' ELSE 'State Forest / Environment dept · ICG · State Pollution Control Board' END,
  CASE kind WHEN 'intake' THEN 'Alert ' || site || ' to protect intakes' WHEN 'port' THEN 'Prepare port-entrance protection at ' || site WHEN 'fishing' THEN 'Issue advisory for ' || site WHEN 'tourism' THEN 'Issue advisory for ' || site ELSE 'Protect ' || site END, 'protect', 9 + row_number() OVER (PARTITION BY spill_id ORDER BY eta, rank) AS o FROM th WHERE threatened QUALIFY o < 15
  UNION ALL SELECT o_orderkey, CASE WHEN j = 1 AND 90e0 - j * 10 - o_orderkey % 37 >= 60 THEN 'P1' ELSE 'P2' END, 24e0, 'DG Shipping (Port State Control) · ICG', 'Inspect ' || CASE WHEN j % 2 = 1 THEN 'V' || j ELSE CAST(o_orderkey * 4 + j AS VARCHAR) END || CASE WHEN o_orderkey % 2 = 0 THEN ' at Mumbai' ELSE ' (no port ahead)' END, 'enforce', 39 + j FROM orders, range(1, 4) q(j) WHERE j <= o_orderkey % 3 * 2)
SELECT spill_id, CAST(row_number() OVER (PARTITION BY spill_id ORDER BY priority, round(deadline_h, 9), ord) AS INT) AS step, priority, round(deadline_h, 6) AS deadline_h, agency, title, kind FROM ac QUALIFY step <= 14""",
}
_OUTLINES = AREAS["outline_rings"].rsplit("SELECT scene, label, CAST(ring_r", 1)[0].rstrip()
_BAND = AREAS["band_contrast"].split("i3 AS (", 1)[1].rsplit("SELECT scene, label, round(", 1)[0].rstrip()
_HULL = BOXES.split("\nhl AS", 1)[0].rstrip().rstrip(",")
ORACLES["slick_triage"] = f"""{_OUTLINES}, i3 AS ({_BAND},
cr AS (SELECT scene || '-' || label AS k, scene, label, ring_r, ring_c, c0 * 0.5e0 AS ax, -r0 * 0.5e0 AS ay, c1 * 0.5e0 AS bx, -r1 * 0.5e0 AS b_y FROM bs),
ra AS (SELECT k, ring_r, ring_c, abs(sum(ax * b_y - bx * ay)) / 2 AS a FROM cr GROUP BY ALL), oz AS (SELECT k, arg_max(struct_pack(ring_r, ring_c), a) AS o, max(a) AS area FROM ra GROUP BY k),
sd AS (SELECT cr.k, scene, label, ax, ay, bx, b_y, area FROM cr JOIN oz ON cr.k = oz.k AND cr.ring_r = o.ring_r AND cr.ring_c = o.ring_c),
pt AS (SELECT k, x, y, row_number() OVER (PARTITION BY k ORDER BY x, y) AS i FROM (SELECT DISTINCT k, ay AS y, unnest([min(ax), max(ax)]) AS x FROM sd GROUP BY k, ay)), {_HULL},
nv AS (SELECT DISTINCT h.k, p.x, p.y FROM hs h JOIN pt p ON p.k = h.k AND abs((h.bx - h.ax) * (p.y - h.ay) - (h.b_y - h.ay) * (p.x - h.ax)) < 1e-9 AND (p.x - h.ax) * (p.x - h.bx) + (p.y - h.ay) * (p.y - h.b_y) < -1e-9),
hl AS (SELECT k, sum(ax * b_y - bx * ay) / 2 AS hull FROM hs WHERE (k, ax, ay) NOT IN (SELECT (k, x, y) FROM nv) AND (k, bx, b_y) NOT IN (SELECT (k, x, y) FROM nv) GROUP BY k),
bo AS (SELECT k, scene, label, any_value(area) AS area, min(ax) - 3 AS x0, max(ax) + 3 AS x1, min(ay) - 3 AS y0, max(ay) + 3 AS y1 FROM sd GROUP BY ALL),
tp AS (SELECT bo.k, (c + 0.5e0) * 0.5e0 AS x, -(r + 0.5e0) * 0.5e0 AS y FROM bo JOIN tl ON tl.scene = bo.scene AND v = 100 WHERE (c + 0.5e0) * 0.5e0 BETWEEN x0 AND x1 AND -(r + 0.5e0) * 0.5e0 BETWEEN y0 AND y1),
ds AS (SELECT k, x, y, CASE WHEN count(*) FILTER ({CROSSED}) % 2 = 1 THEN 0e0 ELSE min({OFF}) END AS d FROM (SELECT *, {T} FROM tp JOIN sd USING (k)) GROUP BY k, x, y),
lo AS (SELECT *, x * ux + y * uy AS pu, y * ux - x * uy AS pv, (u0 + u1) / 2 AS cu, (v0 + v1) / 2 AS cv FROM ds JOIN bx USING (k)),
en AS (SELECT k, x, y, d, CASE WHEN u1 - u0 >= v1 - v0 THEN least(sqrt(pow(pu - u0, 2) + pow(pv - cv, 2)), sqrt(pow(pu - u1, 2) + pow(pv - cv, 2))) ELSE least(sqrt(pow(pu - cu, 2) + pow(pv - v0, 2)), sqrt(pow(pu - cu, 2) + pow(pv - v1, 2))) END AS e FROM lo),
nt AS (SELECT k, min(d) AS tk, arg_min(e, struct_pack(d, x, y)) AS ek FROM en GROUP BY k),
cb AS (SELECT own.scene, own.label, CASE WHEN rn.n >= 20 AND own.n >= 5 THEN (rn.v - own.v) * 0.25e0 END AS co, own.v / 128 AS pb FROM own LEFT JOIN rn USING (scene, label)),
fx AS (SELECT bo.scene, bo.label AS component_id, co, greatest(u1 - u0, v1 - v0) AS lk, greatest(u1 - u0, v1 - v0) / least(u1 - u0, v1 - v0) AS el, area / hull AS so, area AS ar, tk, ek, pb FROM bo JOIN bx USING (k) JOIN hl USING (k) JOIN cb ON cb.scene = bo.scene AND cb.label = bo.label LEFT JOIN nt USING (k)),
g0 AS (SELECT *, coalesce(tk <= 1 AND el >= 4 AND ek <= greatest(1e0, 0.15e0 * lk), false) AS ship_trail FROM fx),
g1 AS (SELECT *, 0.5e0 + CASE WHEN ship_trail THEN 2e0 ELSE 0e0 END + CASE WHEN el >= 4 THEN 1e0 ELSE 0e0 END + CASE WHEN co >= 2 THEN 1e0 ELSE 0e0 END AS o, CASE WHEN co < 1 THEN 1e0 ELSE 0e0 END + CASE WHEN so < 0.3 AND el < 3 THEN 1e0 ELSE 0e0 END + CASE WHEN ar > 50 AND el < 3 THEN 1e0 ELSE 0e0 END AS l FROM g0)
SELECT scene, component_id, round(co, 5) AS contrast_db, round(el, 5) AS elongation, round(so, 5) AS solidity, round(ar, 5) AS area_km2, round(tk, 5) AS target_km, CASE WHEN o - l >= 1.5 THEN 'OIL_LIKELY' WHEN l - o >= 1.5 THEN 'LOOKALIKE_LIKELY' ELSE 'UNCERTAIN' END AS label,
  o AS oil_points, l AS lookalike_points, ship_trail, round(o - l + pb, 3) AS triage_score, CAST(row_number() OVER (PARTITION BY scene ORDER BY round(o - l + pb, 3) DESC, component_id) AS INT) AS triage_rank FROM g1"""
_MATCHES = re.sub(r"\bsc\b", "rsc", ORACLES["radar_and_reports"].split(f"{RAW}, ", 1)[1].split("\nSELECT scene, det_id, mmsi", 1)[0])
ORACLES |= {
    "day_scan": """SELECT CAST(419000000 + user_id AS VARCHAR) AS mmsi, CAST(floor(epoch(ts)) AS BIGINT) AS t, 17 + event_id % 400 / 100e0 AS lat, 70 + event_id % 700 / 100e0 AS lon, CASE WHEN event_id % 9 <> 0 THEN 'A' END AS vessel_name FROM events
WHERE user_id % 5 <> 0 AND user_id % 7 <> 3 AND 17 + event_id % 400 / 100e0 BETWEEN 17.5 AND 20.25 AND 70 + event_id % 700 / 100e0 BETWEEN 71 AND 74.5 AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-13 18:30:00'""",
    "voyages": """WITH q AS (SELECT CAST(user_id AS VARCHAR) AS mmsi, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000, true) AS new FROM events), g AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY mmsi ORDER BY t) AS v FROM q)
SELECT mmsi, min(t) AS start_us, count(*) AS n FROM g GROUP BY mmsi, v""",
    "monsoon_regimes": "SELECT o_orderkey, CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 'southwest' WHEN month(o_orderdate) IN (12, 1, 2) THEN 'northeast' ELSE 'transition' END AS regime FROM orders",
    "evidence_attached": f"""WITH RECURSIVE {SCORED.replace("CAST(c.mmsi AS BIGINT) % 10 = 3 AS sar", "c.mmsi IN (SELECT mmsi FROM att) AS sar").replace("kn AS (SELECT mmsi, CASE", f"{_MATCHES}, ml AS (SELECT m.scene, m.mmsi, dt.lon - 71.7e0 AS x, dt.lat - 18.6e0 AS y FROM m JOIN dt USING (scene, det_id)), sk AS (SELECT s_suppkey AS k, i, 0.5e0 * cos(i * pi() / 3 + s_suppkey % 5) AS x, 0.4e0 * sin(i * pi() / 3 + s_suppkey % 5) AS y FROM supplier, range(6) q(i)), sl AS (SELECT p.k, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS b_y FROM sk p JOIN sk q ON p.k = q.k AND q.i = (p.i + 1) % 6), att AS (SELECT DISTINCT mmsi FROM (SELECT scene, mmsi, x, y, CASE WHEN count(*) FILTER ({CROSSED}) % 2 = 1 THEN 0e0 ELSE min({OFF}) END AS dd FROM (SELECT *, {T} FROM ml JOIN sl ON sl.k = ml.scene) GROUP BY ALL) WHERE dd <= 0.05), kn AS (SELECT mmsi, CASE")}
SELECT mmsi, round(sar_attached, 5) AS sar_attached, round(score, 5) AS score FROM sc""",
}
