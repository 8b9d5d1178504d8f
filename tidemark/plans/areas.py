"""Queries on areas, outlines, forcing and records, with the SQL that gives their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forcing, land, outlines, raster, records, scoring
from ..sources.tables import table
from .oracles import RAW
from .queries import fixes, rounded

NOW = 901929600.0
DAY = 86400.0


def _rings(s, d):
    """One ring a part: five to eight corners around a centre, counter-clockwise (km)."""
    k = F.col("p_partkey")
    n = 5 + k % 4

    def corner(i):
        turn, far = 2 * F.pi() * i / n, 1 + (k * 7 + i * i * 3 + i * 5) % 11 / 10.0
        return F.struct((k % 40 + (4 + k % 5) * far * F.cos(turn)).alias("x"), (k % 30 + 2 * far * F.sin(turn)).alias("y"))

    return table(s, d, "part").select(k.alias("slick_id"), F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), corner).alias("ring"))


def shape_descriptors(s, d):
    return rounded(land.described(_rings(s, d)).drop("ring"))


def geodesic_metrics(s, d):
    from ..functions import polygon

    at = F.transform("ring", lambda p: F.struct((70 + p["x"] / 100).alias("x"), (15 + p["y"] / 100).alias("y")))
    rows = _rings(s, d).select("slick_id", at.alias("ring"))
    return rounded(rows.select("slick_id", polygon.sphere_area_km2(F.col("ring")).alias("area_km2"), polygon.sphere_perimeter_km(F.col("ring")).alias("perimeter_km")))


def trail_ends(s, d):
    k = F.col("slick_id")
    pairs = _rings(s, d).withColumns({"x": (k * 3 % 47).cast("double"), "y": (k * 5 % 31).cast("double")})
    return rounded(land.trail_ends(pairs).select("slick_id", "end_km", "slick_km"))


def attached_vessels(s, d):
    k = F.col("o_orderkey")
    matches = table(s, d, "orders").select((k % 199).alias("scene"), F.col("o_custkey").cast("string").alias("mmsi"), (k * 13 % 500 / 10.0).alias("x"), (k * 17 % 400 / 10.0).alias("y"))
    return rounded(land.attached_vessels(_rings(s, d).withColumnRenamed("slick_id", "scene"), matches, 1.0))


def _drift(s, d):
    k = F.col("event_id")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / DAY) * DAY
    return table(s, d, "events").select((F.col("user_id") % 5).alias("scene"), k.alias("pid"), at.cast("double").alias("tq"), (k * 37 % 1201 / 10.0 - 60).alias("px"), (k * 53 % 1103 / 10.0 - 55).alias("py"))


def _islands(s, d):
    k = F.col("n_nationkey")
    corner = lambda i: F.struct((k * 11 % 100 - 50 + (3 + k % 4) * F.cos(F.pi() * i / 3)).alias("x"), (k * 29 % 90 - 45 + (2 + k % 3) * F.sin(F.pi() * i / 3)).alias("y"))
    return table(s, d, "nation").select(F.transform(F.sequence(F.lit(0), F.lit(5)), corner).alias("ring"))


def land_points(s, d):
    return land.on_land(_drift(s, d), _islands(s, d), 0.5).select("pid", "hit")


def beaching(s, d):
    return rounded(land.beaching(land.on_land(_drift(s, d), _islands(s, d), 0.5)))


def outside_share(s, d):
    return rounded(land.outside_share(_drift(s, d), 45.0))


def sized_domain(s, d):
    k = F.col("pid")
    return rounded(land.sized_domain(_drift(s, d).withColumns({"scene": k % 7, "px": F.col("px") * (1 + k % 7) / 4}), 30.0))


def _tiles(s, d):
    """Pixels: 4,096 orders a scene."""
    k = F.col("o_orderkey")
    r, c = (F.floor(k / 64) % 64).cast("int"), (k % 64).cast("int")
    rows = table(s, d, "orders").select(F.floor(k / 4096).cast("int").alias("scene"), r.alias("r"), c.alias("c"), (k * 7919 % 101).cast("double").alias("v"))
    cell = F.floor(F.col("r") / 6) * 5 + F.floor(F.col("c") / 9) * 3 + F.col("scene")
    return rows.withColumns({"m": ((cell % 5 == 0) | ((F.col("r") * 5 + F.col("c") * 3) % 41 == 0)).cast("int"), "sea": F.col("c") + F.col("r") % 5 >= 9})


def _blobs(s, d):
    return raster.labelled(_tiles(s, d), eight=False)


def band_contrast(s, d):
    return rounded(outlines.band_contrast(_blobs(s, d), _tiles(s, d), 3, 10, 0.25))


def at_sea(s, d):
    return outlines.at_sea(_tiles(s, d).filter("v > 90").select("scene", "r", "c"), _tiles(s, d), 8)


def outline_rings(s, d):
    return outlines.traced(_blobs(s, d)).select("scene", "label", F.col("ring.r").alias("ring_r"), F.col("ring.c").alias("ring_c"), "seq", "r", "c")


def db_targets(s, d):
    tiles = _tiles(s, d).withColumn("v", F.col("v") / 8)
    found = raster.sized_components(raster.labelled(tiles.withColumn("m", (F.col("v") > 10).cast("int"))), 2, 400)
    return rounded(raster.component_statistics(found.select("scene", "r", "c", "label"), tiles.select("scene", "r", "c", "v")).select("scene", "label", "n_pixels", "row", "col", "peak"))


def stretched(s, d):
    return rounded(outlines.stretched(_tiles(s, d)))


def forcing_extent(s, d):
    k = F.col("event_id")
    hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600) * 3600
    rows = table(s, d, "events").select((F.col("user_id") % 20).alias("field"), (10 + k % 83 / 4).alias("latitude"), (65 + k % 71 / 4).alias("longitude"), hours.cast("double").alias("valid_time"))
    return forcing.extent(forcing.canonical(rows), "field")


def request_budget(s, d):
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    rows = table(s, d, "events").select("event_id", (F.col("user_id") % 15).alias("client"), t.alias("t"), (40 + F.col("event_id") % 60).alias("points"))
    return forcing.budgeted(rows, 1500, 86400).select("event_id", "used", "waits")


def request_endpoint(s, d):
    end = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    return table(s, d, "orders").select("o_orderkey", forcing.endpoint(end, F.lit(NOW)).alias("endpoint"))


def nearest_wind(s, d):
    asked = table(s, d, "events").select((F.col("user_id") % 10).alias("station"), F.col("event_id").alias("qid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    i = F.col("id")
    station, h = i % 10, F.floor(i / 10)
    series = s.range(7440).select(station.alias("station"), (1704067200.0 + h * 3600).alias("t"), F.when((h * 7 + station) % 5 != 0, h * 3 % 17 + station / 2).alias("value"))
    return forcing.nearest_known(asked, series, "station").select("qid", "at", "value")


def scan_list(s, d):
    k = F.col("o_orderkey")
    rows = table(s, d, "orders").select((k % 6).alias("lane"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("t"), k.alias("scene"), (k % 100 / 99.0).alias("coverage"), (k % 140 / 10.0).alias("wind_ms"))
    return rounded(forcing.to_scan(rows))


def source_states(s, d):
    k = F.col("s_suppkey")
    needs = F.filter(F.array(F.when(k % 3 == 0, F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))), F.when(k % 5 == 0, F.lit("NATION_1"))), lambda x: x.isNotNull())
    sources = table(s, d, "supplier").select(k.alias("source"), (k % 4 != 0).alias("integrated"), needs.alias("needs"))
    settings = table(s, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("x").alias("value"))
    return records.source_states(sources, settings)


def catalogue(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("analysis_id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("changed"), F.col("o_orderstatus").alias("status"), "o_custkey")
    return records.catalogue(rows, "status")


def provider_rows(s, d):
    return records.provider_rows(fixes(s, d).withColumn("provider", F.col("mmsi").cast("long") % 3))


def mask_source(s, d):
    k = F.col("p_partkey")
    side = F.when(k % 3 != 0, F.array(64 + k % 2, F.lit(64).cast("long")))
    return table(s, d, "part").select("p_partkey", records.sea_mask_source(F.array(F.lit(64).cast("long"), F.lit(64).cast("long")), side, F.when(k % 5 < 3, "epsg:4326").otherwise("EPSG:32643"), (k % 7 == 0).cast("double")).alias("mask"))


def selected_components(s, d):
    from pyspark.sql import Window

    rows = table(s, d, "part").select((F.col("p_partkey") % 50).alias("scene"), F.col("p_partkey").alias("component_id"), "p_size", "p_retailprice")
    ranks = rows.filter("scene % 3 = 1").withColumn("triage_rank", F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("p_retailprice"), "component_id")))
    return records.selected(rows, rows.filter("scene % 3 = 0 and p_size % 7 = 0"), ranks).select("scene", "component_id")


def single_label(s, d):
    return records.single_label(table(s, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("label")), "o_custkey")


def tag_number(s, d):
    k = F.col("p_partkey")
    tag = F.when(k % 4 != 0, F.concat(F.lit("mode=sos;gray_per_db="), F.when(k % 3 == 0, (k / 8).cast("string")).otherwise(k.cast("string")), F.lit(";x=1"))).otherwise("plain")
    return table(s, d, "part").select("p_partkey", records.tag_number(tag, "gray_per_db").alias("gray_per_db"))


def tracked_fixes(s, d):
    rows = fixes(s, d).withColumn("mmsi", F.concat("mmsi", F.lit("-"), (F.floor(F.col("t") / DAY)).cast("string")))
    return records.tracked(rows).select("src_order", "mmsi")


def strict_json(s, d):
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(float("inf"))).otherwise(k % 64 / 4)
    inner = F.struct(value.alias("value"), k.alias("_private"), F.array(value, F.lit(0.5)).alias("values"))
    return records.strict_json(table(s, d, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), inner.alias("score"), value.alias("_hidden")))


def cell_features(s, d):
    k = F.col("p_partkey")
    rows = table(s, d, "part").select((k % 4).alias("map"), (70 + k % 64 / 32).alias("lon"), (15 + k % 48 / 16).alias("lat"), (F.when(k % 3 == 0, 1e-5).otherwise(k % 256 / 256)).alias("p"))
    return records.cell_features(rows)


def track_features(s, d):
    at = fixes(s, d).withColumns({"lat": F.round(F.col("lat") * 16) / 16, "lon": F.round(F.col("lon") * 16) / 16, "t": F.floor("t").cast("long")})
    return records.track_features(at)


def robustness_dirichlet(s, d):
    weights = {"spatial": 0.3, "temporal": 0.25, "trajectory": 0.2, "type": 0.1, "continuity": 0.15}
    k = F.col("n_nationkey")
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), ((k * 7 + j * 5) % 11 / 10).alias("value")) for j, f in enumerate(weights))))
    factors = table(s, d, "nation").select(k.cast("string").alias("mmsi"), (k + 1).alias("base_rank"), parts.alias("p")).select("mmsi", "base_rank", "p.*")
    return rounded(scoring.robustness(factors, scoring.dirichlet_weights(s, weights)))


QUERIES = {f.__name__: f for f in (
    shape_descriptors, geodesic_metrics, trail_ends, attached_vessels, land_points, beaching, outside_share, sized_domain, band_contrast, at_sea, outline_rings, db_targets, stretched,
    forcing_extent, request_budget, request_endpoint, nearest_wind, scan_list, source_states, catalogue, provider_rows, mask_source, selected_components, single_label, tag_number,
    tracked_fixes, strict_json, cell_features, track_features, robustness_dirichlet,
)}

RINGS = """rg AS (SELECT p_partkey AS k, 5 + p_partkey % 4 AS n FROM part), cn AS (SELECT k, n, i, 1 + (k * 7 + i * i * 3 + i * 5) % 11 / 10e0 AS far, 2 * pi() * i / n AS turn FROM rg, range(8) q(i) WHERE i < n),
pt AS (SELECT k, n, i, k % 40 + (4 + k % 5) * far * cos(turn) AS x, k % 30 + 2e0 * far * sin(turn) AS y FROM cn),
sd AS (SELECT a.k, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM pt a JOIN pt b ON a.k = b.k AND b.i = (a.i + 1) % a.n)"""
BOXES = """hs AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS l FROM pt a JOIN pt b ON a.k = b.k AND a.i <> b.i JOIN pt p ON p.k = a.k GROUP BY ALL HAVING min((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) > -1e-9),
dr AS (SELECT k, (bx - ax) / l AS ux, (b_y - ay) / l AS uy FROM hs),
ex AS (SELECT dr.k, ux, uy, max(x * ux + y * uy) AS u1, min(x * ux + y * uy) AS u0, max(y * ux - x * uy) AS v1, min(y * ux - x * uy) AS v0 FROM dr JOIN pt ON pt.k = dr.k GROUP BY ALL),
bx AS (SELECT k, unnest(arg_min(struct_pack(ux, uy, u0, u1, v0, v1), (u1 - u0) * (v1 - v0))) FROM ex GROUP BY k),
hl AS (SELECT k, sum(ax * b_y - bx * ay) / 2 AS hull FROM hs GROUP BY k)"""
CROSSED = "(ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax"
OFF = "sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2))"
T = "greatest(0e0, least(1e0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / greatest(pow(bx - ax, 2) + pow(b_y - ay, 2), 1e-12))) AS t"
DRIFT = "dp AS (SELECT user_id % 5 AS scene, event_id AS pid, floor(epoch(ts) / 86400) * 86400e0 AS tq, event_id * 37 % 1201 / 10e0 - 60 AS x, event_id * 53 % 1103 / 10e0 - 55 AS y FROM events)"
HITS = f"""{DRIFT}, ic AS (SELECT n_nationkey AS k, i, n_nationkey * 11 % 100 - 50 + (3 + n_nationkey % 4) * cos(pi() * i / 3) AS x, n_nationkey * 29 % 90 - 45 + (2 + n_nationkey % 3) * sin(pi() * i / 3) AS y FROM nation, range(6) q(i)),
il AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM ic a JOIN ic b ON a.k = b.k AND b.i = (a.i + 1) % 6),
im AS (SELECT pid, k, count(*) FILTER ({CROSSED}) % 2 = 1 OR min({OFF}) <= 0.5 AS hit FROM (SELECT *, {T} FROM dp, il) GROUP BY pid, k), hits AS (SELECT pid, bool_or(hit) AS hit FROM im GROUP BY pid)"""
TILES = """tl0 AS (SELECT o_orderkey AS k, CAST(o_orderkey // 4096 AS INT) AS scene, CAST(o_orderkey // 64 % 64 AS INT) AS r, CAST(o_orderkey % 64 AS INT) AS c, CAST(o_orderkey * 7919 % 101 AS DOUBLE) AS v FROM orders),
tl AS (SELECT *, ((r // 6 * 5 + c // 9 * 3 + scene) % 5 = 0 OR (r * 5 + c * 3) % 41 = 0) AS m, c + r % 5 >= 9 AS sea FROM tl0)"""
NEAR = "abs(b.r - t.r) + abs(b.c - t.c) <= 1"
MARKED = lambda where, near: f"gg AS (SELECT scene, r, c, CAST(r AS BIGINT) * 4294967296 + c AS label FROM tl WHERE {where}), t AS (SELECT * FROM gg UNION SELECT b.scene, b.r, b.c, t.label FROM t JOIN gg b ON b.scene = t.scene AND {near} AND t.label < b.label), lb AS (SELECT scene, r, c, min(label) AS label FROM t GROUP BY ALL)"
OFFSETS = lambda n: f"SELECT i, j FROM range(-{n}, {n + 1}) a(i), range(-{n}, {n + 1}) b(j) WHERE abs(i) + abs(j) <= {n}"

ORACLES = {
    "shape_descriptors": f"""WITH {RINGS}, {BOXES}, ar AS (SELECT k, sum(ax * b_y - bx * ay) / 2 AS a, sum((ax + bx) * (ax * b_y - bx * ay)) AS sx, sum((ay + b_y) * (ax * b_y - bx * ay)) AS sy, sum(sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2))) AS p FROM sd GROUP BY k),
w AS (SELECT *, greatest(u1 - u0, v1 - v0) AS l, least(u1 - u0, v1 - v0) AS w FROM ar JOIN bx USING (k) JOIN hl USING (k))
SELECT k AS slick_id, round(sx / (6 * a), 6) AS x, round(sy / (6 * a), 6) AS y, round(abs(a), 6) AS area_km2, round(p, 6) AS perimeter_km, round(l, 6) AS length_km, round(w, 6) AS width_km, round(l / w, 6) AS elongation, round(4 * pi() * abs(a) / (p * p), 6) AS compactness, round(abs(a) / hull, 6) AS solidity FROM w""",
    "geodesic_metrics": f"""WITH {RINGS}, g AS (SELECT k, 70 + ax / 100 AS ax, 15 + ay / 100 AS ay, 70 + bx / 100 AS bx, 15 + b_y / 100 AS b_y FROM sd)
SELECT k AS slick_id, round(abs(sum(radians(bx - ax) * (2 + sin(radians(ay)) + sin(radians(b_y))))) * 6371.0088e0 * 6371.0088e0 / 2, 6) AS area_km2, round(sum(6371.0088e0 * 2 * asin(sqrt(pow(sin(radians(b_y - ay) / 2), 2) + cos(radians(ay)) * cos(radians(b_y)) * pow(sin(radians(bx - ax) / 2), 2)))), 6) AS perimeter_km FROM g GROUP BY k""",
    "trail_ends": f"""WITH {RINGS}, {BOXES}, q AS (SELECT k, CAST(k * 3 % 47 AS DOUBLE) AS x, CAST(k * 5 % 31 AS DOUBLE) AS y FROM rg),
ds AS (SELECT k, CASE WHEN count(*) FILTER ({CROSSED}) % 2 = 1 THEN 0e0 ELSE min({OFF}) END AS d FROM (SELECT *, {T} FROM q JOIN sd USING (k)) GROUP BY k),
lo AS (SELECT *, x * ux + y * uy AS pu, y * ux - x * uy AS pv, (u0 + u1) / 2 AS cu, (v0 + v1) / 2 AS cv FROM q JOIN bx USING (k)),
en AS (SELECT k, CASE WHEN u1 - u0 >= v1 - v0 THEN least(sqrt(pow(pu - u0, 2) + pow(pv - cv, 2)), sqrt(pow(pu - u1, 2) + pow(pv - cv, 2))) ELSE least(sqrt(pow(pu - cu, 2) + pow(pv - v0, 2)), sqrt(pow(pu - cu, 2) + pow(pv - v1, 2))) END AS e FROM lo)
SELECT k AS slick_id, round(e, 6) AS end_km, round(d, 6) AS slick_km FROM en JOIN ds USING (k)""",
    "attached_vessels": f"""WITH {RINGS}, q AS (SELECT o_orderkey AS o, o_orderkey % 199 AS k, CAST(o_custkey AS VARCHAR) AS mmsi, o_orderkey * 13 % 500 / 10e0 AS x, o_orderkey * 17 % 400 / 10e0 AS y FROM orders),
ds AS (SELECT o, k, mmsi, CASE WHEN count(*) FILTER ({CROSSED}) % 2 = 1 THEN 0e0 ELSE min({OFF}) END AS d FROM (SELECT *, {T} FROM q JOIN sd USING (k)) GROUP BY ALL)
SELECT k AS scene, mmsi, round(min(d), 6) AS target_km FROM ds WHERE d <= 1 GROUP BY k, mmsi""",
    "land_points": f"WITH {HITS} SELECT pid, hit FROM hits",
    "beaching": f"""WITH {HITS}, fr AS (SELECT scene, tq, count(*) AS n, count(*) FILTER (hit) AS h, avg(x) FILTER (hit) AS x, avg(y) FILTER (hit) AS y FROM dp JOIN hits USING (pid) GROUP BY ALL), f0 AS (SELECT scene, arg_min(n, tq) AS n0, min(tq) AS t0 FROM fr GROUP BY scene),
sh AS (SELECT *, h / CAST(n0 AS DOUBLE) AS share FROM fr JOIN f0 USING (scene)), c AS (SELECT * FROM sh WHERE share >= 0.01 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY tq) = 1)
SELECT e.scene, round((c.tq - c.t0) / 3600, 6) AS eta_h, round(c.share, 6) AS share_at_contact, round(c.x, 6) AS x, round(c.y, 6) AS y, round(e.share, 6) AS share_end FROM (SELECT scene, arg_max(share, tq) AS share FROM sh GROUP BY scene) e LEFT JOIN c USING (scene)""",
    "outside_share": f"WITH {DRIFT} SELECT scene, round(avg(CASE WHEN abs(x) > 45 OR abs(y) > 45 THEN 1e0 ELSE 0e0 END), 6) AS outside FROM dp GROUP BY scene",
    "sized_domain": f"""WITH {DRIFT}, q AS (SELECT pid % 7 AS scene, x * (1 + pid % 7) / 4e0 AS x, y FROM dp), o AS (SELECT scene, avg(CAST(abs(x) > 30 OR abs(y) > 30 AS INT)) AS a, avg(CAST(abs(x) > 48 OR abs(y) > 48 AS INT)) AS b FROM q GROUP BY scene)
SELECT scene, CASE WHEN a <= 0.001 THEN 30e0 ELSE 48e0 END AS half_km, round(CASE WHEN a <= 0.001 THEN a ELSE b END, 6) AS outside, a <= 0.001 OR b <= 0.001 AS settled FROM o""",
    "band_contrast": f"""WITH RECURSIVE {TILES}, {MARKED("m", NEAR)}, i3 AS ({OFFSETS(3)}), i10 AS ({OFFSETS(10)}), a AS (SELECT DISTINCT scene, label, r + i AS r, c + j AS c FROM lb, i10), b AS (SELECT DISTINCT scene, label, r + i AS r, c + j AS c FROM lb, i3),
rn AS (SELECT label, a.scene, count(*) AS n, avg(v) AS v FROM (SELECT * FROM a EXCEPT SELECT * FROM b) a JOIN tl ON tl.scene = a.scene AND tl.r = a.r AND tl.c = a.c AND sea GROUP BY ALL), own AS (SELECT lb.scene, label, count(*) AS n, avg(v) AS v FROM lb JOIN tl USING (scene, r, c) GROUP BY ALL)
SELECT scene, label, round(CASE WHEN rn.n >= 20 AND own.n >= 5 THEN (rn.v - own.v) * 0.25e0 END, 6) AS contrast_db FROM own LEFT JOIN rn USING (scene, label)""",
    "at_sea": f"WITH {TILES}, o AS ({OFFSETS(8)}), la AS (SELECT DISTINCT scene, r + i AS r, c + j AS c FROM tl, o WHERE NOT sea) SELECT scene, r, c FROM tl WHERE v > 90 AND (scene, r, c) NOT IN (SELECT (scene, r, c) FROM la)",
    "outline_rings": f"""WITH RECURSIVE {TILES}, {MARKED("m", NEAR)}, sx AS (SELECT scene, label, r AS pr, c AS pc, r + dr0 AS r0, c + dc0 AS c0, r + dr1 AS r1, c + dc1 AS c1 FROM lb, (VALUES (0, 0, 0, 1), (0, 1, 1, 1), (1, 1, 1, 0), (1, 0, 0, 0)) d(dr0, dc0, dr1, dc1)),
ou AS (SELECT * FROM sx a WHERE NOT EXISTS (FROM sx b WHERE b.scene = a.scene AND b.label = a.label AND b.r0 = a.r1 AND b.c0 = a.c1 AND b.r1 = a.r0 AND b.c1 = a.c0)),
nx AS (SELECT a.scene, a.label, a.r0, a.c0, a.r1, a.c1, arg_min(b.c1, abs(a.pr - b.pr) + abs(a.pc - b.pc)) AS nc, arg_min(b.r1, abs(a.pr - b.pr) + abs(a.pc - b.pc)) AS nr FROM ou a JOIN ou b ON a.scene = b.scene AND a.label = b.label AND b.r0 = a.r1 AND b.c0 = a.c1 GROUP BY ALL),
wk AS (SELECT scene, label, r0 AS ring_r, c0 AS ring_c, r1 AS ring_r1, c1 AS ring_c1, 0 AS seq, r0, c0, r1, c1, nr, nc FROM nx
  UNION ALL SELECT w.scene, w.label, w.ring_r, w.ring_c, w.ring_r1, w.ring_c1, w.seq + 1, n.r0, n.c0, n.r1, n.c1, n.nr, n.nc FROM wk w JOIN nx n ON n.scene = w.scene AND n.label = w.label AND n.r0 = w.r1 AND n.c0 = w.c1 AND n.r1 = w.nr AND n.c1 = w.nc
  WHERE (n.r0, n.c0, n.r1, n.c1) > (w.ring_r, w.ring_c, w.ring_r1, w.ring_c1)),
bs AS (SELECT * FROM wk QUALIFY row_number() OVER (PARTITION BY scene, label, r0, c0, r1, c1 ORDER BY ring_r, ring_c, ring_r1, ring_c1) = 1)
SELECT scene, label, CAST(ring_r AS BIGINT) AS ring_r, CAST(ring_c AS BIGINT) AS ring_c, CAST(seq AS BIGINT) AS seq, CAST(r0 AS BIGINT) AS r, CAST(c0 AS BIGINT) AS c FROM bs""",
    "db_targets": f"WITH RECURSIVE {TILES}, {MARKED('v / 8 > 10', 'abs(b.r - t.r) <= 1 AND abs(b.c - t.c) <= 1')} SELECT scene, label, count(*) AS n_pixels, round(avg(r), 6) AS row, round(avg(c), 6) AS col, max(v) / 8 AS peak FROM lb JOIN tl USING (scene, r, c) GROUP BY ALL HAVING count(*) BETWEEN 2 AND 400",
    "stretched": f"WITH {TILES}, q AS (SELECT *, CASE WHEN v > 0 THEN 10 * log10(v) END AS db FROM tl), e AS (SELECT scene, quantile_cont(db, 0.02) AS lo, quantile_cont(db, 0.98) AS hi FROM q GROUP BY scene) SELECT scene, r, c, round(db, 6) AS db, CAST(CASE WHEN db IS NULL THEN 0 ELSE floor(greatest(0e0, least(1e0, (db - lo) / greatest(hi - lo, 1e-9))) * 255) END AS INT) AS grey FROM q JOIN e USING (scene)",
    "forcing_extent": "WITH q AS (SELECT user_id % 20 AS field, 10 + event_id % 83 / 4e0 AS lat, 65 + event_id % 71 / 4e0 AS lon, floor(epoch(ts) / 3600) * 3600e0 AS time FROM events) SELECT field, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, min(time) AS time_min, max(time) AS time_max, count(DISTINCT time) AS n_times, count(*) AS n_values FROM q GROUP BY field",
    "request_budget": "WITH q AS (SELECT event_id, user_id % 15 AS client, CAST(floor(epoch(ts)) AS BIGINT) AS t, 40 + event_id % 60 AS points FROM events), u AS (SELECT event_id, CAST(sum(points) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM q) SELECT event_id, used, used > 1500 AS waits FROM u",
    "request_endpoint": f"SELECT o_orderkey, CASE WHEN epoch(o_orderdate) > {NOW} - 518400 THEN 'forecast' ELSE 'archive' END AS endpoint FROM orders",
    "nearest_wind": """WITH s AS (SELECT i % 10 AS station, 1704067200e0 + i // 10 * 3600 AS at, i // 10 * 3 % 17 + i % 10 / 2e0 AS value FROM range(7440) q(i) WHERE (i // 10 * 7 + i % 10) % 5 <> 0), q AS (SELECT event_id AS qid, user_id % 10 AS station, epoch(ts) AS t FROM events),
a AS (SELECT qid, s.at, s.value, t FROM q ASOF LEFT JOIN s ON q.station = s.station AND q.t >= s.at), b AS (SELECT qid, s.at, s.value, t FROM q ASOF LEFT JOIN s ON q.station = s.station AND q.t <= s.at)
SELECT qid, CASE WHEN a.at IS NULL OR b.at - b.t < a.t - a.at THEN b.at ELSE a.at END AS at, CASE WHEN a.at IS NULL OR b.at - b.t < a.t - a.at THEN b.value ELSE a.value END AS value FROM a JOIN b USING (qid)""",
    "scan_list": "SELECT o_orderkey % 6 AS lane, epoch(o_orderdate) AS t, o_orderkey AS scene, round(o_orderkey % 100 / 99e0, 6) AS coverage, o_orderkey % 140 / 10e0 AS wind_ms FROM orders WHERE o_orderkey % 100 / 99e0 >= 0.95 AND o_orderkey % 140 / 10e0 BETWEEN 3.5 AND 10 ORDER BY lane, t, scene LIMIT 12",
    "source_states": """WITH n AS (SELECT s_suppkey, s_suppkey % 4 <> 0 AS integrated, (s_suppkey % 3 = 0 AND s_nationkey % 2 = 0) OR (s_suppkey % 5 = 0 AND 1 % 2 = 0) AS lacks FROM supplier)
SELECT s_suppkey AS source, NOT lacks AS configured, CASE WHEN integrated AND NOT lacks THEN 'ACTIVE' WHEN NOT lacks THEN 'READY_TO_INTEGRATE' ELSE 'NOT_CONFIGURED' END AS state FROM n""",
    "catalogue": "SELECT o_orderkey AS analysis_id, epoch(o_orderdate) AS changed, o_orderstatus AS status FROM orders ORDER BY changed DESC, analysis_id",
    "provider_rows": f"WITH {RAW}, q AS (SELECT *, CAST(mmsi AS BIGINT) % 3 AS provider FROM fixes), w AS (SELECT *, t - lag(t) OVER (PARTITION BY provider, mmsi ORDER BY t) AS step FROM q) SELECT provider, CAST(min(floor(t / 86400)) AS BIGINT) AS first_day, CAST(max(floor(t / 86400)) AS BIGINT) AS last_day, count(DISTINCT mmsi) AS n_vessels, count(*) AS n_positions, min(step) FILTER (step > 0) AS interval_s FROM w GROUP BY provider",
    "mask_source": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN 'SIDECAR' WHEN p_partkey % 5 < 3 AND p_partkey % 7 <> 0 THEN 'COASTLINE' ELSE 'NONE' END AS mask FROM part",
    "selected_components": """WITH q AS (SELECT p_partkey % 50 AS scene, p_partkey AS component_id, p_size, p_retailprice FROM part), a AS (SELECT * FROM q WHERE scene % 3 = 0 AND p_size % 7 = 0), b AS (SELECT * FROM q WHERE scene % 3 = 1 QUALIFY row_number() OVER (PARTITION BY scene ORDER BY p_retailprice DESC, component_id) = 1)
SELECT scene, component_id FROM a UNION ALL SELECT scene, component_id FROM b UNION ALL SELECT scene, component_id FROM q WHERE scene NOT IN (SELECT scene FROM a UNION SELECT scene FROM b)""",
    "single_label": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) ELSE 'UNCERTAIN' END AS label FROM orders GROUP BY o_custkey",
    "tag_number": "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 8e0 ELSE CAST(p_partkey AS DOUBLE) END END AS gray_per_db FROM part",
    "tracked_fixes": f"WITH {RAW}, q AS (SELECT src_order, mmsi || '-' || CAST(CAST(floor(t / 86400) AS BIGINT) AS VARCHAR) AS mmsi FROM fixes) SELECT * FROM q QUALIFY count(*) OVER (PARTITION BY mmsi) >= 2",
    "strict_json": """WITH q AS (SELECT o_orderkey AS k, o_orderstatus AS s, CASE WHEN o_orderkey % 4 < 2 THEN 'null' ELSE CAST(o_orderkey % 64 / 4e0 AS VARCHAR) END AS v FROM orders) SELECT '{"id":' || k || ',"status":"' || s || '","score":{"value":' || v || ',"values":[' || v || ',0.5]}}' AS document FROM q""",
    "cell_features": """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(round(70 + p_partkey % 64 / 32e0, 5) AS VARCHAR) || ',' || CAST(round(15 + p_partkey % 48 / 16e0, 5) AS VARCHAR) || ']},"properties":{"kind":"probability_cell","map":' || p_partkey % 4 || ',"probability":' || CAST(p_partkey % 256 / 256e0 AS VARCHAR) || '}}' AS feature FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 256 <> 0""",
    "track_features": f"""WITH {RAW}, q AS (SELECT mmsi, CAST(floor(t) AS BIGINT) AS t, round(round(lon * 16) / 16, 5) AS lon, round(round(lat * 16) / 16, 5) AS lat FROM fixes), g AS (SELECT mmsi, t // 86400 AS day, string_agg('[' || lon || ',' || lat || ']', ',' ORDER BY t, lon, lat) AS p, string_agg(CAST(t AS VARCHAR), ',' ORDER BY t, lon, lat) AS ts, count(*) AS n FROM q GROUP BY ALL)
SELECT mmsi, day, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || p || ']}},"properties":{{"mmsi":"' || mmsi || '","times":[' || ts || ']}}}}' AS feature FROM g WHERE n > 1""",
}
