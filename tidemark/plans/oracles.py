"""SQL that gives the rows of the registered queries on the same tables, written against the rules, not the plans."""

from ..sources.tables import PORTS, SITES

RAW = """
ev AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch(ts) AS t, (epoch(ts) - 1704067200e0) / 3600e0 AS h FROM events),
ev1 AS (SELECT *, 71e0 + ((user_id // 15) % 10) * 0.1e0 + 0.5e0 * cos(h * 0.0523598776e0 + user_id) AS lon0 FROM ev),
raw0 AS (SELECT event_id AS src_order, 0 AS dup, CAST(419000000 + user_id AS VARCHAR) AS mmsi, CASE WHEN k <> 98 THEN t END AS t,
  CASE WHEN k = 99 THEN 95e0 WHEN k = 97 THEN 0e0 ELSE 18e0 + (user_id % 15) * 0.1e0 + 0.5e0 * sin(h * 0.0654498469e0 + user_id) END AS lat,
  CASE WHEN k = 97 THEN 0e0 WHEN k IN (1, 2) THEN lon0 + 40e0 ELSE lon0 END AS lon,
  CASE WHEN k % 3 <> 0 THEN 'VESSEL ' || user_id END AS vessel_name,
  CASE WHEN k % 4 = 1 THEN CAST(60 + user_id % 30 AS VARCHAR) WHEN k % 4 = 2 THEN event_type END AS vessel_type, k FROM ev1),
raw AS (SELECT * FROM raw0 UNION ALL SELECT * REPLACE (1 AS dup) FROM raw0 WHERE k = 50),
ok AS (SELECT * FROM raw WHERE t IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
fixes AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY mmsi, t ORDER BY src_order, dup) AS rn FROM ok) WHERE rn = 1),
searched AS (SELECT * FROM fixes WHERE lat BETWEEN 17 AND 21 AND lon BETWEEN 70 AND 75)"""


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(6371.0088e0 * 2 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def modulo(x: str, n: str = "360e0") -> str:
    return f"({x} - {n} * floor(({x}) / {n}))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    return modulo(f"(degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))) + 360)")


def kin(source: str, name: str = "kin") -> str:
    return f"""{name}0 AS (SELECT *, lag(t) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM {source} WINDOW w AS (PARTITION BY mmsi ORDER BY t)),
{name} AS (SELECT *, t - t0 AS dt_s, {haversine('lat0', 'lon0', 'lat', 'lon')} AS dist_km, {bearing('lat0', 'lon0', 'lat', 'lon')} AS course_deg,
  CASE WHEN t - t0 > 0 THEN {haversine('lat0', 'lon0', 'lat', 'lon')} / ((t - t0) / 3600) / 1.852e0 END AS speed_kn FROM {name}0)"""


def spike_pass(source: str, name: str) -> str:
    return f"""{kin(source, name + 'k')},
{name}b AS (SELECT *, coalesce(speed_kn > 45, false) AS bi, t0 IS NULL AS fst FROM {name}k),
{name}c AS (SELECT *, coalesce(lead(bi) OVER (PARTITION BY mmsi ORDER BY t), false) AS bo, lead(t) OVER (PARTITION BY mmsi ORDER BY t) IS NULL AS lst FROM {name}b),
{name}d AS (SELECT *, bi AND bo AS inn, (fst AND bo) OR (lst AND bi) AS en FROM {name}c),
{name} AS (SELECT src_order, dup, mmsi, t, lat, lon FROM {name}d WHERE NOT CASE WHEN (SELECT bool_or(inn) FROM {name}d) THEN inn ELSE en END)"""


GRID = "grid AS (SELECT 1704844800e0 + i * 3600e0 AS tq, i FROM range(49) r(i))"
CLOUD = """cloud AS (SELECT tq, CAST(p AS INT) AS pid, -30e0 + 1.1e0 * h + 6e0 * sin(p * 1.7e0) + 2e0 * sin(p * 0.37e0 + h) AS px, -10e0 + 0.6e0 * h + 6e0 * cos(p * 2.3e0) + 2e0 * cos(p * 0.53e0 + h) AS py
  FROM (SELECT tq, (tq - 1704844800e0) / 3600e0 AS h FROM grid), range(200) r(p))"""
INTERP = """span AS (SELECT mmsi, min(t) AS a, max(t) AS b FROM searched GROUP BY mmsi),
asked AS (SELECT mmsi, tq FROM span, grid WHERE tq BETWEEN a AND b),
prv AS (SELECT q.mmsi, q.tq, f.t AS pt, f.lat AS plat, f.lon AS plon FROM asked q ASOF JOIN searched f ON q.mmsi = f.mmsi AND q.tq >= f.t),
nxt AS (SELECT q.mmsi, q.tq, f.t AS nt, f.lat AS nlat, f.lon AS nlon FROM asked q ASOF JOIN searched f ON q.mmsi = f.mmsi AND q.tq <= f.t),
interp AS (SELECT mmsi, tq, plat + f * (nlat - plat) AS lat, plon + f * (nlon - plon) AS lon FROM (SELECT *, CASE WHEN nt > pt THEN (tq - pt) / (nt - pt) ELSE 0e0 END AS f FROM prv JOIN nxt USING (mmsi, tq) WHERE nt - pt <= 86400)),
pos AS (SELECT *, (lon - 71.4e0) * 111.32e0 * cos(radians(18.7e0)) AS x, (lat - 18.7e0) * 111.32e0 AS y FROM interp)"""
NEAR = """near AS (SELECT mmsi, tq, min(d) AS d_km, count(*) AS n_near, count(*) / 200e0 AS fraction
  FROM (SELECT mmsi, tq, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS d FROM pos JOIN cloud USING (tq)) WHERE d <= 10 GROUP BY mmsi, tq)"""
EDGES = """edges(x1, y1, x2, y2) AS (VALUES (-35e0, -20e0, -10e0, -22e0), (-10e0, -22e0, 0e0, -5e0), (0e0, -5e0, -12e0, 8e0), (-12e0, 8e0, -32e0, 4e0), (-32e0, 4e0, -35e0, -20e0)),
reg AS (SELECT mmsi, tq, CASE WHEN sum(crs) % 2 = 1 THEN 0e0 ELSE min(away) END AS d_region_km FROM (
  SELECT mmsi, tq, sqrt(pow(x - x1 - f * (x2 - x1), 2) + pow(y - y1 - f * (y2 - y1), 2)) AS away, CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END AS crs
  FROM (SELECT *, greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS f FROM pos, edges)) GROUP BY mmsi, tq)"""
CAND = """b1 AS (SELECT mmsi, min(d_km) AS min_d_st_km, arg_min(tq, (d_km, tq)) AS t_best_st, max(fraction) AS max_fraction FROM near GROUP BY mmsi),
b2 AS (SELECT mmsi, min(d_region_km) AS min_d_region_km, arg_min(tq, (d_region_km, tq)) AS t_best_region FROM reg GROUP BY mmsi),
cand AS (SELECT *, min_d_region_km <= 20 OR coalesce(min_d_st_km <= 10, false) AS candidate FROM b2 LEFT JOIN b1 USING (mmsi)),
centre AS (SELECT mmsi, coalesce(t_best_st, t_best_region) AS tc, min_d_st_km, min_d_region_km, candidate FROM cand)"""
FOUND = ", ".join((RAW, GRID, CLOUD, INTERP, NEAR, EDGES, CAND))
OIL = """anch AS (SELECT p.mmsi, p.x, p.y FROM pos p JOIN centre c ON p.mmsi = c.mmsi AND p.tq = c.tc WHERE c.min_d_st_km IS NOT NULL),
dens AS (SELECT mmsi, tq, count(*) / 200e0 AS c FROM anch, cloud WHERE sqrt(pow(x - px, 2) + pow(y - py, 2)) <= 3 GROUP BY mmsi, tq),
oil0 AS (SELECT mmsi, sum(tq * c) / sum(c) AS t_oil, max(c) AS peak FROM dens GROUP BY mmsi),
oil AS (SELECT mmsi, t_oil, sqrt(sum(pow(tq - t_oil, 2) * c) / sum(c)) AS spread_s, any_value(peak) AS peak FROM dens JOIN oil0 USING (mmsi) GROUP BY mmsi, t_oil)"""
TURN = lambda a, b: f"abs({modulo(f'({a} - {b} + 180)')} - 180)"
BEHAVE = f"""{kin('searched')},
bh0 AS (SELECT k.*, tc, abs(t - tc) <= 86400 AS nr FROM kin k JOIN centre USING (mmsi)),
bh1 AS (SELECT *, min(CASE WHEN nr THEN t END) OVER (PARTITION BY mmsi) AS ti, max(CASE WHEN nr THEN t END) OVER (PARTITION BY mmsi) AS tu FROM bh0),
bh2 AS (SELECT *, t < ti AND t >= ti - 259200 AS bef, t > tu AND t <= tu + 259200 AS aft FROM bh1 WHERE ti IS NOT NULL),
tn AS (SELECT mmsi, max(turn) AS mt FROM (SELECT mmsi, {TURN('course_deg', 'lag(course_deg) OVER (PARTITION BY mmsi ORDER BY t)')} AS turn FROM bh2 WHERE nr AND course_deg IS NOT NULL) GROUP BY mmsi),
bh3 AS (SELECT mmsi, avg(speed_kn) FILTER (bef) AS kn_before, avg(speed_kn) FILTER (nr) AS kn_near, avg(speed_kn) FILTER (aft) AS kn_after, median(course_deg) FILTER (bef) AS cb, median(course_deg) FILTER (aft) AS ca,
  coalesce(sum(dt_s) FILTER (nr AND speed_kn < 2), 0e0) AS slow_s FROM bh2 GROUP BY mmsi),
bh4 AS (SELECT *, CASE WHEN kn_before IS NULL THEN kn_after WHEN kn_after IS NULL THEN kn_before ELSE (kn_before + kn_after) / 2 END AS ref FROM bh3 LEFT JOIN tn USING (mmsi)),
bh AS (SELECT mmsi, kn_before, kn_near, kn_after, CASE WHEN ref > 0.5 THEN kn_near / ref END AS slowdown, coalesce(mt, 0e0) AS max_turn_deg, {TURN('ca', 'cb')} AS net_turn_deg, slow_s / 60 AS slow_min FROM bh4)"""
CONT = """gp AS (SELECT mmsi, t0 AS gs, t AS ge, dt_s / 60 AS dm FROM kin WHERE dt_s / 60 > 720),
cont AS (SELECT c.mmsi, count(dm) AS all_gaps, count(*) FILTER (ge >= tc - 86400 AND gs <= tc + 86400) AS relevant_gaps, coalesce(max(dm) FILTER (ge >= tc - 86400 AND gs <= tc + 86400), 0e0) AS max_relevant_gap_min FROM centre c LEFT JOIN gp USING (mmsi) GROUP BY c.mmsi)"""


def kind(x: str) -> str:
    t = f"lower(trim({x}))"
    n = f"CAST(floor(TRY_CAST({t} AS DOUBLE)) AS INT)"
    words = "".join(f" WHEN contains({t}, '{a}') THEN '{b}'" for a, b in (("tanker", "tanker"), ("oil", "tanker"), ("chemical", "tanker"), ("cargo", "cargo"), ("bulk", "bulk_carrier"), ("container", "container"), ("tug", "tug"), ("passenger", "passenger"), ("ferry", "passenger"), ("fishing", "fishing"), ("towing", "tug"), ("hsc", "passenger"), ("high speed", "passenger")))
    return f"""CASE WHEN {x} IS NULL OR {t} IN ('', 'nan', 'none') THEN 'unknown' WHEN TRY_CAST({t} AS DOUBLE) IS NOT NULL THEN CASE WHEN {n} BETWEEN 80 AND 89 THEN 'tanker' WHEN {n} BETWEEN 70 AND 79 THEN 'cargo' WHEN {n} BETWEEN 60 AND 69 THEN 'passenger'
 WHEN {n} = 30 THEN 'fishing' WHEN {n} IN (31, 32, 52) THEN 'tug' ELSE 'other' END{words} ELSE 'other' END"""


SCORE = f"""kn AS (SELECT mmsi, {kind('vt')} AS kind FROM (SELECT mmsi, arg_min(vessel_type, (t, src_order)) FILTER (vessel_type IS NOT NULL) AS vt FROM ok GROUP BY mmsi)),
ft AS (SELECT c.mmsi, c.min_d_region_km AS ds, c.min_d_st_km AS dst, abs(c.tc - t_oil) / 3600 AS dth, slowdown, net_turn_deg, slow_min, max_relevant_gap_min AS gap, kind, CAST(c.mmsi AS BIGINT) % 10 = 3 AS sar
  FROM centre c LEFT JOIN bh USING (mmsi) LEFT JOIN cont USING (mmsi) LEFT JOIN oil USING (mmsi) LEFT JOIN kn USING (mmsi) WHERE candidate),
fs AS (SELECT mmsi, exp(-greatest(ds, 0e0) / 5) AS spatial, coalesce(exp(-dth / 4), 0e0) AS temporal, CASE WHEN dst IS NULL THEN 0e0 ELSE exp(-greatest(dst, 0e0) / 3) END AS trajectory, CASE WHEN sar THEN 1e0 ELSE 0e0 END AS sar_attached,
  CASE kind WHEN 'tanker' THEN 1e0 WHEN 'cargo' THEN 0.7e0 WHEN 'bulk_carrier' THEN 0.7e0 WHEN 'container' THEN 0.6e0 WHEN 'passenger' THEN 0.4e0 WHEN 'fishing' THEN 0.3e0 WHEN 'other' THEN 0.4e0 ELSE 0.5e0 END AS vessel_type,
  least(1e0, 0.6e0 * CASE WHEN slowdown IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, 1 - slowdown)) END + 0.25e0 * least(1e0, coalesce(net_turn_deg, 0e0) / 90) + 0.15e0 * least(1e0, coalesce(slow_min, 0e0) / 120)) AS behavior,
  least(1e0, coalesce(gap, 0e0) / 120) AS ais_continuity FROM ft),
sc AS (SELECT *, 100 * (0.25e0 * spatial + 0.25e0 * temporal + 0.15e0 * trajectory + 0.15e0 * sar_attached + 0.07e0 * vessel_type + 0.08e0 * behavior + 0.05e0 * ais_continuity) AS score FROM fs),
best AS (SELECT mmsi, round(score, 5) AS score, CAST(row_number() OVER (ORDER BY round(score, 5) DESC, mmsi) AS INT) AS rank FROM sc QUALIFY rank <= 10)"""
SCORED = ", ".join((FOUND, OIL, BEHAVE, CONT, SCORE))
PARTICLES = """cloud AS MATERIALIZED (SELECT 1704844800e0 + h * 3600e0 AS tq, CAST(p AS INT) AS pid, -30e0 + 1.1e0 * h + 6e0 * sin(p * 1.7e0) + 2e0 * sin(p * 0.37e0 + h) AS px, -10e0 + 0.6e0 * h + 6e0 * cos(p * 2.3e0) + 2e0 * cos(p * 0.53e0 + h) AS py
  FROM (SELECT o_orderkey // 49 AS p, CAST(o_orderkey % 49 AS DOUBLE) AS h FROM orders))"""
HIST = """lab AS (SELECT CAST(event_id % 3 AS INT) AS label, event_id * 37 % 1201 / 10e0 - 60 AS px, event_id * 53 % 803 / 10e0 - 40 AS py FROM events),
hist AS (SELECT label, CAST(floor((px + 60) / 2) AS INT) AS ix, CAST(floor((py + 40) / 2) AS INT) AS iy, count(*) AS n FROM lab GROUP BY ALL)"""
KDE = """ker AS (SELECT CAST(k AS INT) AS k, exp(-0.5e0 * pow(k / 1.5e0, 2)) / (SELECT sum(exp(-0.5e0 * pow(j / 1.5e0, 2))) FROM range(-6, 7) q(j)) AS w FROM range(-6, 7) r(k)),
kx AS (SELECT label, ix + k AS ix, iy, sum(n * w) AS v FROM hist, ker GROUP BY ALL), kde AS (SELECT label, ix, iy + k AS iy, sum(v * w) AS density FROM kx, ker GROUP BY label, ix, iy + k)"""
DRIFT = ", ".join((HIST, KDE))
SHARE = "sh AS (SELECT label, ix, iy, n / sum(n) OVER (PARTITION BY label) AS p FROM hist)"
PIX = """pix AS (SELECT CAST(o_orderkey // 1500 AS INT) AS scene, CAST(o_orderkey // 50 % 30 AS INT) AS r, CAST(o_orderkey % 50 AS INT) AS c FROM orders),
px AS (SELECT *, CAST((r * 7919 + c * 104729 + scene * 31) % 101 AS DOUBLE) + CASE WHEN r % 23 = 7 AND c % 29 = 11 THEN 200e0 ELSE 0e0 END AS v FROM pix),
mask AS (SELECT scene, r, c, CASE WHEN (r // 7 + c // 5 + scene) % 3 = 0 THEN 1 WHEN (r * 5 + c * 3) % 41 = 0 THEN 1 ELSE 0 END AS m FROM pix)"""
LABELS = "g AS (SELECT scene, r, c, CAST(r AS BIGINT) * 4294967296 + c AS label FROM mask WHERE m = 1), t AS (SELECT * FROM g UNION SELECT b.scene, b.r, b.c, t.label FROM t JOIN g b ON b.scene = t.scene AND abs(b.r - t.r) <= 1 AND abs(b.c - t.c) <= 1 AND t.label < b.label), lb AS (SELECT scene, r, c, min(label) AS label FROM t GROUP BY ALL), sz AS (SELECT scene, label, count(*) AS n_pixels FROM lb GROUP BY ALL)"
DIST = lambda lon1, lat1, lon2, lat2: f"sqrt(pow(({lon2} - {lon1}) * 111.32e0 * cos(radians(({lat1} + {lat2}) / 2)), 2) + pow(({lat2} - {lat1}) * 111.32e0, 2))"
BRG = lambda lon1, lat1, lon2, lat2: modulo(f"(degrees(atan2(({lon2} - {lon1}) * 111.32e0 * cos(radians(({lat1} + {lat2}) / 2)), ({lat2} - {lat1}) * 111.32e0)) + 360)")
PORT = "ports(port, lon, lat) AS (VALUES " + ", ".join(f"('{n}', {x}e0, {y}e0)" for n, x, y in PORTS) + ")"
SITE = "sites(site, kind, lon, lat, radius_km, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {x}e0, {y}e0, {r}e0, {w})" for a, b, x, y, r, w in SITES) + ")"
SLICK = "slicks AS (SELECT i AS spill_id, CAST(8 + (i * 5 % 14) AS DOUBLE) AS lat, CAST(70 + (i * 7 % 22) AS DOUBLE) AS lon, CAST(1 + i % 5 AS DOUBLE) AS radius_km, (i % 6) * 0.5e0 AS speed_kmh, CAST(i * 47 % 360 AS DOUBLE) AS bearing_deg FROM (SELECT s_suppkey AS i FROM supplier))"
BASIN = lambda x, y: f"CASE WHEN {x} >= 91 THEN 'AN' WHEN {y} < 8 AND {x} < 82.5 THEN 'S' WHEN {x} < 77.8 THEN 'W' ELSE 'E' END"
SPILL = """sp AS (SELECT o_orderkey AS spill_id, o_totalprice * 300.1234567e0 AS area_m2, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 70 AS DOUBLE) END AS coast_km, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 120 AS DOUBLE) END AS eta,
  o_orderkey % 2 = 0 AS modelled, (o_orderkey % 9) / 10e0 AS exposure, o_orderkey % 4 AS nt, ['Heavy fuel oil', 'Marine diesel', 'UNKNOWN', 'medium crude'][o_orderkey % 4 + 1] AS oil, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 16 AS DOUBLE) END AS wind FROM orders),
sv0 AS (SELECT spill_id, area_m2, greatest(0e0, least(1e0, log10(greatest(1e-6, area_m2 / 1e6) / 0.05e0) / log10(100 / 0.05e0))) AS size, coalesce(exp(-coast_km / 25), 0e0) AS coast,
  coalesce(CASE WHEN modelled THEN 1e0 ELSE 0.85e0 END * exp(-CASE WHEN eta IS NULL THEN NULL ELSE greatest(0e0, eta - 24) END / 72), 0e0) AS beaching, CASE WHEN nt > 0 THEN least(1e0, exposure + 0.05e0 * (nt - 1)) ELSE 0e0 END AS sensitivity,
  CASE WHEN lower(oil) SIMILAR TO '.*(heavy|crude).*' THEN 1e0 WHEN lower(oil) LIKE '%diesel%' THEN 0.35e0 ELSE 0.7e0 END * CASE WHEN wind > 10 THEN 0.8e0 ELSE 1e0 END AS persistence FROM sp),
sv1 AS (SELECT *, 100 * (0.2e0 * size + 0.15e0 * coast + 0.25e0 * beaching + 0.25e0 * sensitivity + 0.15e0 * persistence) / (0.2e0 + 0.15e0 + 0.25e0 + 0.25e0 + 0.15e0) AS score FROM sv0),
sev AS (SELECT * EXCLUDE (area_m2), CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MODERATE' ELSE 'LOW' END AS level, area_m2 * 5e0 * 1e-6 * 0.9e0 AS tonnes,
  CASE WHEN area_m2 * 0.3e0 * 1e-6 * 0.9e0 < 700 THEN 'Tier 1' WHEN area_m2 * 0.3e0 * 1e-6 * 0.9e0 <= 10000 THEN 'Tier 2' ELSE 'Tier 3' END AS tier_low, CASE WHEN area_m2 * 5e0 * 1e-6 * 0.9e0 < 700 THEN 'Tier 1' WHEN area_m2 * 5e0 * 1e-6 * 0.9e0 <= 10000 THEN 'Tier 2' ELSE 'Tier 3' END AS tier,
  CASE WHEN area_m2 * 50e0 * 1e-6 * 0.9e0 < 700 THEN 'Tier 1' WHEN area_m2 * 50e0 * 1e-6 * 0.9e0 <= 10000 THEN 'Tier 2' ELSE 'Tier 3' END AS tier_high FROM sv1)"""
MAN = "man AS (SELECT o_orderkey AS k, o_custkey AS bundle, 'f/' || o_orderkey AS path, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority) AS sha256 FROM orders), roots AS (SELECT bundle, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path || ':' || sha256)) AS root, count(*) AS n FROM man GROUP BY bundle)"
COMP = """cm AS (SELECT p_partkey % 5 AS scene, p_partkey AS component_id, CAST(1 + p_size % 9 AS DOUBLE) AS el, (p_partkey % 10) / 10e0 AS so, 0.2e0 + (p_partkey % 31) / 10e0 AS co, (p_partkey % 13) / 4e0 AS tk, (p_partkey % 7) / 3e0 AS ek, p_size / 4e0 AS lk, p_retailprice / 20e0 AS ar, (p_partkey % 17) / 17e0 AS pr FROM part),
tg0 AS (SELECT *, tk <= 1 AND el >= 4 AND ek <= greatest(1e0, 0.15e0 * lk) AS ship_trail FROM cm),
tg1 AS (SELECT *, CASE WHEN ship_trail THEN 2e0 ELSE 0e0 END + CASE WHEN el >= 4 THEN 1e0 ELSE 0e0 END + CASE WHEN co >= 2 THEN 1e0 ELSE 0e0 END AS o, CASE WHEN co < 1 THEN 1e0 ELSE 0e0 END + CASE WHEN so < 0.3 AND el < 3 THEN 1e0 ELSE 0e0 END + CASE WHEN ar > 50 AND el < 3 THEN 1e0 ELSE 0e0 END AS l FROM tg0)"""
UPSERT_FROM = "TIMESTAMP '2024-01-16 00:00:00'"
STATES = "st AS (SELECT user_id, event_id, ['QUEUED', 'RUNNING', 'COMPLETED', 'PARTIAL', 'FAILED'][event_id % 5 + 1] AS status, value, ts FROM events)"
LAST = lambda where: f"SELECT user_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, arg_max(value, event_id) AS value FROM st WHERE {where} GROUP BY user_id"

ORACLES = {
    "bbox_time_scan": f"WITH {RAW} SELECT src_order, dup, mmsi, round(t, 6) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ok WHERE lat BETWEEN 17 AND 21 AND lon BETWEEN 70 AND 75 AND t BETWEEN 1704844800 AND 1705017600",
    "vessel_semi_select": f"WITH {RAW} SELECT src_order, dup, mmsi, round(t, 6) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM raw WHERE (t BETWEEN 1704844800 AND 1705017600 OR t IS NULL) AND mmsi IN (SELECT mmsi FROM raw WHERE lat BETWEEN 18 AND 18.6 AND lon BETWEEN 71 AND 71.5 AND t BETWEEN 1704844800 AND 1705017600)",
    "cleaning_report": f"WITH {RAW} SELECT (SELECT count(*) FROM raw) AS input_rows, (SELECT count(*) FROM raw WHERE t IS NULL) AS missing_timestamp, (SELECT count(*) FROM raw WHERE t IS NOT NULL AND (abs(lat) > 90 OR abs(lon) > 180)) AS invalid_coordinates, (SELECT count(*) FROM raw WHERE t IS NOT NULL AND lat = 0 AND lon = 0) AS null_island, (SELECT count(*) FROM ok) - (SELECT count(*) FROM fixes) AS duplicates, (SELECT count(DISTINCT mmsi) FROM ok) AS vessels",
    "dedupe_keep_first": f"WITH {RAW} SELECT src_order, dup, mmsi, t FROM fixes",
    "thin_bins": f"WITH {RAW} SELECT mmsi, CAST(floor(t / 21600) AS BIGINT) AS bin, round(t, 6) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fixes QUALIFY row_number() OVER (PARTITION BY mmsi, floor(t / 21600) ORDER BY t, src_order) = 1",
    "static_first_nonnull": f"WITH {RAW} SELECT mmsi, arg_min(vessel_name, (t, src_order)) FILTER (vessel_name IS NOT NULL) AS vessel_name, arg_min(vessel_type, (t, src_order)) FILTER (vessel_type IS NOT NULL) AS vessel_type FROM ok GROUP BY mmsi",
    "vessel_type": f"WITH k AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN ['Oil Products ', 'Bulk ', 'High Speed ', 'Towing ', 'Pleasure '][p_partkey % 5 + 1] || p_type ELSE (p_size + 40) || '.0' END AS raw FROM part) SELECT p_partkey, raw, {kind('raw')} AS kind FROM k",
    "kinematics": f"WITH {RAW}, {kin('fixes')} SELECT mmsi, round(t, 6) AS t, round(dt_s, 6) AS dt_s, round(dist_km, 6) AS dist_km, round(course_deg, 6) AS course_deg, round(speed_kn, 6) AS speed_kn FROM kin",
    "spike_fixpoint": f"WITH {RAW}, {spike_pass('fixes', 'p1')}, {spike_pass('p1', 'p2')}, {spike_pass('p2', 'p3')} SELECT mmsi, t, src_order FROM p3",
    "gaps": f"WITH {RAW}, {kin('searched')} SELECT mmsi, round(t0, 6) AS gap_start, round(t, 6) AS gap_end, round(dt_s / 60, 6) AS duration_min, round(dist_km, 6) AS dist_km, round(speed_kn, 6) AS implied_speed_kn FROM kin WHERE dt_s / 60 > 1440",
    "track_quality": f"WITH {RAW}, {kin('fixes')} SELECT mmsi, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, round(median(dt_s), 6) AS median_interval_s FROM kin GROUP BY mmsi",
    "interp_at": f"WITH {RAW}, {GRID}, {INTERP} SELECT mmsi, tq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM interp",
    "nearest_frame": f"WITH {RAW} SELECT mmsi, t AS tq, (SELECT CAST(arg_min(i, (abs(f.t - 1704844800e0 - i * 21600e0), i)) AS INT) FROM range(9) r(i)) AS frame FROM fixes f WHERE t BETWEEN 1704844800 AND 1705017600",
    "cloud_interp": f"WITH {PARTICLES}, q AS (SELECT 1704844800e0 + i * 1000e0 AS tq, 1704844800e0 + i * 1000 // 3600 * 3600e0 AS t0 FROM range(60) r(i)) SELECT q.tq, a.pid, round(a.px + (q.tq - a.tq) / 3600 * (coalesce(b.px, a.px) - a.px), 6) AS px, round(a.py + (q.tq - a.tq) / 3600 * (coalesce(b.py, a.py) - a.py), 6) AS py FROM q JOIN cloud a ON a.tq = q.t0 LEFT JOIN cloud b ON b.pid = a.pid AND b.tq = q.t0 + 3600",
    "corridor_nn": f"WITH {FOUND} SELECT mmsi, tq, round(d_km, 6) AS d_km FROM near",
    "corridor_fraction": f"WITH {FOUND} SELECT mmsi, tq, n_near, round(fraction, 6) AS fraction FROM near",
    "region_distance": f"WITH {FOUND} SELECT mmsi, tq, round(d_region_km, 6) AS d_region_km FROM reg",
    "corridor_candidates": f"WITH {FOUND} SELECT mmsi, round(min_d_region_km, 6) AS min_d_region_km, t_best_region, round(min_d_st_km, 6) AS min_d_st_km, t_best_st, round(max_fraction, 6) AS max_fraction, candidate, CASE WHEN candidate THEN 'candidate' ELSE 'never within 20 km of the source or 10 km of the oil' END AS reason FROM cand",
    "temporal_feature": f"WITH {FOUND}, {OIL} SELECT mmsi, round(t_oil, 4) AS t_oil, round(spread_s, 4) AS spread_s, round(peak, 4) AS peak FROM oil",
    "behaviour": f"WITH {FOUND}, {BEHAVE} SELECT mmsi, round(kn_before, 5) AS kn_before, round(kn_near, 5) AS kn_near, round(kn_after, 5) AS kn_after, round(slowdown, 5) AS slowdown, round(max_turn_deg, 5) AS max_turn_deg, round(net_turn_deg, 5) AS net_turn_deg, round(slow_min, 5) AS slow_min FROM bh",
    "continuity": f"WITH {FOUND}, {kin('searched')}, {CONT} SELECT mmsi, all_gaps, relevant_gaps, round(max_relevant_gap_min, 6) AS max_relevant_gap_min FROM cont",
    "evidence_score": f"WITH {SCORED} SELECT mmsi, round(spatial, 5) AS spatial, round(temporal, 5) AS temporal, round(trajectory, 5) AS trajectory, round(sar_attached, 5) AS sar_attached, round(vessel_type, 5) AS vessel_type, round(behavior, 5) AS behavior, round(ais_continuity, 5) AS ais_continuity, round(score, 5) AS score FROM sc",
    "top_candidates": f"WITH {SCORED} SELECT mmsi, score, rank FROM best",
    "separation": f"WITH {SCORED} SELECT a.mmsi, a.score, round(a.score - b.score, 5) AS margin, coalesce(a.score - b.score, 100e0) >= 10 AS separated FROM best a LEFT JOIN best b ON b.rank = 2 WHERE a.rank = 1",
    "triage": f"WITH {COMP} SELECT scene, component_id, CASE WHEN o + 0.5 - l >= 1.5 THEN 'OIL_LIKELY' WHEN l - o - 0.5 >= 1.5 THEN 'LOOKALIKE_LIKELY' ELSE 'UNCERTAIN' END AS label, o + 0.5e0 AS oil_points, l AS lookalike_points, ship_trail, round(o + 0.5e0 - l + pr, 3) AS triage_score, CAST(row_number() OVER (PARTITION BY scene ORDER BY round(o + 0.5e0 - l + pr, 3) DESC, component_id) AS INT) AS triage_rank FROM tg1",
    "triage_counts": f"WITH {COMP} SELECT CASE WHEN o - l - 1.5 >= 1.5 THEN 'OIL_LIKELY' WHEN l + 1.5 - o >= 1.5 THEN 'LOOKALIKE_LIKELY' ELSE 'UNCERTAIN' END AS label, count(*) AS n, count(*) FILTER (ship_trail) AS trails FROM tg1 GROUP BY 1",
    "robustness": """WITH fac AS (SELECT i, CAST(419000000 + i AS VARCHAR) AS mmsi, CAST(i + 1 AS INT) AS base_rank, j, ((i * 7 + j * 5) % 11) / 10e0 AS v FROM (SELECT s_suppkey AS i FROM supplier) a, range(4) b(j)), w AS (SELECT s, j, (s * (17 + 6 * j) + 11 * j) % 97 / 97e0 AS w FROM range(400) a(s), range(4) b(j)),
sc AS (SELECT s, mmsi, base_rank, round(sum(v * w) / sum(w), 9) AS x FROM fac JOIN w USING (j) WHERE w > 0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY x DESC, base_rank) AS r FROM sc)
SELECT mmsi, base_rank, round(avg(CAST(r = 1 AS INT)), 6) AS p_first, round(avg(CAST(r <= 3 AS INT)), 6) AS p_top3, CAST(floor(quantile_cont(r, 0.05)) AS INT) AS rank_p05, CAST(floor(quantile_cont(r, 0.95)) AS INT) AS rank_p95, CASE WHEN base_rank = 1 THEN CASE WHEN avg(CAST(r = 1 AS INT)) >= 0.8 THEN 'ROBUST' WHEN avg(CAST(r = 1 AS INT)) >= 0.5 THEN 'LIKELY' ELSE 'CONTESTED' END END AS verdict FROM rk GROUP BY mmsi, base_rank""",
    "hist2d": f"WITH {DRIFT} SELECT label, ix, iy, n FROM hist",
    "kde": f"WITH {DRIFT} SELECT label, ix, iy, round(density, 6) AS density FROM kde",
    "mass_maps": f"WITH {DRIFT}, m AS (SELECT label, ix, iy, density / sum(density) OVER (PARTITION BY label) AS p FROM kde) SELECT ix, iy, round(sum(p) / 3, 9) AS p FROM m GROUP BY ix, iy",
    "hdr": f"WITH {DRIFT}, {SHARE}, o AS (SELECT *, sum(p) OVER (PARTITION BY label ORDER BY p DESC, ix, iy ROWS UNBOUNDED PRECEDING) - p AS before FROM sh), e AS (SELECT label, min(p) FILTER (before < 0.7995) AS edge FROM o GROUP BY label) SELECT label, ix, iy, round(p, 9) AS p FROM o JOIN e USING (label) WHERE p >= edge",
    "centre_spread": f"WITH {DRIFT}, {SHARE}, s AS (SELECT label, sum(p * x) / sum(p) AS cx, sum(p * y) / sum(p) AS cy, sum(p * x * x) / sum(p) AS xx, sum(p * y * y) / sum(p) AS yy FROM (SELECT *, -60e0 + (ix + 0.5e0) * 2 AS x, -40e0 + (iy + 0.5e0) * 2 AS y FROM sh) GROUP BY label) SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(sqrt(greatest(0e0, xx - cx * cx + yy - cy * cy)), 6) AS spread FROM s",
    "fill_stranded": f"WITH {PARTICLES}, g AS (SELECT pid, CAST((tq - 1704844800e0) / 3600 AS INT) AS step, px, py FROM cloud), n AS (SELECT pid, step, CASE WHEN step = 0 OR (step + pid) % 4 <> 3 THEN px END AS px, CASE WHEN step = 0 OR (step + pid) % 4 <> 3 THEN py END AS py FROM g) SELECT pid, step, round(coalesce(px, lag(px) OVER w), 6) AS px, round(coalesce(py, lag(py) OVER w), 6) AS py FROM n WINDOW w AS (PARTITION BY pid ORDER BY step)",
    "advect": "WITH RECURSIVE a AS (SELECT CAST(i % 6 AS INT) AS member, i AS pid, 0 AS step, CAST((i * 13) % 20 - 10 AS DOUBLE) AS x, CAST((i * 7) % 20 - 10 AS DOUBLE) AS y, 0.02e0 + 0.004e0 * (i % 6) AS f FROM range(300) r(i) UNION ALL SELECT member, pid, step + 1, x + 1e0 * (0.5e0 - 0.02e0 * y + f * 6e0), y + 1e0 * (0.1e0 + 0.02e0 * x + f * -3e0), f FROM a WHERE step < 24) SELECT member, pid, step, round(x, 6) AS x, round(y, 6) AS y FROM a",
    "field_sample": """WITH f AS (SELECT i // 121 AS it, i // 11 % 11 AS iy, i % 11 AS ix FROM range(726) r(i)), p AS (SELECT i AS id, i % 40 / 9e0 AS ft, i * 7 % 80 / 9e0 AS fy, i * 11 % 80 / 9e0 AS fx FROM (SELECT event_id AS i FROM events)),
w AS (SELECT id, greatest(0e0, 1 - abs(ft - it)) * greatest(0e0, 1 - abs(fy - iy)) * greatest(0e0, 1 - abs(fx - ix)) AS w, 0.1e0 * it + 0.3e0 * iy * ix AS u, 1e0 * it - 0.2e0 * ix AS v FROM p JOIN f ON abs(ft - it) < 1 AND abs(fy - iy) < 1 AND abs(fx - ix) < 1) SELECT id, round(sum(w * u), 6) AS u, round(sum(w * v), 6) AS v FROM w GROUP BY id""",
    "coverage": """WITH f AS (SELECT 'om_' || i AS file, 68e0 + i % 5 AS w, 15e0 + i % 4 AS s, 72e0 + i % 7 AS e, 19e0 + i % 5 AS n, 1704844800e0 - (i % 3) * 86400e0 AS t0, 1704844800e0 + (i % 6) * 86400e0 AS t1 FROM (SELECT s_suppkey AS i FROM supplier)),
q AS (SELECT i AS rid, floor((70.1e0 + (i % 9) * 0.2e0) * 4) / 4 AS w, floor((16.3e0 + (i % 5) * 0.3e0) * 4) / 4 AS s, ceil((72.4e0 + (i % 7) * 0.6e0) * 4) / 4 AS e, ceil((18.2e0 + (i % 4) * 0.7e0) * 4) / 4 AS n, floor((1704844800e0 + (i % 10) * 3600e0) / 86400) * 86400 AS t0, ceil((1704844800e0 + 3600e0 * (12 + i % 60)) / 86400) * 86400 AS t1 FROM (SELECT p_partkey AS i FROM part))
SELECT rid, arg_min(f.file, ((f.e - f.w) * (f.n - f.s), f.file)) FILTER (f.file IS NOT NULL) AS file FROM q LEFT JOIN f ON f.w <= q.w AND f.s <= q.s AND f.e >= q.e AND f.n >= q.n AND f.t0 <= q.t0 AND f.t1 >= q.t1 GROUP BY rid""",
    "severity": f"WITH {SPILL} SELECT spill_id, round(size, 6) AS size, round(coast, 6) AS coast, round(beaching, 6) AS beaching, round(sensitivity, 6) AS sensitivity, round(persistence, 6) AS persistence, round(score, 6) AS score, level, round(tonnes, 6) AS tonnes, tier_low, tier, tier_high FROM sev",
    "action_rules": f"WITH {SPILL}, r AS (" + " UNION ALL ".join(f"SELECT spill_id, {p} AS priority, '{a}' AS action, {h}e0 AS deadline_h FROM sev WHERE {c}" for p, a, h, c in (
        (1, "notify", 1, "true"), (1, "activate_tier_3", 2, "tier_high = 'Tier 3'"), (1, "close_intakes", 6, "sensitivity >= 0.5"), (2, "boom_sites", 12, "sensitivity > 0"), (2, "shoreline_teams", 24, "beaching >= 0.5"), (2, "aerial_survey", 6, "size >= 0.5"),
        (3, "dispersant_assessment", 12, "coast < 0.5 AND size >= 0.3"), (3, "sampling", 24, "persistence >= 0.7"), (4, "monitor", 48, "level IN ('LOW', 'MODERATE')"))) + ") SELECT *, CAST(row_number() OVER (PARTITION BY spill_id ORDER BY priority, deadline_h, action) AS INT) AS step FROM r",
    "site_threat": f"""WITH {SITE}, {SLICK}, a AS (SELECT s.spill_id, s.radius_km AS sr, speed_kmh, s.bearing_deg, t.site, t.kind, t.weight, t.radius_km AS tr, {DIST('s.lon', 's.lat', 't.lon', 't.lat')} AS cd, {BRG('s.lon', 's.lat', 't.lon', 't.lat')} AS b FROM slicks s, sites t),
b AS (SELECT *, greatest(0e0, cd - sr - tr) AS d_now, radians(b - bearing_deg) AS off FROM a), c AS (SELECT *, greatest(0e0, least(speed_kmh * 240, cd * cos(off))) AS along FROM b WHERE d_now <= 400),
d AS (SELECT *, CASE WHEN d_now <= 5 THEN 0e0 WHEN speed_kmh > 0 AND greatest(0e0, sqrt(pow(cd * cos(off) - along, 2) + pow(cd * sin(off), 2)) - tr) <= 15 THEN along / speed_kmh END AS eta FROM c),
e AS (SELECT *, CASE WHEN eta IS NULL THEN 0e0 ELSE weight / 10e0 * exp(-eta / 96) END AS ex FROM d WHERE eta IS NOT NULL OR d_now <= 60)
SELECT spill_id, site, kind, round(d_now, 6) AS d_now_km, round(eta, 6) AS eta_hours, round(ex, 6) AS exposure, coalesce(eta, 1e9) <= 240 AS threatened, CAST(row_number() OVER (PARTITION BY spill_id ORDER BY round(ex, 9) DESC, round(d_now, 9), site) AS INT) AS rank FROM e QUALIFY rank <= 12""",
    "next_port": f"""WITH {RAW}, {PORT}, l AS (SELECT mmsi, max(t) AS t1, arg_max(lat, t) AS la, arg_max(lon, t) AS lo FROM searched GROUP BY mmsi),
f AS (SELECT l.*, t, {DIST('s.lon', 's.lat', 'lo', 'la')} AS d, {BRG('s.lon', 's.lat', 'lo', 'la')} AS b FROM searched s JOIN l USING (mmsi) WHERE t < t1), g AS (SELECT mmsi, t1, la, lo, coalesce(max(t) FILTER (t1 - t >= 3600 AND d >= 1), min(t)) AS ts FROM f GROUP BY ALL),
h AS (SELECT g.*, f.b AS course, f.d / ((g.t1 - g.ts) / 3600) / 1.852e0 AS kn FROM g JOIN f ON g.mmsi = f.mmsi AND g.ts = f.t), c AS (SELECT h.*, p.port, {DIST('lo', 'la', 'p.lon', 'p.lat')} AS pd, {BRG('lo', 'la', 'p.lon', 'p.lat')} AS pb, {BASIN('lo', 'la')} AS b1, {BASIN('p.lon', 'p.lat')} AS b2 FROM h, ports p),
e AS (SELECT *, abs({modulo('(pb - course + 540)')} - 180) AS off FROM c), n AS (SELECT mmsi, arg_min(port, (pd, port)) AS nearest_port FROM e GROUP BY mmsi),
a AS (SELECT * FROM e WHERE off <= 40 AND pd <= 2000 AND kn > 0.5 AND CASE b1 WHEN 'W' THEN b2 IN ('W', 'S') WHEN 'E' THEN b2 IN ('E', 'S') WHEN 'AN' THEN b2 IN ('AN', 'E') ELSE b2 IN ('W', 'E', 'S') END QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY pd, port) = 1)
SELECT h.mmsi, round(h.course, 6) AS course_deg, round(h.kn, 6) AS speed_kn, nearest_port, a.port, round(a.pd, 6) AS distance_km, round(a.off, 6) AS offset_deg, round(a.pd / (a.kn * 1.852e0), 6) AS eta_hours FROM h JOIN n USING (mmsi) LEFT JOIN a USING (mmsi)""",
    "nearest_place": f"WITH {PORT}, {SLICK} SELECT spill_id AS id, port AS place, round({haversine('s.lat', 's.lon', 'p.lat', 'p.lon')}, 6) AS d_km FROM slicks s, ports p QUALIFY row_number() OVER (PARTITION BY spill_id ORDER BY {haversine('s.lat', 's.lon', 'p.lat', 'p.lon')}, port) = 1",
    "responsible_mrcc": f"WITH {SLICK} SELECT spill_id, CASE WHEN lon >= 91 THEN 'MRCC Port Blair' WHEN lon < 77.6 OR (lat < 8.3 AND lon < 78.5) THEN 'MRCC Mumbai' ELSE 'MRCC Chennai' END AS mrcc, {BASIN('lon', 'lat')} AS basin FROM slicks",
    "spill_compare": f"""WITH o AS (SELECT o_orderkey AS id, 1704844800e0 + o_orderkey * 7200e0 AS t, 18e0 + (o_orderkey % 7) * 0.2e0 AS lat, 71e0 + (o_orderkey % 5) * 0.3e0 AS lon, 0.05e0 + (o_orderkey % 3) * 0.05e0 AS half, o_totalprice AS area FROM orders),
p AS (SELECT a.id AS id_a, b.id AS id_b, (b.t - a.t) / 3600 AS hours, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d, {bearing('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS dir, b.area - a.area AS da, a.half AS ha, b.half AS hb,
  greatest(0e0, least(a.lat + a.half, b.lat + b.half) - greatest(a.lat - a.half, b.lat - b.half)) * greatest(0e0, least(a.lon + a.half, b.lon + b.half) - greatest(a.lon - a.half, b.lon - b.half)) AS i FROM o a JOIN o b ON b.t > a.t AND b.t - a.t <= 259200)
SELECT id_a, id_b, round(hours, 6) AS hours, round(d, 6) AS d_km, round(dir, 6) AS direction_deg, round(d / hours, 6) AS speed_kmh, round(da, 6) AS area_change_m2, round(i / (4 * ha * ha + 4 * hb * hb - i), 6) AS iou FROM p WHERE i > 0 OR d <= 3 * hours""",
    "manifest_root": f"WITH {MAN} SELECT * FROM roots",
    "manifest_chain": f"WITH {MAN} SELECT bundle // 8 AS analysis, bundle, sha256(coalesce(lag(root) OVER (PARTITION BY bundle // 8 ORDER BY bundle), '') || '|' || root) AS chain FROM roots",
    "manifest_verify": f"WITH {MAN} SELECT bundle, path, CASE WHEN k % 17 = 0 THEN 'missing' WHEN k % 13 = 0 THEN 'modified' ELSE 'ok' END AS status FROM man UNION ALL SELECT bundle, path || '.new', 'added' FROM man WHERE k % 29 = 0",
    "components": f"WITH RECURSIVE {PIX}, g AS (SELECT scene, r, c, CAST(r AS BIGINT) * 4294967296 + c AS label FROM mask WHERE m = 1), t AS (SELECT * FROM g UNION SELECT b.scene, b.r, b.c, t.label FROM t JOIN g b ON b.scene = t.scene AND abs(b.r - t.r) <= 1 AND abs(b.c - t.c) <= 1 AND t.label < b.label) SELECT scene, r, c, min(label) AS label FROM (SELECT * FROM t) GROUP BY scene, r, c",
    "cfar": f"""WITH {PIX}, down AS (SELECT i, CASE WHEN i < 0 THEN -1 - i WHEN i > 29 THEN 59 - i ELSE i END AS at FROM range(-12, 42) q(i)), axis AS (SELECT i, CASE WHEN i < 0 THEN -1 - i WHEN i > 49 THEN 99 - i ELSE i END AS at FROM range(-12, 62) q(i)),
pad AS (SELECT px.scene, y.i AS r, x.i AS c, px.v FROM px JOIN down y ON y.at = px.r JOIN axis x ON x.at = px.c),
s AS (SELECT a.scene, a.r, a.c, a.v, count(*) AS n, sum(b.v) AS s, sum(b.v * b.v) AS q FROM px a JOIN pad b ON a.scene = b.scene AND abs(a.r - b.r) <= 12 AND abs(a.c - b.c) <= 12 AND NOT (abs(a.r - b.r) <= 4 AND abs(a.c - b.c) <= 4) GROUP BY ALL),
m AS (SELECT scene, r, c, v, s / n AS mean, sqrt(greatest(1e-9, q / n - (s / n) * (s / n))) AS sd FROM s) SELECT scene, r, c, v, round(mean, 6) AS mean, round(sd, 6) AS sd FROM m WHERE v > least(mean + 4 * sd, 254.5e0)""",
    "sized_components": f"WITH RECURSIVE {PIX}, {LABELS} SELECT lb.*, n_pixels FROM lb JOIN sz USING (scene, label) WHERE n_pixels BETWEEN 3 AND 400",
    "ring_contrast": f"""WITH RECURSIVE {PIX}, {LABELS}, own AS (SELECT lb.* FROM lb JOIN sz USING (scene, label) WHERE n_pixels BETWEEN 30 AND 400),
ring AS (SELECT DISTINCT o.scene, o.label, p.r, p.c, p.v FROM own o JOIN px p ON p.scene = o.scene AND abs(p.r - o.r) <= 3 AND abs(p.c - o.c) <= 3 WHERE NOT EXISTS (FROM own k WHERE k.scene = p.scene AND abs(k.r - p.r) <= 1 AND abs(k.c - p.c) <= 1)),
a AS (SELECT scene, label, avg(v) AS around, stddev_pop(v) AS deviation FROM ring GROUP BY ALL), i AS (SELECT scene, label, avg(v) AS inside FROM own JOIN px USING (scene, r, c) GROUP BY ALL)
SELECT scene, label, round(around - inside, 6) AS contrast, round((around - inside) / greatest(deviation, 1e-9), 6) AS contrast_sigma FROM i JOIN a USING (scene, label)""",
    "morphology": "WITH " + PIX + "".join(
        f", {n} AS (SELECT a.scene, a.r, a.c, CASE WHEN sum(b.m) {test} THEN 1 ELSE 0 END AS m FROM {src} a JOIN {src} b ON a.scene = b.scene AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.scene, a.r, a.c)"
        for n, src, test in (("m1", "mask", "= 9"), ("m2", "m1", "> 0"), ("m3", "m2", "> 0"), ("m4", "m3", "= 9"))) + " SELECT scene, r, c FROM m4 WHERE m = 1",
    "block_percentile_mad": f"WITH {PIX}, b AS (SELECT scene, CAST(r // 16 AS BIGINT) AS br, CAST(c // 16 AS BIGINT) AS bc, v FROM px), l AS (SELECT scene, br, bc, quantile_cont(v, 0.6) AS level, median(v) AS mid FROM b GROUP BY ALL) SELECT scene, br, bc, round(any_value(level), 6) AS level, round(greatest(0.3e0, 1.4826e0 * median(abs(v - mid))), 6) AS deviation FROM b JOIN l USING (scene, br, bc) GROUP BY scene, br, bc",
    "decimate": f"WITH {PIX} SELECT scene, CAST(r // 4 AS BIGINT) AS r, CAST(c // 4 AS BIGINT) AS c, round(avg(v), 6) AS v FROM px GROUP BY ALL",
    "dice_iou": f"WITH {PIX}, p AS (SELECT scene, m AS a, CASE WHEN (r + c) % 11 = 0 THEN 1 - m ELSE m END AS p FROM mask) SELECT scene, round(2e0 * sum(a * p) / (sum(a) + sum(p)), 6) AS dice, round(CAST(sum(a * p) AS DOUBLE) / (sum(a) + sum(p) - sum(a * p)), 6) AS iou FROM p GROUP BY scene",
    "velocity_parts": f"WITH {SLICK}, a AS (SELECT spill_id, bearing_deg, speed_kmh * sin(radians(bearing_deg)) AS u, speed_kmh * cos(radians(bearing_deg)) AS v FROM slicks) SELECT spill_id, round(u, 6) AS u, round(v, 6) AS v, round(-u, 6) AS wu, round(-v, 6) AS wv, round(sqrt(pow(u + 0.5e0, 2) + pow(v - 0.25e0, 2)), 6) AS speed, round({modulo('(degrees(atan2(u + 0.5e0, v - 0.25e0)) + 360)')}, 6) AS toward, round({TURN('bearing_deg', '350e0')}, 6) AS turn FROM a",
    "latest_state": f"WITH {STATES}, l AS ({LAST('true')}) SELECT user_id, event_id, CASE WHEN status IN ('COMPLETED', 'PARTIAL', 'FAILED') THEN status ELSE 'FAILED' END AS status, value, CASE WHEN status NOT IN ('COMPLETED', 'PARTIAL', 'FAILED') THEN 'INTERRUPTED' END AS error FROM l",
    "upsert_latest": f"WITH {STATES}, a AS ({LAST(f'ts IS NULL OR ts < {UPSERT_FROM}')}), b AS ({LAST(f'ts >= {UPSERT_FROM}')}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE user_id NOT IN (SELECT user_id FROM b)",
    "provenance_mix": "WITH p AS (SELECT DISTINCT user_id, CASE WHEN user_id % 4 = 0 THEN 'LOCAL_FILE' ELSE ['REAL', 'SYNTHETIC', 'LOCAL_FILE'][event_id % 3 + 1] END AS p FROM events) SELECT user_id, CASE WHEN count(*) > 1 THEN 'MIXED:' ELSE '' END || string_agg(p, ',' ORDER BY p) AS provenance FROM p GROUP BY user_id",
    "search_window": f"WITH {RAW}, {GRID}, {INTERP}, b AS (SELECT min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM interp) SELECT round(w - 40 / 111.32e0 / cos(radians((s + n) / 2)), 6) AS w, round(s - 40 / 111.32e0, 6) AS s, round(e + 40 / 111.32e0 / cos(radians((s + n) / 2)), 6) AS e, round(n + 40 / 111.32e0, 6) AS n, 1705017600e0 - 54 * 3600 AS t0, 1705017600e0 + 6 * 3600 AS t1 FROM b",
    "drift_vector": f"WITH {PARTICLES}, c AS (SELECT tq, avg(px) AS x, avg(py) AS y FROM cloud GROUP BY tq), a AS (SELECT (SELECT x FROM c ORDER BY tq LIMIT 1) AS x0, (SELECT y FROM c ORDER BY tq LIMIT 1) AS y0, (SELECT x FROM c ORDER BY tq DESC LIMIT 1) AS x1, (SELECT y FROM c ORDER BY tq DESC LIMIT 1) AS y1) SELECT round(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 48, 6) AS speed_kmh, round({modulo('(degrees(atan2(x1 - x0, y1 - y0)) + 360)')}, 6) AS bearing_deg FROM a",
    "scene_search": """WITH q AS (SELECT 'S' || i AS scene, 1704844800e0 + (i * 37 % 91) * 3600e0 AS t, 66e0 + i % 9 AS w, 14e0 + i % 6 AS s, 69e0 + i % 9 AS e, 16.5e0 + i % 6 AS n FROM (SELECT p_partkey AS i FROM part) WHERE i % 5 <> 0 AND i % 4 <> 0),
c AS (SELECT scene, t, greatest(0e0, least(e, 72e0) - greatest(w, 70e0)) * greatest(0e0, least(n, 18e0) - greatest(s, 17e0)) / 2 AS coverage FROM q) SELECT scene, t, round(coverage, 6) AS coverage FROM c WHERE coverage > 0""",
    "scene_clip": """WITH q AS (SELECT i AS rid, 70e0 + i % 7 * 0.31e0 AS w, 17e0 + i % 5 * 0.29e0 AS s, 71e0 + i % 7 * 0.31e0 AS e, 17.8e0 + i % 5 * 0.29e0 AS n FROM (SELECT p_partkey AS i FROM part)),
c AS (SELECT *, greatest(0e0, least(e, 72.2e0) - greatest(w, 70.1e0)) * greatest(0e0, least(n, 18.6e0) - greatest(s, 17.1e0)) / ((e - w) * (n - s)) AS share FROM q), v AS (SELECT *, CASE WHEN share < 0.05 THEN 'outside' WHEN share > 0.95 THEN 'whole' ELSE 'clipped' END AS verdict FROM c)
SELECT rid, round(share, 6) AS share, verdict, round(CASE WHEN verdict = 'clipped' THEN greatest(w, 70.1e0) ELSE w END, 6) AS ow, round(CASE WHEN verdict = 'clipped' THEN greatest(s, 17.1e0) ELSE s END, 6) AS os, round(CASE WHEN verdict = 'clipped' THEN least(e, 72.2e0) ELSE e END, 6) AS oe, round(CASE WHEN verdict = 'clipped' THEN least(n, 18.6e0) ELSE n END, 6) AS "on" FROM v""",
    "georeference": """WITH q AS (SELECT i AS image, 500 + i * 13 AS width, 400 + i * 7 AS height, 70e0 + i % 9 * 0.1e0 AS w, 16e0 + i % 7 * 0.2e0 AS s, 70.6e0 + i % 8 * 0.1e0 AS e, 16.7e0 + i % 7 * 0.2e0 AS n FROM (SELECT s_suppkey AS i FROM supplier)), m AS (SELECT *, cos(radians((s + n) / 2)) AS k FROM q WHERE w < e)
SELECT image, round((e - w) / width, 7) AS dx, round(-((n - s) / height), 7) AS dy, round(((e - w) / width * 111320 * k + (n - s) / height * 111320) / 2, 7) AS pixel_m, CAST(ceil((e - w) * 111320e0 * k / 10) AS BIGINT) AS columns, CAST(ceil((n - s) * 111320e0 * 1e0 / 10) AS BIGINT) AS rows FROM m""",
    "release_window": "WITH h(h) AS (VALUES (0e0), (0.5e0), (1e0), (3e0), (6e0), (12e0), (24e0), (36e0), (48e0)), q AS (SELECT i AS spill_id, h FROM (SELECT p_partkey AS i FROM part), h WHERE h >= i % 60 OR i % 60 > 48) SELECT spill_id, CAST(count(*) AS INT) AS n, min(h) AS first, sum(h) AS total FROM q GROUP BY spill_id",
    "drift_reach": "WITH p AS (SELECT user_id % 20 AS area, quantile_cont(value / 500e0, 0.95) AS p95 FROM events GROUP BY 1) SELECT area, round(p95, 6) AS p95, round(least(0.5e0, greatest(0.15e0, 1.3e0 * p95)), 6) AS reach FROM p",
    "synthetic_forcing": "WITH q AS (SELECT CAST(i // 80 AS INT) AS it, CAST(i // 10 % 8 AS INT) AS iy, CAST(i % 10 AS INT) AS ix FROM range(2000) r(i)) SELECT it, iy, ix, round(0.3e0 + 0.1e0 * sin(ix * 0.5e0 + iy * 0.25e0) + 0.15e0 * sin(it * (2 * pi() / 12.42e0)), 6) AS u, round(-0.1e0 + 0.1e0 * cos(iy * 0.5e0) + 0.05e0 * sin(it * (2 * pi() / 24)), 6) AS v FROM q",
    "tile_merge": """WITH q AS (SELECT o_orderkey // 4096 AS scene, o_orderkey // 1024 % 4 // 2 * 24 AS tr, o_orderkey // 1024 % 2 * 24 AS tc, o_orderkey // 32 % 32 AS a, o_orderkey % 32 AS b FROM orders), z AS (SELECT *, tr + a AS r, tc + b AS c, greatest(1e-3, 0.5e0 - 0.5e0 * cos(2 * pi() * a / 31)) * greatest(1e-3, 0.5e0 - 0.5e0 * cos(2 * pi() * b / 31)) AS w FROM q),
m AS (SELECT scene, r, c, sum(w * (((r * 31 + c * 17 + tr + tc) % 23 - 11) / 4e0)) / sum(w) AS z FROM z GROUP BY scene, r, c) SELECT CAST(scene AS INT) AS scene, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(1 / (1 + exp(-z)), 6) AS probability FROM m""",
    "calibration": "WITH t AS (SELECT p_partkey % 12 AS scene, p_partkey AS setting, p_partkey * 7 % 100 / 100e0 AS recall, p_size % 20 / 100e0 AS fp FROM part) SELECT scene, setting, round(recall, 6) AS recall, round(fp, 6) AS false_positive FROM t QUALIFY row_number() OVER (PARTITION BY scene ORDER BY round(recall - 4 * fp, 9) DESC, setting) = 1",
    "component_targets": """WITH b AS (SELECT p_partkey % 4 AS scene, p_partkey AS component_id, p_partkey * 17 % 90 + 0.25e0 AS x0, p_partkey * 23 % 80 + 0.25e0 AS y0 FROM part), t AS (SELECT i % 4 AS scene, CAST(i * 29 % 91 AS DOUBLE) AS x, CAST(i * 31 % 83 AS DOUBLE) AS y FROM (SELECT s_suppkey AS i FROM supplier)),
d AS (SELECT b.scene, component_id, sqrt(pow(greatest(0e0, x0 - x, x - x0 - 1.5e0), 2) + pow(greatest(0e0, y0 - y, y - y0 - 1e0), 2)) AS k FROM b JOIN t USING (scene)) SELECT scene, component_id, round(min(k) FILTER (k <= 3), 6) AS target_km FROM d GROUP BY scene, component_id""",
    "component_stats": f"WITH RECURSIVE {PIX}, g AS (SELECT scene, r, c, CAST(r AS BIGINT) * 4294967296 + c AS label FROM mask WHERE m = 1), t AS (SELECT * FROM g UNION SELECT b.scene, b.r, b.c, t.label FROM t JOIN g b ON b.scene = t.scene AND abs(b.r - t.r) + abs(b.c - t.c) <= 1 AND t.label < b.label), l AS (SELECT scene, r, c, min(label) AS label FROM t GROUP BY scene, r, c) SELECT scene, label, count(*) AS n_pixels, round(avg(r), 6) AS row, round(avg(c), 6) AS col, max(v) AS peak, round(avg(v), 6) AS mean_v, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM l JOIN px USING (scene, r, c) GROUP BY scene, label",
    "position_format": f"WITH {SLICK}, p AS (SELECT spill_id, lat + 0.2567e0 AS a, lon - spill_id % 60 * 3.337e0 AS o FROM slicks), t AS (SELECT spill_id, a, o, CAST(round(abs(a) * 600) AS BIGINT) AS ta, CAST(round(abs(o) * 600) AS BIGINT) AS t_o FROM p) SELECT spill_id, printf('%02d°%04.1f''%s %03d°%04.1f''%s', ta // 600, (ta % 600) / 10e0, CASE WHEN a >= 0 THEN 'N' ELSE 'S' END, t_o // 600, (t_o % 600) / 10e0, CASE WHEN o >= 0 THEN 'E' ELSE 'W' END) AS position FROM t",
    "polygon_points": """WITH c AS (SELECT p_partkey AS k, i, p_partkey % 40 + (4 + p_partkey % 5) * cos(i * 2.5e0 + p_partkey % 7) AS x, p_partkey % 30 + (2 + i) * sin(i * 2.5e0) AS y FROM part, range(5) q(i)),
b AS (SELECT k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY k), g AS (SELECT k, CAST(n AS INT) AS i, x0 + (n * 0.7548776662466927e0 - floor(n * 0.7548776662466927e0)) * (x1 - x0) AS x, y0 + (n * 0.5698402909980532e0 - floor(n * 0.5698402909980532e0)) * (y1 - y0) AS y FROM b, range(1, 21) q(n)),
s AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM c a JOIN c b ON a.k = b.k AND b.i = (a.i + 1) % 5) SELECT k AS ring, i, round(x, 6) AS x, round(y, 6) AS y FROM g JOIN s USING (k) GROUP BY k, i, x, y HAVING count(*) FILTER ((ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax) % 2 = 1""",
}
PAIRED = """dt AS (SELECT o_orderkey // 30 AS scene, o_orderkey AS det_id, -30e0 + o_orderkey * 37 % 60 AS dx, -20e0 + o_orderkey * 53 % 45 AS dy FROM orders), se AS (SELECT event_id // 20 AS scene, CAST(419000000 + event_id AS VARCHAR) AS mmsi, -30.3e0 + event_id * 41 % 61 AS x, -20.4e0 + event_id * 29 % 46 AS y FROM events),
pr AS (SELECT * FROM (SELECT scene, det_id, mmsi, sqrt(pow(x - dx, 2) + pow(y - dy, 2)) AS d FROM dt JOIN se USING (scene)) WHERE d <= 1.5),
oq AS (SELECT scene, det_id, row_number() OVER (PARTITION BY scene ORDER BY det_id) AS k, list(struct_pack(mmsi, d) ORDER BY d, mmsi) AS c FROM pr GROUP BY scene, det_id),
g AS (SELECT DISTINCT scene, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS STRUCT(mmsi VARCHAR, d DOUBLE)) AS p FROM oq
  UNION ALL SELECT scene, k, CASE WHEN p IS NULL THEN used ELSE list_append(used, p.mmsi) END, det_id, p FROM (SELECT g.scene, oq.k, g.used, oq.det_id, list_filter(oq.c, lambda x: NOT list_contains(g.used, x.mmsi))[1] AS p FROM g JOIN oq ON oq.scene = g.scene AND oq.k = g.k + 1)),
m AS (SELECT scene, det_id, p.mmsi AS mmsi, p.d AS d FROM g WHERE p IS NOT NULL)"""
ORACLES |= {
    "sar_ais_pairs": f"WITH RECURSIVE {PAIRED} SELECT scene, det_id, mmsi, round(d, 6) AS d_km FROM m",
    "sar_only": f"WITH RECURSIVE {PAIRED} SELECT scene, det_id FROM dt WHERE det_id NOT IN (SELECT det_id FROM m)",
    "ais_only": f"WITH RECURSIVE {PAIRED} SELECT scene, mmsi FROM se WHERE mmsi NOT IN (SELECT mmsi FROM m)",
    "port_arrivals": ORACLES["next_port"].replace("SELECT h.mmsi,", "SELECT h.mmsi, round(h.t1 + a.pd / (a.kn * 1.852e0) * 3600, 3) AS arrives, round((1706745600e0 - h.t1) / 3600, 6) AS silent_h, CASE WHEN a.port IS NULL THEN 'no_port' WHEN h.t1 + a.pd / (a.kn * 1.852e0) * 3600 <= 1706745600e0 THEN 'due' ELSE 'en_route' END AS note,"),
}
