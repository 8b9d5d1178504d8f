"""Outlines that meet, levels of the sea, rays to the shore: queries against SQL, operators against brute force."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_oracles import SF, ordered, plain
from tidemark.functions import polygon
from tidemark.functions.geo import haversine_km
from tidemark.operators import background, land, overlap
from tidemark.plans import geometry

RING = "array<struct<x:double,y:double>>"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


@pytest.mark.parametrize("name", sorted(geometry.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = geometry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(geometry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered([tuple(plain(r[c]) for c in columns) for r in got.collect()]) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


def star(r, n, x, y, size):
    """A ring that isn't convex: any distance from the centre in each direction."""
    return [(x + size * (0.2 + r.random()) * math.cos(2 * math.pi * i / n), y + size * (0.2 + r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def inside(corners, x, y):
    hit = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            hit ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return hit


def test_shared_area_of_rings_that_are_not_convex_equals_a_count_of_pixels(spark):
    r = random.Random(5)
    pairs = [(star(r, r.randint(3, 14), 0, 0, 3), star(r, r.randint(3, 14), r.uniform(-3, 3), r.uniform(-3, 3), 2)) for _ in range(25)]
    pairs += [(a[::-1], b) for a, b in pairs[:5]]
    comb = [(0, 0), (6, 0), (6, 4), (5, 4), (5, 1), (3, 1), (3, 4), (2, 4), (2, 1), (0, 1)]
    pairs += [(comb, [(-1, 2), (7, 2), (7, 3), (-1, 3)])]
    rows = spark.createDataFrame([(i, ring(*a), ring(*b)) for i, (a, b) in enumerate(pairs)], f"i int, a {RING}, b {RING}")
    got = {x.i: x for x in rows.select("i", polygon.intersection_area(F.col("a"), F.col("b")).alias("both"), polygon.union_area(F.col("a"), F.col("b")).alias("any")).collect()}
    step = 0.01
    x, y = np.meshgrid(np.arange(-8, 9, step) + step / 2, np.arange(-8, 9, step) + step / 2)
    for i, (a, b) in enumerate(pairs):
        one, two = inside(a, x, y), inside(b, x, y)
        assert got[i].both == pytest.approx((one & two).sum() * step * step, abs=0.05)
        assert got[i].any == pytest.approx((one | two).sum() * step * step, abs=0.08)
    assert got[len(pairs) - 1].both == pytest.approx(2.0)


def test_shared_area_of_special_rings(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    cases = [(square, square, 4), (square, ring((2, 0), (4, 0), (4, 2), (2, 2)), 0), (square, ring((0.5, 0.5), (1, 0.5), (1, 1)), 0.125), (square, ring((5, 5), (6, 5), (6, 6)), 0), (square, [], 0), (square, None, None), (square, ring((1, 1)), 0), (square, ring((0, 0), (1, 1)), 0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {RING}, b {RING}")
    got = {x.i: x.both for x in rows.select("i", polygon.intersection_area(F.col("a"), F.col("b")).alias("both")).collect()}
    for i, (_, b, want) in enumerate(cases):
        assert (got[i] or 0) == pytest.approx(want or 0), b


def test_clipping_keeps_what_is_in_the_box(spark):
    r = random.Random(2)
    shapes = [star(r, r.randint(3, 12), r.uniform(-2, 2), r.uniform(-2, 2), 2) for _ in range(20)]
    rows = spark.createDataFrame([(i, ring(*a)) for i, a in enumerate(shapes)] + [(90, []), (91, None)], f"i int, ring {RING}")
    box = ring((-1, -0.5), (1.5, -0.5), (1.5, 1), (-1, 1))
    want = {i: polygon_area for i, polygon_area in rows.withColumn("box", F.lit(None).cast(RING)).select("i", polygon.intersection_area(F.col("ring"), F.array(*(F.struct(F.lit(p["x"]).alias("x"), F.lit(p["y"]).alias("y")) for p in box)))).collect()}
    got = {x.i: abs(x.area) for x in overlap.cut_to_box(rows, -1, -0.5, 1.5, 1).select("i", polygon.area(F.col("ring")).alias("area")).collect()}
    assert {i: round(a, 9) for i, a in got.items() if a > 1e-9} == {i: round(a, 9) for i, a in want.items() if a}


def test_pairs_of_observations_equal_brute_force(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        lat, lon = r.choice([0, 60, 89.5, -45]) + r.uniform(-1, 1) * 0.4, r.choice([0, 179.9, -179.9]) + r.uniform(-0.2, 0.2)
        size = r.choice([0.01, 0.1, 1.5])
        rows.append((i, r.uniform(0, 3e5), lat, lon, 1.0, ring(*((lon + size * math.cos(t), lat + 0.3 * size * math.sin(t)) for t in (0, 1.5, 3, 4.5))), None, None))
    rows.append((100, 5.0, 10.0, 10.0, 1.0, None, 11.0, 10.0))
    rows.append((101, 3605.0, 10.0, 10.01, 3.0, [], None, None))
    schema = f"id int, t double, lat double, lon double, area_m2 double, ring {RING}, pred_lat double, pred_lon double"
    got = {(x.id_a, x.id_b): x for x in overlap.compared(spark.createDataFrame(rows, schema)).collect()}

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in rows for b in rows if 0 < b[1] - a[1] <= 72 * 3600 and km(a, b) <= 3 * (b[1] - a[1]) / 3600}
    assert want <= set(got) and all(got[p].overlap for p in set(got) - want)
    assert got[100, 101].drift_error_km == pytest.approx(km((0, 0, 11, 10), (0, 0, 10, 10.01))) and got[100, 101].area_change_m2 == 2 and got[100, 101].iou == 0
    assert overlap.compared(spark.createDataFrame([], schema)).collect() == []


def brute_anomaly(v, sea, block, percent, k):
    h, w = v.shape
    bh, bw = -(-h // block), -(-w // block)
    coarse = np.full((bh, bw), np.nan)
    for i in range(bh):
        for j in range(bw):
            own = v[i * block : (i + 1) * block, j * block : (j + 1) * block][sea[i * block : (i + 1) * block, j * block : (j + 1) * block]]
            if len(own) >= max(4, block * block // 4):
                coarse[i, j] = np.percentile(own, 100 * percent)
    known = [(i, j) for i in range(bh) for j in range(bw) if not np.isnan(coarse[i, j])]
    full = np.array([[coarse[min(known, key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p))] for j in range(bw)] for i in range(bh)])
    padded = np.pad(full, k // 2, mode="edge")
    smooth = np.array([[np.sort(padded[i : i + k, j : j + k].ravel())[k * k // 2] for j in range(bw)] for i in range(bh)])
    out = np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            y, x = r * (bh - 1) / max(1, bh * block - 1), c * (bw - 1) / max(1, bw * block - 1)
            i, j = int(y), int(x)
            at = lambda a, b: smooth[min(a, bh - 1), min(b, bw - 1)]
            out[r, c] = (at(i, j) * (1 - x + j) + at(i, j + 1) * (x - j)) * (1 - y + i) + (at(i + 1, j) * (1 - x + j) + at(i + 1, j + 1) * (x - j)) * (y - i)
    return out


@pytest.mark.parametrize(("h", "w", "block", "k"), [(20, 26, 4, 3), (17, 9, 4, 4), (5, 30, 5, 2), (3, 3, 3, 1)])
def test_background_equals_numpy(spark, h, w, block, k):
    r = np.random.default_rng(h)
    v, sea = r.normal(0, 2, (h, w)), r.random((h, w)) < 0.8
    sea[: h // 2, : w // 2] &= w < 10
    pixels = spark.createDataFrame([(7, i, j, float(v[i, j]), bool(sea[i, j])) for i in range(h) for j in range(w)], "scene int, r int, c int, v double, sea boolean")
    want = brute_anomaly(v, sea, block, 0.6, k)
    got = {(x.r, x.c): x for x in background.anomalies(pixels, block, 0.6, k).collect()}
    assert len(got) == h * w
    off = v - want
    core = off[sea & (off > -3)]
    deviation = max(0.3, 1.4826 * np.median(np.abs(core - np.median(core))))
    for (i, j), x in got.items():
        assert x.background == pytest.approx(want[i, j])
        assert x.anomaly == pytest.approx(off[i, j] if sea[i, j] else 0) and x.deviation == pytest.approx(deviation, abs=0.003)
        assert x.grey == 150 if not sea[i, j] else abs(x.grey - min(255, max(0, 150 + off[i, j] * 40 / deviation))) < 1.5


def test_scenes_without_sea_have_no_rows(spark):
    pixels = spark.createDataFrame([(1, i, j, 1.0, False) for i in range(4) for j in range(4)], "scene int, r int, c int, v double, sea boolean")
    assert background.anomalies(pixels, 2).collect() == [] and background.anomalies(pixels.limit(0), 2).collect() == []


def test_rays_meet_the_first_shore(spark):
    island, wall = ring((10, -5), (20, -5), (20, 5), (10, 5)), ring((30, -100), (31, -100), (31, 100), (30, 100))
    shapes = spark.createDataFrame([(island,), (wall,)], f"ring {RING}")
    rays = [(1, 0.0, 0.0, 90.0, 2.0), (2, 0.0, 20.0, 90.0, 0.0), (3, 15.0, 0.0, 0.0, 1.0), (4, 0.0, 0.0, 270.0, 1.0), (5, 25.0, 0.0, 270.0, None), (6, 0.0, 0.0, 0.0, 1.0), (7, 15.0, -30.0, 0.0, 1.0)]
    got = {x.id: x for x in land.landfall(spark.createDataFrame(rays, "id int, px double, py double, bearing_deg double, speed_kmh double"), shapes, 50.0, 7.0).collect()}
    assert {i: None if x.landfall_km is None else round(x.landfall_km, 6) for i, x in got.items()} == {1: 10.0, 2: 30.0, 3: 0.0, 4: None, 5: 5.0, 6: None, 7: 25.0}
    assert got[1].eta_h == pytest.approx(5) and got[2].eta_h is None and got[5].eta_h is None and got[7].y == pytest.approx(-5)


def test_f4_pairs_are_the_same_with_and_without_cells_and_are_not_shuffled(spark, monkeypatch):
    g = np.random.default_rng(4)
    schema = "id int, t double, lat double, lon double, area_m2 double, ring array<struct<x:double,y:double>>, pred_lat double, pred_lon double"
    rows = []
    for i in range(260):
        lat, lon = float(g.choice([0.0, 10.0, 89.8]) + g.uniform(-0.3, 0.3)), float(g.choice([0.0, 179.9, 181.0]) + g.uniform(-0.3, 0.3))
        turns = np.sort(g.uniform(0, 2 * np.pi, int(g.integers(3, 9))))
        ring = [(lon + 0.2 * float(np.cos(u)), lat + 0.1 * float(np.sin(u))) for u in turns] if i % 11 else ([] if i % 2 else None)
        rows.append((i, float(g.integers(0, 400) * 3600), min(lat, 90.0), lon, float(i), ring, None, None))
    spills = spark.createDataFrame(rows, schema).repartition(3)
    near, ring = {r[0]: r for r in rows}, polygon.equal_area(F.col("ring"))
    both = spills.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("lat").alias("la"), F.col("lon").alias("oa"), ring.alias("ra")).crossJoin(spills.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), ring.alias("rb"))).filter("tb > ta and tb - ta <= 259200")
    shared = F.coalesce(F.when(polygon.boxes_meet(F.col("ra"), F.col("rb")), polygon.intersection_area(F.col("ra"), F.col("rb"))), F.lit(0.0))
    both = both.select("a", "b", ((F.col("tb") - F.col("ta")) / 3600).alias("h"), haversine_km(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")).alias("d"), shared.alias("s"))
    want = {(x.a, x.b): (round(x.h, 6), round(x.d, 6), round(x.s, 4)) for x in both.filter("s > 0 or d <= 3 * h").collect()}
    assert len(near) == 260 and len(want) > 500 and any(v[2] > 0 for v in want.values())
    for few, many, pairs in ((2000, 256, 1 << 16), (1, 256, 50), (2000, 1, 50)):
        for name, value in (("FEW", few), ("MANY_PARTS", many), ("PAIRS", pairs), ("SIDES", 300)):
            monkeypatch.setattr(overlap, name, value)
        found = overlap.compared(spills)
        got = found.collect()
        assert len(got) == len(want) and {(x.id_a, x.id_b): (round(x.hours, 6), round(x.d_km, 6), round(x.shared_km2, 4)) for x in got} == want
        # one shuffle, of observations
        assert (plan := found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]).count("Exchange hashpartitioning") == 1 and "Join" not in plan
