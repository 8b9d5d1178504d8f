"""Areas, outlines, forcing and records: queries against their SQL, and odd input."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_oracles import SF, ordered, plain
from tidemark.functions import polygon
from tidemark.operators import forcing, land, outlines, records, scoring
from tidemark.plans import areas

NAMES = ["shape_descriptors", "trail_ends", "attached_vessels", "beaching", "sized_domain", "band_contrast", "at_sea", "outline_rings", "stretched", "request_budget", "nearest_wind", "source_states", "selected_components", "strict_json", "track_features"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = areas.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(areas.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert ordered([tuple(plain(r[c]) for c in columns) for r in got.collect()]) == ordered([tuple(plain(r[i]) for i in at) for r in want.fetchall()])


RING = "array<struct<x:double,y:double>>"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def test_shapes_of_simple_and_broken_rings(spark):
    rows = [(0, ring((0, 0), (4, 0), (4, 2), (0, 2))), (1, []), (2, None), (3, ring((1, 1))), (4, ring((0, 0), (3, 4)))]
    got = {r["k"]: r for r in land.described(spark.createDataFrame(rows, f"k int, ring {RING}")).collect()}
    box = got[0]
    assert (box["x"], box["y"], box["area_km2"], box["perimeter_km"], box["length_km"], box["width_km"], box["elongation"], box["solidity"]) == pytest.approx((2, 1, 8, 12, 4, 2, 2, 1))
    assert box["compactness"] == pytest.approx(4 * np.pi * 8 / 144)
    assert got[1]["x"] is None and got[1]["length_km"] is None and got[2]["area_km2"] is None
    assert got[3]["length_km"] == 0 and got[4]["length_km"] == pytest.approx(5) and got[4]["width_km"] == pytest.approx(0)


def test_area_on_the_sphere_within_one_percent(spark):
    # 0.1 by 0.1 degrees at 18.9 N: 111.32 km a degree, times the cosine of the latitude.
    square = spark.createDataFrame([(ring((72.0, 18.85), (72.1, 18.85), (72.1, 18.95), (72.0, 18.95)),)], f"ring {RING}")
    got = square.select(polygon.sphere_area_km2(F.col("ring")).alias("a"), polygon.sphere_perimeter_km(F.col("ring")).alias("p")).first()
    wide, high = 11.132 * np.cos(np.radians(18.9)), 11.132
    assert got["a"] == pytest.approx(wide * high, rel=0.01) and got["p"] == pytest.approx(2 * (wide + high), rel=0.01)


def test_points_by_land(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 4.4, 1.0), (2, 4.6, 1.0), (3, None, 1.0)], "pid int, px double, py double")
    island = spark.createDataFrame([(ring((0, 0), (4, 0), (4, 4), (0, 4)),), ([],), (None,)], f"ring {RING}")
    hits = lambda polygons: {r["pid"]: r["hit"] for r in land.on_land(points, polygons, 0.5, 3.0).collect()}
    assert hits(island) == {0: True, 1: True, 2: False, 3: False}
    assert set(hits(island.limit(0)).values()) == {False}


def test_outline_of_a_ring_has_two_rings(spark):
    pixels = [(0, r, c, 7) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    got = outlines.traced(spark.createDataFrame(pixels, "scene int, r int, c int, label long"))
    rings = {}
    for row in got.collect():
        rings.setdefault((row["ring"]["r"], row["ring"]["c"]), []).append((row["seq"], row["r"], row["c"]))
    assert {k: [s for s, _, _ in sorted(v)] for k, v in rings.items()} == {(0, 0): list(range(12)), (1, 1): [0, 1, 2, 3]}
    corners = [(r, c) for _, r, c in sorted(rings[0, 0])]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True))
    assert outlines.traced(spark.createDataFrame([], "scene int, r int, c int, label long")).count() == 0


def test_forcing_names_and_nearest_values(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0)], "latitude double, x double, valid_time double")
    assert forcing.canonical(rows).columns == ["lat", "lon", "time"]
    with pytest.raises(ValueError, match="time"):
        forcing.canonical(rows.drop("valid_time"))
    series = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 2.0), ("a", 11.0, None)], "k string, t double, value double")
    asked = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 3, 99.0), ("a", 4, -5.0), ("b", 5, 0.0)], "k string, qid int, t double")
    assert {r["qid"]: r["value"] for r in forcing.nearest_known(asked, series, "k").collect()} == {1: 1.0, 2: 2.0, 3: 2.0, 4: 1.0, 5: None}


def test_strict_json_drops_private_fields(spark):
    rows = spark.createDataFrame([(1, float("nan"), {"_a": 1.0, "b": float("inf")}, [float("-inf"), 2.0], 3)], "k int, v double, s struct<_a:double,b:double>, l array<double>, _p int")
    assert [r[0] for r in records.strict_json(rows).collect()] == ['{"k":1,"v":null,"s":{"b":null},"l":[null,2.0]}']


def test_ranks_under_random_weights(spark):
    weights = {"spatial": 0.5, "type": 0.3, "time": 0.2, "none": 0.0}
    got = scoring.dirichlet_weights(spark, weights, n=300)
    values = np.array([[0.9, 0.1, 0.5], [0.2, 0.8, 0.6], [0.5, 0.5, 0.1]])
    draws = np.random.default_rng(0).dirichlet(np.array([0.5, 0.3, 0.2]) * 40, size=300)
    order = np.argsort(-(draws @ values.T), axis=1)
    factors = spark.createDataFrame([(str(i), i + 1, f, float(values[i, j])) for i in range(3) for j, f in enumerate(("spatial", "type", "time"))], "mmsi string, base_rank int, factor string, value double")
    first = {r["mmsi"]: r["p_first"] for r in scoring.robustness(factors, got).collect()}
    assert first == {str(i): pytest.approx((order[:, 0] == i).mean()) for i in range(3)}
