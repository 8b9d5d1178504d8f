"""What joins make and how they are planned: figures that must grow with the input, not with its square or in the driver."""

import time

import numpy as np
from pyspark.sql import functions as F

from test_oracles import SF
from tidemark import catalog
from tidemark.operators import forcing, impact, land, outlines, overlap, raster, scenes, scoring, sightings, state, warp
from tidemark.plans import queries


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    yield kind, plan
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    below = plan.children()
    for i in range(below.size()):
        yield from nodes(below.apply(i))


def rows_joined(df):
    """The most rows that a join of the collected query made."""
    return max(plan.metrics().apply("numOutputRows").value() for kind, plan in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in kind)


def covering_by_hand(files, requests):
    found = {}
    for rid, *r in requests:
        low, high = [np.floor(x * 4) / 4 for x in r[:2]] + [np.floor(r[4] / 86400) * 86400], [np.ceil(x * 4) / 4 for x in r[2:4]] + [np.ceil(r[5] / 86400) * 86400]
        fit = [((e - w) * (n - s), name) for name, w, s, e, n, t0, t1 in files if w <= low[0] and s <= low[1] and t0 <= low[2] and e >= high[0] and n >= high[1] and t1 >= high[2]]
        found[rid] = min(fit)[1] if fit else None
    return found


def test_f1_covering_files_equal_brute_force_and_equal_ones_meet_once(spark):
    names = "w double, s double, e double, n double, t0 double, t1 double"
    g = np.random.default_rng(1)
    box = lambda wide, days: [*(a := g.uniform(0, 3, 2).round(2)), *(a + g.uniform(0.2, wide, 2)), t := float(g.integers(0, 400000)), t + float(g.integers(1, days * 86400))]
    files = [(f"f{i}", *map(float, box(9, 9))) for i in range(150)] + [("big", -1.0, -1.0, 20.0, 20.0, 86400.0, 864000.0), ("none", 2.0, 2.0, 1.0, 3.0, 0.0, 9e5)]
    asked = [(i, *map(float, box(1, 2))) for i in range(200)] + [(900, 0.0, 0.0, 1.0, 1.0, 86400.0, 172800.0)]
    put = lambda rows, key: spark.createDataFrame(rows, f"{key}, {names}")
    got = {r["rid"]: r["file"] for r in state.covering(put(files, "file string"), put(asked, "rid int")).collect()}
    assert got == covering_by_hand(files, asked) and None in got.values()
    many = state.covering(put(files[-2:-1], "x string").crossJoin(spark.range(300)).select(F.concat("x", "id").alias("file"), "w", "s", "e", "n", "t0", "t1"), put(asked[-1:], "x int").crossJoin(spark.range(300)).select(F.col("id").alias("rid"), "w", "s", "e", "n", "t0", "t1"))
    assert {r["file"] for r in many.collect()} == {"big0"} and rows_joined(many) == 300


def test_f4_nearest_values_equal_brute_force_over_parts_of_time(spark):
    g = np.random.default_rng(4)
    held = [(k, float(t), float(v) if v > 2 else None) for k in (1, 2) for t, v in zip(g.permutation(400)[:60] * 7, g.integers(0, 20, 60), strict=True)]
    asked = [(int(k), i, float(t)) for i, (k, t) in enumerate(zip(g.integers(1, 4, 300), g.integers(-300, 3300, 300), strict=True))]
    got = forcing.nearest_known(spark.createDataFrame(asked, "k int, qid int, t double"), spark.createDataFrame(held, "k int, t double, value double"), "k", 100.0)
    want = {i: min(((abs(s - t), s, v) for h, s, v in held if h == k and v is not None), default=(None, None, None))[1:] for k, i, t in asked}
    assert {r["qid"]: (r["at"], r["value"]) for r in got.collect()} == want


def test_f4_a_long_series_takes_no_square_of_its_length(spark):
    asked = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").alias("qid"), (F.col("id") * 1.0).alias("t"))
    got = forcing.nearest_known(asked, asked.filter("qid < 1").select("k", "t", F.lit(5.0).alias("value")), "k")
    began = time.monotonic()
    assert got.filter("value = 5").count() == 300_000 and time.monotonic() - began < 60


def test_f18_points_in_the_window_equal_brute_force(spark):
    g = np.random.default_rng(18)
    rows = [(i, int(c), float(t), int(p) if p else None) for i, (c, t, p) in enumerate(zip(g.integers(0, 2, 400), g.uniform(0, 20000, 400), g.integers(0, 9, 400), strict=True))]
    rows += [(900, None, 5.0, 3), (901, None, 6.5, 4), (902, 0, None, 7), (903, 1, -2.5, 2)]
    got = forcing.budgeted(spark.createDataFrame(rows, "i int, client int, t double, points int"), 40, 2500)

    def used(c, t):
        near = [p for _, c2, t2, p in rows if c2 == c and p is not None and (t2 is None if t is None else t2 is not None and np.floor(t) - 2499 <= np.floor(t2) <= np.floor(t))]
        return sum(near) if near else None

    want = {i: (u, None if u is None else u > 40) for i, c, t, _ in rows for u in [used(c, t)]}
    assert {r["i"]: (r["used"], r["waits"]) for r in got.collect()} == want


def test_f18_no_frame_slides_over_a_busy_window(spark):
    got = forcing.budgeted(spark.range(400_000).select(F.lit(1).alias("client"), (F.col("id") / 4).alias("t"), F.lit(1).alias("points")), 10**9, 10**6)
    began = time.monotonic()
    assert got.agg(F.max("used")).first()[0] == 400_000 and time.monotonic() - began < 60


def joins(df):
    return {kind for kind, _ in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in kind}


def test_pixel_tables_are_not_sent_through_the_driver(spark):
    """F6, F8, F10 to F13."""
    pixels = spark.range(400).select(F.lit(0).alias("scene"), F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 20 > 2).alias("sea"), (F.col("id") * 7919 % 13 < 8).cast("int").alias("m"))
    labels = raster.labelled(pixels)
    made = [raster.sized_components(labels, 2, 400), raster.component_statistics(labels, pixels), raster.ring_contrast(labels, pixels, 1, 3), outlines.band_contrast(labels, pixels, 3, 10, 0.25), outlines.at_sea(pixels.select("scene", "r", "c"), pixels, 3), outlines.traced(labels)]
    for df in made:
        df.collect()
        assert joins(df) == {"SortMergeJoinExec"}


def test_control_points_are_not_sent_through_the_driver(spark):
    """F7, F9."""
    points = spark.range(3).select(F.col("id").cast("int").alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")).select("scene", (F.col("i") % 5 * 2.0).alias("row"), (F.floor(F.col("i") / 5) * 2.0).alias("col"), (F.col("i") % 5 / 4).alias("lon"), (F.floor(F.col("i") / 5) / 4).alias("lat"))
    pixels = points.select("scene", F.col("row").cast("int").alias("r"), F.col("col").cast("int").alias("c"), F.lit(1.0).alias("v"))
    areas = points.select("scene", F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(0.5).alias("e"), F.lit(0.5).alias("n")).distinct()
    for df in (warp.residuals(points, warp.fitted(points)), warp.warped(pixels, points, areas, 20000.0)):
        assert df.collect() and joins(df) == {"SortMergeJoinExec"}


def test_f15_f17_f19_f20_rows_of_one_file_are_dealt_out(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 2.0))))
    rows = spark.range(50).coalesce(1).select(F.col("id").alias("ring_id"), ring.alias("ring"), F.lit(9.0).alias("x"), F.lit(1.0).alias("y"))
    spills = spark.range(50).coalesce(1).select(F.col("id").alias("spill_id"), *(F.lit(v).alias(c) for c, v in (("lat", 19.0), ("lon", 72.0), ("radius_km", 1.0), ("speed_kmh", 1.0), ("bearing_deg", 90.0))))
    made = [land.described(rows.drop("x", "y")), land.trail_ends(rows), scenes.points_within(rows.select(F.col("ring_id").alias("ring"), F.col("ring").alias("corners")), 20)]
    assert [df.rdd.getNumPartitions() for df in made] == [4, 4, 4]
    threats = impact.threatened_sites(spills, spark.createDataFrame([("a", "port", 72.1, 19.0, 5.0, 6)], "site string, kind string, lon double, lat double, radius_km double, weight int"))
    assert "RoundRobinPartitioning(4)" in threats._jdf.queryExecution().toString()


def test_f14_vessels_are_dealt_out_before_they_meet_samples(spark):
    factors = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("mmsi"), F.col("id").cast("int").alias("base_rank"), F.lit("a").alias("factor"), F.col("id").cast("double").alias("value"))
    got = scoring.robustness(factors, spark.range(300).select(F.col("id").alias("sample"), F.lit("a").alias("factor"), F.lit(1.0).alias("weight")))
    assert {r["p_first"] for r in got.filter("mmsi = '39'").collect()} == {1.0}
    assert "hashpartitioning(mmsi" in got._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_f16_equal_boxes_and_targets_meet_once(spark):
    boxes = spark.range(200).select(F.lit(0).alias("scene"), F.col("id").alias("component_id"), *(F.lit(v).alias(c) for c, v in (("x0", 1.0), ("y0", 1.0), ("x1", 2.0), ("y1", 2.0))))
    got = scenes.with_nearest_target(boxes, spark.range(300).select(F.lit(0).alias("scene"), F.lit(3.0).alias("x"), F.lit(2.0).alias("y")))
    assert [r["target_km"] for r in got.collect()] == [1.0] * 200 and rows_joined(got) == 200


def test_f21_f22_f23_reports_are_read_once_for_all_features(spark):
    assert not [f for f in catalog.QUERIES["temporal_feature"](spark, SF).inputFiles() if "events" in f]
    # what is left is the one reading of types: reports and their repeats
    assert queries._features(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id") <= 2


def test_f3_f5_fixes_meet_times_of_scenes_not_scenes(spark):
    fixes = spark.range(50).select(F.col("id").cast("string").alias("mmsi"), F.lit(1000.0).alias("t"), F.lit(10.0).alias("lat"), (F.col("id") / 10).alias("lon"))
    boxes = spark.range(200).select(F.col("id").alias("scene"), F.lit(1000.0).alias("t"), F.lit(0.05).alias("w"), F.lit(9.0).alias("s"), F.lit(0.15).alias("e"), F.lit(11.0).alias("n"))
    near = sightings.at_scene_time(fixes, boxes)
    assert {(r["mmsi"], r["lon"]) for r in near.collect()} == {("1", 0.1)} and near.count() == 200
    assert rows_joined(near) <= 200 * 50 and joins(near) >= {"SortMergeJoinExec"}
    assert sightings.at_scene_time(fixes.withColumn("t", F.lit(9000.0)), boxes, 100.0).collect() == []
    radar = spark.range(30).select(F.lit(0).cast("long").alias("scene"), F.col("id").alias("det_id"), F.lit(10.0).alias("lat"), F.lit(0.1).alias("lon"))
    pairs = sightings.candidates(radar, near, 8.0)
    assert len(pairs.collect()) == 30 and "SortMergeJoinExec" in joins(pairs)


def test_f2_only_cells_on_the_sphere_are_asked(spark):
    g = np.random.default_rng(2)
    rows = spark.createDataFrame([(float(np.degrees(np.arcsin(z))), float(o)) for z, o in zip(g.uniform(-1, 1, 300), g.uniform(-180, 180, 300), strict=True)] + [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, 90.0)], "lat double, lon double")
    for size in (50.0, 3000.0):
        own = rows.select("*", *overlap._cell(F.col("lat"), F.col("lon"), size))
        assert own.filter(overlap._on_sphere(size)).count() == 304
        cells = own.select("ux", "uy", "uz", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select((F.col("ux") + F.col("i")).alias("ux"), "uy", "uz", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select("ux", (F.col("uy") + F.col("i")).alias("uy"), "uz", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("i")).select("ux", "uy", (F.col("uz") + F.col("i")).alias("uz"))
        assert cells.filter(overlap._on_sphere(size)).count() < 0.6 * 27 * 304


def test_f6_detections_take_vessels_as_before_and_pairs_are_not_written(spark, monkeypatch):
    g = np.random.default_rng(6)
    place = lambda n: (g.uniform(10, 10.8, n).round(2), np.where(g.random(n) < 0.5, g.uniform(179.6, 180, n), g.uniform(-180, -179.6, n)).round(2))
    radar = spark.createDataFrame([(int(s), i, *map(float, p)) for i, (s, *p) in enumerate(zip(g.integers(0, 4, 300), *place(300), strict=True))] + [(1, 900, None, 10.0), (9, 901, 10.0, 179.9), (None, 902, 10.0, 179.9)], "scene int, det_id long, lat double, lon double")
    fixes = spark.createDataFrame([(f"m{k % 90}", 1000.0 + k // 90 * 10, *map(float, p)) for k, p in enumerate(zip(*place(180), strict=True))], "mmsi string, t double, lat double, lon double")
    boxes = spark.createDataFrame([(s, 1000.0 + s, -180.0, 9.0, 180.0, 11.0 - s / 5) for s in range(1, 7)], "scene int, t double, w double, s double, e double, n double")
    near = sightings.at_scene_time(fixes, boxes)
    want = {(r.scene, r.det_id): (r.mmsi, round(r.d_km, 9)) for r in sightings.one_to_one(sightings.candidates(radar.filter("lat is not null"), near, 8.0)).collect()}
    inside = {(r.scene, r.mmsi) for r in near.collect()}
    names, put = [], sightings.written
    monkeypatch.setattr(sightings, "written", lambda df, name: names.append(name) or put(df, name))
    for records in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        rows = sightings.compared(radar, fixes, boxes, 8.0).collect()
        met = sightings.matched(radar, fixes, boxes, 8.0).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        by = lambda rows, status: [r for r in rows if r.status == status]
        assert len(want) > 50 and {(r.scene, r.det_id): (r.mmsi, round(r.d_km, 9)) for r in by(rows, "matched")} == want
        assert sorted(map(tuple, met)) == sorted(map(tuple, by(rows, "matched")))
        assert len(by(rows, "radar_only")) == 303 - len(want) and {902, 901, 900} <= {r.det_id for r in by(rows, "radar_only")}
        silent = [(r.scene, r.mmsi) for r in by(rows, "reports_only")]
        assert len(silent) == len(set(silent)) and set(silent) == inside - {(s, m) for (s, _), (m, _) in want.items()}
    assert set(names) == {"places"}  # before: vessels of all scenes, and pairs in each round


def test_f5_matches_alone_write_no_vessels_and_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(sightings, "written", lambda *_: (_ for _ in ()).throw(AssertionError("written")))
    radar = spark.createDataFrame([(1, 1, 10.0, 20.0), (1, 2, 10.0, 20.01), (3, 3, 10.0, 20.0)], "scene int, det_id long, lat double, lon double")
    fixes = spark.createDataFrame([("a", 0.0, 10.0, 20.01), ("b", 0.0, 10.5, 20.0)], "mmsi string, t double, lat double, lon double")
    boxes = spark.createDataFrame([(s, 0.0, 19.0, 9.0, 21.0, 11.0) for s in (1, 2)], "scene int, t double, w double, s double, e double, n double")
    assert [(r.det_id, r.mmsi, r.status) for r in sightings.matched(radar, fixes, boxes, 8.0).collect()] == [(1, "a", "matched")]
