"""Hand-made rows with known answers."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import domain, geo
from tidemark.operators import corridor, raster, scoring, surface, tracks
from tidemark.sources import tables
from tidemark.streaming.gaps import stream_gaps

ROW = "src_order long, dup int, mmsi string, t double, lat double, lon double"


def test_cleaning_counts_each_defect(spark):
    t = [0.0, 0.0, 1200.0, 1800.0, 2400.0, 3000.0, None]
    lat, lon = [18.0, 18.0, 18.01, 95.0, 18.02, 18.03, 18.0], [72.0, 72.0, 72.01, 72.0, 73.5, 72.03, 72.0]
    rows = spark.createDataFrame([(i, 0, "1", t[i], lat[i], lon[i]) for i in range(7)], ROW)
    report = tracks.cleaning_report(rows).first()
    assert (report.duplicates, report.invalid_coordinates, report.missing_timestamp) == (1, 1, 1)
    kept = tracks.without_spikes(tracks.distinct_fixes(tracks.valid(rows)))
    assert [r.lat for r in kept.orderBy("t").collect()] == [18.0, 18.01, 18.03]


def test_one_gap_of_ninety_minutes(spark):
    rows = spark.createDataFrame([(i, 0, "1", m * 60.0, 18.0, 72.0 + i / 100) for i, m in enumerate((0, 5, 95, 100))], ROW)
    assert [r.duration_min for r in tracks.gaps(rows, 30).collect()] == [90.0]


def test_two_fix_track_with_a_jump_loses_both(spark):
    rows = spark.createDataFrame([(0, 0, "1", 0.0, 18.0, 72.0), (1, 0, "1", 60.0, 19.0, 72.0)], ROW)
    assert tracks.without_spikes(rows).count() == 0


def test_bucket_join_equals_brute_force(spark):
    at = spark.range(60).select(F.col("id").cast("string").alias("mmsi"), (F.col("id") % 3 * 3600.0).alias("tq"), (F.col("id") * 7 % 23 - 11.0).alias("x"), (F.col("id") * 5 % 19 - 9.0).alias("y"))
    cloud = spark.range(90).select((F.col("id") % 3 * 3600.0).alias("tq"), F.col("id").cast("int").alias("pid"), (F.col("id") * 11 % 29 - 14.5).alias("px"), (F.col("id") * 3 % 17 - 8.5).alias("py"))
    got = {(r.mmsi, r.n_near, round(r.d_km, 9)) for r in corridor.nearest_particles(at, cloud, 4.0).collect()}
    want = set()
    for p in at.collect():
        near = [d for c in cloud.collect() if c.tq == p.tq and (d := ((p.x - c.px) ** 2 + (p.y - c.py) ** 2) ** 0.5) <= 4]
        want |= {(p.mmsi, len(near), round(min(near), 9))} if near else set()
    assert got == want


def test_interpolation_stops_at_gaps_and_ends(spark):
    rows = spark.createDataFrame([(0, 0, "1", 0.0, 10.0, 20.0), (1, 0, "1", 100.0, 11.0, 21.0), (2, 0, "1", 1000.0, 12.0, 22.0)], ROW)
    asked = spark.createDataFrame([(-1.0,), (0.0,), (50.0,), (100.0,), (500.0,), (1000.0,), (1001.0,)], "tq double")
    assert {r.tq: r.lat for r in tracks.interpolated(rows, asked, 200).collect()} == {0.0: 10.0, 50.0: 10.5, 100.0: 11.0, 1000.0: 12.0}


def test_density_regions_are_nested_and_mass_is_one(spark):
    cells = spark.range(200).select(F.lit(0).alias("label"), (F.col("id") % 20).cast("int").alias("ix"), (F.col("id") / 20).cast("int").alias("iy"), (F.col("id") * 37 % 41 + 1).alias("n"))
    mass = surface.mass(surface.smoothed(cells, 1.5), "density")
    assert mass.agg(F.sum("p")).first()[0] == pytest.approx(1)
    inner, outer = ({(r.ix, r.iy) for r in surface.highest_density(mass, q).collect()} for q in (0.5, 0.8))
    assert inner < outer
    assert sum(r.p for r in surface.highest_density(mass, 0.5).collect()) >= 0.5


def test_components_by_connectivity(spark):
    mask = spark.createDataFrame([(0, r, c, int((r, c) in {(0, 0), (1, 1), (1, 2), (3, 3)})) for r in range(4) for c in range(4)], "scene int, r int, c int, m int")
    assert raster.labelled(mask).select("label").distinct().count() == 2
    assert raster.labelled(mask, eight=False).select("label").distinct().count() == 3


def test_greedy_pairs_follow_detection_order(spark):
    det = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.2, 0.0)], "scene long, det_id long, dx double, dy double")
    seen = spark.createDataFrame([(0, "a", 0.15, 0.0), (0, "b", 0.9, 0.0)], "scene long, mmsi string, x double, y double")
    assert {(r.det_id, r.mmsi) for r in corridor.greedy_pairs(det, seen, 1.5).collect()} == {(1, "a"), (2, "b")}


def test_robust_ranking(spark):
    keys = ("spatial", "temporal", "trajectory")
    factors = spark.createDataFrame([(m, i + 1, k, v) for i, (m, v) in enumerate((("a", 0.95), ("b", 0.2))) for k in keys], "mmsi string, base_rank int, factor string, value double")
    weights = spark.createDataFrame([(s, k, (s * (i + 3) % 7) / 7 + 0.01) for s in range(50) for i, k in enumerate(keys)], "sample long, factor string, weight double")
    top = scoring.robustness(factors, weights).filter("base_rank = 1").first()
    assert top.p_first > 0.99 and top.verdict == "ROBUST"


def test_types_and_times(spark):
    kinds = spark.createDataFrame([("80",), ("35.0",), ("Oil/Chemical Tanker",), ("  ",), (None,), ("High Speed Craft",), ("Offshore supply",)], "raw string")
    assert [r[0] for r in kinds.select(domain.vessel_type(F.col("raw"))).collect()] == ["tanker", "other", "tanker", "unknown", "unknown", "passenger", "other"]
    times = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024:01:02 03:04:05",), ("20240102T030405",), ("02/01/2024 03:04:05",), ("bad",)], "x string")
    got = [r[0] for r in times.select(F.unix_timestamp(domain.parsed_time(F.col("x")))).collect()]
    assert got == [1704164645] * 4 + [None]
    spot = spark.range(1).select(geo.nautical(F.lit(18.9), F.lit(-72.5))).first()[0]
    assert spot == "18°54.0'N 072°30.0'W"


def test_position_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# PROVENANCE: SYNTHETIC_DEMO\nMMSI,BaseDateTime,LAT,LON,SOG\n419000001,2024-01-02T03:04:05,18.5,x,7.5\n")
    row = tables.read_positions(spark, str(tmp_path / "a.csv"), "marinecadastre").first()
    assert (row.mmsi, row.lat, row.lon, row.sog, row.imo) == ("419000001", 18.5, None, 7.5, None)
    assert tables.file_provenance(spark, str(tmp_path)).first()[0] == "SYNTHETIC_DEMO"
    with pytest.raises(ValueError, match="lat"):
        tables.canonical(spark.range(1).selectExpr("'1' mmsi", "'2024' timestamp"))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("1", m * 60.0) for m in (0, 5, 95, 100)] + [("2", m * 60.0) for m in (0, 20, 45)], "mmsi string, t double")
    rows.select("mmsi", F.timestamp_seconds("t").alias("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mmsi string, timestamp timestamp").parquet(str(tmp_path / "in"))
    query = stream_gaps(stream, 30).writeStream.format("memory").queryName("gaps_found").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("gaps_found").collect()] == [("1", 300.0, 5700.0, 90.0)]
