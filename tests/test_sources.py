"""Position files, presence reports, source choice and small functions that no query reaches."""

import json

from pyspark.sql import functions as F

from tidemark.functions import domain, geo
from tidemark.operators import impact, surface
from tidemark.sources import tables
from tidemark.streaming.gaps import sessions


def test_provenance_is_the_first_line(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.csv").write_text("mmsi,timestamp,lat,lon\n# PROVENANCE: REAL\n")
    assert tables.file_provenance(spark, str(tmp_path / "a")).first()[0] == "LOCAL_FILE"
    (tmp_path / "a/two.csv").write_text("# PROVENANCE: REAL live\nmmsi\n")
    assert tables.file_provenance(spark, str(tmp_path / "a")).first()[0] == "MIXED"


def test_presence_reports_flat_and_nested(spark, tmp_path):
    row = {"mmsi": "419000001", "date": "2024-01-02T03", "lat": 18.5, "lon": 71.0, "shipName": "A", "vesselType": "Undefined"}
    (tmp_path / "a.json").write_text(json.dumps({"entries": [row, {**row, "date": None}, {**row, "lat": None}]}))
    (tmp_path / "b.json").write_text(json.dumps({"entries": [{"public-presence": [{**row, "mmsi": "419000002"}]}]}))
    got = {r.mmsi: r for f in "ab" for r in tables.read_presence_report(spark, str(tmp_path / f"{f}.json")).collect() if r.mmsi}
    assert set(got) == {"419000001", "419000002"} and got["419000001"].vessel_name == "A" and got["419000001"].vessel_type is None


def test_a_day_ingested_again_is_replaced(spark, tmp_path):
    columns = "`Type of mobile` string, `# Timestamp` string, MMSI string, Latitude string, Longitude string"
    day = lambda lat, when: spark.createDataFrame([("Class A", when, "419000001", lat, "71.0"), ("Base Station", when, "419000002", lat, "71.0"), ("Class B", "bad time", "419000003", lat, "71.0")], columns)
    path = str(tmp_path / "days")
    for lat, when in (("18.0", "02/01/2024 03:04:05"), ("18.5", "03/01/2024 03:04:05"), ("19.0", "02/01/2024 03:04:05")):
        tables.ingest_day(day(lat, when), path)
    got = tables.scan_days(spark, path, (70, 17, 72, 20), "2024-01-01", "2024-01-04").collect()
    assert sorted(r.lat for r in got) == [18.5, 19.0]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    scan = tables.scan_days(spark, path, (70, 17, 72, 20), "2024-01-01", "2024-01-04")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(lat,17.0)" in plan


def test_the_first_source_with_rows_is_used(spark):
    some, none = spark.range(1), spark.range(0)
    name, rows, log = tables.select_source([("live", lambda: None), ("cache", lambda: none), ("demo", lambda: some), ("never", lambda: 1 / 0)])
    assert name == "demo" and rows.count() == 1 and log == ["live: no rows", "cache: no rows", "demo: used"]
    assert tables.select_source([("live", lambda: None)])[0] is None


def test_times_sentinels_and_regimes(spark):
    text = ["2024-01-02T03:04:05+05:30", "2024:01:02 03:04:05", "20240102T030405", "02/01/2024 03:04:05", "no time", None]
    rows = spark.createDataFrame([(t,) for t in text], "t string").select(F.unix_seconds(domain.parsed_time(F.col("t"))).alias("t"))
    assert [r.t for r in rows.collect()] == [1704144845, 1704164645, 1704164645, 1704164645, None, None]
    words = spark.createDataFrame([(w,) for w in ("Unknown", " nan ", "", " A ")], "w string").select(domain.null_sentinels(F.col("w")).alias("w"))
    assert [r.w for r in words.collect()] == [None, None, None, "A"]
    months = spark.range(1, 13).select(domain.monsoon_regime(F.col("id")).alias("r"))
    assert [r.r[0] for r in months.collect()] == list("nntttsssst" + "tn")


def test_boxes_that_touch_overlap(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    row = spark.range(1).select(geo.bboxes_overlap(box(0, 0, 1, 1), box(1, 1, 2, 2)), geo.bboxes_overlap(box(0, 0, 1, 1), box(1.1, 0, 2, 1)))
    assert tuple(row.first()) == (True, False)


def test_a_pause_splits_voyages(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 600), ("a", 2401), ("b", 0)], "mmsi string, t long").select("mmsi", F.timestamp_seconds("t").alias("timestamp"))
    assert sorted((r.mmsi, r.n) for r in sessions(rows, 30).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_points_at_the_edge_of_a_field(spark):
    field = spark.createDataFrame([(t, y, x, float(t + y + x), 1.0) for t in (0, 1) for y in (0, 1) for x in (0, 1)], "it int, iy int, ix int, u double, v double")
    points = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 1.0, 1.0, 1.0), (3, 0.5, 1.5, 0.0), (4, -1.0, 0.0, 0.0)], "id int, ft double, fy double, fx double")
    assert {r.id: r.u for r in surface.sampled_field(points, field, (1.0, 1.0, 1.0)).collect()} == {1: 1.5, 2: 3.0, 3: None, 4: None}


def test_a_long_list_of_places_raises(spark):
    import pytest

    with pytest.raises(ValueError, match="more than"):
        impact.listed(spark.range(impact.SHORT + 1).selectExpr("cast(id as string) place", "1.0D lat", "2.0D lon"))
