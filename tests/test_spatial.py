"""Quadtree joins against all pairs, the keyed table under repeated and failing writers, alarms of silent vessels."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from tidemark.operators import spatial
from tidemark.sources.keyed import Conflict, KeyedTable
from tidemark.streaming.alarms import silent_vessels

RING = "array<struct<x:double,y:double>>"
POINT = "id int, px double, py double"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def distance(corners, x, y):
    hit, best = False, math.inf
    for a, b in zip(corners, corners[1:] + corners[:1], strict=True):
        ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
        hit ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        best = min(best, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return 0 if hit else best


@pytest.fixture(scope="module")
def crowd():
    r = random.Random(4)
    dense = [(i, r.gauss(50, 0.3), r.gauss(-20, 0.3)) for i in range(900)]
    sparse = [(1000 + i, r.uniform(-100, 100), r.uniform(-100, 100)) for i in range(200)]
    return dense + sparse + [(2000 + i, 3.0, 3.0) for i in range(150)] + [(3000, None, 1.0), (3001, float("nan"), 0.0), (3002, 100.0, 100.0)]


@pytest.mark.parametrize(("limit", "depth"), [(20, 16), (50, 3), (5000, 16), (1, 9)])
def test_pairs_equal_brute_force(spark, crowd, limit, depth):
    r = random.Random(limit)
    shapes = [ring(*((x + s * math.cos(t), y + s * math.sin(t)) for t in (0, 1.3, 2.9, 4.4))) for x, y, s in [(50, -20, 0.2), (50.3, -20.1, 0.5), (0, 0, 200), (300, 300, 5), *((r.uniform(-100, 100), r.uniform(-100, 100), r.uniform(1, 30)) for _ in range(25))]]
    table = spark.createDataFrame([*enumerate(shapes), (90, []), (91, None), (92, ring((3, 3), (4, 4)))], f"shape_id int, ring {RING}")
    got = sorted((x.id, x.shape_id, round(x.distance, 6)) for x in spatial.within(spark.createDataFrame(crowd, POINT).repartition(3), table, 0.7, limit, depth).collect())
    want = sorted((i, k, round(distance(s, x, y), 6)) for i, x, y in crowd if x is not None and not math.isnan(x) for k, s in enumerate(shapes) if distance(s, x, y) <= 0.7)
    assert got == want


@pytest.mark.parametrize(("limit", "depth"), [(20, 16), (50, 3), (1, 6)])
def test_no_part_of_a_leaf_is_over_the_limit(spark, crowd, limit, depth):
    points = spark.createDataFrame(crowd, POINT)
    tree = spatial.quadtree(points, limit, depth)
    rows = spatial.located(points.filter("px is not null and not isnan(px)"), tree)
    assert rows.count() == len(crowd) - 2
    leaves = {(x.level, x.nx, x.ny): x.n for x in tree.nodes.filter("leaf").collect()}
    assert sum(leaves.values()) == len(crowd) - 2
    assert all(n <= limit for (level, _, _), n in leaves.items() if level < depth)
    # points of a square that can't be split are dealt by a hash, about evenly
    parts = {tuple(x)[:4]: x[4] for x in rows.groupBy(*spatial.NODE, "part").count().collect()}
    assert all(n <= limit for (level, *_), n in parts.items() if level < depth) and max(parts.values()) < max(2 * limit, limit + 30)
    inner = {(x.level, x.nx, x.ny) for x in tree.nodes.filter("not leaf").collect()}
    assert all((level - 1, x >> 1, y >> 1) in inner for level, x, y in leaves if level)


def test_nothing_meets_nothing(spark):
    none, shapes = spark.createDataFrame([], POINT), spark.createDataFrame([(1, ring((0, 0), (1, 0), (0, 1)))], f"shape_id int, ring {RING}")
    assert spatial.within(none, shapes, 1.0).collect() == []
    one = spark.createDataFrame([(1, 0.2, 0.2)], POINT)
    assert [tuple(x) for x in spatial.within(one, shapes, 0.0).collect()] == [(1, 1, 0.0)]
    assert spatial.within(one, shapes.limit(0), 1.0).collect() == []


def rows_of(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=str)


COLUMNS = "k string, t int, v string"


def test_upserts_keep_the_last_row_of_each_key(spark, tmp_path):
    own = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"], buckets=4)
    with pytest.raises(LookupError):
        own.read()
    make = lambda *rows: spark.createDataFrame(rows, COLUMNS)
    assert own.upsert(make(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n"))) == 1
    assert own.upsert(make(("a", 1, "late"), ("b", 1, "same time"), ("c", 5, None))) == 2
    assert rows_of(own) == sorted([("a", 2, "y"), ("b", 1, "same time"), (None, 1, "n"), ("c", 5, None)], key=str)
    assert rows_of(own, 1) == sorted([("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], key=str)
    assert own.upsert(make()) == 2
    with pytest.raises(ValueError, match="columns"):
        own.upsert(make(("a", 1, "x")).drop("v"))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    own = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"], buckets=8)
    own.upsert(spark.range(100).selectExpr("cast(id as string) k", "1 t", "'x' v"))
    before = own.commit().buckets
    own.upsert(spark.createDataFrame([("5", 2, "y")], COLUMNS))
    after = own.commit().buckets
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1 and own.read().count() == 100


def test_a_repeated_batch_and_a_failed_writer_leave_one_valid_version(spark, tmp_path):
    own = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"], buckets=2)
    one, two = spark.createDataFrame([("a", 1, "x")], COLUMNS), spark.createDataFrame([("a", 9, "y")], COLUMNS)
    assert own.upsert(one, "s", 0) == 1 and own.upsert(two, "s", 0) == 1 and rows_of(own) == [("a", 1, "x")]

    def dies():
        raise OSError("the writer died")

    with pytest.raises(OSError):
        own.upsert(two, "s", 1, _before_commit=dies)
    assert own.versions() == [1] and rows_of(own) == [("a", 1, "x")]
    assert own.upsert(two, "s", 1) == 2 and rows_of(own) == [("a", 9, "y")]
    assert len(own.vacuum(keep=1)) == 2 and own.versions() == [2] and rows_of(own) == [("a", 9, "y")]


def test_of_two_writers_the_second_begins_again(spark, tmp_path):
    own = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"], buckets=1)
    other = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"], buckets=1)
    done = []

    def meanwhile():
        if not done:
            done.append(other.upsert(spark.createDataFrame([("b", 1, "other")], COLUMNS)))

    assert own.upsert(spark.createDataFrame([("a", 1, "own")], COLUMNS), _before_commit=meanwhile) == 2
    assert rows_of(own) == [("a", 1, "own"), ("b", 1, "other")]
    with pytest.raises(Conflict):
        own.upsert(spark.createDataFrame([("a", 2, "x")], COLUMNS), tries=1, _before_commit=lambda: other.upsert(spark.createDataFrame([("b", 2, "x")], COLUMNS)) and None)


def test_a_stream_into_the_table(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, "x"), ("b", 1, "x")], [("a", 2, "y")]]):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    own = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], ["t"], buckets=2)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        stream.writeStream.foreachBatch(own.sink("s")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(own) == [("a", 2, "y"), ("b", 1, "x")] and own.commit().batches == {"s": len(own.versions()) - 1}


ORIGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def alarms(spark, tmp_path, batches, name, **kw):
    """Alarms of batches of (vessel, minute), each batch a run of its own from the same checkpoint."""
    out = []
    for i, rows in enumerate(batches):
        made = spark.createDataFrame([(m, ORIGIN + timedelta(minutes=t)) for m, t in rows], "mmsi string, timestamp timestamp")
        made.coalesce(1).write.parquet(str(tmp_path / f"{name}/in/{i}"))
        stream = spark.readStream.schema("mmsi string, timestamp timestamp").parquet(str(tmp_path / f"{name}/in/*"))
        found = silent_vessels(stream, 30, "10 minutes", **kw)
        query = found.writeStream.format("parquet").option("path", str(tmp_path / f"{name}/out")).option("checkpointLocation", str(tmp_path / f"{name}/state")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen = spark.read.schema("mmsi string, kind string, since double, until double, duration_min double").parquet(str(tmp_path / f"{name}/out")).collect()
        minute = lambda s: None if s is None or math.isnan(s) else (s - ORIGIN.timestamp()) / 60
        out.append(sorted((r.mmsi, r.kind, minute(r.since), minute(r.until)) for r in seen))
    return [sorted(set(b) - set(a)) for a, b in zip([[], *out], out, strict=False)]


def test_alarm_comes_before_the_next_report(spark, tmp_path):
    found = alarms(spark, tmp_path, [[("a", 0), ("b", 0)], [("b", 25), ("b", 50)], [("b", 70)], [("a", 100), ("b", 100)], [("b", 125)]], "one")
    assert ("a", "silent", 0.0, None) in sum(found[:3], []) and not any(x[1] == "resumed" for x in sum(found[:3], []))
    assert ("a", "resumed", 0.0, 100.0) in sum(found, []) and not any(x[0] == "b" and x[1] == "silent" and x[2] < 100 for x in sum(found, []))


def test_late_rows_and_forgotten_vessels(spark, tmp_path):
    found = alarms(spark, tmp_path, [[("a", 0), ("a", 20), ("b", 20)], [("b", 45), ("b", 70)], [("a", 5), ("b", 95)], [("b", 120), ("b", 145)], [("b", 170), ("b", 195)], [("b", 215)], [("a", 220), ("b", 220)]], "two", forget_min=60.0)
    mine = [x for x in sum(found, []) if x[0] == "a"]
    # the row of minute 5 is behind the watermark; forgotten, the vessel begins anew at 220
    assert mine == [("a", "silent", 20.0, None), ("a", "lost", 20.0, None)]


def test_several_silences_in_one_batch(spark, tmp_path):
    found = alarms(spark, tmp_path, [[("a", 100), ("a", 0), ("a", 40), ("a", 40), ("a", 70)]], "three")
    assert [x for x in found[0] if x[1] == "resumed"] == [("a", "resumed", 0.0, 40.0)]
