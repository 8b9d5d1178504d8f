"""Control points, tiles with a scorer, blocked raster files and the ellipsoid."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ellipsoid
from tidemark.operators import tiles, warp
from tidemark.sources import raster

CONTROL = "scene int, row double, col double, lon double, lat double"


def terms(x, y):
    return np.column_stack([np.ones_like(x), x, y, x * y, x * x, y * y])


def test_fit_equals_least_squares(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for scene in range(3):
        lon, lat = r.uniform(70, 72, 40), r.uniform(-15, -14, 40)
        row, col = 1000 * (lat + 14.5) ** 2 + 50 * lon + r.normal(0, 0.5, 40), 900 * lon - 100 * lat * lon + r.normal(0, 0.5, 40)
        rows += [(scene, *map(float, x)) for x in zip(row, col, lon, lat, strict=True)]
        a = terms(lon - lon.mean(), lat - lat.mean())
        want[scene] = [a @ np.linalg.lstsq(a, v, rcond=None)[0] - v for v in (row, col)]
    rows += [(7, 1.0, 2.0, 70.0, 15.0), (8, None, 1.0, 1.0, 1.0)] + [(9, float(i), float(i), 70.0 + i, 15.0 + i) for i in range(12)]
    points = spark.createDataFrame(rows, CONTROL).repartition(3)
    fits = warp.fitted(points)
    kept = {x.scene: x for x in fits.collect()}
    assert set(kept) == {0, 1, 2, 7, 9} and kept[7].row_k is None and kept[9].col_k is None and kept[0].n == 40
    got = warp.residuals(points.filter("scene < 3"), fits).collect()
    for scene in range(3):
        mine = sorted((x.lon, x.row_off, x.col_off) for x in got if x.scene == scene)
        order = np.argsort([x[3] for x in rows if x[0] == scene])
        assert np.allclose([x[1] for x in mine], want[scene][0][order], atol=1e-6) and np.allclose([x[2] for x in mine], want[scene][1][order], atol=1e-6)


def test_resampling_equals_a_loop(spark):
    r = np.random.default_rng(2)
    v = r.uniform(1, 9, (20, 24))
    v[r.random(v.shape) < 0.15] = 0.0
    control = [(1, 2 + 16 * (15 - la) + lo - 70, 1 + 20 * (lo - 70), lo, la) for lo in np.linspace(70, 71, 5).tolist() for la in np.linspace(14, 15, 5).tolist()]
    areas = spark.createDataFrame([(1, 70.1, 14.05, 71.3, 14.9), (2, 70.0, 14.0, 71.0, 15.0), (1, 71.0, 14.0, 70.0, 15.0)], "scene int, w double, s double, e double, n double")
    pixels = spark.createDataFrame([(1, i, j, float(v[i, j])) for i in range(20) for j in range(24)] + [(1, 50, 50, None)], "scene int, r int, c int, v double")
    got = {(x.gr, x.gc): x.v for x in warp.warped(pixels, spark.createDataFrame(control, CONTROL), areas, 9000.0).collect()}
    width, height = round(1.2 * 111320 * math.cos(math.radians(14.475)) / 9000), round(0.85 * 111320 / 9000)
    want = {}
    for i in range(height):
        for j in range(width):
            lo, la = 70.1 + (j + 0.5) * 1.2 / width, 14.9 - (i + 0.5) * 0.85 / height
            y, x = 2 + 16 * (15 - la) + lo - 70 - 0.5, 1 + 20 * (lo - 70) - 0.5
            near = [(a, b, (1 - abs(y - a)) * (1 - abs(x - b))) for a in (math.floor(y), math.floor(y) + 1) for b in (math.floor(x), math.floor(x) + 1)]
            near = [(v[a, b], w) for a, b, w in near if 0 <= a < 20 and 0 <= b < 24 and v[a, b] and w > 1e-9]
            if near:
                want[i, j] = sum(p * w for p, w in near) / sum(w for _, w in near)
    assert got == {k: pytest.approx(x, abs=1e-6) for k, x in want.items()}


def test_grids_have_a_limit(spark):
    areas = spark.createDataFrame([(1, 70.0, 10.0, 75.0, 15.0), (2, 70.0, 10.0, 70.1, 10.1), (3, 70.0, 10.0, 70.0, 10.1)], "scene int, w double, s double, e double, n double")
    assert {x.scene: x.accepted for x in warp.gridded(areas, 10.0).collect()} == {1: False, 2: True, 3: False}


def plain_scores(v, tile, overlap, scorer):
    h, w = v.shape
    p = np.pad(v, ((0, max(0, tile - h)), (0, max(0, tile - w))), mode="reflect").astype(np.float32)
    places = lambda n: sorted({*range(0, n - tile + 1, tile - overlap), n - tile})
    ys, xs = places(p.shape[0]), places(p.shape[1])
    bell = np.hanning(tile + 2)[1:-1]
    bell = np.maximum(np.outer(bell, bell), 1e-3) if len(ys) * len(xs) > 1 else np.ones((tile, tile))
    total, weight = np.zeros(p.shape), np.zeros(p.shape)
    for y in ys:
        for x in xs:
            total[y : y + tile, x : x + tile] += scorer(p[None, y : y + tile, x : x + tile])[0] * bell
            weight[y : y + tile, x : x + tile] += bell
    return (total / weight)[:h, :w]


@pytest.mark.parametrize(("h", "w", "tile", "overlap"), [(20, 33, 8, 3), (16, 16, 8, 0), (5, 30, 8, 2), (3, 4, 8, 2), (8, 8, 8, 4), (21, 8, 8, 7)])
def test_tiles_equal_numpy(spark, h, w, tile, overlap):
    def blurred(cells):
        """Looks at a tile's neighbours, and at its own mean."""
        padded = np.pad(cells, ((0, 0), (1, 1), (1, 1)))
        n = cells.shape[1]
        return sum(padded[:, i : i + n, j : j + n] for i in range(3) for j in range(3)) / 9 + cells.mean(axis=(1, 2), keepdims=True) / 7

    v = np.random.default_rng(h).normal(0, 1, (h, w))
    rows = [(k, i, j, float(v[i, j]) + k) for k in (3, 4) for i in range(h) for j in range(w)]
    pixels = spark.createDataFrame(rows, "scene int, r int, c int, v double").repartition(3)
    got = {(x.scene, x.r, x.c): x.z for x in tiles.scored(tiles.cut(pixels, tile, overlap), lambda: blurred, tile, at_once=3).collect()}
    assert len(got) == 2 * h * w
    for k in (3, 4):
        want = plain_scores(v + k, tile, overlap, blurred)
        assert all(abs(got[k, i, j] - want[i, j]) < 1e-4 for i in range(h) for j in range(w))


def test_missing_pixels_are_filled(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, None), ("a", 1, 2, float("nan"))], "scene string, r int, c int, v double")
    tile = tiles.cut(pixels, 3, 1, fill=5.0).first()
    assert (tile.rows, tile.columns, tile.cells[:3]) == (2, 3, [1.0, 5.0, 5.0]) and set(tile.cells[3:]) <= {1.0, 5.0}
    assert tiles.cut(pixels.limit(0)).collect() == []


def tiff(path, cells, block, order="<", deflate=True, differences=False, strips=False, affine=True):
    """A TIFF of one band."""
    h, w = cells.shape
    bh, bw = (block[0], w) if strips else block
    blocks = []
    for i in range(0, h, bh):
        for j in range(0, w, bw):
            part = cells[i : i + bh, j : j + bw]
            full = part if strips else np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1])))
            full = np.diff(full, axis=1, prepend=full.dtype.type(0)) if differences else full
            raw = full.astype(full.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [cells.dtype.itemsize * 8]), 259: ("H", [8 if deflate else 1]), 277: ("H", [1]), 317: ("H", [2 if differences else 1]), 339: ("H", [kind])}
    tags |= {273: ("I", None), 278: ("I", [bh]), 279: ("I", [len(b) for b in blocks])} if strips else {322: ("H", [bw]), 323: ("H", [bh]), 324: ("I", None), 325: ("I", [len(b) for b in blocks])}
    if affine:
        tags |= {33550: ("d", [0.5, 0.25, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 70.0, 20.0, 0.0])}
    at = 8 + 2 + 12 * len(tags) + 4
    extra, offsets, spot = b"", [], at + sum(8 * len(v or blocks) for _, v in tags.values()) + 16
    for b in blocks:
        offsets.append(spot)
        spot += len(b)
    tags[273 if strips else 324] = ("I", offsets)
    entries = b""
    for tag, (form, values) in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}{form}", *values)
        if len(raw) > 4:
            place, extra = at + len(extra), extra + raw
            raw = struct.pack(order + "I", place)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[form], len(values)) + raw.ljust(4, b"\0")
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)) + entries + bytes(4)
    body = head + extra
    path.write_bytes(body + bytes(offsets[0] - len(body)) + b"".join(blocks))


@pytest.fixture(scope="module")
def rasters(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(raster.BlockedRaster)
    yield spark.read.format("blocked_raster")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize("kind", [{}, {"order": ">", "deflate": False}, {"differences": True}, {"strips": True}, {"strips": True, "order": ">", "differences": True, "affine": False}])
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4"])
def test_all_pixels_of_a_file(rasters, tmp_path, kind, dtype):
    if dtype == "f4" and kind.get("differences"):
        pytest.skip("differences are for integers")
    cells = np.random.default_rng(3).integers(0, 200, (37, 50)).astype(dtype)
    tiff(tmp_path / "a.tif", cells, (16, 16), **kind)
    got = rasters.load(str(tmp_path)).collect()
    assert len(got) == cells.size and all(x.v == cells[x.r, x.c] for x in got)
    if kind.get("affine", True):
        assert all(x.x == 70 + (x.c + 0.5) * 0.5 and x.y == 20 - (x.r + 0.5) * 0.25 for x in got)
    else:
        assert got[0].x is None


def test_only_blocks_in_the_window_are_read(spark, rasters, tmp_path):
    cells = np.arange(64 * 80, dtype="u2").reshape(64, 80)
    tiff(tmp_path / "a.tif", cells, (16, 16))
    tiff(tmp_path / "b.tif", cells + 1, (16, 16))
    (tmp_path / "notes.txt").write_text("no raster")
    every = rasters.load(str(tmp_path))
    window = every.filter((F.col("r") >= 17) & (F.col("r") < 32) & (F.col("c") > 31) & (F.col("c") <= 48))
    assert every.rdd.getNumPartitions() == 40 and window.rdd.getNumPartitions() == 4
    got = window.collect()
    assert len(got) == 2 * 15 * 17 and all(x.v == cells[x.r, x.c] + x.path.endswith("b.tif") for x in got)
    assert every.filter("r = 5").rdd.getNumPartitions() == 10 and every.filter("r > 100").count() == 0


@pytest.mark.parametrize("k", [2, 3, 16, 50])
def test_decimation_is_the_mean_of_squares(rasters, tmp_path, k):
    cells = np.random.default_rng(5).integers(0, 200, (50, 66)).astype("i2")
    tiff(tmp_path / "a.tif", cells, (16, 32))
    h, w = 50 // k, 66 // k
    want = cells[: h * k, : w * k].reshape(h, k, w, k).mean(axis=(1, 3))
    got = {(x.r, x.c): x for x in rasters.option("decimate", k).load(str(tmp_path / "a.tif")).collect()}
    rasters.option("decimate", 1)
    assert set(got) == {(i, j) for i in range(h) for j in range(w)} and all(x.v == pytest.approx(want[p]) for p, x in got.items())
    assert got[0, 0].x == 70 + 0.25 * k


def test_other_files_are_refused(tmp_path):
    from pyarrow import fs

    (tmp_path / "a.tif").write_bytes(b"not a raster at all")
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.tif")) as file, pytest.raises(ValueError, match="TIFF"):
        raster.layout(file)


def test_distances_on_the_ellipsoid(spark):
    # published worked example: Flinders Peak to Buninyong, on another ellipsoid; here on WGS84, and simple arcs
    cases = [(144.42486789, -37.95103342, 143.92649554, -37.65282114), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0), (179.9, 5.0, -179.9, 5.0)]
    rows = spark.createDataFrame(cases, "a double, b double, c double, d double")
    got = [x.g for x in rows.select(ellipsoid.inverse(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).collect()]
    assert got[0].metres == pytest.approx(54972.271, abs=0.05) and got[0].azimuth == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=1e-5)
    assert got[1].metres == pytest.approx(6378137 * math.pi / 180, abs=1e-3) and got[1].azimuth == pytest.approx(90)
    assert got[2].metres == pytest.approx(10001965.729, abs=1e-2) and got[3].metres == 0
    assert got[4].metres == pytest.approx(0.2 * 6378137 * math.pi / 180 * math.cos(math.radians(5)), rel=1e-4) and got[4].azimuth == pytest.approx(90, abs=0.02)
    far = spark.createDataFrame([(0.0, 0.3, 179.8, -0.2)], "a double, b double, c double, d double")
    assert far.select(ellipsoid.inverse(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("g")).first().g is None


def test_projection_there_and_back(spark):
    rows = spark.createDataFrame([(lon0 + dx, lat0 + dy, lon0, lat0) for lon0, lat0 in ((70.0, 15.0), (179.99, -60.0), (0.0, 85.0), (-120.0, 0.0)) for dx in (-0.5, 0.0, 0.7) for dy in (-0.4, 0.0, 0.9)], "lon double, lat double, lon0 double, lat0 double")
    there = rows.withColumn("p", ellipsoid.to_plane(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0")))
    for x in there.withColumn("q", ellipsoid.from_plane(F.col("p.x"), F.col("p.y"), F.col("lon0"), F.col("lat0"))).collect():
        assert abs((x.q.lon - x.lon + 180) % 360 - 180) < 1e-9 and abs(x.q.lat - x.lat) < 1e-9
        assert math.copysign(1, x.p.y) == math.copysign(1, x.lat - x.lat0) or abs(x.lat - x.lat0) < 0.1


def test_affine_of_centres_and_corners(spark):
    row = spark.range(1).select(F.array(*map(F.lit, (0.5, 0.1, 70.0, 0.2, -0.25, 20.0))).alias("t"))
    x, y = ellipsoid.affine(F.col("t"), F.lit(2), F.lit(4))
    u, v = ellipsoid.affine(F.col("t"), F.lit(2), F.lit(4), centre=False)
    assert tuple(row.select(x, y, u, v).first()) == pytest.approx((0.5 * 4.5 + 0.1 * 2.5 + 70, 0.2 * 4.5 - 0.25 * 2.5 + 20, 0.5 * 4 + 0.1 * 2 + 70, 0.2 * 4 - 0.25 * 2 + 20))
