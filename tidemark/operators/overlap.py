"""Polygons against polygons: what observations share, and how a spill moved between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import shuffles_removed
from ..functions import polygon
from ..functions.geo import EARTH_KM, bearing_deg, haversine_km


#: Observations of one horizon that meet without cells of space.
FEW = 2000
#: Parts of time from which these are made wider than the horizon.
MANY_PARTS = 256
#: Pairs of observations, and of sides, that a task holds at once.
PAIRS, SIDES = 1 << 16, 1 << 18


def _place(lat: Column, lon: Column) -> list[Column]:
    """A point of the sphere in space (km)."""
    a, o = F.radians(lat), F.radians(lon)
    return [EARTH_KM * x for x in (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))]


def _cell(lat: Column, lon: Column, size_km: float) -> list[Column]:
    """Cell of a point of the sphere in space: neither poles nor the date line are special."""
    return [F.floor(x / size_km).alias(c) for c, x in zip(("ux", "uy", "uz"), _place(lat, lon), strict=True)]


def _on_sphere(size_km: float) -> Column:
    """Whether a cell holds a part of the sphere (or nearly, for rounding): the others have no points."""
    radius = EARTH_KM / size_km
    low, high = [[f(F.abs(F.col(c)), F.abs(F.col(c) + 1)) for c in ("ux", "uy", "uz")] for f in (F.least, F.greatest)]
    # a cell lies on one side of zero, so its nearest and farthest corners bound its distances from the centre
    far = lambda ends: F.sqrt(sum((x * x for x in ends[1:]), ends[0] * ends[0]))
    return (far(low) <= radius + 1e-6 * radius) & (far(high) >= radius - 1e-6 * radius)


def _layout(spills: DataFrame, max_kmh: float, horizon_h: float) -> tuple[float, float | None]:
    """Widths of parts of time (s) and of cells of space (km): wide ones, as fewer observations are then listed twice,
    while few are within one horizon; no cells if all of a horizon can meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Outlines(pa.Table.from_batches([batch]))
            part, at, n = np.unique(np.floor(own.t / (horizon_h * 3600)).astype(np.int64), return_inverse=True, return_counts=True)
            far = np.zeros(len(part))
            np.maximum.at(far, at, own.far)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n, pa.int64()), pa.array(far)], ["part", "n", "far"])

    parts = spills.select("t", "lat", "lon", "ring").mapInArrow(run, "part long, n long, far double").groupBy("part").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    with shuffles_removed(spills.sparkSession):
        most, first, last, far = parts.agg(F.max("n"), F.min("part"), F.max("part"), F.max("far")).first()
    spans = (last or 0) - (first or 0)
    wide = next((k for k in (8, 4, 2) if spans >= MANY_PARTS * k), 1)
    reach = max(max_kmh * horizon_h, 2 * (far or 0.0), 1e-3)
    return wide * horizon_h * 3600, None if (most or 0) <= FEW else reach


class Outlines:
    """Observations of a sorted table as arrays: t, lat, lon, farthest corner, and rings in the plane that keeps areas."""

    def __init__(self, table: pa.Table) -> None:
        self.t, self.lat, self.lon = (table.column(c).to_numpy().astype(float) for c in ("t", "lat", "lon"))
        flat = table.column("ring").combine_chunks()
        flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
        n = flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        self.first = np.append(0, np.cumsum(n))
        owner = np.repeat(np.arange(len(n)), n)
        lon, lat = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2).T
        off = _km(self.lat[owner], self.lon[owner], lat, lon)
        self.far = self._each(np.fmax, off, n, 0.0)
        x, y = EARTH_KM * np.radians(lon), EARTH_KM * np.sin(np.radians(lat))
        self.low, self.high = ([self._each(f, c, n, np.nan) for c in (x, y)] for f in (np.minimum, np.maximum))
        after = np.arange(len(owner)) + 1
        ends = self.first[1:][n > 0] - 1
        after[ends] = self.first[:-1][n > 0]
        # a side from left to right, + 1 where the inside of a counter-clockwise ring is below
        right = x < x[after]
        self.l, self.r, self.y = np.where(right, x, x[after]), np.where(right, x[after], x), np.where(right, y, y[after])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.k = np.where(x != x[after], (y[after] - y) / (x[after] - x), 0.0)
        self.up = np.where(right, -1.0, 1.0)
        area = np.bincount(owner, x * y[after] - x[after] * y, len(n)) / 2
        self.area = np.where(np.isnan(area), 0.0, area)

    @staticmethod
    def _each(f: np.ufunc, values: np.ndarray, n: np.ndarray, none: float) -> np.ndarray:
        out, first = np.full(len(n), none), np.cumsum(n) - n
        if len(values):
            out[n > 0] = f.reduceat(values, first[n > 0])
        return out

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Areas that rings a[i] and b[i] share, as polygon.intersection_area has them; 0 where boxes don't meet."""
        out = np.zeros(len(a))
        meet = np.ones(len(a), bool)
        for low, high in zip(self.low, self.high, strict=True):
            meet &= (low[a] < high[b]) & (low[b] < high[a])
        met = np.flatnonzero(meet)
        a, b = a[met], b[met]
        base = np.minimum(self.low[1][a], self.low[1][b])
        n_a, n_b = (self.first[x + 1] - self.first[x] for x in (a, b))
        # sides of a, each with all sides of its b, some at once
        pair = np.repeat(np.arange(len(a)), n_a)
        e = _ranges(self.first[a], n_a)
        upto, total, i = np.cumsum(n_b[pair]), np.zeros(len(a)), 0
        while i < len(pair):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SIDES, "right")))
            m = n_b[pair[i:j]]
            own, x, y = np.repeat(pair[i:j], m), np.repeat(e[i:j], m), _ranges(self.first[b[pair[i:j]]], m)
            l, r = np.maximum(self.l[x], self.l[y]), np.minimum(self.r[x], self.r[y])
            held = np.flatnonzero(l < r)
            own, x, y, l, r = own[held], x[held], y[held], l[held], r[held]
            x0, x1 = (self.y[x] + self.k[x] * (c - self.l[x]) for c in (l, r))
            y0, y1 = (self.y[y] + self.k[y] * (c - self.l[y]) for c in (l, r))
            d0, d1 = x0 - y0, x1 - y1
            both = np.abs(d0) + np.abs(d1)
            with np.errstate(divide="ignore", invalid="ignore"):
                apart = np.where(d0 * d1 >= 0, both / 2, (d0 * d0 + d1 * d1) / (2 * both))
            total += np.bincount(own, self.up[x] * self.up[y] * (r - l) * ((x0 + y0 + x1 + y1) / 4 - base[own] - apart / 2), len(a))
            i = j
        total *= np.sign(self.area[a]) * np.sign(self.area[b])
        most = np.minimum(np.abs(self.area[a]), np.abs(self.area[b]))
        out[met] = np.where(total > 1e-9 * most, np.minimum(total, most), 0.0)
        return out


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """As geo.haversine_km."""
    a, b = np.radians(lat1), np.radians(lat2)
    half = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return EARTH_KM * 2 * np.arcsin(np.sqrt(half))


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + sizes[i] - 1 of all i."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _met(rows: DataFrame, keys: list[str], max_kmh: float, horizon_h: float) -> DataFrame:
    """rows, sorted by keys and time within a task -> pairs with what they share. The rows of one horizon are held."""
    sides = {"a": ("id", "lat", "lon", "area_m2", "pred_lat", "pred_lon"), "b": ("id", "lat", "lon", "area_m2")}
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{c}_{x} {kinds[c]}" for x, names in sides.items() for c in names] + [f"{c} double" for c in ("hours", "d_km", "shared", "size_a", "size_b")])
    reach = horizon_h * 3600 * (1 + 1e-9)

    def met(table: pa.Table, old: int) -> Iterator[pa.RecordBatch]:
        own = Outlines(table)
        new = np.zeros(len(own.t), bool)
        for c in keys:
            part = table.column(c).to_numpy()
            new[1:] |= part[1:] != part[:-1]
        edges = np.append(np.flatnonzero(np.append(True, new[1:])), len(new))
        lo, hi = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lo[i:j] = i + np.searchsorted(own.t[i:j], own.t[i:j] - reach, "left")
            hi[i:j] = i + np.searchsorted(own.t[i:j], own.t[i:j], "left")
        hi[:old] = lo[:old]
        n = np.where(table.column("home").to_numpy(zero_copy_only=False), hi - lo, 0)
        last, i = np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(last, (last[i - 1] if i else 0) + PAIRS, "right")))
            b, a = np.repeat(np.arange(i, j), n[i:j]), _ranges(lo[i:j], n[i:j])
            hours, d = (own.t[b] - own.t[a]) / 3600, _km(own.lat[a], own.lon[a], own.lat[b], own.lon[b])
            near = (d <= max_kmh * hours) | (d < own.far[a] + own.far[b])
            kept = np.flatnonzero((hours > 0) & (hours <= horizon_h) & near)
            a, b, hours, d = a[kept], b[kept], hours[kept], d[kept]
            shared = own.shared(a, b)
            kept = np.flatnonzero((shared > 0) | (d <= max_kmh * hours))
            a, b = a[kept], b[kept]
            if len(kept):
                columns = [table.column(c).take(pa.array(at)).combine_chunks() for x, at in (("a", a), ("b", b)) for c in sides[x]]
                figures = (hours[kept], d[kept], shared[kept], np.abs(own.area[a]), np.abs(own.area[b]))
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, figures)], [f"{c}_{x}" for x in sides for c in sides[x]] + ["hours", "d_km", "shared", "size_a", "size_b"])
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            yield from met(table, 0 if held is None else len(held))
            same = np.array(table.column("t").to_numpy() >= table.column("t")[-1].as_py() - reach)
            for c in keys:
                same &= table.column(c).to_numpy() == table.column(c)[-1].as_py()
            held = table.filter(pa.array(same))

    return rows.mapInArrow(run, schema)


def compared(spills: DataFrame, max_kmh: float = 3.0, horizon_h: float = 72.0) -> DataFrame:
    """Pairs of observations of one spill, the later one b, with what changed.

    spills: id, t, lat, lon (centre), area_m2, ring of (lon, lat) corners in degrees, and where drift predicted the
    centre for the next observation (pred_lat, pred_lon, or null). Two observations are one spill if their outlines
    share an area or their centres are within `max_kmh`. Ids are unique; a null or empty ring shares nothing.

    Observations are dealt out once, with their outlines, to parts of time and, where many are within one horizon, to
    cells of space; an earlier one is listed in each part and cell that its reach touches, and pairs are made in the part
    and cell of the later one, in order of time. Pairs are neither shuffled nor written.
    """
    flat = F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    spills = spills.select("id", F.col("t").cast("double").alias("t"), *(F.col(c).cast("double").alias(c) for c in ("lat", "lon")), "area_m2", "pred_lat", "pred_lon", flat.alias("ring")).filter("t is not null and lat is not null and lon is not null")
    wide, size = _layout(spills, max_kmh, horizon_h)
    own, keys = F.floor(F.col("t") / wide), ["bucket"]
    rows = spills.withColumn("bucket", F.explode(F.sequence(own, F.floor((F.col("t") + horizon_h * 3600 * (1 + 1e-9)) / wide)))).withColumn("home", F.col("bucket") == own)
    if size is not None:
        # cells twice as wide as two can be apart
        places = dict(zip(("ux", "uy", "uz"), _place(F.col("lat"), F.col("lon")), strict=True))
        for c, x in places.items():
            rows = rows.withColumn(c, F.explode(F.sequence(F.floor((x - size) / (2 * size)), F.floor((x + size) / (2 * size))))).withColumn("home", F.col("home") & (F.col(c) == F.floor(x / (2 * size))))
        rows, keys = rows.filter(_on_sphere(2 * size)), [*keys, *places]
    rows = _met(rows.repartition(*keys).sortWithinPartitions(*keys, "t"), keys, max_kmh, horizon_h)
    whole = F.col("size_a") + F.col("size_b") - F.col("shared")
    grown = F.col("area_m2_b") - F.col("area_m2_a")
    return rows.select(
        "id_a", "id_b", "hours", "d_km", (F.col("shared") > 0).alias("overlap"), bearing_deg(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")).alias("direction_deg"),
        (F.col("d_km") / F.col("hours")).alias("speed_kmh"), grown.alias("area_change_m2"), (grown / F.col("hours")).alias("spreading_m2_h"),
        F.col("shared").alias("shared_km2"), F.when(whole > 0, F.col("shared") / whole).otherwise(0.0).alias("iou"),
        haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("pred_lat_a"), F.col("pred_lon_a")).alias("modelled_km"),
        haversine_km(F.col("pred_lat_a"), F.col("pred_lon_a"), F.col("lat_b"), F.col("lon_b")).alias("drift_error_km"),
    )


def cut_to_box(shapes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Shapes with their rings cut to a box; those without a part in it go."""
    return shapes.withColumn("ring", polygon.clipped(F.col("ring"), west, south, east, north)).filter(F.size("ring") > 2)
