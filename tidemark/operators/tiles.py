"""Scenes cut into overlapping tiles, scored by any function of NumPy batches, and put together again."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer takes tiles (n, tile, tile) as 32-bit floats and gives as many scores.
Scorer = Callable[[np.ndarray], np.ndarray]


def _starts(at: Column, length: Column, tile: int, stride: int) -> Column:
    """First places of the tiles over a place: every `stride`, and one that ends where the scene does."""
    last = F.greatest(F.lit(0), length - tile)
    low, high = F.greatest(F.lit(0), F.ceil((at - (tile - 1)) / stride)), F.least(F.floor(at / stride), F.floor(last / stride))
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: k * stride)).otherwise(F.array().cast("array<bigint>"))
    return F.array_union(regular, F.when(at >= last, F.array(last.cast("long"))).otherwise(F.array().cast("array<bigint>")))


def _reflected(rows: DataFrame, axis: str, length: str, tile: int) -> DataFrame:
    """Scenes shorter than a tile continued by their mirror image (the edge pixel once), to and fro if need be."""
    n, x = F.col(length), F.col(axis)
    period = F.greatest(F.lit(1), 2 * n - 2)
    places = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(tile)) - 1), lambda p: F.least(p % period, period - p % period) == x)
    single = F.sequence(F.lit(0).cast("long"), F.lit(tile - 1).cast("long"))
    return rows.withColumn(axis, F.explode(F.when(n >= tile, F.array(x.cast("long"))).when(n == 1, single).otherwise(places)))


def cut(pixels: DataFrame, tile: int = 256, overlap: int = 32, fill: float = 0.0) -> DataFrame:
    """Pixels (scene, r, c, v) -> tiles (scene, rows, columns, tr, tc, cells): tile x tile values by rows.

    rows and columns are the scene's size, so that no one asks again. Missing pixels have the value `fill`. A tile
    is one row of a bounded size.
    """
    sizes = pixels.groupBy("scene").agg((F.max("r") + 1).cast("long").alias("rows"), (F.max("c") + 1).cast("long").alias("columns"))
    rows = pixels.select("scene", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("v").cast("float").alias("v")).join(sizes, "scene")
    rows = _reflected(_reflected(rows, "r", "rows", tile), "c", "columns", tile)
    stride = tile - overlap
    rows = rows.withColumn("tr", F.explode(_starts(F.col("r"), F.col("rows"), tile, stride))).withColumn("tc", F.explode(_starts(F.col("c"), F.col("columns"), tile, stride)))
    at = ((F.col("r") - F.col("tr")) * tile + F.col("c") - F.col("tc")).cast("int")
    listed = rows.groupBy("scene", "rows", "columns", "tr", "tc").agg(F.collect_list(F.struct(at.alias("at"), "v")).alias("listed"))
    head = ", ".join(f"{c} {t}" for c, t in listed.drop("listed").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("listed")
            flat = lists.flatten()
            cells = np.full(len(batch) * tile * tile, fill, np.float32)
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            value = flat.field(1).to_numpy(zero_copy_only=False)
            cells[row * tile * tile + flat.field(0).to_numpy()] = np.where(np.isnan(value), np.float32(fill), value)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * tile * tile), pa.array(cells))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scene", "rows", "columns", "tr", "tc")), whole], ["scene", "rows", "columns", "tr", "tc", "cells"])

    return listed.mapInArrow(run, f"{head}, cells array<float>")


def weights(tile: int) -> np.ndarray:
    """Bell in both directions, at least a thousandth, so that tiles fade into each other."""
    bell = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(1, tile + 1) / (tile + 1))
    return np.maximum(np.outer(bell, bell), 1e-3)


def scored(tiles: DataFrame, make: Callable[[], Scorer], tile: int = 256, at_once: int = 8) -> DataFrame:
    """Tiles -> (scene, r, c, z): scores of a pixel's tiles, their mean weighted by nearness to the tiles' middles.

    `make` is called once a task (it may load a model) and gives the scorer, which gets up to `at_once` tiles. Each
    tile gives a row a pixel of the scene, without the continued part; means are added up where they are made first.
    """
    head = dict(tiles.dtypes)["scene"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, bell = make(), weights(tile)
        r, c = np.divmod(np.arange(tile * tile), tile)
        for batch in batches:
            cells = batch.column("cells").flatten().to_numpy().reshape(-1, tile, tile)
            place = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("rows", "columns", "tr", "tc")}
            for i in range(0, len(cells), at_once):
                found = np.asarray(scorer(cells[i : i + at_once]), np.float64)
                for k, z in enumerate(found, i):
                    row, column = place["tr"][k] + r, place["tc"][k] + c
                    kept = (row < place["rows"][k]) & (column < place["columns"][k])
                    n = int(kept.sum())
                    # a scene of one tile takes its scores as they are
                    w = np.ones(n) if place["rows"][k] <= tile and place["columns"][k] <= tile else bell.ravel()[kept]
                    scene = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), batch.column("scene").slice(k, 1)).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([scene, pa.array(row[kept].astype(np.int32)), pa.array(column[kept].astype(np.int32)), pa.array(z.ravel()[kept] * w), pa.array(w)], ["scene", "r", "c", "zw", "w"])

    each = tiles.mapInArrow(run, f"scene {head}, r int, c int, zw double, w double")
    return each.groupBy("scene", "r", "c").agg((F.sum("zw") / F.sum("w")).alias("z"))


def probabilities(pixels: DataFrame, make: Callable[[], Scorer], tile: int = 256, overlap: int = 32) -> DataFrame:
    """(scene, r, c, probability): the sigmoid of the tiles' mean scores."""
    found = scored(cut(pixels, tile, overlap), make, tile)
    return found.select("scene", "r", "c", (1 / (1 + F.exp(-F.col("z")))).alias("probability"))
