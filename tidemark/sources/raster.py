"""Tiled TIFF rasters as a table of pixels: a partition a block, and only the blocks that filters can meet are read.

    spark.dataSource.register(BlockedRaster)
    spark.read.format("blocked_raster").load("/scenes").filter("r between 100 and 300 and c < 512")

Columns: path, r, c (pixel, from 0), v (double), x and y (centre of the pixel, where the file has an affine).
Options: `decimate` k takes means of k x k pixels, as r // k and c // k; blocks are then read in groups that hold whole
squares. `pattern` chooses files in a folder. Filters on r and c are pushed down while
spark.sql.python.filterPushdown.enabled is true; Spark applies them again in any case.

One band of integers or floats, in tiles or strips, plain or deflated, with or without horizontal differences.
Blocks are read through pyarrow's file systems, so paths may be local or on a shared store.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, r int, c int, v double, x double, y double"
#: Bytes of the values of a tag, and their letters, by TIFF type.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
#: Tags by name.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strips", 277: "bands", 278: "strip_rows", 279: "strip_sizes", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_sizes", 339: "sample", 33550: "scale", 33922: "tie", 34264: "affine"}


@dataclass
class Layout:
    """Where a file's blocks are; affine: x = a col + b row + c, y = d col + e row + f."""

    order: str
    width: int
    height: int
    block_width: int
    block_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    dtype: str
    deflated: bool
    differences: bool
    affine: tuple[float, ...] | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)


def layout(file: pa.NativeFile) -> Layout:
    """The first directory of a TIFF."""
    head = file.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    file.seek(struct.unpack(order + "I", head[4:])[0])
    n = struct.unpack(order + "H", file.read(2))[0]
    found = {}
    for tag, kind, count, raw in struct.iter_unpack(order + "HHI4s", file.read(12 * n)):
        if tag in TAGS and kind in TYPES:
            found[TAGS[tag]] = (kind, count, raw)

    def values(name: str, default: tuple = ()) -> tuple:
        if name not in found:
            return default
        kind, count, raw = found[name]
        form = f"{order}{count}{TYPES[kind]}"
        size = struct.calcsize(form)
        if size > 4:
            file.seek(struct.unpack(order + "I", raw)[0])
            raw = file.read(size)
        return struct.unpack(form, raw[:size])

    one = lambda name, default=None: values(name, (default,))[0]
    if one("bands", 1) != 1 or one("compression", 1) not in (1, 8, 32946) or one("predictor", 1) not in (1, 2):
        raise ValueError("only one band, plain or deflated, is read")
    width, height = one("width"), one("height")
    tiled = "tiles" in found
    affine = None
    if "affine" in found:
        a = values("affine")
        affine = (a[0], a[1], a[3], a[4], a[5], a[7])
    elif "scale" in found and "tie" in found:
        (sx, sy, *_), (i, j, _, x, y, *_) = values("scale"), values("tie")
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    return Layout(
        order, width, height, one("tile_width") if tiled else width, one("tile_height") if tiled else min(height, one("strip_rows", height)), values("tiles" if tiled else "strips"), values("tile_sizes" if tiled else "strip_sizes"),
        f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one('sample', 1)] }{one('bits', 8) // 8}", one("compression", 1) != 1, one("predictor", 1) == 2, affine,
    )


def read_block(file: pa.NativeFile, shape: Layout, k: int) -> np.ndarray:
    """Block k, cut to the raster."""
    row, column = divmod(k, shape.across)
    height = min(shape.block_height, shape.height - row * shape.block_height)
    file.seek(shape.offsets[k])
    raw = file.read(shape.sizes[k])
    raw = zlib.decompress(raw) if shape.deflated else raw
    cells = np.frombuffer(raw, shape.dtype)
    cells = cells.reshape(-1, shape.block_width)  # the last strip may be short
    if shape.differences:
        cells = np.cumsum(cells, axis=1, dtype=cells.dtype)
    return cells[:height, : shape.width - column * shape.block_width]


@dataclass
class Block(InputPartition):
    """Blocks of one file that one task reads; rows and columns are those of the pixels wanted."""

    path: str
    shape: Layout
    blocks: tuple[int, ...]
    rows: tuple[int, int]
    columns: tuple[int, int]


class BlockedRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocked_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> BlockedReader:
        return BlockedReader(self.options)


class BlockedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern, self.factor = options["path"], options.get("pattern", "*.tif*"), int(options.get("decimate", "1"))
        self.low, self.high = {"r": 0, "c": 0}, {"r": None, "c": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on r and c narrow the window; all filters are given back, for Spark to apply to the pixels."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.low and isinstance(getattr(f, "value", None), (int, float)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    least = int(np.floor(f.value)) + 1 if isinstance(f, GreaterThan) else int(np.ceil(f.value))
                    self.low[name] = max(self.low[name], least)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    most = int(np.ceil(f.value)) if isinstance(f, LessThan) else int(np.floor(f.value)) + 1
                    self.high[name] = most if self.high[name] is None else min(self.high[name], most)
            yield f

    def _files(self) -> tuple[fs.FileSystem, list[str]]:
        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        if system.get_file_info(path).type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
            return system, sorted(f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern))
        return system, [path]

    def partitions(self) -> list[Block]:
        """Of each file the blocks that meet the window; with decimation, groups of blocks that hold whole squares."""
        system, files = self._files()
        out = []
        for path in files:
            with system.open_input_file(path) as file:
                shape = layout(file)
            span = lambda c, size: (self.low[c] * self.factor, min(size, size if self.high[c] is None else self.high[c] * self.factor))
            (r0, r1), (c0, c1) = span("r", shape.height), span("c", shape.width)
            # whole squares only
            r1, c1 = min(r1, shape.height // self.factor * self.factor), min(c1, shape.width // self.factor * self.factor)
            step = lambda block: int(np.lcm(block, self.factor))
            high, wide = step(shape.block_height), step(shape.block_width)
            for r in range(r0 // high * high, r1, high):
                for c in range(c0 // wide * wide, c1, wide):
                    rows, columns = (max(r, r0), min(r + high, r1)), (max(c, c0), min(c + wide, c1))
                    if rows[0] < rows[1] and columns[0] < columns[1]:
                        blocks = tuple(i * shape.across + j for i in range(rows[0] // shape.block_height, -(-rows[1] // shape.block_height)) for j in range(columns[0] // shape.block_width, -(-columns[1] // shape.block_width)))
                        out.append(Block(path, shape, blocks, rows, columns))
        return out

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block meets the window
            return
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        shape, (r0, r1), (c0, c1), k = partition.shape, partition.rows, partition.columns, self.factor
        whole = np.zeros((r1 - r0, c1 - c0))
        with system.open_input_file(partition.path) as file:
            for i in partition.blocks:
                row, column = (p * size for p, size in zip(divmod(i, shape.across), (shape.block_height, shape.block_width), strict=True))
                cells = read_block(file, shape, i)
                a, b = max(row, r0), min(row + cells.shape[0], r1)
                c, d = max(column, c0), min(column + cells.shape[1], c1)
                whole[a - r0 : b - r0, c - c0 : d - c0] = cells[a - row : b - row, c - column : d - column]
        whole = whole.reshape((r1 - r0) // k, k, (c1 - c0) // k, k).mean(axis=(1, 3)) if k > 1 else whole
        r, c = np.indices(whole.shape).reshape(2, -1) + np.array([[r0 // k], [c0 // k]])
        if shape.affine:
            a, b, x0, d, e, y0 = shape.affine
            row, column = (r + 0.5) * k, (c + 0.5) * k
            x, y = pa.array(a * column + b * row + x0), pa.array(d * column + e * row + y0)
        else:
            x = y = pa.nulls(len(r), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(r)), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(whole.ravel()), x, y], ["path", "r", "c", "v", "x", "y"])
