"""Points by polygons with partitions that follow the data: a quadtree whose leaves hold a bounded number of points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import written
from ..functions import polygon

#: Levels that are counted at once; open nodes go on to the next few.
AT_ONCE = 4
#: Nodes that are broadcast; larger trees are joined by shuffles.
BROADCAST = 1 << 18
NODE = ["level", "nx", "ny"]


@dataclass
class Quadtree:
    """Nodes (level, nx, ny, n, leaf) over the square (x0, y0, side); node (l, i, j) is the i-th by j-th of 4**l squares."""

    nodes: DataFrame
    x0: float
    y0: float
    side: float
    depth: int
    limit: int

    def place(self, value: Column, low: float, level: Column | int) -> Column:
        """Index of a coordinate at a level; what lies outside belongs to the first or last square."""
        n = F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level)).cast("long")
        return F.least(n - 1, F.greatest(F.lit(0).cast("long"), F.floor((value - low) / self.side * n)))

    def levels(self) -> list[int]:
        return sorted(r[0] for r in self.nodes.filter("leaf").select("level").distinct().collect())  # at most depth + 1


def quadtree(points: DataFrame, limit: int, depth: int = 16) -> Quadtree:
    """A tree over points (px, py), split where a square has more than `limit`, down to `depth`.

    Points are counted once by the finest squares; these counts, not the points, are added up level by level, and
    only those under open nodes go on. Squares without points are no nodes. Points without a place don't count.
    """
    there = points.filter("px is not null and py is not null and not isnan(px) and not isnan(py)")
    r = there.agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.greatest(F.max("px") - F.min("px"), F.max("py") - F.min("py")).alias("side")).first()
    tree = Quadtree(points.sparkSession.createDataFrame([], "level int, nx long, ny long, n long, leaf boolean"), r.x0 or 0.0, r.y0 or 0.0, r.side or 1.0, depth, limit)
    cells = there.groupBy(tree.place(F.col("px"), tree.x0, depth).alias("ix"), tree.place(F.col("py"), tree.y0, depth).alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    cells, top = written(cells, "cells"), 0
    while top <= depth and not cells.isEmpty():
        last = min(depth, top + AT_ONCE - 1)
        each = cells.withColumn("level", F.explode(F.sequence(F.lit(top), F.lit(last))))
        at = lambda c: F.expr(f"shiftright({c}, {depth} - level)")
        counts = written(each.groupBy("level", at("ix").alias("nx"), at("iy").alias("ny")).agg(F.sum("n").alias("n")), "nodes")
        above = counts.filter(F.col("n") > limit).select((F.col("level") + 1).alias("level"), F.col("nx").alias("ux"), F.col("ny").alias("uy"))
        own = counts.withColumns({"ux": F.shiftright("nx", 1), "uy": F.shiftright("ny", 1)})
        # the first of these levels lies under open nodes; further down the parent tells
        kept = own.filter(F.col("level") == top).unionByName(own.filter(F.col("level") > top).join(above, ["level", "ux", "uy"], "left_semi"))
        nodes = kept.select(*NODE, "n", ((F.col("n") <= limit) | (F.col("level") == depth)).alias("leaf"))
        tree.nodes = written(tree.nodes.unionByName(nodes), "nodes")
        opened = counts.filter((F.col("level") == last) & (F.col("n") > limit)).select("nx", "ny")
        shift = depth - last
        cells = written(cells.withColumns({"nx": F.shiftright("ix", shift), "ny": F.shiftright("iy", shift)}).join(opened, ["nx", "ny"], "left_semi").select("ix", "iy", "n"), "cells")
        top = last + 1
    return tree


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST else table


def located(points: DataFrame, tree: Quadtree) -> DataFrame:
    """Points with the leaf they lie in, and the part of it: leaves that can't be split are cut into parts by a hash."""
    leaves = tree.nodes.filter("leaf").select(*NODE, F.ceil(F.col("n") / tree.limit).cast("int").alias("parts"))
    level = F.explode(F.array(*map(F.lit, tree.levels())))
    rows = points.withColumn("level", level).withColumns({"nx": tree.place(F.col("px"), tree.x0, F.col("level")), "ny": tree.place(F.col("py"), tree.y0, F.col("level"))})
    return rows.join(_small(leaves), NODE).withColumn("part", F.pmod(F.xxhash64(*points.columns), F.col("parts")).cast("int")).drop("parts")


def overlapped(shapes: DataFrame, tree: Quadtree, buffer: float) -> DataFrame:
    """(shape_id, level, nx, ny, part) of the leaves that each shape's box, widened by the buffer, meets.

    Shapes come down the tree: from a node that isn't a leaf to those of its four squares that are nodes and meet
    the box. No shape is listed in squares without points.
    """
    end = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    at = shapes.filter(F.size("ring") > 2).select("shape_id", (end("x", F.array_min) - buffer).alias("w"), (end("y", F.array_min) - buffer).alias("s"), (end("x", F.array_max) + buffer).alias("e"), (end("y", F.array_max) + buffer).alias("t"))
    at = at.withColumns({"nx": F.lit(0).cast("long"), "ny": F.lit(0).cast("long")})
    found, nodes, deepest = None, tree.nodes, max(tree.levels(), default=-1)
    for level in range(deepest + 1):
        here = at.join(_small(nodes.filter(F.col("level") == level)), ["nx", "ny"])
        mine = here.filter("leaf").select("shape_id", *NODE, F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / tree.limit) - 1).cast("int"))).alias("part"))
        found = mine if found is None else found.unionByName(mine)
        if level == deepest:
            break
        steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
        down = here.filter("not leaf").withColumn("q", steps).withColumns({"nx": F.col("nx") * 2 + F.col("q.i"), "ny": F.col("ny") * 2 + F.col("q.j")})
        meets = F.col("nx").between(tree.place(F.col("w"), tree.x0, level + 1), tree.place(F.col("e"), tree.x0, level + 1)) & F.col("ny").between(tree.place(F.col("s"), tree.y0, level + 1), tree.place(F.col("t"), tree.y0, level + 1))
        at = written(down.filter(meets).select("shape_id", "w", "s", "e", "t", "nx", "ny"), "shapes")
    return found


def within(points: DataFrame, shapes: DataFrame, buffer: float, limit: int = 100_000, depth: int = 16) -> DataFrame:
    """points (id, px, py) x shapes (shape_id, ring) -> (id, shape_id, distance): each point in a ring (0) or within
    the buffer of its outline, once for each such shape.

    A point lies in one leaf, so every pair meets once, whatever the density; a task joins at most `limit` points
    of a leaf with the shapes there. Rings with fewer than three corners, and points without a place, meet nothing.
    Ids of shapes are unique.
    """
    points = points.filter("px is not null and py is not null and not isnan(px) and not isnan(py)").select("id", "px", "py")
    tree = quadtree(points, limit, depth)
    if not tree.levels():
        return points.sparkSession.createDataFrame([], points.select("id").schema.add("shape_id", shapes.schema["shape_id"].dataType).add("distance", "double"))
    listed = overlapped(shapes, tree, buffer).join(shapes.select("shape_id", "ring"), "shape_id")
    pairs = located(points, tree).join(listed, [*NODE, "part"])
    d = polygon.distance(F.col("ring"), F.col("px"), F.col("py"))
    return pairs.select("id", "shape_id", d.alias("distance")).filter(F.col("distance") <= buffer)
