"""Probability surfaces on sparse grids: histograms, kernel density, highest-density regions, drift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(particles: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """(label, ix, iy, n) of particles (label, px, py)."""
    at = lambda c, o: F.floor((F.col(c) - o) / cell).cast("int")
    return particles.groupBy("label", at("px", x0).alias("ix"), at("py", y0).alias("iy")).agg(F.count(F.lit(1)).alias("n"))


def smoothed(cells: DataFrame, sigma: float, value: str = "n") -> DataFrame:
    """Gaussian smoothing, separable: each axis is a join with 2r + 1 offsets by explode and a grouped sum.

    The kernel ends at four sigma and sums to one; mass that leaves the grid is lost at no edge.
    """
    r = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-r, r + 1), weights, strict=True)))

    def axis(rows: DataFrame, name: str) -> DataFrame:
        spread = rows.withColumn("o", F.explode(kernel)).withColumns({name: F.col(name) + F.col("o.k"), "v": F.col("v") * F.col("o.w")})
        return spread.groupBy("label", "ix", "iy").agg(F.sum("v").alias("v"))

    return axis(axis(cells.withColumn("v", F.col(value).cast("double")), "ix"), "iy").withColumnRenamed("v", "density")


def mass(cells: DataFrame, value: str) -> DataFrame:
    """Shares of each label's total; a label that sums to zero stays zero."""
    total = F.sum(value).over(Window.partitionBy("label"))
    return cells.select("label", "ix", "iy", F.when(total > 0, F.col(value) / total).otherwise(0.0).alias("p"))


def combined(masses: DataFrame, labels: int) -> DataFrame:
    """Mean map over the labels; a cell that a label lacks counts zero."""
    return masses.groupBy("ix", "iy").agg((F.sum("p") / labels).alias("p"))


def highest_density(masses: DataFrame, level: float) -> DataFrame:
    """Cells of the smallest region that holds at least `level` of the mass, with ties of its last cell."""
    order = Window.partitionBy("label").orderBy(F.desc("p"), "ix", "iy").rowsBetween(Window.unboundedPreceding, 0)
    rows = masses.withColumn("before", F.sum("p").over(order) - F.col("p"))
    edge = F.min(F.when(F.col("before") < level, F.col("p"))).over(Window.partitionBy("label"))
    return rows.withColumn("edge", edge).filter("p >= edge").select("label", "ix", "iy", "p")


def centre_spread(masses: DataFrame, x0: float, y0: float, cell: float) -> DataFrame:
    """Mass-weighted centre of each label and the root of its summed variances."""
    x, y = x0 + (F.col("ix") + 0.5) * cell, y0 + (F.col("iy") + 0.5) * cell
    sums = masses.groupBy("label").agg(*(F.sum(F.col("p") * e).alias(k) for k, e in {"w": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y}.items()))
    mx, my = F.col("x") / F.col("w"), F.col("y") / F.col("w")
    return sums.select("label", mx.alias("cx"), my.alias("cy"), F.sqrt(F.greatest(F.lit(0.0), F.col("xx") / F.col("w") - mx * mx + F.col("yy") / F.col("w") - my * my)).alias("spread"))


def filled(positions: DataFrame) -> DataFrame:
    """Inactive particles keep their last place: (pid, step, px, py) with nulls filled forward."""
    w = Window.partitionBy("pid").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return positions.select("pid", "step", F.last("px", True).over(w).alias("px"), F.last("py", True).over(w).alias("py"))


def advected(particles: DataFrame, steps: int, dt_h: float, wind: tuple[float, float]) -> DataFrame:
    """Transport of particles (member, pid, x, y, factor) through a rotating current plus a share of wind.

    Each particle is one row; its path is folded in an array expression, so members and particles run in
    parallel and nothing is exchanged. Transport only: no weathering.
    """
    u, v = wind
    start = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")))

    def step(path, _):
        at = F.element_at(path, -1)
        x = at["x"] + dt_h * (0.5 - 0.02 * at["y"] + F.col("factor") * u)
        y = at["y"] + dt_h * (0.1 + 0.02 * at["x"] + F.col("factor") * v)
        return F.concat(path, F.array(F.struct(x.alias("x"), y.alias("y"))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return particles.select("member", "pid", F.posexplode(path).alias("step", "at")).select("member", "pid", "step", F.col("at.x").alias("x"), F.col("at.y").alias("y"))


def sampled_field(points: DataFrame, field: DataFrame, step: tuple[float, float, float]) -> DataFrame:
    """Trilinear values of a regular field (it, iy, ix, u, v) at points (id, ft, fy, fx in grid units); null where one of
    the grid points around is missing, as outside the field. `step` is the field's spacing, for callers that keep it."""
    base = points.withColumns({f"b{a}": F.floor(f"f{a}").cast("int") for a in "tyx"})
    corner = F.explode(F.array(*(F.struct(*(F.lit(n).alias(f"d{a}") for a, n in zip("tyx", (i, j, k), strict=True))) for i in (0, 1) for j in (0, 1) for k in (0, 1))))
    rows = base.withColumn("c", corner)
    weight = F.lit(1.0)
    for a in "tyx":
        part = F.col(f"f{a}") - F.col(f"b{a}")
        weight = weight * F.when(F.col(f"c.d{a}") == 1, part).otherwise(1 - part)
    rows = rows.select("id", weight.alias("w"), *((F.col(f"b{a}") + F.col(f"c.d{a}")).alias(f"i{a}") for a in "tyx")).filter("w > 0")
    there = rows.join(field.withColumn("there", F.lit(1)), ["it", "iy", "ix"], "left")
    whole = F.count("there") == F.count(F.lit(1))
    return there.groupBy("id").agg(*(F.when(whole, F.sum(F.col("w") * F.col(c))).alias(c) for c in ("u", "v")))
