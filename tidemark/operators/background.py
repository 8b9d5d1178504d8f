"""Level of the sea around each pixel, and how far pixels lie above or below it (pixels: scene, r, c, v, sea)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import written

#: Steps of a unit in which anomalies are counted for medians: so few different values that one row sums them up.
STEPS = 1000


def coarse_levels(pixels: DataFrame, block: int, percent: float) -> DataFrame:
    """(scene, br, bc, level): percentile of the sea pixels of each block, null where a quarter (at least four) is missing."""
    keys = ["scene", F.floor(F.col("r") / block).cast("int").alias("br"), F.floor(F.col("c") / block).cast("int").alias("bc")]
    value = F.when(F.col("sea") & ~F.isnan("v"), F.col("v"))
    level = F.when(F.count(value) >= max(4, block * block // 4), F.percentile(value, percent))
    found = written(pixels.groupBy(*keys).agg(level.alias("level")), "levels")
    # every block of the scene's rectangle, whether it has pixels or not
    each = found.groupBy("scene").agg(F.max("br").alias("rows"), F.max("bc").alias("columns"))
    grid = each.withColumn("br", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("bc", F.explode(F.sequence(F.lit(0), F.col("columns"))))
    return grid.select("scene", "br", "bc").join(found, ["scene", "br", "bc"], "left")


def filled(blocks: DataFrame) -> DataFrame:
    """Blocks without a level take that of the nearest block with one, the first by row and column if several are.

    Down each column windows give the nearest level above and below; the nearest block is then one of those
    on the block's own row, which meet it by scene and row. Scenes without any level have no rows.
    """
    down = Window.partitionBy("scene", "bc").orderBy("br")
    known = F.when(F.col("level").isNotNull(), F.struct(F.col("br").alias("fr"), "level"))
    above = F.last(known, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(known, ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing))
    near = blocks.withColumns({"above": above, "below": below})
    # above wins ties: it is the smaller row
    pick = F.when(F.col("below").isNull() | (F.col("br") - F.col("above.fr") <= F.col("below.fr") - F.col("br")), F.col("above")).otherwise(F.col("below"))
    near = written(near.select("scene", "br", "bc", "level", F.coalesce(pick, F.col("below")).alias("at")), "columns")
    lacking = near.filter("level is null").select("scene", "br", "bc")
    there = near.filter("at is not null").select("scene", "br", F.col("bc").alias("fc"), "at")
    off = F.pow(F.col("bc") - F.col("fc"), F.lit(2)) + F.pow(F.col("br") - F.col("at.fr"), F.lit(2))
    found = lacking.join(there, ["scene", "br"]).groupBy("scene", "br", "bc").agg(F.min_by("at.level", F.struct(off, F.col("at.fr"), F.col("fc"))).alias("level"))
    return near.filter("level is not null").select("scene", "br", "bc", "level").union(found)


def _edges_repeated(rows: DataFrame, axis: str, before: int, after: int) -> DataFrame:
    """Grids (scene, br, bc, ...) continued by copies of their first and last lines along an axis."""
    ends = rows.groupBy("scene").agg(F.min(axis).alias("first"), F.max(axis).alias("last"))
    x = F.col(axis)
    places = F.sequence(F.when(x == F.col("first"), x - before).otherwise(x), F.when(x == F.col("last"), x + after).otherwise(x))
    return rows.join(ends, "scene").withColumn(axis, F.explode(places)).drop("first", "last")


def smoothed(blocks: DataFrame, k: int) -> DataFrame:
    """Median of the k x k blocks around each (of an even number of values the upper one), edges repeated.

    Even windows reach one block farther up and left. Values come from two windows, along rows and then down
    columns, so no block is copied to its neighbours.
    """
    up, on = k // 2, k - 1 - k // 2
    wide = _edges_repeated(_edges_repeated(blocks, "bc", up, on), "br", up, on)
    row = F.collect_list("level").over(Window.partitionBy("scene", "br").orderBy("bc").rowsBetween(-up, on))
    square = F.flatten(F.collect_list("row").over(Window.partitionBy("scene", "bc").orderBy("br").rowsBetween(-up, on)))
    rows = wide.withColumn("row", row).withColumn("all", square)
    kept = rows.join(blocks.select("scene", "br", "bc"), ["scene", "br", "bc"], "left_semi")
    return kept.select("scene", "br", "bc", F.element_at(F.array_sort("all"), k * k // 2 + 1).alias("level"))


def enlarged(pixels: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """Pixels with `background`: block levels drawn out linearly, first and last blocks on first and last pixels."""
    across, down = Window.partitionBy("scene", "br").orderBy("bc"), Window.partitionBy("scene", "bc").orderBy("br")
    rows = blocks.withColumn("right", F.coalesce(F.lead("level").over(across), F.col("level")))
    rows = rows.withColumns({"low": F.coalesce(F.lead("level").over(down), F.col("level")), "low_right": F.coalesce(F.lead("right").over(down), F.col("right"))})
    sizes = blocks.groupBy("scene").agg((F.max("br") + 1).alias("rows"), (F.max("bc") + 1).alias("columns"))
    place = lambda x, n: F.when(F.col(n) > 1, F.col(x) * (F.col(n) - 1) / (F.col(n) * block - 1)).otherwise(0.0)
    at = pixels.join(sizes, "scene").withColumns({"y": place("r", "rows"), "x": place("c", "columns")})
    at = at.withColumns({"br": F.floor("y").cast("int"), "bc": F.floor("x").cast("int")})
    fy, fx = F.col("y") - F.col("br"), F.col("x") - F.col("bc")
    level = (F.col("level") * (1 - fx) + F.col("right") * fx) * (1 - fy) + (F.col("low") * (1 - fx) + F.col("low_right") * fx) * fy
    return at.join(rows, ["scene", "br", "bc"]).withColumn("background", level).select(*pixels.columns, "background")


def _median(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Median of a scene's values in `STEPS` of a unit, from the counts of the different ones."""
    counts = rows.groupBy("scene", F.round(F.col(column) * STEPS).cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("scene").agg((F.percentile(F.col("x"), 0.5, F.col("n")) / STEPS).alias(name))


def anomalies(pixels: DataFrame, block: int, percent: float = 0.6, window: int = 3, dark: float = -3.0, grey: float = 150.0, spread: float = 40.0) -> DataFrame:
    """Pixels with `background`, `anomaly` (0 on land) and `grey` (0 to 255), and their scene's `deviation`.

    The deviation is robust (1.4826 times the median distance from the median, at least 0.3) and leaves
    pixels darker than `dark` out. Scenes without enough sea for a single block have no rows.
    """
    around = written(enlarged(pixels, smoothed(filled(coarse_levels(pixels, block, percent)), window), block), "background")
    off = around.withColumn("anomaly", F.col("v") - F.col("background"))
    core = off.filter(F.col("sea") & (F.col("anomaly") > dark)).select("scene", "anomaly")
    middle = _median(core, "anomaly", "middle")
    apart = core.join(middle, "scene").select("scene", F.abs(F.col("anomaly") - F.col("middle")).alias("apart"))
    deviation = F.greatest(F.lit(0.3), 1.4826 * F.coalesce("mad", F.lit(0.0)))
    rows = off.join(_median(apart, "apart", "mad"), "scene", "left").withColumn("deviation", deviation)
    shade = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), grey + F.col("anomaly") * spread / F.col("deviation"))))
    sea = F.col("sea")
    return rows.select("scene", "r", "c", "background", F.when(sea, F.col("anomaly")).otherwise(0.0).alias("anomaly"), F.when(sea, shade).otherwise(grey).cast("int").alias("grey"), "deviation")
