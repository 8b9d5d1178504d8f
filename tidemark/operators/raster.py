"""Raster operators on pixel tables (scene, r, c, v): windows over rows and columns, no arrays.

Tables of pixels and labels are stored in a hundredth of their size in memory, from which the planner would take them for
small and send them through the driver: joins of them ask for a merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import written


def _along(axis: str, reach: int) -> Window:
    other = "c" if axis == "r" else "r"
    return Window.partitionBy("scene", other).orderBy(axis).rangeBetween(-reach, reach)


def box_sums(pixels: DataFrame, columns: dict[str, str], half: int) -> DataFrame:
    """Sums of the square of 2 half + 1 pixels around each pixel, cut at the edge: rows first, then columns."""
    rows = pixels.withColumns({f"{k}_": F.sum(v).over(_along("r", half)) for k, v in columns.items()})
    return rows.withColumns({k: F.sum(f"{k}_").over(_along("c", half)) for k in columns}).drop(*(f"{k}_" for k in columns))


def mirrored(pixels: DataFrame, half: int) -> DataFrame:
    """Scenes continued by `half` pixels of their mirror image at each edge (the edge pixel comes twice).

    Scenes have at least `half` rows and columns; the continued ones begin at -half.
    """
    sizes = F.broadcast(pixels.groupBy("scene").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns")))  # one row a scene
    rows = pixels.join(sizes, "scene")
    for axis, size in (("r", "rows"), ("c", "columns")):
        x, n = F.col(axis), F.col(size)
        places = F.array(x, F.when(x < half, -1 - x), F.when(x >= n - half, 2 * n - 1 - x))
        rows = rows.withColumn(axis, F.explode(F.filter(places, lambda p: p.isNotNull())))
    return rows


def cfar(pixels: DataFrame, guard: int, background: int, k: float, ceiling: float = 254.5, floor: float = 0.0) -> DataFrame:
    """Pixels brighter than mean + k deviations of the ring between the guard and background squares.

    The threshold is at most `ceiling`; darker pixels than `floor` never count. Scenes are mirrored at
    their edges, so every ring has all its pixels.
    """
    rows = mirrored(pixels, background).withColumn("vv", F.col("v") * F.col("v"))
    sums = {"s": "v", "q": "vv"}
    rows = box_sums(rows, {f"{a}i": b for a, b in sums.items()}, guard)
    rows = box_sums(rows, {f"{a}o": b for a, b in sums.items()}, background)
    rows = rows.filter("r >= 0 and c >= 0 and r < rows and c < columns")
    n = (2 * background + 1) ** 2 - (2 * guard + 1) ** 2
    mean = (F.col("so") - F.col("si")) / n
    sd = F.sqrt(F.greatest(F.lit(1e-9), (F.col("qo") - F.col("qi")) / n - mean * mean))
    bright = (F.col("v") > F.least(F.col("mean") + k * F.col("sd"), F.lit(ceiling))) & (F.col("v") >= floor)
    return rows.withColumns({"mean": mean, "sd": sd}).filter(bright).select("scene", "r", "c", "v", "mean", "sd")


def sized_components(labels: DataFrame, least: int, most: int) -> DataFrame:
    """Pixels of components of `least` to `most` pixels."""
    n = labels.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n_pixels")).filter(F.col("n_pixels").between(least, most))
    return labels.join(n.hint("merge"), ["scene", "label"])


def ring_contrast(labels: DataFrame, pixels: DataFrame, inner: int, outer: int) -> DataFrame:
    """For each component the mean level around it less its own, and the same in deviations of its surroundings.

    The surroundings are pixels in the square of `outer` pixels around a component's pixel, but not in the
    square of `inner` pixels around one of any component.
    """
    def near(reach: int, columns: list[str]) -> DataFrame:
        off = F.sequence(F.lit(-reach), F.lit(reach))
        rows = labels.withColumn("i", F.explode(off)).withColumn("r", F.col("r") + F.col("i"))
        rows = rows.select("scene", "label", "r", "c").distinct().withColumn("j", F.explode(off)).withColumn("c", F.col("c") + F.col("j"))
        return rows.select(*columns).distinct()

    ring = near(outer, ["scene", "label", "r", "c"]).join(near(inner, ["scene", "r", "c"]).hint("merge"), ["scene", "r", "c"], "left_anti")
    around = ring.join(pixels.hint("merge"), ["scene", "r", "c"]).groupBy("scene", "label").agg(F.avg("v").alias("around"), F.stddev_pop("v").alias("deviation"))
    own = labels.join(pixels.hint("merge"), ["scene", "r", "c"]).groupBy("scene", "label").agg(F.avg("v").alias("inside"))
    contrast = F.col("around") - F.col("inside")
    return own.join(around.hint("merge"), ["scene", "label"]).select("scene", "label", contrast.alias("contrast"), (contrast / F.greatest("deviation", F.lit(1e-9))).alias("contrast_sigma"))


def eroded(mask: DataFrame, half: int) -> DataFrame:
    """(scene, r, c, m) with a full rectangle of pixels: square erosion; outside counts as 0."""
    size = 2 * half + 1
    rows = box_sums(mask.withColumn("mm", F.col("m").cast("long")), {"k": "mm"}, half)
    return rows.withColumn("m", (F.col("k") == size * size).cast("int")).drop("k", "mm")


def dilated(mask: DataFrame, half: int) -> DataFrame:
    rows = box_sums(mask.withColumn("mm", F.col("m").cast("long")), {"k": "mm"}, half)
    return rows.withColumn("m", (F.col("k") > 0).cast("int")).drop("k", "mm")


def opened_closed(mask: DataFrame, half: int = 1) -> DataFrame:
    return eroded(dilated(dilated(eroded(mask, half), half), half), half)


def labelled(mask: DataFrame, eight: bool = True, rounds: int = 1000) -> DataFrame:
    """(scene, r, c, label) of set pixels: the smallest r * 2**32 + c of each connected component.

    Labels spread along whole runs of a row or column at each round (runs are cut by windows), so a
    round crosses a straight stretch at once; diagonal steps join runs if `eight`.
    """
    rows = mask.filter("m = 1").select("scene", "r", "c", (F.col("r").cast("long") * (1 << 32) + F.col("c")).alias("label"))
    across, down = Window.partitionBy("scene", "r").orderBy("c"), Window.partitionBy("scene", "c").orderBy("r")
    rows = rows.withColumns({"h": F.col("c") - F.row_number().over(across), "w": F.col("r") - F.row_number().over(down)})
    rows = written(rows, "labels")
    for _ in range(rounds):
        least = F.least(F.min("label").over(Window.partitionBy("scene", "r", "h")), F.min("label").over(Window.partitionBy("scene", "c", "w")))
        spread = rows.withColumn("least", least)
        if eight:
            steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 1) for j in (-1, 1))))
            near = spread.withColumn("s", steps).select("scene", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c"), F.col("least").alias("other"))
            near = near.groupBy("scene", "r", "c").agg(F.min("other").alias("other"))
            spread = spread.join(near.hint("merge"), ["scene", "r", "c"], "left").withColumn("least", F.least("least", "other")).drop("other")
        spread = written(spread.withColumn("changed", F.col("least") < F.col("label")).drop("label").withColumnRenamed("least", "label"), "labels")
        rows = spread.drop("changed")
        if spread.filter("changed").isEmpty():
            return rows.select("scene", "r", "c", "label")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def component_statistics(labels: DataFrame, pixels: DataFrame) -> DataFrame:
    rows = labels.join(pixels.hint("merge"), ["scene", "r", "c"])
    return rows.groupBy("scene", "label").agg(F.count(F.lit(1)).alias("n_pixels"), F.avg("r").alias("row"), F.avg("c").alias("col"), F.max("v").alias("peak"), F.avg("v").alias("mean_v"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))


def block_levels(pixels: DataFrame, block: int, percent: float) -> DataFrame:
    """Percentile and robust deviation (1.4826 MAD, at least 0.3) of square blocks."""
    keys = ["scene", F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")]
    rows = pixels.select(*keys, "v")
    level = rows.groupBy("scene", "br", "bc").agg(F.percentile("v", percent).alias("level"), F.median("v").alias("mid"))
    off = rows.join(level, ["scene", "br", "bc"]).groupBy("scene", "br", "bc").agg(F.first("level").alias("level"), F.median(F.abs(F.col("v") - F.col("mid"))).alias("mad"))
    return off.select("scene", "br", "bc", "level", F.greatest(F.lit(0.3), 1.4826 * F.col("mad")).alias("deviation"))


def decimated(pixels: DataFrame, factor: int) -> DataFrame:
    """Block means: the coarser raster."""
    return pixels.groupBy("scene", F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg("v").alias("v"))


def overlap_scores(pairs: DataFrame) -> DataFrame:
    """Dice and intersection over union of (scene, predicted, actual) pixels."""
    s = pairs.groupBy("scene").agg(F.sum(F.col("predicted") * F.col("actual")).alias("both"), F.sum("predicted").alias("p"), F.sum("actual").alias("a"))
    return s.select("scene", F.when(F.col("p") + F.col("a") > 0, 2 * F.col("both") / (F.col("p") + F.col("a"))).alias("dice"), F.when(F.col("p") + F.col("a") - F.col("both") > 0, F.col("both") / (F.col("p") + F.col("a") - F.col("both"))).alias("iou"))
