"""Outlines of pixel components and the bands around them, as joins of pixel tables (merged: see raster)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import written


def within_steps(pixels: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """Distinct (keys, r, c) at most that many steps along rows and columns from a pixel."""
    rows = pixels.select(*keys, "r", "c").withColumn("i", F.explode(F.sequence(F.lit(-steps), F.lit(steps))))
    # Steps left over after the row offset; the widest of equal pixels holds the others.
    rows = rows.groupBy(*keys, (F.col("r") + F.col("i")).alias("r"), "c").agg(F.max(steps - F.abs("i")).alias("left"))
    return rows.withColumn("j", F.explode(F.sequence(-F.col("left"), F.col("left")))).select(*keys, "r", (F.col("c") + F.col("j")).alias("c")).distinct()


def band_contrast(labels: DataFrame, pixels: DataFrame, inner: int, outer: int, per_level: float, least_ring: int = 20, least_own: int = 5) -> DataFrame:
    """Mean of sea pixels in the band between `inner` and `outer` steps around a component, less its own mean.

    Pixels have `sea`; components with too few pixels, or too few in the band, get null.
    """
    keys = ["scene", "label"]
    band = within_steps(labels, keys, outer).join(within_steps(labels, keys, inner).hint("merge"), [*keys, "r", "c"], "left_anti")
    around = band.join(pixels.filter("sea").hint("merge"), ["scene", "r", "c"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ring"), F.avg("v").alias("ring_v"))
    own = labels.join(pixels.hint("merge"), ["scene", "r", "c"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_own"), F.avg("v").alias("own_v"))
    enough = (F.col("n_ring") >= least_ring) & (F.col("n_own") >= least_own)
    return own.join(around.hint("merge"), keys, "left").select(*keys, F.when(enough, (F.col("ring_v") - F.col("own_v")) * per_level).alias("contrast_db"))


def at_sea(detections: DataFrame, pixels: DataFrame, steps: int) -> DataFrame:
    """Detections (scene, r, c) more than `steps` steps from any land pixel."""
    coast = within_steps(pixels.filter("not sea"), ["scene"], steps)
    return detections.join(coast.hint("merge"), ["scene", "r", "c"], "left_anti")


def traced(labels: DataFrame) -> DataFrame:
    """Outline rings of components: (scene, label, ring, seq, r, c), the corner where each side starts.

    Every pixel has four directed sides, with the pixel on the right; those that meet a reverse side of the
    same component cancel. A side is followed by the one that starts at its end, by its own pixel's where two
    do. Each side finds the smallest side of its ring, and its distance to it, by doubling its jumps, so a ring
    of n sides takes log2 n joins. Corners carry pixel coordinates: pixel (r, c) spans r to r + 1, c to c + 1.
    """
    r, c = F.col("r"), F.col("c")
    side = lambda *p: F.struct(*(v.cast("long").alias(n) for n, v in zip(("r0", "c0", "r1", "c1"), p, strict=True)))
    four = F.explode(F.array(side(r, c, r, c + 1), side(r, c + 1, r + 1, c + 1), side(r + 1, c + 1, r + 1, c), side(r + 1, c, r, c)))
    sides = labels.select("scene", "label", F.struct("r", "c").alias("pixel"), four.alias("s"))
    back = sides.select("scene", "label", F.struct(F.col("s.r1").alias("r0"), F.col("s.c1").alias("c0"), F.col("s.r0").alias("r1"), F.col("s.c0").alias("c1")).alias("s"))
    outer = written(sides.join(back.hint("merge"), ["scene", "label", "s"], "left_anti"), "sides")
    a = outer.select("scene", "label", "s", "pixel", F.struct(F.col("s.r1").alias("r"), F.col("s.c1").alias("c")).alias("at"))
    b = outer.select("scene", "label", F.col("s").alias("next"), F.col("pixel").alias("other"), F.struct(F.col("s.r0").alias("r"), F.col("s.c0").alias("c")).alias("at"))
    step = a.join(b.hint("merge"), ["scene", "label", "at"]).groupBy("scene", "label", "s").agg(F.min_by("next", F.col("pixel") != F.col("other")).alias("next"))
    # `low` is the smallest of the 2**k sides from s on, `far` the jumps to it; `next` lies 2**k sides ahead.
    # A round that changes nothing anywhere has seen every ring whole.
    rows, jump, changed = written(step.withColumns({"low": F.col("s"), "far": F.lit(0).cast("long")}), "outline"), 1, True
    while changed:
        ahead = rows.select("scene", "label", F.col("s").alias("next"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("far").alias("far2"))
        nearer = F.col("low2") < F.col("low")
        joined = rows.join(ahead.hint("merge"), ["scene", "label", "next"]).select(
            "scene", "label", "s", F.col("next2").alias("next"), F.when(nearer, F.col("low2")).otherwise(F.col("low")).alias("low"),
            F.when(nearer, F.col("far2") + jump).otherwise(F.col("far")).alias("far"), nearer.alias("changed"),
        )
        rows, jump = written(joined, "outline"), jump * 2
        changed = not rows.filter("changed").isEmpty()
    sizes = rows.groupBy("scene", "label", "low").agg(F.count(F.lit(1)).alias("n"))
    start = F.struct(F.col("low.r0").alias("r"), F.col("low.c0").alias("c")).alias("ring")
    return rows.join(sizes.hint("merge"), ["scene", "label", "low"]).select("scene", "label", start, F.pmod(F.col("n") - F.col("far"), F.col("n")).alias("seq"), F.col("s.r0").alias("r"), F.col("s.c0").alias("c"))


def stretched(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Backscatter v as decibels stretched between two percentiles of the scene to grey 0..255; nothing, and v <= 0, is 0."""
    rows = pixels.withColumn("db", F.when(F.col("v") > 0, 10 * F.log10("v")))
    ends = rows.groupBy("scene").agg(F.percentile("db", F.array(F.lit(low), F.lit(high))).alias("e"))
    part = (F.col("db") - F.col("e")[0]) / F.greatest(F.col("e")[1] - F.col("e")[0], F.lit(1e-9))
    grey = F.when(part.isNotNull(), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * 255).cast("int"))
    return rows.join(F.broadcast(ends), "scene").select("scene", "r", "c", "db", F.coalesce(grey, F.lit(0)).alias("grey"))  # one row a scene
