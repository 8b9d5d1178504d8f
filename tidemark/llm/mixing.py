"""Mixing sources to target weights on a time-varying curriculum.

Targets: sources share the words in proportion to their weights; none gets more than `most` times its
own words, and what is cut is shared again among the others. A source's documents stand in a fixed
hashed order; whole passes over the source come first and the words of the last, partial pass are
taken from the front of the order.

Curriculum: each source's weight runs over training time 0..1 along a linear schedule. Its integral is
the source's cumulative share of demand; inverting it gives the time at which the source's next words
are wanted, which is the position of the copy that holds them. Copies are then range-sorted by it.

Cumulative words need no window over a source: documents are summed in hashed slices, the slices (a
bounded number a source) are accumulated, and windows run within one slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a source; a slice is what one window sorts.
SLICES = 4096


def n_words(text) -> F.Column:
    """Words of [^\\x20\\x09-\\x0D]+ in a text, 0 for null, without building them."""
    blanks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w"), " \t\n\x0b\x0c\r", "")
    return F.length(blanks).cast("long")


def shared_targets(sizes: list[int], weights: list[float], most: float = 3.0, total: float | None = None) -> list[float]:
    """Targets by weight, at most `most` times each size; the excess goes to the others by weight until none is above."""
    total = float(sum(sizes) if total is None else total)
    targets, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(t for i, t in enumerate(targets) if i not in free)
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight if weight else 0.0 for i in free}
        above = {i for i in free if share[i] > most * sizes[i]}
        for i in above:
            targets[i] = float(most * sizes[i])
        if not above:
            for i in free:
                targets[i] = share[i]
            break
        free -= above
    return targets


def _plan(docs: DataFrame, source_col: str, weights: tuple[float, ...], most: float, tilt: float) -> DataFrame:
    """One row a source, small: source, source_size, target and its schedule's slope.

    Sources are few (they are named weights); their sums come to the driver, one row each.
    """
    rows = docs.groupBy("source").agg(F.sum("size").alias("source_size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    sizes = [int(r["source_size"]) for r in rows]
    targets = shared_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    # heavier sources fall off over time, lighter ones come in: the schedule of source i is 1 + slope * (2t - 1)
    slopes = [tilt * (1 - 2 * (i % len(weights)) / max(1, len(weights) - 1)) * -1 for i in range(len(rows))]
    spark = docs.sparkSession
    return spark.createDataFrame([(r["source"], s, t, k) for r, s, t, k in zip(rows, sizes, targets, slopes, strict=True)], "source string, source_size long, target double, slope double")


def wanted_at(share: F.Column, slope: F.Column) -> F.Column:
    """Time t in 0..1 with t + slope * (t*t - t) = share: the integral of 1 + slope * (2t - 1), inverted."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(F.abs(slope) < 1e-9, share).otherwise(2 * share / (1 - slope + root))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, tilt: float = 0.8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Copies of documents in training order.

    Returns one row for each document and copy: doc_id, source, copy (0 for documents of which nothing
    is taken), size, source_size, target, words (of this copy, less than size only at the end of a
    partial pass), position (null if nothing is taken), range-sorted by position. `keep` names further
    columns to carry.

    Null texts have size 0 and are never taken; null sources are a source of their own, last in order.
    Repeated rows are documents like others. The order is by a hash of id and text, so ties are rows of
    one id and text, which are alike: reruns agree. An empty table gives an empty result. Weights repeat
    over the sources in code-point order.
    """
    # the text belongs to the hash: documents that share an id, or have none, spread over the slices too
    mixed = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), mixed.alias("mixed"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    rows = rows.withColumn("slice", F.shiftrightunsigned("mixed", 64 - SLICES.bit_length() + 1))
    sized = docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    plan = _plan(sized, source_col, weights, most, tilt)
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = slices.select("source", "slice", (F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words")).alias("before"))
    return _placed(rows, plan, before, keep)


def _placed(rows: DataFrame, plan: DataFrame, before: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    within = Window.partitionBy("source", "slice").orderBy("mixed", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = [rows["source"].eqNullSafe(before["source"]), rows["slice"] == before["slice"]]
    rows = rows.join(before, same).drop(before["source"]).drop(before["slice"])
    rows = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])  # one row a source
    passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
    rows = rows.withColumn("passes", F.when(F.col("source_size") > 0, passes).otherwise(0)).withColumn("offset", F.col("before") + F.col("inside"))
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    rows = rows.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset"))))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("last") > 0).cast("long")).otherwise(0)
    rows = rows.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.least(F.lit(1), F.col("copies")), F.col("copies"))))
    words = F.when(F.col("copy") == 0, 0).when(F.col("copy") <= F.col("passes"), F.col("size")).otherwise(F.col("last"))
    share = ((F.col("copy") - 1) * F.col("source_size") + F.col("offset")) / F.col("target")
    position = F.when(F.col("copy") > 0, wanted_at(F.least(F.lit(1.0), share), F.col("slope")))
    out = rows.select("doc_id", "source", "copy", "size", "source_size", "target", words.cast("long").alias("words"), position.alias("position"), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def totals(copies: DataFrame, row: str) -> DataFrame:
    """Copies of mix() -> a row for each document: taken (words of all its copies) and its first position.

    `row` tells documents apart; equal rows (each has its copy of smallest number once) stay as many as they are.
    """
    keys = [row, "doc_id", "source", "size", "source_size", "target"]
    least = F.min("copy").over(Window.partitionBy(*keys))
    sums = copies.withColumn("least", least).groupBy(*keys).agg(F.sum("words").alias("words"), F.min("position").alias("position"), F.count_if(F.col("copy") == F.col("least")).alias("times"))
    each = sums.withColumns({"taken": F.floor(F.col("words") / F.col("times")), "over": F.col("words") % F.col("times")})
    each = each.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.withColumn("taken", F.col("taken") + (F.col("one") <= F.col("over")).cast("long")).drop("words", "times", "over", "one")
