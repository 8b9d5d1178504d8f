"""States of analyses, upserts and provenance on append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("COMPLETED", "PARTIAL", "FAILED")


def latest(events: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """The last row of each key by the order columns, as a grouped maximum."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def upserted(stored: DataFrame, changes: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Stored rows with the last change of each key in place of the old row, or added."""
    new = latest(changes, key, order)
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def interrupted(states: DataFrame) -> DataFrame:
    """At a restart, unfinished analyses have failed."""
    open_ = ~F.col("status").isin(*TERMINAL)
    return states.withColumns({"error": F.when(open_, "INTERRUPTED"), "status": F.when(open_, "FAILED").otherwise(F.col("status"))})


def mixed_provenance(rows: DataFrame, key: str) -> DataFrame:
    """The provenance of each key, or MIXED: with the sorted distinct ones."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_set("provenance")).alias("all"))
    joined = F.array_join("all", ",")
    return found.select(key, F.when(F.size("all") > 1, F.concat(F.lit("MIXED:"), joined)).otherwise(joined).alias("provenance"))


def _in_units(column: str, unit: float, up: bool) -> Column:
    """The first (or last) whole number of units that is not below (above) the value, however the division is rounded."""
    n = (F.ceil if up else F.floor)(F.col(column) / unit)
    held = n * unit >= F.col(column) if up else n * unit <= F.col(column)
    return F.when(held, n).otherwise(n + 1 if up else n - 1)


def covering(files: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (rid, w, s, e, n, t0, t1) the smallest cached file that covers it, snapped outward to 0.25 degrees and whole days.

    Corners of requests lie on that grid, so of files that hold the same part of it the smallest answers for all, and equal
    requests are asked once: what meets in the join is bounded by the grid, not by the rows.
    """
    units = {"w": 0.25, "s": 0.25, "e": 0.25, "n": 0.25, "t0": 86400.0, "t1": 86400.0}
    lower = ("w", "s", "t0")
    r = requests.select("rid", *((F.floor if c in lower else F.ceil)(F.col(c) / u).alias(c) for c, u in units.items()))
    asked = r.select(*units).distinct()
    # a request's corner and first day lie in one cell; a file is listed in the cells it covers
    cells = {"cx": ("w", "e", 20), "cy": ("s", "n", 20), "day": ("t0", "t1", 10)}
    area = (F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))
    f = files.filter("w <= e and s <= n and t0 <= t1").select("file", area.alias("area"), *(_in_units(c, u, c in lower).alias(f"f{c}") for c, u in units.items()))
    f = f.filter("fw <= fe and fs <= fn and ft0 <= ft1").groupBy(*(f"f{c}" for c in units)).agg(F.min(F.struct("area", "file")).alias("least"))
    for name, (low, high, size) in cells.items():
        asked = asked.withColumn(name, F.floor(F.col(low) / size))
        f = f.withColumn(name, F.explode(F.sequence(F.floor(F.col(f"f{low}") / size), F.floor(F.col(f"f{high}") / size))))
    holds = (F.col("fw") <= F.col("w")) & (F.col("fs") <= F.col("s")) & (F.col("fe") >= F.col("e")) & (F.col("fn") >= F.col("n")) & (F.col("ft0") <= F.col("t0")) & (F.col("ft1") >= F.col("t1"))
    best = asked.join(f, list(cells)).filter(holds).groupBy(*units).agg(F.min("least")["file"].alias("file"))
    return r.join(best, list(units), "left").select("rid", "file")
