"""Evidence features, weighted scores, ranks and their robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.domain import WEIGHTS, clamp, type_relevance, weighted
from ..functions.geo import angle_difference
from .tracks import gaps, kinematics


def oil_time(anchors: DataFrame, cloud: DataFrame, radius_km: float = 1.5) -> DataFrame:
    """(mmsi, t_oil, spread_s, peak): density-weighted time of the oil at each vessel's anchor (mmsi, x, y).

    Anchors and particles meet in cells of the radius; times come with the particles.
    """
    cell = lambda c: F.floor(F.col(c) / radius_km)
    around = F.explode(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy"))))))
    asked = anchors.withColumn("cell", around).select("mmsi", "x", "y", "cell.cx", "cell.cy")
    held = cloud.select("tq", "px", "py", cell("px").alias("cx"), cell("py").alias("cy"))
    sizes = cloud.groupBy("tq").agg(F.count(F.lit(1)).alias("n"))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2)))
    near = asked.join(held, ["cx", "cy"]).filter(d <= radius_km).groupBy("mmsi", "tq").agg(F.count(F.lit(1)).alias("k")).join(sizes, "tq")
    sums = near.withColumn("c", F.col("k") / F.col("n")).groupBy("mmsi").agg(F.sum("c").alias("s"), F.sum(F.col("tq") * F.col("c")).alias("st"), F.max("c").alias("peak"), F.collect_list(F.struct("tq", "c")).alias("all"))
    mean = F.col("st") / F.col("s")
    spread = F.sqrt(F.aggregate("all", F.lit(0.0), lambda a, p: a + F.pow(p["tq"] - mean, F.lit(2)) * p["c"]) / F.col("s"))
    return sums.select("mmsi", mean.alias("t_oil"), spread.alias("spread_s"), "peak")


def behaviour(fixes: DataFrame, centres: DataFrame, hours: float, side_hours: float) -> DataFrame:
    """Speeds before, near and after a time of interest (mmsi, tc), largest and net course change, slow minutes.

    A speed of zero counts like any other (not as missing).
    """
    rows = kinematics(fixes).join(centres, "mmsi").withColumn("near", F.abs(F.col("t") - F.col("tc")) <= hours * 3600)
    both = Window.partitionBy("mmsi")
    rows = rows.withColumns({"t_in": F.min(F.when(F.col("near"), F.col("t"))).over(both), "t_out": F.max(F.when(F.col("near"), F.col("t"))).over(both)}).filter("t_in is not null")
    before = (F.col("t") < F.col("t_in")) & (F.col("t") >= F.col("t_in") - side_hours * 3600)
    after = (F.col("t") > F.col("t_out")) & (F.col("t") <= F.col("t_out") + side_hours * 3600)
    turns = rows.filter("near and course_deg is not null").withColumn("turn", angle_difference(F.col("course_deg"), F.lag("course_deg").over(Window.partitionBy("mmsi").orderBy("t")))).groupBy("mmsi").agg(F.coalesce(F.max("turn"), F.lit(0.0)).alias("max_turn_deg"))
    means = rows.groupBy("mmsi").agg(
        F.avg(F.when(before, F.col("speed_kn"))).alias("kn_before"), F.avg(F.when(F.col("near"), F.col("speed_kn"))).alias("kn_near"), F.avg(F.when(after, F.col("speed_kn"))).alias("kn_after"),
        F.median(F.when(before, F.col("course_deg"))).alias("course_before"), F.median(F.when(after, F.col("course_deg"))).alias("course_after"),
        F.coalesce(F.sum(F.when(F.col("near") & (F.col("speed_kn") < 2), F.col("dt_s"))), F.lit(0.0)).alias("slow_s"),
    )
    reference = F.when(F.col("kn_before").isNull(), F.col("kn_after")).when(F.col("kn_after").isNull(), F.col("kn_before")).otherwise((F.col("kn_before") + F.col("kn_after")) / 2)
    out = means.join(turns, "mmsi", "left").withColumn("reference", reference)
    return out.select("mmsi", "kn_before", "kn_near", "kn_after", F.when(F.col("reference") > 0.5, F.col("kn_near") / F.col("reference")).alias("slowdown"), F.coalesce("max_turn_deg", F.lit(0.0)).alias("max_turn_deg"), angle_difference(F.col("course_after"), F.col("course_before")).alias("net_turn_deg"), (F.col("slow_s") / 60).alias("slow_min"))


def continuity(fixes: DataFrame, centres: DataFrame, threshold_min: float, window_h: float) -> DataFrame:
    """Number and longest of all gaps and of those that touch the window around the time of interest."""
    rows = centres.join(gaps(fixes, threshold_min), "mmsi", "left")
    relevant = (F.col("gap_end") >= F.col("tc") - window_h * 3600) & (F.col("gap_start") <= F.col("tc") + window_h * 3600)
    return rows.groupBy("mmsi").agg(F.count("duration_min").alias("all_gaps"), F.count_if(F.coalesce(relevant, F.lit(False))).alias("relevant_gaps"), F.coalesce(F.max(F.when(relevant, F.col("duration_min"))), F.lit(0.0)).alias("max_relevant_gap_min"))


def factor_scores(features: DataFrame) -> DataFrame:
    """Scores between 0 and 1 of all factors, and their weighted sum of 100."""
    slow = F.when(F.col("slowdown").isNull(), 0.0).otherwise(clamp(1 - F.col("slowdown")))
    turn = F.least(F.lit(1.0), F.coalesce("net_turn_deg", F.lit(0.0)) / 90)
    stop = F.least(F.lit(1.0), F.coalesce("slow_min", F.lit(0.0)) / 120)
    parts = {
        "spatial": F.exp(-F.greatest("d_source_km", F.lit(0.0)) / 5),
        "temporal": F.coalesce(F.exp(-F.col("dt_hours") / 4), F.lit(0.0)),
        "trajectory": F.when(F.col("d_st_km").isNull(), 0.0).otherwise(F.exp(-F.greatest(F.col("d_st_km"), F.lit(0.0)) / 3)),
        "sar_attached": F.coalesce(F.col("sar_attached").cast("double"), F.lit(0.0)),
        "vessel_type": type_relevance(F.col("kind")),
        "behavior": F.least(F.lit(1.0), 0.6 * slow + 0.25 * turn + 0.15 * stop),
        "ais_continuity": F.least(F.lit(1.0), F.coalesce("gap_min", F.lit(0.0)) / 120),
    }
    out = features.select("mmsi", *(v.alias(k) for k, v in parts.items()))
    return out.withColumn("score", weighted({k: F.col(k) for k in WEIGHTS}, WEIGHTS))


def ranked(scores: DataFrame, keep: int = 10) -> DataFrame:
    """The best `keep` with ranks; equal scores by vessel."""
    best = scores.orderBy(F.desc("score"), "mmsi").limit(keep)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "mmsi")))  # at most `keep` rows


def separation(best: DataFrame, gap: float = 10.0) -> DataFrame:
    order = Window.orderBy("rank")
    rows = best.withColumn("margin", F.col("score") - F.lead("score").over(order)).filter("rank = 1")
    return rows.select("mmsi", "score", "margin", (F.coalesce("margin", F.lit(100.0)) >= gap).alias("separated"))


def robustness(factors: DataFrame, weights: DataFrame) -> DataFrame:
    """Ranks of candidates under many weight vectors (sample, factor, weight).

    factors (mmsi, base_rank, factor, value). Returns per vessel: share of first and of top-three ranks,
    5th and 95th percentile of the rank, and a verdict for the vessel that ranks first now. The weights are broadcast: their
    number depends on the samples alone.
    """
    positive = weights.filter("weight > 0")
    total = positive.groupBy("sample").agg(F.sum("weight").alias("w"))
    n = int(factors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out by vessel first: each row meets every sample, and sums then stay where they are
    scores = factors.repartition(n, "mmsi").join(F.broadcast(positive), "factor").groupBy("sample", "mmsi", "base_rank").agg(F.sum(F.col("value") * F.col("weight")).alias("s")).join(total, "sample")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc(F.round(F.col("s") / F.col("w"), 9)), "base_rank"))
    out = scores.withColumn("rank", rank).groupBy("mmsi", "base_rank").agg(F.avg((F.col("rank") == 1).cast("double")).alias("p_first"), F.avg((F.col("rank") <= 3).cast("double")).alias("p_top3"), F.floor(F.percentile("rank", 0.05)).cast("int").alias("rank_p05"), F.floor(F.percentile("rank", 0.95)).cast("int").alias("rank_p95"))
    verdict = F.when(F.col("p_first") >= 0.8, "ROBUST").when(F.col("p_first") >= 0.5, "LIKELY").otherwise("CONTESTED")
    return out.withColumn("verdict", F.when(F.col("base_rank") == 1, verdict))


def triage(components: DataFrame, wind_ms: float | None) -> DataFrame:
    """Points for and against oil, label and rank of dark components."""
    trail = F.coalesce((F.col("target_km") <= 1) & (F.col("elongation") >= 4) & (F.col("end_km") <= F.greatest(F.lit(1.0), 0.15 * F.col("length_km"))), F.lit(False))
    contrast = F.col("contrast_db")
    oil = F.when(trail, 2.0).otherwise(0.0) + F.when(F.col("elongation") >= 4, 1.0).otherwise(0.0) + F.when(contrast >= 2, 1.0).otherwise(0.0)
    look = F.when(contrast < 1, 1.0).otherwise(0.0) + F.when((F.col("solidity") < 0.3) & (F.col("elongation") < 3), 1.0).otherwise(0.0) + F.when((F.col("area_km2") > 50) & (F.col("elongation") < 3), 1.0).otherwise(0.0)
    if wind_ms is not None:
        oil, look = oil + (0.5 if 3 <= wind_ms <= 12 else 0.0), look + (1.5 if wind_ms < 3 else 0.5 if wind_ms > 12 else 0.0)
    rows = components.withColumns({"oil_points": oil, "lookalike_points": look, "ship_trail": trail})
    lead = F.col("oil_points") - F.col("lookalike_points")
    label = F.when(lead >= 1.5, "OIL_LIKELY").when(lead <= -1.5, "LOOKALIKE_LIKELY").otherwise("UNCERTAIN")
    rows = rows.withColumns({"label": label, "triage_score": F.round(lead + F.coalesce("probability", F.lit(0.0)), 3)})
    return rows.withColumn("triage_rank", F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("triage_score"), "component_id")))


def dirichlet_weights(spark, weights: dict[str, float], n: int = 2000, concentration: float = 40.0, seed: int = 0) -> DataFrame:
    """Weight table (sample, factor, weight): n draws around the given weights; its size depends on the parameters alone."""
    import numpy as np

    names = [k for k, w in weights.items() if w > 0]
    base = np.array([weights[k] for k in names], float)
    draws = np.random.default_rng(seed).dirichlet(base / base.sum() * concentration, size=n)
    rows = [(i, f, float(w)) for i, row in enumerate(draws) for f, w in zip(names, row, strict=True)]
    return spark.createDataFrame(rows, "sample long, factor string, weight double")
