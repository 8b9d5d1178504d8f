"""A response plan for each spill: rules on its severity, what it threatens, the vessels suspected and the weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import written
from ..functions.domain import rescue_centre

# Agencies, deadlines (hours), thresholds and kinds of the plan.
COAST_GUARD = "Indian Coast Guard"
PROTECT = {
    "intake": ("Plant operator / NPCIL · ICG", "Alert {} to protect intakes"),
    "port": ("Port authority (Tier 1 resources) · ICG", "Prepare port-entrance protection at {}"),
    "fishing": ("State fisheries / tourism department · District administration", "Issue advisory for {}"),
    "tourism": ("State fisheries / tourism department · District administration", "Issue advisory for {}"),
    None: ("State Forest / Environment dept · ICG · State Pollution Control Board", "Protect {}"),
}
ACTION = "priority string, deadline_h double, agency string, title string, kind string, ord int"
MOST = 14


def _action(ord: int, priority: Column | str, hours: float, agency: Column | str, title: Column | str, kind: str) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text(priority).alias("priority"), F.lit(float(hours)).alias("deadline_h"), text(agency).alias("agency"), text(title).alias("title"), F.lit(kind).alias("kind"), F.lit(ord).alias("ord"))


def _of_spill(spills: DataFrame) -> DataFrame:
    """Rules that look at the spill alone (and at the counts of what it threatens)."""
    serious, wind = F.col("level").isin("HIGH", "CRITICAL"), F.col("wind_ms")
    centre = rescue_centre(F.col("lon"), F.col("lat"))
    rough = F.coalesce(wind > 10, F.lit(False))
    offshore = F.coalesce(F.col("coast_km") > 20, F.lit(False)) & (F.col("n_sensitive_near") == 0)
    rules = [
        (F.lit(True), _action(1, "P1", 1, F.concat(F.lit(f"{COAST_GUARD} — "), centre), F.concat(F.lit("Report the detection to "), centre), "notify")),
        (F.lit(True), _action(2, "P1", 3, f"{COAST_GUARD} (aerial / surface unit)", "Confirm the slick on scene", "verify")),
        (F.lit(True), _action(3, "P1", 6, f"{COAST_GUARD} / pollution response team", "Collect oil samples for fingerprinting", "evidence")),
        (rough, _action(30, "P2", 6, COAST_GUARD, "Defer boom containment; monitor", "contain")),
        (~rough, _action(30, F.when(serious, "P1").otherwise("P2"), 6, f"{COAST_GUARD} (Pollution Response vessel)", "Contain and recover at sea", "contain")),
        (offshore, _action(31, "P3", 12, f"{COAST_GUARD} (approval authority)", "Consider dispersants only with approval", "contain")),
        (~offshore, _action(31, "P2", 6, COAST_GUARD, "Do not use dispersants here", "contain")),
        (F.col("n_dark") > 0, _action(50, "P2", 12, f"{COAST_GUARD} / Navy (MDA)", F.concat(F.lit("Identify "), F.col("n_dark").cast("string"), F.lit(" SAR-only vessel(s) without AIS")), "enforce")),
        (F.lit(True), _action(60, "P2", 12, "INCOIS / ICG", "Update the forecast with the next satellite pass", "monitor")),
        (F.col("tier") != "Tier 1", _action(70, "P1", 2, f"{COAST_GUARD} (Central Coordinating Authority)", F.concat(F.lit("Activate "), F.col("tier"), F.lit(" response")), "notify")),
    ]
    listed = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), a) for c, a in rules)), lambda a: a.isNotNull())
    shore = spills.filter("beach_eta_h is not null and n_threatened = 0").select(
        "spill_id", F.when(F.col("beach_eta_h") <= 24, "P1").otherwise("P2").alias("priority"), F.greatest(F.col("beach_eta_h") - 6, F.lit(1.0)).alias("deadline_h"), F.lit("Coastal State/UT · District administration").alias("agency"),
        F.lit("Prepare shoreline response").alias("title"), F.lit("protect").alias("kind"), F.lit(20).alias("ord"),
    )
    return spills.select("spill_id", F.inline(listed)).unionByName(shore)


def _of_sites(threats: DataFrame, keep: int = 5) -> DataFrame:
    """The sites reached first, each with who protects it and until when."""
    eta = F.col("eta_hours")
    first = F.row_number().over(Window.partitionBy("spill_id").orderBy("eta_hours", "rank"))
    rows = threats.filter("threatened").withColumn("ord", first + 9).filter(F.col("ord") < 10 + keep)
    pick = lambda i: F.coalesce(*(F.when(F.col("site_kind") == k, F.lit(v[i])) for k, v in PROTECT.items() if k), F.lit(PROTECT[None][i]))
    title = F.replace(pick(1), F.lit("{}"), F.col("site"))
    urgent = F.when(eta <= 24, "P1").when(eta <= 72, "P2").otherwise("P3")
    rows = rows.withColumnRenamed("kind", "site_kind")
    return rows.select("spill_id", urgent.alias("priority"), F.greatest(eta - 6, F.lit(1.0)).alias("deadline_h"), pick(0).alias("agency"), title.alias("title"), F.lit("protect").alias("kind"), "ord")


def _of_suspects(suspects: DataFrame, keep: int = 3) -> DataFrame:
    """Inspections of the best ranked vessels, at the port ahead if there is one."""
    rows = suspects.filter(F.col("rank") <= keep)
    where = F.when(F.col("port").isNotNull(), F.concat(F.lit(" at "), F.col("port"))).otherwise(F.lit(" (no port ahead)"))
    urgent = F.when((F.col("rank") == 1) & (F.col("score") >= 60), "P1").otherwise("P2")
    return rows.select("spill_id", urgent.alias("priority"), F.lit(24.0).alias("deadline_h"), F.lit("DG Shipping (Port State Control) · ICG").alias("agency"), F.concat(F.lit("Inspect "), F.coalesce("name", "mmsi"), where).alias("title"), F.lit("enforce").alias("kind"), (F.col("rank") + 39).cast("int").alias("ord"))


def planned(spills: DataFrame, threats: DataFrame, suspects: DataFrame) -> DataFrame:
    """At most fourteen actions a spill, by priority, deadline and rule: spill_id, step, priority, deadline_h, agency, title, kind.

    spills: spill_id, lat, lon, level, tier, wind_ms, coast_km, beach_eta_h, n_dark. threats: rows of
    impact.threatened_sites with the sites' weight. suspects: spill_id, mmsi, name, rank, score, port. Unknown wind counts as
    fair, an unknown distance to the coast as near. A spill without threats or suspects has the rules of its own.
    """
    threats = written(threats, "threats")  # counted and listed
    near = threats.groupBy("spill_id").agg(F.count_if("threatened").alias("n_threatened"), F.count_if((F.col("weight") >= 8) & (F.col("d_now_km") < 30)).alias("n_sensitive_near"))
    rows = written(spills.join(near.hint("merge"), "spill_id", "left").na.fill(0, ["n_threatened", "n_sensitive_near"]), "spills")
    every = _of_spill(rows).unionByName(_of_sites(threats)).unionByName(_of_suspects(suspects))
    order = Window.partitionBy("spill_id").orderBy("priority", F.round("deadline_h", 9), "ord")
    ranked = every.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= MOST)
    return ranked.select("spill_id", "step", "priority", "deadline_h", "agency", "title", "kind")


def deadlines(plan: DataFrame, spills: DataFrame) -> DataFrame:
    """The plan with the time at which each action is due: the observation's time (t, seconds) and its hours."""
    return plan.join(spills.select("spill_id", "t"), "spill_id").withColumn("due", F.col("t") + F.col("deadline_h") * 3600).drop("t")
