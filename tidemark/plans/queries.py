"""Registered queries: each applies one operator of the library to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import spread, written
from ..functions import domain, geo
from ..operators import corridor, impact, raster, scenes, scoring, state, surface, tracks
from ..sources import tables
from ..sources.tables import ORIGIN_LAT, ORIGIN_LON, STEP_S, WINDOW_END, WINDOW_START

BBOX = (70.0, 17.0, 75.0, 21.0)
DAY = 86400.0
GAP_MIN = 1440.0
#: Events from here on are changes to what was stored before.
UPSERT_FROM = "2024-01-16 00:00:00"
#: A source region: a polygon in the local plane (km).
REGION = [(-35.0, -20.0), (-10.0, -22.0), (0.0, -5.0), (-12.0, 8.0), (-32.0, 4.0)]


def numbered(s: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """The keys of a table as `id`: a row of input for each of its rows."""
    return tables.table(s, d, name).select(F.col(key).alias("id"))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names or [c for c, t in df.dtypes if t == "double"]})


def raw(s: SparkSession, d: str) -> DataFrame:
    return tables.position_reports(s, d)


def fixes(s: SparkSession, d: str) -> DataFrame:
    return tracks.distinct_fixes(tracks.valid(raw(s, d)))


def searched(s: SparkSession, d: str) -> DataFrame:
    """Fixes inside the search box: planted spikes lie outside."""
    return fixes(s, d).filter(geo.inside_bbox(F.col("lat"), F.col("lon"), BBOX))


def positions(s: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    at = tracks.interpolated(searched(s, d) if rows is None else rows, tables.time_grid(s), DAY)
    return corridor.in_plane(at, ORIGIN_LAT, ORIGIN_LON)


def bbox_time_scan(s, d):
    rows = tracks.valid(raw(s, d)).filter(geo.inside_bbox(F.col("lat"), F.col("lon"), BBOX) & F.col("t").between(WINDOW_START, WINDOW_END))
    return rounded(rows.select("src_order", "dup", "mmsi", "t", "lat", "lon"))


def vessel_semi_select(s, d):
    return rounded(tracks.near_vessels(raw(s, d), (71.0, 18.0, 71.5, 18.6), WINDOW_START, WINDOW_END).select("src_order", "dup", "mmsi", "t", "lat", "lon"))


def cleaning_report(s, d):
    return tracks.cleaning_report(raw(s, d))


def dedupe_keep_first(s, d):
    return fixes(s, d).select("src_order", "dup", "mmsi", "t")


def thin_bins(s, d):
    return rounded(tracks.thinned(fixes(s, d), 6 * 3600.0))


def static_first_nonnull(s, d):
    return tracks.first_known(tracks.valid(raw(s, d)), "vessel_name", "vessel_type")


def vessel_type(s, d):
    kinds = tables.table(s, d, "part").select(F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 7 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, F.concat(F.element_at(F.array(*map(F.lit, ("Oil Products ", "Bulk ", "High Speed ", "Towing ", "Pleasure "))), (F.col("p_partkey") % 5 + 1).cast("int")), F.col("p_type"))).otherwise(F.concat((F.col("p_size") + 40).cast("string"), F.lit(".0"))).alias("raw"))
    return kinds.select("p_partkey", "raw", domain.vessel_type(F.col("raw")).alias("kind"))


def kinematics(s, d):
    return rounded(tracks.kinematics(fixes(s, d)).select("mmsi", "t", "dt_s", "dist_km", "course_deg", "speed_kn"))


def spike_fixpoint(s, d):
    return tracks.without_spikes(fixes(s, d)).select("mmsi", "t", "src_order")


def gaps(s, d):
    return rounded(tracks.gaps(searched(s, d), GAP_MIN))


def track_quality(s, d):
    return rounded(tracks.quality(fixes(s, d)))


def interp_at(s, d):
    return rounded(tracks.interpolated(searched(s, d), tables.time_grid(s), DAY))


def nearest_frame(s, d):
    steps = int((WINDOW_END - WINDOW_START) / 21600) + 1
    return corridor.nearest_frame(fixes(s, d).filter(F.col("t").between(WINDOW_START, WINDOW_END)).select("mmsi", F.col("t").alias("tq")), WINDOW_START, 21600.0, steps)


def _particles(s, d):
    """Drifting particles, an order an hourly position: forty-nine hours a particle, in the local plane (km)."""
    k = F.col("o_orderkey")
    p, h = F.floor(k / 49), (k % 49).cast("double")
    return tables.table(s, d, "orders").select(
        (WINDOW_START + h * STEP_S).alias("tq"), p.cast("int").alias("pid"), (-30.0 + 1.1 * h + 6.0 * F.sin(p * 1.7) + 2.0 * F.sin(p * 0.37 + h)).alias("px"), (-10.0 + 0.6 * h + 6.0 * F.cos(p * 2.3) + 2.0 * F.cos(p * 0.53 + h)).alias("py"),
    )


def _between_steps(s):
    return s.range(60).select((F.lit(WINDOW_START) + F.col("id") * 1000.0).alias("tq"))


def cloud_interp(s, d):
    return rounded(corridor.cloud_at(_particles(s, d), _between_steps(s), STEP_S))


def corridor_nn(s, d):
    return rounded(corridor.nearest_particles(positions(s, d), tables.particle_cloud(s), 10.0).select("mmsi", "tq", "d_km"))


def corridor_fraction(s, d):
    return rounded(corridor.nearest_particles(positions(s, d), tables.particle_cloud(s), 10.0).select("mmsi", "tq", "n_near", "fraction"))


def region_distance(s, d):
    return rounded(corridor.region_distances(positions(s, d), REGION))


def _candidates(s, d, at=None):
    at = written(spread(positions(s, d)), "positions") if at is None else at  # read by both joins
    return corridor.candidates(corridor.nearest_particles(at, tables.particle_cloud(s), 10.0), corridor.region_distances(at, REGION))


def corridor_candidates(s, d):
    return rounded(_candidates(s, d))


def _centres(s, d, at=None):
    return _candidates(s, d, at).select("mmsi", F.coalesce("t_best_st", "t_best_region").alias("tc"), "min_d_st_km", "min_d_region_km", "candidate")


def temporal_feature(s, d):
    at = written(spread(positions(s, d)), "positions")
    at = at.join(_centres(s, d, at).filter("min_d_st_km is not null").select("mmsi", F.col("tc").alias("tq")), ["mmsi", "tq"])
    return rounded(scoring.oil_time(at.select("mmsi", "x", "y"), tables.particle_cloud(s), 3.0), digits=4)


def behaviour(s, d):
    return rounded(scoring.behaviour(searched(s, d), _centres(s, d).select("mmsi", "tc"), 24.0, 72.0), digits=5)


def continuity(s, d):
    return rounded(scoring.continuity(searched(s, d), _centres(s, d).select("mmsi", "tc"), 720.0, 24.0))


def _features(s, d):
    seen = written(searched(s, d), "fixes")
    at = written(spread(positions(s, d, seen)), "positions")
    c = written(_centres(s, d, at), "centres")  # read by every feature
    b = scoring.behaviour(seen, c.select("mmsi", "tc"), 24.0, 72.0).select("mmsi", "slowdown", "net_turn_deg", "slow_min")
    g = scoring.continuity(seen, c.select("mmsi", "tc"), 720.0, 24.0).select("mmsi", F.col("max_relevant_gap_min").alias("gap_min"))
    at = at.join(c.filter("min_d_st_km is not null").select("mmsi", F.col("tc").alias("tq")), ["mmsi", "tq"])
    o = scoring.oil_time(at.select("mmsi", "x", "y"), tables.particle_cloud(s), 3.0).select("mmsi", "t_oil")
    k = tracks.first_known(tracks.valid(raw(s, d)), "vessel_type").select("mmsi", domain.vessel_type(F.col("vessel_type")).alias("kind"))
    rows = c.filter("candidate").join(b, "mmsi", "left").join(g, "mmsi", "left").join(o, "mmsi", "left").join(k, "mmsi", "left")
    return rows.select("mmsi", F.col("min_d_region_km").alias("d_source_km"), F.col("min_d_st_km").alias("d_st_km"), (F.abs(F.col("tc") - F.col("t_oil")) / 3600).alias("dt_hours"), "slowdown", "net_turn_deg", "slow_min", "gap_min", "kind", (F.col("mmsi").cast("long") % 10 == 3).alias("sar_attached"))


def evidence_score(s, d):
    return rounded(scoring.factor_scores(_features(s, d)), digits=5)


def _best(s, d):
    scores = scoring.factor_scores(_features(s, d)).select("mmsi", F.round("score", 5).alias("score"))
    return scoring.ranked(scores)


def top_candidates(s, d):
    return _best(s, d)


def separation(s, d):
    return rounded(scoring.separation(_best(s, d)), digits=5)


def _detections(s, d):
    k = F.col("o_orderkey")
    return tables.table(s, d, "orders").select(F.floor(k / 30).alias("scene"), k.alias("det_id"), (-30.0 + k * 37 % 60).alias("dx"), (-20.0 + k * 53 % 45).alias("dy"))


def _seen(s, d):
    k = F.col("event_id")
    return tables.table(s, d, "events").select(F.floor(k / 20).alias("scene"), (F.lit(419000000) + k).cast("string").alias("mmsi"), (-30.3 + k * 41 % 61).alias("x"), (-20.4 + k * 29 % 46).alias("y"))


def sar_ais_pairs(s, d):
    return rounded(corridor.greedy_pairs(_detections(s, d), _seen(s, d), 1.5))


def sar_only(s, d):
    return _detections(s, d).join(corridor.greedy_pairs(_detections(s, d), _seen(s, d), 1.5), ["scene", "det_id"], "left_anti").select("scene", "det_id")


def ais_only(s, d):
    return _seen(s, d).join(corridor.greedy_pairs(_detections(s, d), _seen(s, d), 1.5), ["scene", "mmsi"], "left_anti").select("scene", "mmsi")


def _components(s, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    return tables.table(s, d, "part").select((k % 5).alias("scene"), k.alias("component_id"), (1.0 + size % 9).cast("double").alias("elongation"), ((k % 10) / 10.0).alias("solidity"), (0.2 + (k % 31) / 10.0).alias("contrast_db"), ((k % 13) / 4.0).alias("target_km"), ((k % 7) / 3.0).alias("end_km"), (size / 4.0).alias("length_km"), (F.col("p_retailprice") / 20.0).alias("area_km2"), ((k % 17) / 17.0).alias("probability"))


def triage(s, d):
    return scoring.triage(_components(s, d), 7.0).select("scene", "component_id", "label", "oil_points", "lookalike_points", "ship_trail", "triage_score", "triage_rank")


def triage_counts(s, d):
    return scoring.triage(_components(s, d), 2.0).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("ship_trail").alias("trails"))


def robustness(s, d):
    k = F.col("s_suppkey")
    parts = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), ((k * 7 + 5 * j) % 11 / 10.0).alias("value")) for j, f in enumerate(("spatial", "temporal", "trajectory", "type"))))).alias("p")
    factors = tables.table(s, d, "supplier").select((F.lit(419000000) + k).cast("string").alias("mmsi"), (k + 1).cast("int").alias("base_rank"), parts).select("mmsi", "base_rank", "p.*")
    n = F.col("id")
    w = s.range(400).select(n.alias("sample"), F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), ((n * (17 + 6 * j) + 11 * j) % 97 / 97.0).alias("weight")) for j, f in enumerate(("spatial", "temporal", "trajectory", "type"))))).alias("w")).select("sample", "w.*")
    return rounded(scoring.robustness(factors, w))


def _labelled(s, d):
    """Places with one of three release times, an event each (km)."""
    k = F.col("event_id")
    return tables.table(s, d, "events").select((k % 3).cast("int").alias("label"), (k * 37 % 1201 / 10.0 - 60).alias("px"), (k * 53 % 803 / 10.0 - 40).alias("py"))


def hist2d(s, d):
    return surface.histogram(_labelled(s, d), -60.0, -40.0, 2.0)


def kde(s, d):
    return rounded(surface.smoothed(surface.histogram(_labelled(s, d), -60.0, -40.0, 2.0), 1.5))


def mass_maps(s, d):
    masses = surface.mass(surface.smoothed(surface.histogram(_labelled(s, d), -60.0, -40.0, 2.0), 1.5), "density")
    return rounded(surface.combined(masses, 3), digits=9)


def hdr(s, d):
    """On exact shares (histogram counts), so that equal cells tie on any engine."""
    return rounded(surface.highest_density(surface.mass(surface.histogram(_labelled(s, d), -60.0, -40.0, 2.0), "n"), 0.7995), digits=9)


def centre_spread(s, d):
    return rounded(surface.centre_spread(surface.mass(surface.histogram(_labelled(s, d), -60.0, -40.0, 2.0), "n"), -60.0, -40.0, 2.0))


def fill_stranded(s, d):
    h = ((F.col("tq") - WINDOW_START) / 3600).cast("int")
    gone = (h > 0) & ((h + F.col("pid")) % 4 == 3)
    return rounded(surface.filled(_particles(s, d).select("pid", h.alias("step"), F.when(~gone, F.col("px")).alias("px"), F.when(~gone, F.col("py")).alias("py"))))


def advect(s, d):
    n = F.col("id")
    seeds = s.range(300).select((n % 6).cast("int").alias("member"), n.alias("pid"), ((n * 13) % 20 - 10).cast("double").alias("x"), ((n * 7) % 20 - 10).cast("double").alias("y"), (0.02 + 0.004 * (n % 6)).alias("factor"))
    return rounded(surface.advected(seeds, 24, 1.0, (6.0, -3.0)))


def field_sample(s, d):
    f = s.range(6 * 11 * 11).select((F.col("id") / 121).cast("int").alias("it"), (F.col("id") / 11 % 11).cast("int").alias("iy"), (F.col("id") % 11).cast("int").alias("ix"))
    f = f.withColumns({"u": 0.1 * F.col("it") + 0.3 * F.col("iy") * F.col("ix"), "v": 1.0 * F.col("it") - 0.2 * F.col("ix")})
    n = F.col("id")
    pts = numbered(s, d, "events", "event_id").select(n.alias("id"), (n % 40 / 9.0).alias("ft"), (n * 7 % 80 / 9.0).alias("fy"), (n * 11 % 80 / 9.0).alias("fx"))
    return rounded(surface.sampled_field(pts, f, (1.0, 1.0, 1.0)))


def _files(s, d):
    n = F.col("id")
    return numbered(s, d, "supplier", "s_suppkey").select(F.concat(F.lit("om_"), n.cast("string")).alias("file"), (68.0 + n % 5).alias("w"), (15.0 + n % 4).alias("s"), (72.0 + n % 7).alias("e"), (19.0 + n % 5).alias("n"), (WINDOW_START - (n % 3) * DAY).alias("t0"), (WINDOW_START + (n % 6) * DAY).alias("t1"))


def coverage(s, d):
    n = F.col("id")
    asked = numbered(s, d, "part", "p_partkey").select(n.alias("rid"), (70.1 + (n % 9) * 0.2).alias("w"), (16.3 + (n % 5) * 0.3).alias("s"), (72.4 + (n % 7) * 0.6).alias("e"), (18.2 + (n % 4) * 0.7).alias("n"), (WINDOW_START + (n % 10) * 3600.0).alias("t0"), (WINDOW_START + 3600.0 * (12 + n % 60)).alias("t1"))
    return state.covering(_files(s, d), asked)


def _spills(rows):
    k = F.col("o_orderkey")
    return rows.select(k.alias("spill_id"), (F.col("o_totalprice") * 300.1234567).alias("area_m2"), F.when(k % 11 != 0, (k % 70).cast("double")).alias("coast_km"), F.when(k % 3 != 0, (k % 120).cast("double")).alias("beach_eta_h"), (k % 2 == 0).alias("modelled"), ((k % 9) / 10.0).alias("exposure"), (k % 4).alias("n_threatened"), F.element_at(F.array(*map(F.lit, ("Heavy fuel oil", "Marine diesel", "UNKNOWN", "medium crude"))), (k % 4 + 1).cast("int")).alias("oil_type"), F.when(k % 5 != 0, (k % 16).cast("double")).alias("wind_ms"))


def severity(s, d):
    return rounded(impact.severity(_spills(tables.table(s, d, "orders"))))


def action_rules(s, d):
    return impact.actions(impact.severity(_spills(tables.table(s, d, "orders"))))


def _slicks(s, d):
    n = F.col("id")
    return numbered(s, d, "supplier", "s_suppkey").select(n.alias("spill_id"), (8.0 + (n * 5 % 14)).cast("double").alias("lat"), (70.0 + (n * 7 % 22)).cast("double").alias("lon"), (1.0 + n % 5).cast("double").alias("radius_km"), ((n % 6) * 0.5).alias("speed_kmh"), (n * 47 % 360).cast("double").alias("bearing_deg"))


def site_threat(s, d):
    return rounded(impact.threatened_sites(_slicks(s, d), tables.sites(s)))


def next_port(s, d):
    return rounded(impact.next_ports(impact.last_leg(searched(s, d)), tables.ports(s)))


def port_arrivals(s, d):
    """As of the end of the month."""
    legs = written(impact.last_leg(searched(s, d)), "legs")
    found = impact.arrivals(impact.next_ports(legs, tables.ports(s)), legs, 1706745600.0)
    return rounded(rounded(found, "arrives", digits=3), *(c for c, t in found.dtypes if t == "double" and c != "arrives"))


def nearest_place(s, d):
    return rounded(impact.nearest_places(_slicks(s, d).select(F.col("spill_id").alias("id"), "lat", "lon"), tables.ports(s).withColumnRenamed("port", "place")))


def responsible_mrcc(s, d):
    return _slicks(s, d).select("spill_id", domain.rescue_centre(F.col("lon"), F.col("lat")).alias("mrcc"), domain.basin(F.col("lon"), F.col("lat")).alias("basin"))


def _observed(rows):
    k = F.col("o_orderkey")
    return rows.select(k.alias("id"), (WINDOW_START + k * 7200.0).alias("t"), (18.0 + (k % 7) * 0.2).alias("lat"), (71.0 + (k % 5) * 0.3).alias("lon"), (0.05 + (k % 3) * 0.05).alias("half"), F.col("o_totalprice").alias("area_m2"))


def spill_compare(s, d):
    return rounded(impact.associated(_observed(tables.table(s, d, "orders"))))


def _manifest(s, d):
    k = F.col("o_orderkey")
    return tables.table(s, d, "orders").select(F.col("o_custkey").alias("bundle"), F.concat(F.lit("f/"), k.cast("string")).alias("path"), F.sha2(F.concat_ws("|", k.cast("string"), "o_orderstatus", "o_orderpriority"), 256).alias("sha256"))


def manifest_root(s, d):
    return impact.manifest_roots(_manifest(s, d))


def manifest_chain(s, d):
    return impact.chained(impact.manifest_roots(_manifest(s, d)).withColumn("analysis", F.floor(F.col("bundle") / 8)), "analysis")


def manifest_verify(s, d):
    m = _manifest(s, d)
    n = F.substring("path", 3, 20).cast("long")
    there = m.filter(n % 17 != 0).withColumn("sha256", F.when(n % 13 == 0, "changed").otherwise(F.col("sha256"))).unionByName(m.filter(n % 29 == 0).withColumn("path", F.concat("path", F.lit(".new"))))
    return impact.verified(m, there)


def _pixels(s, d):
    """Scenes of 30 rows and 50 columns, a pixel an order."""
    n = F.col("o_orderkey")
    r, c, sc = (F.floor(n / 50) % 30).cast("int"), (n % 50).cast("int"), F.floor(n / 1500).cast("int")
    rows = tables.table(s, d, "orders").select(sc.alias("scene"), r.alias("r"), c.alias("c"))
    bright = F.when((F.col("r") % 23 == 7) & (F.col("c") % 29 == 11), 200.0).otherwise(0.0)
    return rows.withColumn("v", ((F.col("r") * 7919 + F.col("c") * 104729 + F.col("scene") * 31) % 101).cast("double") + bright)


def _mask(s, d):
    return _pixels(s, d).select("scene", "r", "c", F.when((F.floor(F.col("r") / 7) + F.floor(F.col("c") / 5) + F.col("scene")) % 3 == 0, 1).when((F.col("r") * 5 + F.col("c") * 3) % 41 == 0, 1).otherwise(0).alias("m"))


def components(s, d):
    return raster.labelled(_mask(s, d))


def component_stats(s, d):
    return rounded(raster.component_statistics(raster.labelled(_mask(s, d), eight=False), _pixels(s, d)))


def cfar(s, d):
    return rounded(raster.cfar(_pixels(s, d), 4, 12, 4.0))


def sized_components(s, d):
    return raster.sized_components(raster.labelled(_mask(s, d)), 3, 400)


def ring_contrast(s, d):
    found = raster.sized_components(raster.labelled(_mask(s, d)), 30, 400).select("scene", "r", "c", "label")
    return rounded(raster.ring_contrast(found, _pixels(s, d), 1, 3))


def morphology(s, d):
    return raster.opened_closed(_mask(s, d), 1).filter("m = 1").select("scene", "r", "c")


def block_percentile_mad(s, d):
    return rounded(raster.block_levels(_pixels(s, d), 16, 0.6))


def decimate(s, d):
    return rounded(raster.decimated(_pixels(s, d), 4))


def dice_iou(s, d):
    m = _mask(s, d).withColumnRenamed("m", "actual")
    return rounded(raster.overlap_scores(m.withColumn("predicted", F.when((F.col("r") + F.col("c")) % 11 == 0, 1 - F.col("actual")).otherwise(F.col("actual")))))


def position_format(s, d):
    return _slicks(s, d).select("spill_id", geo.nautical(F.col("lat") + 0.2567, F.col("lon") - F.col("spill_id") % 60 * 3.337).alias("position"))


def velocity_parts(s, d):
    u, v = geo.towards(F.col("speed_kmh"), F.col("bearing_deg"))
    wu, wv = geo.coming_from(F.col("speed_kmh"), F.col("bearing_deg"))
    rows = _slicks(s, d).withColumns({"u": u, "v": v, "wu": wu, "wv": wv})
    speed, toward = geo.polar(F.col("u") + 0.5, F.col("v") - 0.25)
    return rounded(rows.select("spill_id", "u", "v", "wu", "wv", speed.alias("speed"), toward.alias("toward"), geo.angle_difference(F.col("bearing_deg"), F.lit(350.0)).alias("turn")))


def _states(e):
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "RUNNING", "COMPLETED", "PARTIAL", "FAILED"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("user_id", "event_id", status.alias("status"), F.col("value"))


def latest_state(s, d):
    return state.interrupted(state.latest(_states(tables.table(s, d, "events")), "user_id", ("event_id",)))


def upsert_latest(s, d):
    """Every event is stored or, from the split on, a change."""
    e = tables.table(s, d, "events")
    late = F.coalesce(F.col("ts") >= F.to_timestamp(F.lit(UPSERT_FROM)), F.lit(False))
    return state.upserted(state.latest(_states(e.filter(~late)), "user_id", ("event_id",)), _states(e.filter(late)), "user_id", ("event_id",))


def provenance_mix(s, d):
    e = tables.table(s, d, "events")
    return state.mixed_provenance(e.select("user_id", F.when(F.col("user_id") % 4 == 0, "LOCAL_FILE").otherwise(F.element_at(F.array(*map(F.lit, ("REAL", "SYNTHETIC", "LOCAL_FILE"))), (F.col("event_id") % 3 + 1).cast("int"))).alias("provenance")), "user_id")


def track_simplify(s, d):
    return rounded(tracks.simplified(searched(s, d), 5.0, DAY))


def search_window(s, d):
    rows = positions(s, d).agg(F.min("lon").alias("w0"), F.min("lat").alias("s0"), F.max("lon").alias("e0"), F.max("lat").alias("n0"))
    k = 40 / 111.32
    wide = k / F.cos(F.radians((F.col("s0") + F.col("n0")) / 2))
    return rounded(rows.select((F.col("w0") - wide).alias("w"), (F.col("s0") - k).alias("s"), (F.col("e0") + wide).alias("e"), (F.col("n0") + k).alias("n"), F.lit(WINDOW_END - (48 + 6) * 3600).alias("t0"), F.lit(WINDOW_END + 6 * 3600).alias("t1")))


def drift_vector(s, d):
    """Centroids of the first and last frame: speed and direction of the cloud."""
    at = _particles(s, d).groupBy("tq").agg(F.avg("px").alias("x"), F.avg("py").alias("y"))
    ends = at.agg(F.min_by(F.struct("tq", "x", "y"), "tq").alias("a"), F.max_by(F.struct("tq", "x", "y"), "tq").alias("b"))
    speed, toward = geo.polar(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return rounded(ends.select((speed / ((F.col("b.tq") - F.col("a.tq")) / 3600)).alias("speed_kmh"), toward.alias("bearing_deg")))


def scene_search(s, d):
    n = F.col("id")
    rows = numbered(s, d, "part", "p_partkey").select(F.concat(F.lit("S"), n.cast("string")).alias("scene"), (WINDOW_START + (n * 37 % 91) * 3600.0).alias("t"), F.when(n % 5 == 0, "EW").otherwise("IW").alias("mode"), F.when(n % 4 == 0, F.array(F.lit("HH"))).otherwise(F.array(F.lit("VV"), F.lit("VH"))).alias("polarisations"), (66.0 + n % 9).alias("w"), (14.0 + n % 6).alias("s"), (69.0 + n % 9).alias("e"), (16.5 + n % 6).alias("n"))
    return rounded(scenes.found_scenes(rows, (70.0, 17.0, 72.0, 18.0)))


def scene_clip(s, d):
    n = F.col("id")
    rows = numbered(s, d, "part", "p_partkey").select(n.alias("rid"), (70.0 + n % 7 * 0.31).alias("w"), (17.0 + n % 5 * 0.29).alias("s"), (71.0 + n % 7 * 0.31).alias("e"), (17.8 + n % 5 * 0.29).alias("n"), F.lit(70.1).alias("fw"), F.lit(17.1).alias("fs"), F.lit(72.2).alias("fe"), F.lit(18.6).alias("fn"))
    return rounded(scenes.clipped(rows))


def georeference(s, d):
    n = F.col("id")
    rows = numbered(s, d, "supplier", "s_suppkey").select(n.alias("image"), (500 + n * 13).alias("width"), (400 + n * 7).alias("height"), (70.0 + n % 9 * 0.1).alias("w"), (16.0 + n % 7 * 0.2).alias("s"), (70.6 + n % 8 * 0.1).alias("e"), (16.7 + n % 7 * 0.2).alias("n"))
    return rounded(scenes.georeferenced(rows), "dx", "dy", "pixel_m", digits=7)


def release_window(s, d):
    hours = F.array(*map(F.lit, (0.0, 0.5, 1.0, 3.0, 6.0, 12.0, 24.0, 36.0, 48.0)))
    rows = numbered(s, d, "part", "p_partkey").select(F.col("id").alias("spill_id"), scenes.release_offsets(hours, (F.col("id") % 60).cast("double")).alias("o"))
    return rows.select("spill_id", F.size("o").alias("n"), F.array_min("o").alias("first"), F.aggregate("o", F.lit(0.0), lambda a, x: a + x).alias("total"))


def drift_reach(s, d):
    return rounded(scenes.drift_reach(tables.table(s, d, "events").select((F.col("user_id") % 20).alias("area"), (F.col("value") / 500.0).alias("speed"))))


def synthetic_forcing(s, d):
    return rounded(scenes.forcing(s, 25, 10, 8))


def tile_merge(s, d):
    n = F.col("id")
    tile = numbered(s, d, "orders", "o_orderkey").select(F.floor(n / 4096).cast("int").alias("scene"), F.floor(n / 1024 % 4).cast("int").alias("k"), F.floor(n / 32 % 32).cast("int").alias("i"), (n % 32).cast("int").alias("j"))
    tile = tile.select("scene", (F.floor(F.col("k") / 2) * 24).cast("int").alias("tr"), (F.col("k") % 2 * 24).cast("int").alias("tc"), "i", "j")
    rows = tile.withColumns({"r": F.col("tr") + F.col("i"), "c": F.col("tc") + F.col("j")}).withColumn("z", ((F.col("r") * 31 + F.col("c") * 17 + F.col("tr") + F.col("tc")) % 23 - 11) / 4.0)
    return rounded(scenes.merged_tiles(rows, 32))


def calibration(s, d):
    rows = tables.table(s, d, "part").select((F.col("p_partkey") % 12).alias("scene"), F.col("p_partkey").alias("setting"), (F.col("p_partkey") * 7 % 100 / 100.0).alias("recall"), (F.col("p_size") % 20 / 100.0).alias("false_positive"))
    return rounded(scenes.best_settings(rows))


def hash_sample(s, d):
    return scenes.sampled(tables.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


def polygon_points(s, d):
    k = F.col("p_partkey")
    corner = lambda i: F.struct((k % 40 + (4 + k % 5) * F.cos(i * 2.5 + k % 7)).alias("x"), (k % 30 + (2 + i) * F.sin(i * 2.5)).alias("y"))
    rings = tables.table(s, d, "part").select(k.alias("ring"), F.transform(F.sequence(F.lit(0), F.lit(4)), corner).alias("corners"))
    return rounded(scenes.points_within(rings, 20))


def _linked(rows, s, d):
    k = F.col("p_partkey")
    boxes = rows.select((k % 4).alias("scene"), k.alias("component_id"), (k * 17 % 90 + 0.25).alias("x0"), (k * 23 % 80 + 0.25).alias("y0")).withColumns({"x1": F.col("x0") + 1.5, "y1": F.col("y0") + 1.0})
    points = numbered(s, d, "supplier", "s_suppkey").select((F.col("id") % 4).alias("scene"), (F.col("id") * 29 % 91).cast("double").alias("x"), (F.col("id") * 31 % 83).cast("double").alias("y"))
    return rounded(scenes.with_nearest_target(boxes, points))


def component_targets(s, d):
    return _linked(tables.table(s, d, "part"), s, d)


QUERIES = {f.__name__: f for f in (
    bbox_time_scan, vessel_semi_select, cleaning_report, dedupe_keep_first, thin_bins, static_first_nonnull, vessel_type, kinematics, spike_fixpoint, gaps, track_quality,
    interp_at, nearest_frame, cloud_interp, corridor_nn, corridor_fraction, region_distance, corridor_candidates, temporal_feature, behaviour, continuity, evidence_score,
    top_candidates, separation, sar_ais_pairs, sar_only, ais_only, triage, triage_counts, robustness, hist2d, kde, mass_maps, hdr, centre_spread, fill_stranded, advect, field_sample,
    coverage, severity, action_rules, site_threat, next_port, port_arrivals, nearest_place, responsible_mrcc, spill_compare, manifest_root, manifest_chain, manifest_verify, components,
    component_stats, sized_components, ring_contrast, cfar, morphology, block_percentile_mad, decimate, dice_iou, position_format, velocity_parts, latest_state, upsert_latest, provenance_mix, track_simplify,
    search_window, drift_vector, scene_search, scene_clip, georeference, release_window, drift_reach, synthetic_forcing, tile_merge, calibration, hash_sample, polygon_points, component_targets,
)}
