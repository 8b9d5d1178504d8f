"""Records of an investigation: states of sources, catalogue, selections, JSON and GeoJSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source_states(sources: DataFrame, configured: DataFrame) -> DataFrame:
    """Sources (source, integrated, needs: names of settings) with their state, given the table of settings (name, value)."""
    needs = sources.select("source", F.explode("needs").alias("name"))
    held = configured.filter("value <> ''").select("name").distinct()
    lacking = needs.join(held, "name", "left_anti").select("source").distinct().withColumn("lacks", F.lit(True))
    ready = F.col("lacks").isNull()
    state = F.when(F.col("integrated") & ready, "ACTIVE").when(ready, "READY_TO_INTEGRATE").otherwise("NOT_CONFIGURED")
    return sources.join(lacking, "source", "left").select("source", ready.alias("configured"), state.alias("state"))


def catalogue(analyses: DataFrame, *columns: str) -> DataFrame:
    """Analyses, the latest change first."""
    return analyses.orderBy(F.desc("changed"), "analysis_id").select("analysis_id", "changed", *columns)


def provider_rows(reports: DataFrame) -> DataFrame:
    """What each provider holds: days, vessels, positions and the densest reporting interval."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy("provider", "mmsi").orderBy("t"))
    rows = reports.withColumn("step", F.when(step > 0, step))
    return rows.groupBy("provider").agg(F.min(F.floor(F.col("t") / 86400)).alias("first_day"), F.max(F.floor(F.col("t") / 86400)).alias("last_day"), F.count_distinct("mmsi").alias("n_vessels"), F.count(F.lit(1)).alias("n_positions"), F.min("step").alias("interval_s"))


def sea_mask_source(scene_shape: Column, sidecar_shape: Column, crs: Column, skew: Column) -> Column:
    """Where a scene's sea mask comes from: a stored mask of equal shape, else the coastline for north-up WGS84, else nowhere."""
    return F.when(sidecar_shape == scene_shape, "SIDECAR").when((F.upper(crs) == "EPSG:4326") & (skew == 0), "COASTLINE").otherwise("NONE")


def selected(components: DataFrame, chosen: DataFrame, ranks: DataFrame) -> DataFrame:
    """Chosen components of each scene; without a choice the one ranked first, without ranks all."""
    picked = chosen.select("scene", "component_id", F.lit(0).alias("by"))
    picked = picked.unionByName(ranks.filter("triage_rank = 1").select("scene", "component_id", F.lit(1).alias("by")))
    best = picked.groupBy("scene").agg(F.min("by").alias("by"))
    listed = picked.join(best, ["scene", "by"]).select("scene", "component_id")
    return components.join(listed, ["scene", "component_id"], "left_semi").unionByName(components.join(best, "scene", "left_anti"))


def single_label(rows: DataFrame, *keys: str) -> DataFrame:
    """The label that all rows of a key share, else UNCERTAIN."""
    return rows.groupBy(*keys).agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise("UNCERTAIN").alias("label"))


def tag_number(tag: Column, name: str) -> Column:
    """The number after `name=` in a text, null without one."""
    return F.regexp_extract(tag, name + r"=(\d+(?:\.\d+)?)", 1).try_cast("double")


def tracked(fixes: DataFrame, least: int = 2) -> DataFrame:
    """Fixes of vessels that have at least that many."""
    n = fixes.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return fixes.join(n.select("mmsi"), "mmsi", "left_semi")


def _strict(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.StructType):
        fields = [_strict(value[f.name], f.dataType).alias(f.name) for f in kind.fields if not f.name.startswith("_")]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _strict(v, kind.elementType))
    return value


def strict_json(rows: DataFrame) -> DataFrame:
    """Rows as one JSON text each (document): NaN and infinities null, fields that begin with `_` left out at any depth."""
    fields = [_strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields if not f.name.startswith("_")]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature as a struct; written one a line, a collection of any size needs no single task."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))


def cell_features(cells: DataFrame, least: float = 1e-5) -> DataFrame:
    """Probability cells (map, lon, lat, p) above the threshold as points."""
    rows = cells.filter(F.col("p") > least)
    f = feature("Point", F.array(F.round("lon", 5), F.round("lat", 5)), F.struct(F.lit("probability_cell").alias("kind"), F.col("map"), F.col("p").alias("probability")))
    return rows.select(F.to_json(f).alias("feature"))


def track_features(fixes: DataFrame, day_s: float = 86400.0) -> DataFrame:
    """Tracks as one line a vessel and day, so that no array holds a whole track; (mmsi, day, feature)."""
    rows = fixes.groupBy("mmsi", F.floor(F.col("t") / day_s).alias("day")).agg(F.sort_array(F.collect_list(F.struct("t", "lon", "lat"))).alias("p"))
    line = F.transform("p", lambda q: F.array(F.round(q["lon"], 5), F.round(q["lat"], 5)))
    f = feature("LineString", line, F.struct("mmsi", F.transform("p", lambda q: q["t"]).alias("times")))
    return rows.filter(F.size("p") > 1).select("mmsi", "day", F.to_json(f).alias("feature"))
