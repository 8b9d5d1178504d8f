"""Sources: position files, documents of other providers, and the adapter from event tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import null_sentinels, parsed_time

CANONICAL = ("mmsi", "timestamp", "lat", "lon", "sog", "cog", "vessel_name", "imo", "vessel_type")
#: Headers of known position files.
HEADERS = {
    "default": {c: c for c in CANONICAL},
    "marinecadastre": {"MMSI": "mmsi", "BaseDateTime": "timestamp", "LAT": "lat", "LON": "lon", "SOG": "sog", "COG": "cog", "VesselName": "vessel_name", "IMO": "imo", "VesselType": "vessel_type"},
    "dma": {"MMSI": "mmsi", "# Timestamp": "timestamp", "Latitude": "lat", "Longitude": "lon", "SOG": "sog", "COG": "cog", "Name": "vessel_name", "IMO": "imo", "Ship type": "vessel_type"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(rows: DataFrame, headers: str | dict[str, str] = "default") -> DataFrame:
    """Rename, require identity, time and position, add missing columns as null, coerce types (bad values: null)."""
    names = HEADERS[headers] if isinstance(headers, str) else headers
    rows = rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns})
    missing = [c for c in ("mmsi", "timestamp", "lat", "lon") if c not in rows.columns]
    if missing:
        raise ValueError(f"position rows lack {', '.join(missing)}")
    column = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.trim(column("mmsi")).alias("mmsi"), parsed_time(column("timestamp")).alias("timestamp"),
        *(column(c).try_cast("double").alias(c) for c in ("lat", "lon", "sog", "cog")),
        *(null_sentinels(column(c)).alias(c) for c in ("vessel_name", "imo", "vessel_type")),
    )


def read_positions(spark: SparkSession, path: str, headers: str | dict[str, str] = "default", kind: str = "csv") -> DataFrame:
    """Position files as canonical columns. Lines that begin with # are comments, but for the header `# Timestamp`."""
    if kind == "parquet":
        return canonical(spark.read.parquet(path), headers)
    reader = spark.read.option("header", True)
    return canonical((reader if headers == "dma" else reader.option("comment", "#")).csv(path), headers)


def file_provenance(spark: SparkSession, path: str) -> DataFrame:
    """One row: the provenance of the files' first lines, LOCAL_FILE without one, MIXED if they differ."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).filter("at = 0")
    first = lines.withColumn("line", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "line").alias("value"))
    each = first.select("file", F.regexp_extract("value", r"^# PROVENANCE: (\S+)", 1).alias("found"))
    named = each.select(F.when(F.col("found") == "", "LOCAL_FILE").otherwise(F.col("found")).alias("provenance"))
    return named.agg(F.when(F.count_distinct("provenance") > 1, "MIXED").otherwise(F.max("provenance")).alias("provenance"))


def read_presence_report(spark: SparkSession, path: str) -> DataFrame:
    """Vessel-presence JSON: `entries` hold rows, or maps from dataset names to rows."""
    row = "array<struct<mmsi:string,date:string,lat:double,lon:double,shipName:string,imo:string,vesselType:string>>"
    flat = spark.read.schema(f"entries {row}").option("multiLine", True).json(path).select(F.explode("entries").alias("r"))
    nested = spark.read.schema(f"entries array<map<string,{row}>>").option("multiLine", True).json(path)
    nested = nested.select(F.explode("entries").alias("m")).select(F.explode(F.flatten(F.map_values("m"))).alias("r"))
    rows = flat.unionByName(nested).select("r.*").filter("date is not null and lat is not null")
    named = rows.withColumnsRenamed({"date": "timestamp", "shipName": "vessel_name", "vesselType": "vessel_type"})
    return canonical(named)


def ingest_day(rows: DataFrame, path: str) -> None:
    """Class A and B reports of a day-first CSV as a zstd table partitioned by day; a rerun replaces its days."""
    kept = rows.filter(F.col("Type of mobile").isin("Class A", "Class B"))
    found = canonical(kept, "dma").withColumn("day", F.to_date("timestamp"))
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def scan_days(spark: SparkSession, path: str, bbox: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """Day files within a box and a time range: partitions, row groups and columns are pruned by the reader."""
    w, s, e, n = bbox
    rows = spark.read.parquet(path).filter(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return rows.filter(F.col("lat").between(s, n) & F.col("lon").between(w, e) & F.col("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & F.col("mmsi").rlike("^[0-9]{9}$"))


def select_source(attempts: list[tuple[str, object]]) -> tuple[str | None, DataFrame | None, list[str]]:
    """The first attempt (name, function that returns rows or None) with rows; and what was tried."""
    log = []
    for name, load in attempts:
        rows = load()
        empty = rows is None or rows.isEmpty()
        log.append(f"{name}: {'no rows' if empty else 'used'}")
        if not empty:
            return name, rows, log
    return None, None, log


def position_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position reports made from `events`: one vessel a user, with planted defects.

    Property k plants them: 98 no time, 99 latitude out of range, 97 null island, 1 and 2 a position
    spike, 50 an exact repeat. src_order and dup give the input order.
    """
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = e.select("event_id", "user_id", "event_type", "value", k.alias("k"), seconds.alias("t"))
    h, u = (F.col("t") - 1704067200.0) / 3600.0, F.col("user_id")
    lon0 = 71.0 + (F.floor(u / 15) % 10) * F.lit(0.1) + 0.5 * F.cos(h * 0.0523598776 + u)
    rows = e.select(
        F.col("event_id").alias("src_order"), F.lit(0).alias("dup"), (F.lit(419000000) + u).cast("string").alias("mmsi"),
        F.when(F.col("k") != 98, F.col("t")).alias("t"),
        F.when(F.col("k") == 99, 95.0).when(F.col("k") == 97, 0.0).otherwise(18.0 + (u % 15) * F.lit(0.1) + 0.5 * F.sin(h * 0.0654498469 + u)).alias("lat"),
        F.when(F.col("k") == 97, 0.0).when(F.col("k").isin(1, 2), lon0 + 40.0).otherwise(lon0).alias("lon"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("VESSEL "), u.cast("string"))).alias("vessel_name"),
        F.when(F.col("k") % 4 == 1, (F.lit(60) + u % 30).cast("string")).when(F.col("k") % 4 == 2, F.col("event_type")).alias("vessel_type"),
        F.col("k"),
    )
    return rows.unionByName(rows.filter("k = 50").withColumn("dup", F.lit(1)))


#: The search of the investigation queries.
WINDOW_START, WINDOW_END, STEP_S = 1704844800.0, 1705017600.0, 3600.0
ORIGIN_LAT, ORIGIN_LON = 18.7, 71.4
PARTICLES = 200
COS_ORIGIN = math.cos(math.radians(ORIGIN_LAT))


def time_grid(spark: SparkSession) -> DataFrame:
    """Query times of the window."""
    steps = int((WINDOW_END - WINDOW_START) / STEP_S) + 1
    return spark.range(steps).select((F.lit(WINDOW_START) + F.col("id") * STEP_S).alias("tq"))


def particle_cloud(spark: SparkSession) -> DataFrame:
    """Backtracked particles in closed form: hourly positions in the local plane (km)."""
    grid = time_grid(spark)
    h = (F.col("tq") - WINDOW_START) / 3600.0
    p = F.col("pid")
    return grid.crossJoin(spark.range(PARTICLES).select(F.col("id").cast("int").alias("pid"))).select("tq", "pid", (-30.0 + 1.1 * h + 6.0 * F.sin(p * 1.7) + 2.0 * F.sin(p * 0.37 + h)).alias("px"), (-10.0 + 0.6 * h + 6.0 * F.cos(p * 2.3) + 2.0 * F.cos(p * 0.53 + h)).alias("py"))


def ports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PORTS, "port string, lon double, lat double")


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, "site string, kind string, lon double, lat double, radius_km double, weight int")


#: Ports (name, lon, lat).
PORTS = [
    ("Deendayal (Kandla)", 70.22, 23.00), ("Mundra", 69.72, 22.74), ("Sikka", 69.83, 22.43), ("Pipavav", 71.53, 20.90), ("Mumbai", 72.84, 18.94),
    ("JNPT (Nhava Sheva)", 72.95, 18.95), ("Mormugao", 73.80, 15.41), ("New Mangalore", 74.80, 12.92), ("Kochi", 76.25, 9.97), ("Vizhinjam", 76.99, 8.37),
    ("V.O. Chidambaranar (Tuticorin)", 78.20, 8.76), ("Chennai", 80.30, 13.10), ("Kamarajar (Ennore)", 80.33, 13.26), ("Krishnapatnam", 80.13, 14.25),
    ("Visakhapatnam", 83.30, 17.68), ("Gangavaram", 83.23, 17.62), ("Paradip", 86.68, 20.26), ("Dhamra", 86.97, 20.80), ("Haldia", 88.10, 22.02), ("Port Blair", 92.73, 11.67),
]
#: Sensitive sites (id, kind, lon, lat, radius in km, weight of 10).
SITES = [
    ("gulf_kutch_mnp", "coral_mangrove", 69.80, 22.45, 25.0, 10), ("veraval", "fishing", 70.37, 20.90, 8.0, 7), ("kandla", "port", 70.22, 23.00, 8.0, 6),
    ("tarapur", "intake", 72.65, 19.83, 5.0, 9), ("thane_creek", "mangrove", 72.98, 19.10, 8.0, 9), ("mumbai_port", "port", 72.90, 18.93, 10.0, 6),
    ("alibag", "tourism", 72.87, 18.55, 10.0, 6), ("ratnagiri", "fishing", 73.28, 16.99, 8.0, 7), ("malvan", "coral", 73.45, 16.05, 10.0, 9),
    ("goa", "tourism", 73.78, 15.45, 20.0, 7), ("netrani", "coral", 74.32, 14.02, 5.0, 8), ("mangaluru", "port", 74.80, 12.92, 8.0, 6),
    ("lakshadweep", "coral", 72.63, 10.57, 60.0, 10), ("kochi", "port", 76.25, 9.97, 12.0, 8), ("vizhinjam", "port", 76.99, 8.37, 6.0, 6),
    ("kudankulam", "intake", 77.71, 8.17, 5.0, 9), ("gulf_mannar", "coral", 79.10, 9.15, 35.0, 10), ("tuticorin", "port", 78.20, 8.76, 8.0, 6),
    ("pichavaram", "mangrove", 79.78, 11.43, 8.0, 9), ("kalpakkam", "intake", 80.17, 12.55, 5.0, 9), ("chennai", "port", 80.30, 13.15, 12.0, 7),
    ("pulicat", "lagoon", 80.25, 13.60, 15.0, 9), ("coringa", "mangrove", 82.30, 16.80, 15.0, 9), ("vizag", "port", 83.30, 17.68, 10.0, 6),
    ("chilika", "lagoon", 85.45, 19.70, 25.0, 10), ("paradip", "port", 86.68, 20.26, 8.0, 6), ("gahirmatha", "turtle_mangrove", 87.00, 20.65, 20.0, 10),
    ("haldia", "port", 88.10, 21.95, 10.0, 6), ("sundarbans", "mangrove", 88.90, 21.90, 40.0, 10), ("andaman_mgmnp", "coral", 92.60, 11.55, 20.0, 10), ("port_blair", "port", 92.73, 11.67, 8.0, 6),
]
