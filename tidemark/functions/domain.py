"""Classifiers and small scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numeric ship-type codes.
TYPE_CODES = ((80, 89, "tanker"), (70, 79, "cargo"), (60, 69, "passenger"), (30, 30, "fishing"), (31, 32, "tug"), (52, 52, "tug"))
#: Substrings of ship types; the first that occurs decides.
TYPE_WORDS = (
    ("tanker", "tanker"), ("oil", "tanker"), ("chemical", "tanker"), ("cargo", "cargo"), ("bulk", "bulk_carrier"), ("container", "container"), ("tug", "tug"),
    ("passenger", "passenger"), ("ferry", "passenger"), ("fishing", "fishing"), ("towing", "tug"), ("hsc", "passenger"), ("high speed", "passenger"),
)
#: Relevance of vessel types and weights of the evidence factors.
TYPE_RELEVANCE = {"tanker": 1.0, "cargo": 0.7, "bulk_carrier": 0.7, "container": 0.6, "tug": 0.5, "passenger": 0.4, "fishing": 0.3, "other": 0.4, "unknown": 0.5}
WEIGHTS = {"spatial": 0.25, "temporal": 0.25, "trajectory": 0.15, "sar_attached": 0.15, "vessel_type": 0.07, "behavior": 0.08, "ais_continuity": 0.05}
SEVERITY_WEIGHTS = {"size": 0.20, "coast": 0.15, "beaching": 0.25, "sensitivity": 0.25, "persistence": 0.15}


def _cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first, *rest = pairs
    return reduce(lambda c, p: c.when(*p), rest, F.when(*first)).otherwise(otherwise)


def vessel_type(raw: Column) -> Column:
    """Normalised vessel type of a code or text; the order of the words matters."""
    text = F.lower(F.trim(raw))
    code = F.floor(text.try_cast("double")).try_cast("int")
    numeric = text.rlike(r"^-?[0-9]+(\.[0-9]*)?$")
    by_code = _cases([(code.between(a, b), F.lit(t)) for a, b, t in TYPE_CODES], F.lit("other"))
    by_word = _cases([(text.contains(w), F.lit(t)) for w, t in TYPE_WORDS], F.lit("other"))
    return F.when(raw.isNull() | text.isin("", "nan", "none"), "unknown").when(numeric, by_code).otherwise(by_word)


def type_relevance(kind: Column) -> Column:
    return _cases([(kind == k, F.lit(v)) for k, v in TYPE_RELEVANCE.items()], F.lit(TYPE_RELEVANCE["unknown"]))


def basin(lon: Column, lat: Column) -> Column:
    return F.when(lon >= 91.0, "AN").when((lat < 8.0) & (lon < 82.5), "S").when(lon < 77.8, "W").otherwise("E")


def basins_connect(a: Column, b: Column) -> Column:
    """Basins that a straight course from a can reach without crossing land."""
    return _cases([(a == "W", b.isin("W", "S")), (a == "E", b.isin("E", "S")), (a == "AN", b.isin("AN", "E"))], b.isin("W", "E", "S"))


def rescue_centre(lon: Column, lat: Column) -> Column:
    return F.when(lon >= 91.0, "MRCC Port Blair").when((lon < 77.6) | ((lat < 8.3) & (lon < 78.5)), "MRCC Mumbai").otherwise("MRCC Chennai")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def severity_level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MODERATE").otherwise("LOW")


def response_tier(tonnes: Column) -> Column:
    return F.when(tonnes < 700, "Tier 1").when(tonnes <= 10000, "Tier 2").otherwise("Tier 3")


def persistence(oil_type: Column, wind_ms: Column) -> Column:
    kind = F.lower(F.coalesce(oil_type, F.lit("")))
    base = F.when(kind.rlike("heavy|hfo|ifo|bunker|fuel oil|crude|sludge"), 1.0).when(kind.rlike("diesel|gas oil|mgo|marine gas|kerosene|light|gasoline"), 0.35).otherwise(0.7)
    return base * F.when(wind_ms > 10, 0.8).otherwise(1.0)


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """100 times the weighted mean of the parts."""
    return 100 * reduce(lambda a, b: a + b, [F.lit(w) * parts[k] for k, w in weights.items()]) / sum(weights.values())


def monsoon_regime(month: Column) -> Column:
    return F.when(month.between(6, 9), "southwest").when(month.isin(12, 1, 2), "northeast").otherwise("transition")


def parsed_time(text: Column) -> Column:
    """ISO with or without zone, EXIF, compact and day-first times; naive times are UTC; others null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def null_sentinels(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("Unknown", "Undefined", "", "nan"), trimmed)
