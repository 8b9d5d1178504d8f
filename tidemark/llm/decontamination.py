"""Benchmark decontamination by template windows.

Numbers, names and units of texts and benchmark items become typed placeholders; five-word windows of
these templates are hash-joined, and where they agree along one alignment, slots that hold equal
values in the item must hold equal values in the text. A question whose numbers or names were
replaced is found; a text that merely has the same shape of sentence with mixed-up slots is not.
Literal windows of lower-cased words, joined in the same way, find copies in any letter case.

Only DataFrame functions. Texts are exploded into windows that meet the benchmark's windows in a hash
join on one long; a benchmark up to BROADCAST_ROWS windows is sent to all tasks, a larger one is
shuffled. The first hit of a run tells an alignment, along which all windows are then compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Words that are units after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mile", "miles", "meter", "meters", "metre", "metres", "inch", "inches", "foot", "feet",
    "mg", "g", "kg", "t", "ton", "tons", "lb", "lbs", "oz", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes",
    "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "degree", "degrees",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "mph", "kmh", "hz", "khz", "mhz", "ghz", "w", "kw", "v", "a",
)
#: What is cut from both ends of a word.
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’„…¿¡*_-–—$€£¥₹¢"
NUMBER, NAME, UNIT = "#", "@", "%"
WINDOW = 5
#: Windows of a benchmark (28 bytes or so each) that are broadcast at most.
BROADCAST_ROWS = 1 << 20


def _digit(word: F.Column) -> F.Column:
    return (word >= "0") & (word < ":")


def templates(rows: DataFrame) -> DataFrame:
    """rows (…, text) -> with `words` (cut), `template` (words with placeholders) and `slots` (place, value)."""
    raw = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("raw", raw).withColumn("words", F.transform("raw", lambda w: F.btrim(w, F.lit(PUNCTUATION))))

    def canonical(word: F.Column, i: F.Column) -> F.Column:
        previous = F.when(i > 0, F.get("words", i - 1))
        inside = (i > 0) & ~F.substring(F.get("raw", i - 1), -1, 1).isin(".", "!", "?", ":")
        low = F.lower(word)
        # other capitals than A-Z start no name
        return F.when(_digit(word), NUMBER).when((word >= "A") & (word < "[") & inside, NAME).when(low.isin(*UNITS) & _digit(previous), UNIT).otherwise(low)

    rows = rows.withColumn("template", F.transform("words", canonical))
    marked = F.transform("template", lambda w, i: F.when(w.isin(NUMBER, NAME, UNIT), F.struct(i.alias("place"), F.lower(F.get("words", i)).alias("value"))))
    return rows.withColumn("slots", F.filter(marked, lambda s: s.isNotNull())).drop("raw", "text")


def window_hashes(template: F.Column, size: int = WINDOW) -> F.Column:
    """Hashes of all `size`-word windows, by doubling: a pair of neighbours, a pair of pairs, the rest."""
    one = F.transform(template, lambda w: F.xxhash64(w))
    whole, span = one, 1
    while span < size:
        add = min(span, size - span)
        part = whole if add == span else one if add == 1 else window_hashes(template, add)
        n = F.size(template) - (span + add - 1)
        ahead = F.slice(part, span + 1, n)
        whole = F.zip_with(F.slice(whole, 1, n), ahead, lambda a, b: F.xxhash64(a, b))
        span += add
    return F.when(F.size(template) >= size, whole)


def with_window_hashes(rows: DataFrame, units: str, name: str) -> DataFrame:
    """The column window_hashes(units), step by step: each step is a column, so that none is computed twice."""
    n = F.size(units)
    part = lambda c, start, less: F.slice(c, start, F.greatest(n - less, F.lit(0)))
    rows = rows.withColumn("one", F.transform(units, lambda w: F.xxhash64(w)))
    for to, a, b, at, less in (("two", "one", "one", 2, 1), ("four", "two", "two", 3, 3), (name, "four", "one", 5, 4)):
        rows = rows.withColumn(to, F.zip_with(part(a, 1, less), part(b, at, less), lambda x, y: F.xxhash64(x, y)))
    return rows.withColumn(name, F.when(n >= WINDOW, F.col(name))).drop("one", "two", "four")


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each item text and kind, template or literal: item_id, key, literal, item_words, item_slots,
    item_hashes and anchors (whether a window may be looked up; the others are compared where one was found).

    Template windows with fewer than three literal words fit too much to be looked up. Items under five
    words have no windows.
    """
    rows = templates(benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")))
    rows = rows.dropDuplicates(["item_id", "words"]).withColumn("low", F.transform("words", lambda w: F.lower(w)))
    kinds = F.explode(F.array(F.struct(F.lit(False).alias("literal"), F.col("template").alias("units")), F.struct(F.lit(True).alias("literal"), F.col("low").alias("units")))).alias("kind")
    rows = rows.select("item_id", F.size("low").alias("item_words"), F.col("slots").alias("item_slots"), kinds).select("item_id", "item_words", "item_slots", "kind.*")
    rows = rows.withColumn("key", F.xxhash64("item_id", "literal", "units", "item_slots"))
    telling = F.when(F.col("literal"), F.transform("units", lambda w: (w != "").cast("int"))).otherwise(F.transform("units", lambda w: (~w.isin(NUMBER, NAME, UNIT)).cast("int")))
    rows = rows.withColumns({"telling": telling, "item_hashes": window_hashes(F.col("units"))})
    many = lambda i: F.aggregate(F.slice("telling", i + 1, WINDOW), F.lit(0), lambda n, x: n + x)
    return rows.withColumn("anchors", F.transform("item_hashes", lambda _, i: many(i) >= F.when(F.col("literal"), 1).otherwise(3))).drop("telling")


def anchor_windows(items: DataFrame) -> DataFrame:
    """A row for each window to look up: hash, key, literal, item_place and `previous`, the hash before it if that is looked up too."""
    rows = items.select("key", "literal", "item_hashes", "anchors", F.posexplode("item_hashes").alias("item_place", "hash")).filter(F.get("anchors", F.col("item_place")))
    before = F.col("item_place") - 1
    return rows.select("key", "literal", "item_place", "hash", F.when(F.get("anchors", before), F.get("item_hashes", before)).alias("previous"))


def _alignments(texts: DataFrame, items: DataFrame, literal: bool) -> DataFrame:
    """texts (doc_id, name, slots, template, low) -> a row or more for each alignment: doc_id, name, slots, hashes, shift and the item's columns."""
    texts = with_window_hashes(texts, "template", "hashes")
    if literal:
        texts = with_window_hashes(texts, "low", "literals")
    texts = texts.select("doc_id", "name", "slots", "hashes", *(["literals"] if literal else []))
    # a window without slots is the same in both kinds and is looked up once
    asked = F.concat("hashes", F.zip_with("literals", "hashes", lambda a, b: F.when(a != b, a))) if literal else F.col("hashes")
    # a column of its own: higher-order functions inside the generator would keep it, and the join, out of generated
    # code; and outer, or a filter on the array's size is derived that computes it all again
    texts = texts.withColumn("asked", asked)
    windows = anchor_windows(items)
    small = windows.count() <= BROADCAST_ROWS
    own = F.when(F.col("literal"), F.col("literals")).otherwise(F.col("hashes")) if literal else F.col("hashes")
    n = F.size("hashes")
    place = F.when(F.col("at") >= n, F.col("at") - n).otherwise(F.col("at"))
    if small:
        placed = texts.select(*(c for c in texts.columns if c != "asked"), F.posexplode_outer("asked").alias("at", "hash")).withColumn("place", place)
        hits = placed.join(F.broadcast(windows), "hash")
        # of a run of windows the first one tells the alignment
        hits = hits.filter(F.col("previous").isNull() | ~F.get(own, F.col("place") - 1).eqNullSafe(F.col("previous")))
        return hits.withColumns({"shift": F.col("place") - F.col("item_place"), "own": own}).join(F.broadcast(items.drop("literal", "units")), "key")
    texts = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    placed = texts.select("row", n.alias("n"), F.posexplode_outer("asked").alias("at", "hash")).filter("hash is not null")
    place = F.when(F.col("at") >= F.col("n"), F.col("at") - F.col("n")).otherwise(F.col("at"))
    hits = placed.join(windows, "hash").select("row", "key", "literal", (place - F.col("item_place")).alias("shift")).distinct()
    return hits.join(texts.drop("asked"), "row").withColumn("own", own).join(items.drop("literal", "units"), "key")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", literal: bool = False) -> DataFrame:
    """Documents that contain a benchmark item: at least `least` of its words lie in matching windows
    of alignments with consistent slots.

    With `literal` the lower-cased words count beside the templates: copies in any letter case are found,
    whatever their slots, and items under five words where all their words follow each other.

    Returns a row for each document and item: doc_id, item_id, coverage (0 to 1), exact (all slots of
    some alignment hold the item's own values) and contaminated (true).

    Null or empty texts and items match nothing; nor do those under five words without `literal`.
    Repeated documents or items give one row a pair of ids; null ids are ids of their own. Of different texts
    that share an id each is judged by itself, and one that holds an item is enough. An empty table
    on either side gives an empty result. Extra columns are ignored.
    """
    every = materialize(benchmark_items(benchmark, item_col, item_text_col).filter(F.lit(True) if literal else ~F.col("literal")), "items")
    # documents that share an id are told apart by a hash of the text
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("name", F.xxhash64("text"))
    texts = templates(named).withColumn("low", F.transform("words", lambda w: F.lower(w)))
    # written: otherwise the nested functions below are put into each other again and again
    rows = materialize(_alignments(texts, every.filter(F.col("item_words") >= WINDOW), literal), "alignments")
    shift = F.col("shift")
    rows = rows.withColumn("matched", F.filter(F.sequence(F.lit(0), F.size("item_hashes") - 1), lambda p: F.get("item_hashes", p) == F.get("own", p + shift)))
    rows = materialize(rows.withColumn("sure", F.filter("matched", lambda p: F.get("anchors", p))).drop("own", "item_hashes", "anchors", "hashes", "literals"), "matched")
    inside = lambda places, at: F.exists(places, lambda p: (at >= p) & (at < p + WINDOW))
    own = lambda place: F.get(F.filter("item_slots", lambda t: t["place"] == place), F.lit(0))["value"]

    def pairs(places: str) -> F.Column:
        within = F.filter("slots", lambda s: inside(places, s["place"] - shift))
        return F.array_distinct(F.transform(within, lambda s: F.struct(own(s["place"] - shift).alias("item"), s["value"].alias("text"))))

    consistent = lambda c: F.size(F.array_distinct(F.transform(c, lambda p: p["item"]))) == F.size(c)
    nothing = F.expr("cast(array() as array<struct<item:string,text:string>>)")
    rows = rows.withColumns({"pairs": F.when(F.col("literal"), nothing).otherwise(pairs("matched")), "sure_pairs": F.when(F.col("literal"), nothing).otherwise(pairs("sure"))})
    # windows that are not looked up count where their slots agree with the others
    rows = rows.withColumn("places", F.when(consistent("pairs"), F.col("matched")).when(consistent("sure_pairs"), F.col("sure")).otherwise(F.array().cast("array<int>")))
    covered = lambda places: F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + (WINDOW - 1))))))
    verbatim = (covered("matched") / F.col("item_words") >= least) & F.forall("item_slots", lambda t: inside("matched", t["place"]))
    exact = F.when(F.col("literal"), verbatim).otherwise(F.forall("pairs", lambda p: p["item"] == p["text"]))
    keys = ["doc_id", "item_id"]
    found = rows.select(*keys, "name", "item_words", "places", exact.alias("exact")).groupBy(*keys, "name", "item_words").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.bool_or("exact").alias("exact"))
    found = found.withColumn("coverage", covered("places") / F.col("item_words")).filter(F.col("coverage") >= least).select(*keys, "coverage", "exact")
    if literal:
        found = found.unionByName(_short(texts, every))
    return found.groupBy(*keys).agg(F.max("coverage").alias("coverage"), F.bool_or("exact").alias("exact")).withColumn("contaminated", F.lit(True))


def _short(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Items under five words, each as one window of its own length."""
    items = items.filter(F.col("literal") & (F.col("item_words") < WINDOW) & F.exists("units", lambda w: w != ""))
    sizes = sorted(r["item_words"] for r in items.select("item_words").distinct().collect())
    found = texts.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, exact boolean")
    for k in sizes:
        own = items.filter(F.col("item_words") == k).select("item_id", F.get(window_hashes(F.col("units"), k), F.lit(0)).alias("hash")).distinct()
        placed = texts.select("doc_id", F.explode(F.array_distinct(window_hashes(F.col("low"), k))).alias("hash"))
        found = found.unionByName(placed.join(F.broadcast(own), "hash").select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(True).alias("exact")))
    return found
