"""Secret scans: patterns, and how widely a candidate is owned across the corpus.

Only DataFrame functions: matches and the pieces between them give positions without any Python.

Base kinds (assign, access, hex) are pattern matches and always stay. Further candidates are long
mixed tokens anywhere in a text; each is hashed, and the corpus-wide number of distinct repositories
and owners that hold the hash decides: one held by few is specific to its owner and looks live
(kind `owned`), one that is copied widely is an example and adds no span. The same figures are given
for base candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Kinds in their order with pattern and least length of the value; values are the last group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the run after AKIA is greedy, so a bound in the pattern finds the same matches
HEX = r"[0-9a-f]{32,}"  # likewise: maximal runs
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]+"
KINDS = ("assign", "access", "hex", "owned")
#: Matches of a block of positions.
BLOCK = 128


def _bound(value: F.Column, use) -> F.Column:
    """use(value) with the value computed once: Catalyst would put it into every place of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: F.Column, pattern: str) -> F.Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches, in code points.

    Lengths of matches and of the pieces between them are added up block by block, so that the arrays that
    grow stay short and the cost follows the number of matches.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    paired = lambda m: F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(F.length(g).alias("gap"), x.alias("match")))
    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
    before = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("out"))
    ends = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["match"]))
    starts = lambda bs: F.aggregate(bs, before, lambda acc, b: F.struct((acc["end"] + ends(b)).alias("end"), F.concat(acc["out"], F.array(acc["end"])).alias("out")), lambda acc: acc["out"])
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(acc: F.Column, x: F.Column) -> F.Column:
        begin = acc["end"] + x["gap"]
        stop = begin + F.length(x["match"])
        return F.struct(stop.alias("end"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), stop.alias("end"), x["match"].alias("match")))).alias("out"))

    placed = lambda bs: F.flatten(F.zip_with(bs, starts(bs), lambda b, at: F.aggregate(b, F.struct(at.alias("end"), none.alias("out")), step, lambda acc: acc["out"])))
    return _bound(_bound(found, paired), lambda p: F.when(F.size(p) > 0, _bound(blocks(p), placed)).otherwise(none))


def candidates(docs: DataFrame, least_value: int = 8) -> DataFrame:
    """docs (doc_id, repository, owner, text) -> `spans`: array of (start, kind number, end, value)."""
    text = F.col("text")

    def spans(kind: int, pattern: str, value) -> F.Column:
        return F.transform(located(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), value(m["match"]).alias("value")))

    assign = F.filter(spans(0, ASSIGN, lambda m: F.regexp_extract(m, ASSIGN, 2)), lambda s: F.length(s["value"]) >= least_value)
    same = lambda m: m
    # texts without a match are told by one search and build no arrays
    has = lambda pattern, found: F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))
    base = F.concat(has(ASSIGN, assign), has(ACCESS, spans(1, ACCESS, same)), has(HEX, spans(2, HEX, same)))
    rows = docs.withColumn("base", base).withColumn("more", has(TOKEN, spans(3, TOKEN, same)))
    # a token that overlaps a base span says nothing new
    more = F.filter("more", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.withColumn("found", F.concat("base", more)).drop("base", "more", "text")


def scan(docs: DataFrame, most_owners: int = 2, most_repositories: int = 4, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Spans of likely secrets in every document.

    Returns doc_id, the base counts n_assign, n_access, n_hex, base_sha256 and spans (`kind:start:end`
    ordered by start, then kind, comma-joined), and n_live and n_example: how many spans hold a value
    with few owners, and how many a value copied beyond most_owners or most_repositories.

    A null text is empty and has no spans; null owners or repositories count as one of their own.
    Repeated rows give a row each. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.to_json(F.array(*(F.col(c).cast("string") for c in repository_cols))).alias("repository"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # rows without an id of their own: several may share a doc_id
    rows = materialize(candidates(rows).withColumn("row", F.when(F.size("found") > 0, F.monotonically_increasing_id())), "candidates")
    values = rows.filter("row is not null").select("row", "owner", "repository", F.explode("found").alias("span"))
    values = values.withColumn("hash", F.sha2("span.value", 256))
    # distinct holders first, with partial aggregation: a value in a third of all rows is a few rows a task
    owners = values.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
    owned = owners.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    owned = materialize(owned.withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)), "owned")
    judged = values.select("row", "hash", "span.start", "span.kind", "span.end").join(owned.select("hash", "live"), "hash")
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("judged"))
    # rows without candidates, most of a corpus, pass by the join
    out = rows.filter("row is not null").select("doc_id", "row").join(spans, "row", "left").select("doc_id", "judged")
    out = out.unionByName(rows.filter("row is null").select("doc_id", F.lit(None).cast("array<struct<start:int,kind:int,end:int,live:boolean>>").alias("judged")))
    listed = F.coalesce("judged", F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>"))
    out = out.withColumn("judged", listed).withColumn("base", F.filter("judged", lambda s: s["kind"] < 3))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    join = lambda spans: F.array_join(F.transform(spans, name), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(join(F.col("base")), 256).alias("base_sha256"),
        join(F.filter("judged", lambda s: (s["kind"] < 3) | s["live"])).alias("spans"),
        F.size(F.filter("judged", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
