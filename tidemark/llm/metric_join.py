"""Exact n-gram Jaccard join as a join in the metric space of shingle sets.

1 - Jaccard is a metric, so with link radius r a set x can link with a member y of a pivot q's
region only if d(x, q) <= d(y, q) + r, and, where y lies nearer q than x's own pivot p, only if
d(x, q) - d(x, p) <= 2r. Far sets share no shingle and lie at distance 1 from everything; their
Voronoi regions would say nothing, so first regions are seeded where sets can link at all: a region
for each shingle in the prefixes of at least two sets, rarest shingles first (two linked sets share
a prefix shingle whatever the order). Then, until no region is left,

1. each region takes its most central member as pivot; the members that can link with it, by sizes and
   places in the prefix, are measured, which gives links and components;
2. the pivot leaves, having met every member; a region whose other members are all in one component is
   finished: more links cannot change components; members that can link with no member of another
   component, by the same bounds, leave as well;
3. in a region with few members outside its largest component, these meet the members that the bounds
   and the triangle inequality over the pivot leave, each pair once;
4. other regions take more pivots, all distances to them are measured, and members go to the Voronoi
   region of the nearest pivot and, if they pass both windows, as replicas to other pivots' regions.

Equal sets are one point. A group of n near copies costs n distances to its pivot, not n squared.

Rarity is counted exactly. A task sends the shingles of a run of documents as sorted numbers, one
binary value for each part of the hash space; each part counts its shingles and answers the run with
those that others have too; the run's documents then know their prefixes. What very many documents of
a run share is not sent but announced, and every run hears of it, so no part of the hash space is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .relative_parse import _documents, named
from .store import arrow_batches, drop, materialize, scope
from .text import Texts, _mixed, grams, mix, signed, steps, trimmed, word_hashes, words

#: Bits of a shingle's number in a run, below its number of 48 bits: documents of a run at most 2**PLACE_BITS.
PLACE_BITS = 16
#: Shingles of a run; a longer document is a run of its own.
RUN = 1 << 21
#: Documents of a run that share a shingle beyond which it is announced instead of sent.
COMMON = 256
#: Shingles that one part of the hash space has on average at most.
PART = 1 << 22
#: Ids of sets that are broadcast at most to fetch their texts (some 50 MB); more are shuffled.
BROADCAST_IDS = 2_000_000
#: Pairs of texts that a task holds at once.
PAIRS_AT_ONCE = 64
#: Pairs of members and outsiders that a region may have to be compared without further pivots.
DIRECT = 1 << 20
#: Pivots of a region that is split.
PIVOTS = 8


def shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, ordered by both; a text under `size` words is one shingle."""
    found = words(texts)
    hashes = word_hashes(texts, found)
    at, whole = grams(hashes, found, size)
    text = found.text_of()[at]
    short = np.flatnonzero((found.counts > 0) & (found.counts < size))
    if len(short):
        alone = found.counts[short].astype(np.uint64)
        for k in range(size - 1):
            has = np.flatnonzero(found.counts[short] > k)
            alone[has] = _mixed(alone[has], hashes[found.first[short[has]] + k])
        text, whole = np.concatenate([text, short]), np.concatenate([whole, mix(alone)])
    order = np.argsort(whole)
    by = text[order]
    order = order[np.argsort(by.astype(np.uint16) if len(texts) <= 1 << 16 else by, kind="stable")]
    text, whole = text[order], whole[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    return text[new], whole[new]


def _set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set of hashes; sets are hashes[first[i]:first[i + 1]]."""
    one, two = (np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(k)))) for k in (0, 0x5851F42D4C957F2D))
    sums = [s[first[1:]] - s[first[:-1]] for s in (one, two)]
    return mix(mix(sums[0] + np.diff(first).astype(np.uint64)) + sums[1])


def sized(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, name, n, set_id): size and id of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.column("text")):
                text, hashes = shingles(part.lowered(), size)
                first = np.searchsorted(text, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, len(part)) for c in ("doc_id", "name")), pa.array(np.diff(first), pa.int64()), pa.array(signed(_set_ids(hashes, first)))], ["doc_id", "name", "n", "set_id"])

    return docs.mapInArrow(trimmed(run), "doc_id long, name long, n long, set_id long")


class _Run:
    """Shingles of some documents as sorted numbers (48 bits of the shingle, then the document's place)."""

    def __init__(self) -> None:
        self.numbers: list[np.ndarray] = []
        self.sets: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.known: set[int] = set()
        self.held = 0

    def add(self, text: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
        """Documents whose sets the run does not have yet."""
        n, sets = np.diff(first), _set_ids(hashes, first)
        fresh = [i for i, (k, s) in enumerate(zip(n.tolist(), sets.tolist(), strict=True)) if k and not (s in self.known or self.known.add(s))]
        place = np.full(len(n), -1, np.int64)
        place[fresh] = len(self.known) - len(fresh) + np.arange(len(fresh))
        at = place[text]
        mine = at >= 0
        self.numbers.append((hashes[mine] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at[mine].astype(np.uint64))
        self.sets.append(sets[fresh])
        self.sizes.append(n[fresh])
        self.held += int(mine.sum())


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


SENT_NAMES = ["part", "run", "numbers", "common", "sets", "sizes"]
SENT = "part long, run long, numbers binary, common binary, sets binary, sizes binary"


def sent(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """Runs of documents as rows for each part of the hash space (part >= 0), and of each run itself (part < 0):
    sets, their sizes and the numbers of shingles that are announced as common."""
    bits = np.uint64(64 - (parts - 1).bit_length())

    def flushed(run: _Run, name: int) -> Iterator[pa.RecordBatch]:
        numbers = np.sort(np.concatenate(run.numbers))
        shingle = numbers >> np.uint64(PLACE_BITS)
        head = _heads(shingle)
        many = np.diff(np.append(head, len(shingle))) > COMMON
        common = np.repeat(many, np.diff(np.append(head, len(shingle))))
        announced = shingle[head[many]]
        rest = numbers[~common]
        edges = np.searchsorted(rest >> bits, np.arange(parts + 1, dtype=np.uint64))
        said = np.searchsorted(announced >> (bits - np.uint64(PLACE_BITS)), np.arange(parts + 1, dtype=np.uint64))
        used = np.flatnonzero((np.diff(edges) > 0) | (np.diff(said) > 0))
        none = [b""] * len(used)
        columns = [pa.array(used.astype(np.int64)), pa.array([name] * len(used), pa.int64()), *(pa.array([values[e[k] : e[k + 1]].tobytes() for k in used], pa.binary()) for values, e in ((rest, edges), (announced, said))), pa.array(none, pa.binary()), pa.array(none, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, SENT_NAMES)
        own = [pa.array([-1 - name], pa.int64()), pa.array([name], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (numbers[common], np.zeros(0, np.uint64), np.concatenate(run.sets), np.concatenate(run.sizes)))]
        yield pa.RecordBatch.from_arrays(own, SENT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, name = _Run(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in steps(batch.column("text")):
                text, hashes = shingles(part.lowered(), size)
                first = np.searchsorted(text, np.arange(len(part) + 1))
                if now.held and (now.held + len(text) > RUN or len(now.known) + len(part) > 1 << PLACE_BITS):
                    yield from flushed(now, name)
                    now, name = _Run(), name + 1
                for a in range(0, len(part), 1 << PLACE_BITS):  # a step seldom has so many
                    b = min(a + (1 << PLACE_BITS), len(part))
                    now.add(text[first[a] : first[b]] - a, hashes[first[a] : first[b]], first[a : b + 1] - first[a])
                    if b < len(part) and now.held:
                        yield from flushed(now, name)
                        now, name = _Run(), name + 1
        if now.held:
            yield from flushed(now, name)

    return docs.mapInArrow(trimmed(run), SENT)


def _values(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def answered(rows: DataFrame) -> DataFrame:
    """Of each part's shingles those that at least two documents have, with their numbers of documents,
    back to the runs; rows of the runs themselves pass through."""
    fields = [("run", pa.int64()), ("numbers", pa.binary()), ("times", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary())]

    def solve(table: pa.Table) -> pa.Table:
        runs = table.column("run").to_pylist()
        if table.column("part")[0].as_py() < 0:
            numbers = _values(table.column("numbers"), "<u8")
            most = [np.full(len(x), np.iinfo(np.uint32).max, "<u4").tobytes() for x in numbers]
            return pa.table([table.column("run"), table.column("numbers"), pa.array(most, pa.binary()), table.column("sets"), table.column("sizes")], schema=pa.schema(fields))
        own = _values(table.column("numbers"), "<u8")
        announced = np.unique(np.concatenate(_values(table.column("common"), "<u8")))
        numbers, which = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(numbers >> np.uint64(PLACE_BITS), kind="stable")
        numbers, which = numbers[order], which[order]
        shingle = numbers >> np.uint64(PLACE_BITS)
        head = _heads(shingle)
        times = np.diff(np.append(head, len(shingle)))
        if len(announced):
            at = np.minimum(np.searchsorted(announced, shingle[head]), len(announced) - 1)
            times[announced[at] == shingle[head]] = np.iinfo(np.uint32).max
        each = np.repeat(times, np.diff(np.append(head, len(shingle))))
        kept = np.flatnonzero(each > 1)
        kept = kept[np.argsort(which[kept], kind="stable")]
        edges = np.searchsorted(which[kept], np.arange(len(own) + 1))
        used = np.flatnonzero(np.diff(edges))
        out = [[values[kept[edges[k] : edges[k + 1]]].tobytes() for k in used] for values in (numbers, each.astype("<u4"))]
        none = pa.array([b""] * len(used), pa.binary())
        return pa.table([pa.array([runs[k] for k in used], pa.int64()), *(pa.array(x, pa.binary()) for x in out), none, none], schema=pa.schema(fields))

    return rows.groupBy("part").applyInArrow(solve, "run long, numbers binary, times binary, sets binary, sizes binary")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """answers -> (region, x, n, place): shared shingles in the prefix of each set, with their places in it.

    Shingles that no other document has come first, the others by number of documents and then by hash.
    """
    fields = [("region", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("place", pa.int64())]

    def solve(table: pa.Table) -> pa.Table:
        sets, sizes = (np.concatenate(_values(table.column(k), "<i8")) for k in ("sets", "sizes"))
        numbers, times = np.concatenate(_values(table.column("numbers"), "<u8")), np.concatenate(_values(table.column("times"), "<u4"))
        doc, shingle = (numbers & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64), numbers >> np.uint64(PLACE_BITS)
        order = np.lexsort((shingle, times, doc))
        doc, shingle = doc[order], shingle[order]
        first = np.searchsorted(doc, np.arange(len(sets) + 1))
        place = np.arange(len(doc)) - first[doc] + (sizes - np.diff(first))[doc]
        kept = place < (sizes + 1 + -percent * sizes // 100)[doc]
        doc = doc[kept]
        return pa.table([pa.array(shingle[kept].astype(np.int64)), pa.array(sets[doc]), pa.array(sizes[doc]), pa.array(place[kept])], schema=pa.schema(fields))

    return rows.groupBy("run").applyInArrow(solve, "region long, x long, n long, place long")


def distances(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """pairs (x, q) of set ids -> written, with `shared` and `joint`, the sizes of intersection and union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, q = batch.column("x"), batch.column("q")
            both = [batch.column("x_text"), batch.column("q_text")]
            for part in steps(both[0]):
                # the other side's texts of the same rows; in steps of their own if they are long
                at, sizes = part.first, []
                one = shingles(part.lowered(), size)
                for other in steps(both[1].slice(at, len(part))):
                    lo, hi = other.first, other.first + len(other)
                    two = shingles(other.lowered(), size)
                    a, b = np.searchsorted(one[0], [lo, hi])
                    text, hashes = np.concatenate([one[0][a:b] - lo, two[0]]), np.concatenate([one[1][a:b], two[1]])
                    order = np.lexsort((hashes, text))
                    text, hashes = text[order], hashes[order]
                    twin = (text[1:] == text[:-1]) & (hashes[1:] == hashes[:-1])
                    shared = np.bincount(text[1:][twin], minlength=hi - lo)
                    sizes.append((shared, np.bincount(text, minlength=hi - lo) - shared))
                shared, joint = (np.concatenate([s[k] for s in sizes]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([x.slice(at, len(part)), q.slice(at, len(part)), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())], ["x", "q", "shared", "joint"])

    joined = pairs.join(texts.select(F.col("set_id").alias("x"), F.col("text").alias("x_text")), "x").join(texts.select(F.col("set_id").alias("q"), F.col("text").alias("q_text")), "q")
    with arrow_batches(pairs.sparkSession, PAIRS_AT_ONCE):
        return materialize(joined.select("x", "q", "x_text", "q_text").mapInArrow(trimmed(run), "x long, q long, shared long, joint long"), "distances")


def _fit(a: str, b: str, percent: int) -> F.Column:
    """Whether sets a and b can link if this shingle is the first that they share, or so if it isn't: what
    stands from it on must hold the shingles that a link of these sizes shares."""
    need = percent * (F.col(f"{a}n") + F.col(f"{b}n"))
    return ((100 + percent) * (F.col(f"{a}n") - F.col(f"{a}place")) >= need) & ((100 + percent) * (F.col(f"{b}n") - F.col(f"{b}place")) >= need)


def _renamed(members: DataFrame, prefix: str) -> DataFrame:
    return members.select("region", *(F.col(c).alias(prefix + c) for c in members.columns if c != "region"))


def _most_central(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """members -> (region, q...): the member of most regions of each region.

    The text that others were edited from shares all its prefix; edits bring rare shingles of their own.
    """
    ranked = members.join(degrees, "x")
    best = ranked.groupBy("region").agg(F.max_by(F.struct("x", "n", "place"), F.struct("degree", "x")).alias("q"))
    return best.select("region", *(F.col(f"q.{c}").alias(f"q{c}" if c != "x" else "q") for c in ("x", "n", "place")))


def _mixed_regions(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Members with `component` and `outside` (not in the region's largest component) of regions of at least
    two components, without members that the sizes let link with no one outside their component."""
    rows = members.join(found.withColumnRenamed("node", "x"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    rows = rows.withColumn("reach", F.floor((100 + percent) * (F.col("n") - F.col("place")) / percent) - F.col("n"))
    by = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("reach").alias("reach"))
    by = by.groupBy("region").agg(F.max_by("component", F.struct("members", "component")).alias("main"), F.count(F.lit(1)).alias("components"), F.min("least").alias("least"), F.max("reach").alias("most"))
    rows = rows.join(by.filter("components > 1").drop("components"), "region").withColumn("outside", F.col("component") != F.col("main"))
    rows = materialize(rows.filter("not outside or (reach >= least and n <= most)").drop("least", "most", "main"), "mixed")
    out = rows.filter("outside").groupBy("region").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    return rows.join(out, "region").filter("outside or (reach >= least and n <= most)").drop("least", "most", "reach")


def _collapsed(members: DataFrame) -> DataFrame:
    """One of all regions with the same members at the same places."""
    marks = [F.bit_xor(F.xxhash64("x", "place", F.lit(i))).alias(f"mark{i}") for i in (1, 2)]
    same = members.groupBy("region").agg(F.count(F.lit(1)).alias("members"), *marks)
    return members.join(same.groupBy("members", "mark1", "mark2").agg(F.min("region").alias("region")).select("region"), "region", "left_semi")


def direct_pairs(members: DataFrame, measured: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, q) of outsiders with members of other components that bounds and triangle inequality leave."""
    d = (1 - F.col("shared") / F.col("joint")).alias("d")
    known = members.join(leaders.select("region", "q"), "region").join(measured.select("x", "q", d), ["x", "q"], "left").drop("q")
    a, b = _renamed(known.filter("outside"), "a_"), _renamed(known, "b_")
    # both outside: each pair once
    apart = (F.col("a_component") != F.col("b_component")) & (~F.col("b_outside") | (F.col("a_x") < F.col("b_x")))
    near = F.coalesce(F.abs(F.col("a_d") - F.col("b_d")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    pairs = a.join(b, (a["region"] == b["region"]) & apart & near & _fit("a_", "b_", percent))
    return pairs.select(F.least("a_x", "b_x").alias("x"), F.greatest("a_x", "b_x").alias("q")).distinct()


def voronoi(members: DataFrame, pivots: DataFrame, measured: DataFrame, radius: float) -> DataFrame:
    """members split into the regions of their region's pivots (region, q), with replicas in the windows."""
    d = 1 - F.col("shared") / F.col("joint")
    rows = members.join(pivots, "region").join(measured.select("x", "q", d.alias("d")), ["x", "q"])
    home = rows.groupBy("region", "x").agg(F.min(F.struct("d", "q")).alias("home"))
    rows = rows.join(home, ["region", "x"]).withColumn("core", F.col("q") == F.col("home.q"))
    reach = rows.filter("core").groupBy("region", "q").agg(F.max("d").alias("reach"))
    slack = 1e-9  # distances are quotients: keep a boundary set rather than lose it
    rows = rows.join(reach, ["region", "q"]).filter(F.col("core") | ((F.col("d") - F.col("home.d") <= 2 * radius + slack) & (F.col("d") <= F.col("reach") + radius + slack)))
    return rows.select(F.xxhash64("region", "q").alias("region"), "x", "n", "place")


def _texts(docs: DataFrame, points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) of the wanted sets x: one document stands for equal sets."""
    near = materialize(points.join(wanted.select(F.col("x").alias("set_id")).distinct(), "set_id").select("set_id", "doc_id", "name"), "near")
    listed = F.broadcast(near) if near.count() <= BROADCAST_IDS else near
    texts = materialize(docs.join(listed, ["doc_id", "name"]).select("set_id", "text").dropDuplicates(["set_id"]), "texts")
    drop(near)
    return texts


def _without(pairs: DataFrame, measured: DataFrame | None) -> DataFrame:
    """Pairs that have not been measured either way."""
    if measured is None:
        return pairs
    both = measured.select("x", "q").unionByName(measured.select(F.col("q").alias("x"), F.col("x").alias("q")))
    return pairs.join(both, ["x", "q"], "left_anti")


class _Measured:
    """All pairs measured so far, and what follows from them."""

    def __init__(self, texts: DataFrame, size: int, percent: int) -> None:
        self.texts, self.size, self.percent = texts, size, percent
        self.pairs: DataFrame | None = None

    def add(self, asked: DataFrame) -> None:
        fresh = materialize(_without(asked, self.pairs), "asked")
        new = distances(fresh, self.texts, self.size)
        drop(fresh)
        self.pairs = new if self.pairs is None else self.pairs.unionByName(new)

    def both(self) -> DataFrame:
        turned = self.pairs.select(F.col("q").alias("x"), F.col("x").alias("q"), "shared", "joint")
        return self.pairs.unionByName(turned).dropDuplicates(["x", "q"])

    def components(self) -> DataFrame:
        fits = self.pairs.filter(f"100 * shared >= {self.percent} * joint")
        return components(fits.select(F.col("x").alias("u"), F.col("q").alias("v")))


def linked(members: DataFrame, texts: DataFrame, size: int, percent: int, direct: int) -> DataFrame:
    """members (region, x, n, place) -> (node, component) of all sets that link with another."""
    measured = _Measured(texts, size, percent)
    while True:
        degrees = materialize(members.groupBy("x").agg(F.count(F.lit(1)).alias("degree")), "degrees")
        leaders = materialize(_most_central(members, degrees), "leaders")
        asked = members.join(leaders, "region").withColumnsRenamed({"n": "x_n", "place": "x_place", "qn": "q_n", "qplace": "q_place"}).filter(F.col("x") != F.col("q"))
        measured.add(asked.filter(_fit("x_", "q_", percent)).select("x", "q").distinct())
        rest = members.join(leaders.select("region", F.col("q").alias("x")), ["region", "x"], "left_anti")
        rest = materialize(_mixed_regions(rest, measured.components(), percent), "rest")
        if rest.isEmpty():
            break
        cost = rest.groupBy("region").agg((F.count_if("outside") * F.count(F.lit(1))).alias("cost"))
        large = materialize(cost.filter(F.col("cost") > direct).select("region"), "large")
        few = rest.join(large, "region", "left_anti")
        measured.add(direct_pairs(few, measured.both(), leaders, percent))
        if large.isEmpty():
            break
        dense = materialize(_collapsed(rest.join(large, "region", "left_semi")), "dense")
        order = Window.partitionBy("region").orderBy(F.desc("degree"), F.xxhash64("x"), "x")
        pivots = dense.join(degrees, "x").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
        pivots = materialize(pivots.select("region", F.col("x").alias("q")), "pivots")
        measured.add(dense.join(pivots, "region").filter("x <> q").select("x", "q").distinct())
        self_pairs = pivots.select(F.col("q").alias("x"), "q", F.lit(1).alias("shared"), F.lit(1).alias("joint")).distinct()
        split = voronoi(dense.select("region", "x", "n", "place"), pivots, measured.both().unionByName(self_pairs), 1 - percent / 100)
        # a pivot has met every member
        members = materialize(split.join(pivots.select(F.xxhash64("region", "q").alias("region"), F.col("q").alias("x")), ["region", "x"], "left_anti"), "members")
        if members.isEmpty():
            break
    return measured.components()


def join(docs: DataFrame, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", direct: int = DIRECT) -> DataFrame:
    """Documents with their number of distinct `size`-word shingles and their component under links.

    Two documents link when 100 * |intersection| >= percent * |union| of their shingle sets of
    lower-cased (A-Z) words; a text under `size` words is one shingle. component_id is the smallest id
    reachable. Null or empty texts have no set and stay alone. Repeated rows give repeated results; different
    texts that share an id are documents each, linked by their own texts;
    rows with a null id take no part: their component is null. Extra columns are ignored. `direct` is
    the cost beyond which a region is split further; it does not change the result.
    """
    docs = named(_documents(docs, id_col, text_col))
    with scope() as keep:
        every = keep(materialize(sized(docs, size), "sets"))
        sets = every.filter("n > 0 and doc_id is not null")
        points = materialize(sets.groupBy("set_id").agg(F.min(F.struct("doc_id", "name")).alias("least")).select("set_id", "least.*"), "points")
        total = sets.agg(F.sum("n")).first()[0] or 0
        parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART, 16)
        answers = answered(sent(docs.filter("doc_id is not null"), size, 1 << (parts - 1).bit_length()))
        # copies in several runs come several times
        seeds = materialize(prefixes(answers, percent), "seeds")
        common = seeds.groupBy("region").agg(F.min("x").alias("a"), F.max("x").alias("b")).filter("a <> b").select("region")
        members = materialize(seeds.join(common, "region", "left_semi").distinct(), "members")
        drop(seeds)
        found = linked(members, _texts(docs, points, members), size, percent, direct)
        names = points.select("set_id", F.col("doc_id").alias("least")).join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        known_as = names.join(names.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("set_id", "component_id")
        known_as = keep(materialize(known_as, "known-as"))
    known = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))
    out = every.select("doc_id", "n", known.alias("set_id")).join(known_as, "set_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
