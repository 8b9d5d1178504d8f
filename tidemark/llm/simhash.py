"""SimHash fingerprints of word shingles, and their links by pigeonring filtering.

The bits of two fingerprints are cut into `segments` on a ring. If they differ in at most t bits, some chain of
consecutive segments begins such that its first l segments differ in at most l * t / segments bits, for every l:
else every chain would overdraw its share somewhere, and the shares of the whole ring add up to more than t. With
t + 1 segments the first segment of the chain is equal and the next differs in one bit at most. That makes a key:
start, first and second segment. A fingerprint is filed under its own keys (`own`) and under those with one set
bit of the second segment cleared, so that of two fingerprints that differ there the one with the bit set finds
the other. Candidates of a key must keep the budgets of the longer chains before all bits are counted.

Classes are wanted, not all links, so a dense group isn't compared pair by pair: each key first compares its
members with one of its own (its pivot), links give classes, and later only members of one key that are in
different classes meet. A key whose members are in many classes is cut finer by a third segment of the chain.
Equal fingerprints are one point throughout.

Joins of keys are merged: an exploded table counts as large as what it was made from, a written one as its
compressed file, and Spark would broadcast tables that the driver can't hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import drop, materialize
from .text import Texts, signed, steps, trimmed, words

BITS, SEED = 64, 42
#: Shingles whose bits one step counts.
COUNTED = 1 << 15
#: Members of a key that meet pair by pair; a key with more is cut finer.
DENSE = 256


def _joined(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space each, their places in that, and the first word of each text."""
    found = words(texts)
    n = found.end - found.start
    start = np.cumsum(n + 1) - (n + 1)
    data = np.full(int((n + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(data), bool)
    inside[start + n] = False
    covered = np.zeros(len(texts.data) + 1, np.int8)
    covered[found.start] += 1
    covered[found.end] -= 1
    data[inside] = texts.data[np.cumsum(covered[:-1]).astype(bool)]
    return data, start, start + n, found.first


def shingle_hashes(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, and the number of each text's; a text with fewer words has one of all its words."""
    data, start, end, first = _joined(texts)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    head = np.arange(int(n.sum())) + np.repeat(first[:-1] - (np.cumsum(n) - n), n)
    last = head + np.repeat(np.minimum(counts, size), n) - 1
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    hashes = (digest(raw[a:b], SEED) for a, b in zip(start[head].tolist(), end[last].tolist(), strict=True))
    return np.fromiter(hashes, np.uint64, len(head)), n


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of n[i] hashes the number whose bits are set in over half of them; 0 for none."""
    sums = np.zeros((len(n), BITS), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    for i in range(0, len(hashes), COUNTED):
        own = owner[i : i + COUNTED]
        bits = np.unpackbits(hashes[i : i + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f): a row for each row; A-Z are lower-cased, null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.column("text")):
                found = majority(*shingle_hashes(part.lowered(), size))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), pa.array(signed(found))], ["doc_id", "f"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(trimmed(run), "doc_id long, f long")


class Ring:
    """Masks of chains of segments, one array for each length, by start."""

    def __init__(self, threshold: int) -> None:
        if not 1 <= threshold < BITS - 1:
            raise ValueError("the threshold must be from 1 to 62 bits")
        m = self.segments = threshold + 1
        edges = [BITS * i // m for i in range(m + 1)]
        self.bits = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        self.threshold = threshold

    def budget(self, length: int) -> int:
        return length * self.threshold // self.segments

    def chain(self, start: int, length: int) -> int:
        return sum(1 << b for i in range(length) for b in self.bits[(start + i) % self.segments])


def _literal(number: int) -> Column:
    return F.lit(number - (1 << BITS) if number >> (BITS - 1) else number).cast("long")


def _options(rows: list[tuple[int, ...]], names: tuple[str, ...]) -> Column:
    """Constant rows: a start, then masks."""
    return F.array(*(F.struct(F.lit(start).alias(names[0]), *(_literal(x).alias(n) for x, n in zip(rest, names[1:], strict=True))) for start, *rest in rows))


def _keys(points: DataFrame, ring: Ring) -> DataFrame:
    """(start, key, f, own): a point under its own keys and those with one set bit of the second segment cleared."""
    length = min(2, ring.segments)
    rows = [(s, ring.chain(s, length), bit) for s in range(ring.segments) for bit in (0, *(1 << b for b in ring.bits[(s + 1) % ring.segments]))]
    filed = points.select("f", F.inline(_options(rows, ("start", "mask", "bit"))))
    filed = filed.filter("bit = 0 or (f & bit) <> 0")
    return filed.select("start", F.expr("f & mask & ~bit").alias("key"), "f", F.expr("bit = 0").alias("own"))


def _finer(members: DataFrame, ring: Ring) -> DataFrame:
    """Members of keys, cut by the third segment: own points as they are, and all with as many bits changed as is left."""
    rows = [(s, ring.chain(s + 2, 1), 0, 0, 1) for s in range(ring.segments)]
    for s in range(ring.segments):
        third = [1 << b for b in ring.bits[(s + 2) % ring.segments]]
        for changed in range(ring.budget(3) + 1):
            rows += [(s, ring.chain(s + 2, 1), sum(c), changed, 0) for c in combinations(third, changed)]
    table = members.sparkSession.createDataFrame([(s, *(x - (1 << BITS) if x >> (BITS - 1) else x for x in (mask, flip)), n, bool(own)) for s, mask, flip, n, own in rows], "start int, mask long, flip long, changed int, first boolean")
    # a member under a cleared bit has spent one change
    both = members.join(F.broadcast(table), "start").filter(f"case when first then own else changed + if(own, 0, 1) <= {ring.budget(3)} end")
    return both.select("start", "key", F.expr("(f ^ flip) & mask").alias("third"), "f", "c", F.col("first").alias("own"))


def _linked(pairs: DataFrame, ring: Ring) -> DataFrame:
    """Of pairs (start, u, v) that keep the budgets of their chains, links (u, v)."""
    for length in range(3, ring.segments + 1):
        masks = F.array(*(_literal(ring.chain(s, length)) for s in range(ring.segments)))
        pairs = pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v")).bitwiseAND(masks[F.col("start")])) <= ring.budget(length))
    return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= ring.threshold).select("u", "v").distinct()


def _across(members: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of one key whose classes differ, the first under its own key."""
    a = members.filter("own").select(*on, F.col("f").alias("u"), F.col("c").alias("cu"))
    b = members.select(*on, F.col("f").alias("v"), F.col("c").alias("cv"))
    return a.join(b.hint("merge"), on).filter("cu <> cv").select("start", "u", "v")


def classes(points: DataFrame, threshold: int = 4, dense: int = DENSE) -> DataFrame:
    """points (f), distinct -> (node, component): smallest f reachable by links of at most `threshold` bits, for
    every point that has a link."""
    ring = Ring(threshold)
    filed = _keys(points, ring)
    own = F.when(F.col("own"), F.col("f"))
    keys = filed.groupBy("start", "key").agg(F.min(own).alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1 and pivot is not null")
    shared = materialize(filed.join(keys.hint("merge"), ["start", "key"]), "shared-keys")
    first = shared.filter("f <> pivot").select("start", F.col("pivot").alias("u"), F.col("f").alias("v"))
    found = materialize(components(_linked(first, ring)), "classes")
    classed = shared.join(found.hint("merge"), F.col("f") == F.col("node"), "left").select("start", "key", "f", "own", "n", F.coalesce("component", "f").alias("c"))
    classed = materialize(classed, "classed")
    split = classed.groupBy("start", "key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("start", "key")
    left = materialize(classed.join(split.hint("merge"), ["start", "key"]), "split-keys")
    drop(shared, classed)
    thin = _across(left.filter(F.col("n") <= dense), ["start", "key"])
    fine = _across(_finer(left.filter(F.col("n") > dense), ring), ["start", "key", "third"]) if ring.segments > 2 else _across(left.filter(F.col("n") > dense), ["start", "key"])
    known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    out = materialize(components(known.union(_linked(thin.union(fine), ring))), "classes")
    drop(found, left)
    return out


def near(docs: DataFrame, size: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint 0, which links like any other. Null ids are rows like others but are
    never the smallest; a class of null ids alone has none. Rows that share an id are points each, by their texts;
    repeated rows have one point; an empty table gives an empty one; other columns play no part.
    """
    prints = materialize(fingerprints(docs, size, id_col, text_col), "fingerprints")
    points = materialize(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "points")
    found = classes(points.select("f"), threshold)
    members = points.join(found.hint("merge"), F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("component", "f").alias("c"))
    least = members.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = materialize(members.join(least.hint("merge"), "c").select("f", "component_id"), "components")
    drop(points)
    return prints.join(ids.hint("merge"), "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
