"""Fingerprints against a plain loop, links and classes against all pairs."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.text import steps

LOW = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def plain(text, size=4):
    own = (text or "").encode().translate(LOW).split()
    grams = [b" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints, threshold):
    """Least id of the class of each (id, fingerprint)."""
    values = sorted({f for _, f in prints})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in prints]


TEXTS = ["", None, " \n", "one", "One TWO", "a b c", "a b c d", "a  b\tc\x0bd", "É b ç d é", "x " * 3000, "w" * 5000 + " b c d e", "a b c d a b c d a b c d"]


def test_fingerprints_equal_a_plain_loop(docs, rows, monkeypatch):
    want = sorted((i, plain(t)) for i, t, *_ in rows)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    for size in (1, 3, 4, 9):
        for part in steps(pa.array(TEXTS)):
            assert simhash.majority(*simhash.shingle_hashes(part.lowered(), size)).tolist() == [plain(t, size) for t in TEXTS]
    got = sorted((r.doc_id, r.f % 2**64) for r in simhash.fingerprints(docs).collect())
    assert got == want


def test_spark_hashes_alike(spark):
    own = ["a b c d", "é b c d" * 9, ""]
    got = spark.createDataFrame([(t,) for t in own], "t string").selectExpr("xxhash64(t) as h").collect()
    assert [r.h % 2**64 for r in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in own]


def family(r, n, flips):
    """Numbers at few bits from each other, in chains."""
    out = [r.getrandbits(64)]
    for _ in range(n - 1):
        out.append(r.choice(out[-9:]) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, flips))))
    return out


@pytest.mark.parametrize(("threshold", "dense"), [(1, 2), (2, 2), (4, 2), (4, 256), (7, 2)])
def test_classes_equal_all_pairs(spark, threshold, dense):
    r = random.Random(threshold)
    values = {0, 2**64 - 1, *(r.getrandbits(64) for _ in range(100))}
    for n in (2, 5, 40, 120):
        values |= {*family(r, n, threshold + 2)}
    center = r.getrandbits(64)
    values |= {center ^ sum(1 << b for b in r.sample(range(10), r.randint(0, 9))) for _ in range(150)}  # a dense group within a segment
    signed = sorted(f - (f >> 63 << 64) for f in values)
    points = spark.createDataFrame([(f,) for f in signed], "f long").repartition(4)
    own = {f: f for f in signed} | {r.node: r.component for r in simhash.classes(points, threshold, dense).collect()}
    want = brute([(f, f % 2**64) for f in signed], threshold)
    assert {f: c for f, c in own.items()} == {f: c for f, _, c in want}


def test_every_link_is_in_a_chain_of_some_start():
    r = random.Random(1)
    for threshold in (1, 3, 4, 6):
        ring = simhash.Ring(threshold)
        assert ring.chain(1, ring.segments) == 2**64 - 1
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), r.randint(0, threshold)))
            assert any(all((x & ring.chain(s, n)).bit_count() <= ring.budget(n) for n in range(1, ring.segments + 1)) for s in range(ring.segments))


def test_rows_and_classes(spark, docs, rows):
    more = [(None, "one two"), (None, rows[0][1]), (3, "another text of a shared id"), (3, "another text of a shared id"), (99, None), (None, "alone without an id of its own")]
    own = [(i, t) for i, t, *_ in rows] + more
    both = spark.createDataFrame([(i, t, "x", "y") for i, t in own], "doc_id long, text string, f string, start string").repartition(3)
    got = sorted(map(tuple, simhash.near(both).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == sorted(brute([(i, plain(t)) for i, t in own], 4), key=str)


def test_empty_table(empty):
    assert simhash.near(empty).collect() == []


def test_threshold_out_of_range():
    for t in (0, 63):
        with pytest.raises(ValueError, match="threshold"):
            simhash.Ring(t)


def test_majority_of_none():
    assert simhash.majority(np.zeros(0, np.uint64), np.array([0, 0])).tolist() == [0, 0]


def test_f3_keys_are_not_broadcast(spark, monkeypatch):
    """Spark takes keys for as small as the points they were exploded from."""
    plans = {}

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", seen)
    points = spark.range(2000).select(F.xxhash64("id").alias("f")).union(spark.range(2000).select(F.xxhash64("id").bitwiseXOR(F.lit(1)).alias("f")))
    assert simhash.classes(points, 4).count() == 4000
    assert {"shared-keys", "classed", "split-keys"} <= set(plans)
    for name in ("shared-keys", "classed", "split-keys"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], plans[name]
