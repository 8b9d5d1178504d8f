"""Near-duplicate and substring operators against brute force."""

import hashlib
import random
import string

import numpy as np
import pytest

from tidemark.llm import bwt_dedup, components, metric_join, relative_parse

LOW = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def brute_components(rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().translate(LOW).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_metric_join_equals_brute_force(docs, rows, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in metric_join.join(docs, size, percent).collect()}
    assert got == brute_components(rows, size, percent)


@pytest.mark.parametrize(("direct", "common"), [(metric_join.DIRECT, metric_join.COMMON), (0, metric_join.COMMON), (40, 3), (0, 1)])
def test_metric_join_of_dense_families(spark, direct, common, monkeypatch):
    """Variants of one text, some linked and some not, in the same regions: several rounds are needed."""
    monkeypatch.setattr(metric_join, "COMMON", common)
    r = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in r.sample(range(60), i % 7):
            words[k] = f"x{r.randint(0, 9)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in metric_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, direct=direct).collect()}
    assert got == brute_components(rows, 4, 85)


def test_metric_join_in_many_runs(docs, rows, monkeypatch):
    """Runs and parts of any size give the same links."""
    monkeypatch.setattr(metric_join, "RUN", 200)
    monkeypatch.setattr(metric_join, "PART", 50)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in metric_join.join(docs).collect()}
    assert got == brute_components(rows, 4, 85)


def test_components_of_paths_and_repeats(spark):
    edges = [(i, i + 1) for i in range(20)] + [(5, 5), (30, 31), (31, 30), (30, 31)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def brute_removed(units, window, within):
    """Marks of units covered by windows seen earlier; within: in the same text too."""
    seen, out = {}, {}
    for i in sorted(units):
        marks = [False] * len(units[i])
        own = []
        for j in range(len(units[i]) - window + 1):
            key = tuple(units[i][j : j + window])
            if key in seen or (within and key in own):
                marks[j : j + window] = [True] * window
            own.append(key) if within else None
        for j in range(len(units[i]) - window + 1):
            seen.setdefault(tuple(units[i][j : j + window]), i)
        out[i] = marks
    return out


def test_relative_parse_equals_brute_force(docs, rows):
    got = {r.doc_id: r for r in relative_parse.parse(docs, window=50).collect()}
    units = {i: (t or "").encode().split() for i, t, *_ in rows}
    for i, marks in brute_removed(units, 50, False).items():
        kept = b" ".join(w for w, m in zip(units[i], marks, strict=True) if not m)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(units[i]), sum(marks), hashlib.sha256(kept).hexdigest())
        assert got[i].kept.encode() == kept and sum(f.end - f.start for f in got[i].factors) == sum(marks)
        for f in got[i].factors:  # factors are what the reference has there
            assert f.ref_doc < i and units[i][f.start : f.end] == units[f.ref_doc][f.ref_start : f.ref_start + f.end - f.start]


def test_factors_are_greedy():
    """Phrases 0-60 and 30-90 of document 1 at one distance, 40-120 of document 2, 200-250 of document 3."""
    start, end = np.array([0, 30, 40, 200]), np.array([60, 90, 120, 250])
    got = relative_parse.factored(start, end - start - 9, np.array([1, 1, 2, 3]), np.array([5, 35, 0, 7]), 10)
    assert [(f["start"], f["end"], f["ref_doc"], f["ref_start"]) for f in got] == [(0, 90, 1, 5), (90, 120, 2, 50), (200, 250, 3, 7)]
    assert relative_parse.factored(*[np.zeros(0, np.int64)] * 4, 10) == []


@pytest.mark.parametrize("hot", [bwt_dedup.HOT, 1])
def test_interval_expansion_equals_brute_force(docs, rows, hot, monkeypatch):
    """With hot = 1 every shared anchor takes the path for hot anchors."""
    ranges = bwt_dedup.repeated_ranges
    monkeypatch.setattr(bwt_dedup, "repeated_ranges", lambda d, w, g: ranges(d, w, g, hot))
    small = [r for r in rows if len(r[1] or "") < 5000]
    got = {r.doc_id: r for r in bwt_dedup.remove(docs.filter("n_chars < 5000"), window=100).collect()}
    for i, marks in brute_removed({r[0]: (r[1] or "").encode() for r in small}, 100, True).items():
        text = (rows[i][1] or "").encode()
        kept = bytes(b for b, m in zip(text, marks, strict=True) if not m)
        spans = sum(m and not p for m, p in zip(marks, [False, *marks], strict=False))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(text), sum(marks), spans, hashlib.sha256(kept).hexdigest())


def test_empty_tables(empty):
    assert metric_join.join(empty).count() == relative_parse.parse(empty).count() == bwt_dedup.remove(empty).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in relative_parse.parse(twice).collect()) == [("1", 0), ("1", 0), ("2", 80), ("None", 0)]
    assert {(r.doc_id, r.component_id) for r in metric_join.join(twice).collect()} == {(1, 1), (2, 1), (None, None)}
