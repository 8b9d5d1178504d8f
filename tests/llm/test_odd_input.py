"""Null ids, repeated rows, ids that different texts share, clashing columns and a very long text, for each operator."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bwt_dedup, decontamination, metric_join, mixing, ppm, quality, relative_parse, secrets, token_codec, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i * i % 9973}x{i % 89}" for i in range(60000))
#: id, text: rows without an id, one id for two texts, a row three times, a very long text.
ROWS = [(None, "alpha beta gamma delta " * 20), (None, None), (None, ""), (1, "one two three four five six " * 15), (1, LONG[:900]), (2, "password=abcdefgh123 and more"), (2, "password=abcdefgh123 and more"), (2, "password=abcdefgh123 and more"), (3, LONG)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, hash string, size string, words string, start string, id string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, "a", "b", "c", "d", "e", "f") for i, t in ROWS], SCHEMA).repartition(3).cache()


def ids(found):
    return Counter(r.doc_id for r in found.collect())


WANT = Counter(i for i, _ in ROWS)


def test_scans_give_a_row_for_each_row(odd):
    found = secrets.scan(odd).collect()
    assert Counter(r.doc_id for r in found) == WANT
    assert [r.n_assign for r in found if r.doc_id == 2] == [1, 1, 1]


def test_quality_gives_a_row_for_each_row(odd):
    found = quality.judge(odd).collect()
    assert Counter(r.doc_id for r in found) == WANT
    assert sorted(r.n_words for r in found if r.doc_id is None) == [0, 0, 80] and [r.n_words for r in found if r.doc_id == 3] == [60000]
    assert all(r.base_failed and not r.kept for r in found if r.n_words == 0)


def test_toxicity_gives_a_row_for_each_row(spark, odd):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    assert ids(toxicity.classify(odd, labels)) == WANT


def test_scores_give_a_row_for_each_row(odd):
    found = ppm.score(odd, order=2).collect()
    assert Counter(r.doc_id for r in found) == WANT
    assert len({(r.score, r.base_score) for r in found if r.doc_id == 2}) == 1 and len({r.score for r in found if r.doc_id == 1}) == 2


def test_token_files_hold_every_row(spark, odd):
    files = token_codec.write(odd, TOKENIZER, end_id=2)
    found = token_codec.digest(token_codec.read(spark, files)).collect()
    assert Counter(r.doc_id for r in found) == WANT
    own = token_codec.encoder(TOKENIZER).tokenizer
    assert sorted(r.n_tokens for r in found) == sorted(len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_mixture_is_the_same_however_rows_come(odd):
    rows = odd.withColumn("row", F.struct("doc_id", "text"))
    found = [sorted(mixing.totals(mixing.mix(d, keep=("row",)), "row").select("doc_id", "size", "taken", "position").collect(), key=str) for d in (rows, rows.repartition(1), rows.repartition(5))]
    assert found[0] == found[1] == found[2] and Counter(r.doc_id for r in found[0]) == WANT
    assert all(r.taken <= 3 * r.size for r in found[0])


def test_one_id_for_different_texts_changes_the_order_of_no_rerun(spark):
    docs = spark.createDataFrame([(7, f"text {'w ' * (i % 9)} {i}", "s" if i % 4 else "t") for i in range(60)], "doc_id long, text string, source string")
    found = [sorted(map(tuple, mixing.mix(d, keep=("text",)).collect()), key=str) for d in (docs, docs.repartition(6, "text"), docs.orderBy(F.desc("text")))]
    assert found[0] == found[1] == found[2]


def test_dedup_of_a_very_long_text(spark, odd):
    docs = spark.createDataFrame([(1, LONG), (2, "start " + LONG[200000:230000] + " end"), (3, LONG)], "doc_id long, text string").withColumn("start", F.lit("x"))
    words = [LONG.split(), ("start " + LONG[200000:230000] + " end").split(), LONG.split()]
    seen, want = set(), {}
    for i, ws in enumerate(words):
        hits, own = [False] * len(ws), [tuple(ws[k : k + 50]) for k in range(len(ws) - 49)]
        for k, g in enumerate(own):
            if g in seen:
                hits[k : k + 50] = [True] * 50
        seen |= set(own)
        want[i + 1] = (len(ws), sum(hits), hashlib.sha256(" ".join(w for w, h in zip(ws, hits, strict=True) if not h).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in relative_parse.parse(docs).collect()} == want
    found = {r.doc_id: r for r in bwt_dedup.remove(docs).collect()}
    seen, want = set(), {}
    for i, t in enumerate((LONG, "start " + LONG[200000:230000] + " end", LONG)):
        b, end, kept, spans, covered = t.encode(), 0, [], 0, 0
        for k in range(len(b)):
            g = hash(b[k : k + 100]) if k + 100 <= len(b) else None
            if g is not None and g in seen:
                spans += k > end or (k == 0 and not covered)
                covered += k + 100 - max(end, k)
                end = k + 100
            seen.add(g)
            kept.append(k >= end)
        want[i + 1] = (len(b), covered, spans, hashlib.sha256(bytes(c for c, keep in zip(b, kept, strict=True) if keep)).hexdigest())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in found.items()} == want


def test_joins_of_odd_rows(spark, odd):
    found = {r.doc_id for r in metric_join.join(odd.filter("doc_id is not null")).collect()}
    assert found == {1, 2, 3}
    item = " ".join(LONG.split()[500:530])
    hits = decontamination.contaminated(odd, spark.createDataFrame([(5, item), (5, item), (None, None)], "item_id long, text string"), literal=True).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(3, 5)}


def test_toxic_words_are_found_as_by_a_plain_search():
    model = toxicity.Model({"zonk": 2.0, "blargs": 3.0, "two words": 1.0}, ("zonk street",), 1.0, 0.0)
    own = model.automaton()
    for raw in ("zonk", "a zonk street zonk", "bl4rgs BLARGS", "two  words two words", "xzonk zonkx", "", "nothing here", "zonk " * 500, "zonk street zonk " * 300):
        folded = toxicity.fold(raw)
        spared = [m.span() for m in re.finditer("(?= zonk street )", folded)]
        want = 0
        for term in model.weights:
            for m in re.finditer(f"(?= {term})", folded):
                want += not any(a <= m.start() < a + len(" zonk street") for a, _ in spared)
        assert len(toxicity.matches(own, folded)) == want, raw


def brute_cover(rows, units, n):
    """Marks of the units that windows of n units cover which also start in a smaller id (and, in bytes, earlier in the same text)."""
    own = [units(t or "") for _, t in rows]
    least, out = {}, []
    for (i, _), ws in zip(rows, own, strict=True):
        for k in range(len(ws) - n + 1):
            g = tuple(ws[k : k + n])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    for (i, _), ws in zip(rows, own, strict=True):
        hits, seen = [False] * len(ws), set()
        for k in range(len(ws) - n + 1):
            g = tuple(ws[k : k + n])
            if (i is not None and least[g] < i) or (n == 100 and g in seen):
                hits[k : k + n] = [True] * n
            seen.add(g)
        out.append((ws, hits))
    return out


def passage(start, n):
    return " ".join(f"q{k * k % 7919}z{k % 31}" for k in range(start, start + n))


SHARED = [
    (1, passage(0, 300)),
    (2, "head " + passage(50, 180)),
    (2, "other " + passage(1000, 120)),
    (2, passage(1000, 90) + " tail " + passage(2000, 60)),
    (2, None),
    (2, ""),
    (3, passage(2000, 60) + " x " + passage(2000, 60)),
    (3, passage(2000, 60) + " x " + passage(2000, 60)),
    (3, passage(1020, 80)),
    (None, passage(0, 100)),
    (None, passage(0, 100) + " and more"),
    (1, None),
    (1, passage(3000, 70) + " " + passage(3000, 70)),
]


@pytest.mark.parametrize("hot", [0, 4096])
def test_dedup_of_texts_that_share_an_id(spark, hot, monkeypatch):
    docs = spark.createDataFrame(SHARED, "doc_id long, text string").repartition(4)
    want = sorted((str(i), len(ws), sum(hits), hashlib.sha256(" ".join(w for w, h in zip(ws, hits, strict=True) if not h).encode()).hexdigest()) for (i, _), (ws, hits) in zip(SHARED, brute_cover(SHARED, str.split, 50), strict=True))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in relative_parse.parse(docs).collect()) == want
    want = sorted((str(i), len(b), sum(hits), hashlib.sha256(bytes(c for c, h in zip(b, hits, strict=True) if not h)).hexdigest()) for (i, _), (b, hits) in zip(SHARED, brute_cover(SHARED, str.encode, 100), strict=True))
    monkeypatch.setattr(bwt_dedup.repeated_ranges, "__defaults__", (hot,))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in bwt_dedup.remove(docs).collect()) == want


def test_links_of_texts_that_share_an_id(spark):
    base = passage(0, 120)
    near, far = base.replace(" q9z3 ", " changed "), passage(5000, 100)
    for rows in ([(1, far), (1, base), (2, near)], [(1, base), (1, far), (2, near)], [(5, far), (1, far + " y"), (5, base), (3, near), (None, near), (None, base), (4, None), (4, "")]):
        sets = [(i, set(zip(*((t or "").split()[k:] for k in range(4)), strict=False))) for i, t in rows]
        known = [(i, s) for i, s in sets if i is not None and s]
        root = list(range(len(known)))
        for _ in known:
            for a, (_, s) in enumerate(known):
                for b, (_, u) in enumerate(known):
                    if 100 * len(s & u) >= 85 * len(s | u):
                        root[a] = root[b] = min(root[a], root[b])
        least = [min(known[b][0] for b in range(len(known)) if root[b] == root[a]) for a in range(len(known))]
        want = Counter([(i, len(s), c) for (i, s), c in zip(known, least, strict=True)] + [(i, len(s), i) for i, s in sets if i is not None and not s])
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in metric_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() if r.doc_id is not None)
        assert got == want


def test_halves_of_an_item_in_two_texts_of_one_id_are_no_leak(spark):
    item = passage(0, 40)
    benchmark = spark.createDataFrame([(1, item), (2, "  "), (None, None)], "item_id long, text string")
    halves = [(1, passage(0, 22)), (1, passage(18, 22)), (2, "start " + item + " end"), (2, passage(900, 30)), (None, item), (None, "nothing"), (3, item + " " + LONG)]
    found = decontamination.contaminated(spark.createDataFrame(halves, "doc_id long, text string"), benchmark, literal=True).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {(2, 1, 1.0), (None, 1, 1.0), (3, 1, 1.0)}
