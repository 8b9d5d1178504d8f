"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and accented letters to plain ones and digits and signs to the
letters they stand for; everything else separates words. Lexicon terms are word beginnings with
log-odds weights, learned from labelled rows: terms are chosen greedily so that each toxic training
document is explained by `cover` terms, which keeps words out that merely share documents with
stronger ones. Phrases around a term that only occur in documents labelled clean become exceptions and
cancel the match. The sum of matched weights, divided by the logarithm of the length, is turned into a
score by a one-dimensional logistic fit.

Learning reads a bounded sample (`sample` rows of each label, taken by hash); scoring reads everything.
The model (at most `terms` terms and as many exceptions) is what tasks receive.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relative_parse import _documents

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдеёзіїјкмнорстухѕԁһԛԝαβγεηικνορτυχω", "abbrdee3iijkmhopctyxsdhqwabyenikvoptuxw", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
PREFIXES = range(3, 11)


def _table() -> dict[int, str]:
    """Folding of single characters; built from decompositions, the homoglyphs and the substitutes."""
    table: dict[int, str] = {}
    for code in [*range(0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        letter = unicodedata.normalize("NFKD", chr(code).lower())[:1].lower()
        letter = SUBSTITUTES.get(letter, HOMOGLYPHS.get(letter, letter))
        table[code] = letter if letter.isalpha() else " "
    return table


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        letter = chr(code).lower()[:1]
        self[code] = letter if letter.isalpha() else " "
        return self[code]


FOLDS = _Folds(_table())
ASCII = bytes(ord(FOLDS[i]) for i in range(128)) + bytes([32]) * 128


def fold(text: str) -> str:
    """Folded words joined by single spaces, with a space at both ends."""
    words = []
    for word in text.split():
        bare = word.strip(".,;:!?|\"'()[]")
        if not bare or bare.isdecimal():
            continue
        folded = bare.encode().translate(ASCII).decode() if bare.isascii() else bare.translate(FOLDS)
        words += folded.split()
    return f" {' '.join(words)} "


def beginnings(folded: str) -> set[str]:
    return {w[:k] for w in set(folded.split()) for k in PREFIXES if len(w) >= k}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    bias: float = -20.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found


def matches(automaton, folded: str) -> list[tuple[int, float]]:
    """(place, weight) of the strongest term at each word that no exception phrase covers."""
    if not len(automaton):
        return []
    best: dict[int, float] = {}
    covered: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            covered.append((start, end))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    covered.sort()
    out, i, reach = [], 0, 0
    for place in sorted(best):  # one pass over both, so that a text full of exceptions costs its length
        while i < len(covered) and covered[i][0] <= place:
            reach = max(reach, covered[i][1])
            i += 1
        if place >= reach:
            out.append((place, best[place]))
    return out


def density(automaton, text: str) -> tuple[float, int, int]:
    """(weights by log length, matches, words) of one text."""
    folded = fold(text)
    hits, n = matches(automaton, folded), folded.count(" ") - 1
    return sum(w for _, w in hits) / np.log2(n + 4), len(hits), max(n, 0)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, label_col: str) -> DataFrame:
    """At most about `sample` rows of each label by hash of the id: doc_id, text, toxic."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    marked = marked.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = {k: min(1.0, sample / sizes.get(k, 1)) for k in (0, 1)}
    chosen = marked.filter(part < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    return docs.join(F.broadcast(chosen), "doc_id")  # two ints for each of 2 * sample rows


def _counted(sample: DataFrame) -> DataFrame:
    """(term, toxic documents, clean documents) over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(beginnings(fold(text or "")))
            terms = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "t": [counts[1][x] for x in terms], "c": [counts[0][x] for x in terms]}, schema=pa.schema([("term", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))

    return sample.select("text", "toxic").mapInArrow(run, "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def choose_terms(documents: list[set[str]], counts: dict[str, tuple[int, int]], cover: int, least: int) -> list[str]:
    """Terms by greedy cover of the documents: most documents still short of `cover` terms, fewest clean
    ones, then the longest term; the chosen terms' documents count down."""
    short = [cover] * len(documents)
    of: dict[str, list[int]] = defaultdict(list)
    for i, terms in enumerate(documents):
        for t in terms:
            of[t].append(i)
    chosen, left = [], set(of)
    while left:
        gain = {t: sum(short[i] > 0 for i in of[t]) - 5 * counts[t][1] for t in left}
        best = max(left, key=lambda t: (gain[t], len(t), t))
        if gain[best] < least:
            break
        left = {t for t in left if gain[t] >= least and not t.startswith(best) and not (best.startswith(t) and counts[t][0] == counts[best][0])}
        chosen.append(best)
        for i in of[best]:
            short[i] -= 1
    return chosen


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 4000, terms: int = 2000, cover: int = 2) -> Model:
    """A model from labelled rows whose crc32(doc_id as text) mod 3 is not 1, a bounded sample of them."""
    rows = _sampled(docs, labels.withColumn("doc_id", F.col("doc_id").cast("long")), sample, label_col)
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic:
        return Model()
    least = max(2, toxic // 200)
    odds = lambda t, c: float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    likely = _counted(rows).filter((F.col("t") >= least) & (weight >= 2)).orderBy(F.desc(F.col("t") - 5 * F.col("c")), "term").limit(10 * terms).collect()
    counts = {r["term"]: (r["t"], r["c"]) for r in likely}
    wanted = frozenset(counts)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"terms": pa.array([sorted(beginnings(fold(t or "")) & wanted) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))})

    # the toxic documents of the sample, each with its likely terms: bounded by the sample
    explained = [set(r["terms"]) for r in rows.filter("toxic = 1").select("text").mapInArrow(found, "terms array<string>").collect()]
    chosen = choose_terms(explained, counts, cover, least)[:terms]
    model = Model({t: odds(*counts[t]) for t in chosen})
    model.exceptions = _exceptions(rows, model)[:terms]
    return _calibrated(rows, model)


def _exceptions(rows: DataFrame, model: Model) -> tuple[str, ...]:
    """Two-word phrases around matched terms found in three or more clean sample documents and in no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                phrases = set()
                for place, _ in matches(automaton, folded):
                    here = folded[place + 1 :].split(" ", 2)
                    before = folded[:place].rsplit(" ", 1)[-1]
                    phrases |= {f"{before} {here[0]}"} if before else set()
                    phrases |= {f"{here[0]} {here[1]}"} if len(here) > 1 and here[1] else set()
                out += [(p, toxic) for p in phrases]
            yield pa.RecordBatch.from_pydict({"phrase": pa.array([p for p, _ in out], pa.string()), "toxic": pa.array([t for _, t in out], pa.int32())})

    phrases = rows.select("text", "toxic").mapInArrow(run, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    return tuple(r["phrase"] for r in phrases.filter("t = 0 and n >= 3").orderBy(F.desc("n"), "phrase").limit(10000).collect())


def _calibrated(rows: DataFrame, model: Model) -> Model:
    """Logistic fit of the sample's labels to their densities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": pa.array([float(density(automaton, t or "")[0]) for t in batch.column("text").to_pylist()], pa.float64()), "toxic": batch.column("toxic")})

    got = rows.select("text", "toxic").mapInArrow(run, "x double, toxic int").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    a, b = 0.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge, so that separable labels stay finite
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        gradient = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum() - 0.01 * b])
        hessian = np.array([[(v * x * x).sum() + 0.01, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.bias = float(a), float(b)
    return model


def score(docs: DataFrame, model: Model, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches and n_words of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        automaton = own.automaton()
        for batch in batches:
            got = [density(automaton, t or "") for t in batch.column("text").to_pylist()]
            x = np.array([g[0] for g in got], float)
            p = 1 / (1 + np.exp(-np.clip(own.slope * x + own.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32)), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], ["doc_id", "score", "predicted", "n_matches", "n_words"])

    rows = _documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int, n_matches long, n_words long")
    return rows.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_matches", "n_words")


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **learning: int) -> DataFrame:
    """Learn from `labels` (doc_id, toxic) and score every document.

    Null and empty texts match nothing and get the lowest score. Null ids or labels teach nothing; a
    document labelled twice is toxic if one label says so. Without any toxic training row all scores
    are near 0. Repeated rows get equal scores; an empty table gives an empty result.
    """
    plain = _documents(docs, id_col, text_col)
    return score(plain, learn(plain, labels, label_col, **learning), cut)
