"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document gets a vector of transformed text statistics. For each language and source a
deterministic minimum-covariance-determinant estimate is fitted to all its vectors: from medians and
median deviations on, concentration steps re-estimate mean and covariance from the `fraction` of
vectors nearest by Mahalanobis distance. Documents whose distance, given their length, is too large
are rejected.

All estimates are grouped sums and mergeable quantiles over one small table of statistics, and the
matrices are inverted one row a group, so neither a large source nor many sources meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import broadcast_within, materialize
from .text import SPACE, Texts, grams, range_hashes, steps, trimmed, word_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = ("length", "word_length", "symbols", "dup_lines", "repeats")
#: Standard deviations that are never held against a document, for each feature: a group of very
#: uniform documents doesn't make a slightly different one an outlier.
TOLERANCE = (0.25, 0.10, 0.04, 0.15, 0.15)
#: Groups of fewer rows borrow the estimate of their language, then of all documents.
LEAST_ROWS = 50
#: Median of the chi-squared distribution of five degrees of freedom: makes distances consistent.
MEDIAN_CHI2_5 = 4.351
#: Rejection bound for the squared distance: chi-squared of four degrees (one is given) at 1 - 1e-9.
CUT = 48.0
#: Groups whose models (some 300 bytes each) are broadcast at most; more are joined by shuffling.
BROADCAST_GROUPS = 100_000


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _sorted_by_text(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    order = np.argsort(hashes, kind="stable")
    by = text[order]
    return order[np.argsort(by.astype(np.uint16) if not len(by) or by.max() < 1 << 16 else by, kind="stable")]


def text_statistics(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of every text."""
    data, bounds = texts.data, texts.bounds
    found = words(texts)
    head = (data & 0xC0) != 0x80
    out = {"n_words": found.counts.astype(np.int64), "word_chars": _sums(head & ~SPACE[data], bounds), "n_symbols": _sums(SYMBOL[data], bounds)}

    starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    ends = ends - ((ends > starts) & (data[ends - 1] == 10))
    of_word = np.searchsorted(found.start, starts)
    used = (of_word < len(found.start)) & (found.start[np.minimum(of_word, max(len(found.start) - 1, 0))] < ends) if len(found.start) else np.zeros(len(starts), bool)
    starts, ends = starts[used], ends[used]
    text = np.searchsorted(bounds, starts, "right") - 1
    lines = range_hashes(data, starts, ends)
    order = _sorted_by_text(text, lines)
    again = (text[order][1:] == text[order][:-1]) & (lines[order][1:] == lines[order][:-1])
    out["n_lines"] = np.bincount(text, minlength=len(texts)).astype(np.int64)
    out["n_dup_lines"] = np.bincount(text[order][1:][again], minlength=len(texts)).astype(np.int64)

    at, hashes = grams(word_hashes(texts, found), found, 3)
    text = found.text_of()[at]
    order = _sorted_by_text(text, hashes)
    twin = (text[order][1:] == text[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    many = np.zeros(len(order), bool)
    many[1:] |= twin
    many[:-1] |= twin
    change = np.zeros(len(found.start) + 1, np.int64)
    first = at[order[many]]
    np.add.at(change, first, 1)
    np.add.at(change, first + 3, -1)
    out["n_repeat_words"] = _sums(np.cumsum(change[:-1]) > 0, found.first)
    return out


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, carried: str) -> DataFrame:
    """docs (carried columns, text) -> carried columns and the statistics; `carried` is their schema."""
    names = [c.split()[0] for c in carried.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch.column("text")):
                got = text_statistics(part)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, len(part)) for c in names), *(pa.array(got[k], pa.int64()) for k in STATISTICS)], [*names, *STATISTICS])

    return docs.select(*names, "text").mapInArrow(trimmed(run), carried + "," + ",".join(f"{k} long" for k in STATISTICS))


def features(rows: DataFrame) -> DataFrame:
    """Transformed statistics: logarithms of length and word length, variance-stabilised shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    angle = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), part / whole)))
    return rows.withColumns({
        "length": F.log(n.cast("double")),
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.log1p(F.col("n_symbols") / n),
        "dup_lines": angle(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": angle(F.col("n_repeat_words"), n),
    })


def _inverted(sums: DataFrame, keys: str) -> DataFrame:
    """Grouped sums -> model rows: center, the whole precision matrix and the length's own precision."""
    p = len(FEATURES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["lang_key", "source_key"]].copy()
            n = frame["n"].to_numpy(float)
            centers, precisions = [], []
            for i in range(len(frame)):
                mean = frame["first"].iloc[i] / n[i]
                cov = np.reshape(frame["second"].iloc[i], (p, p)) / n[i] - np.outer(mean, mean)
                cov = (cov + cov.T) / 2 + np.diag(np.square(TOLERANCE))
                precisions.append([*np.linalg.inv(cov).ravel(), 1 / cov[0, 0]])
                centers.append(list(mean))
            out["center"], out["precision"] = centers, precisions
            yield out

    return sums.mapInPandas(run, f"{keys}, center array<double>, precision array<double>")


def _distance() -> F.Column:
    """Squared Mahalanobis distance of the features to the joined model's center."""
    p = len(FEATURES)
    off = [F.col(f) - F.element_at("center", i + 1) for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + off[i] * off[j] * F.element_at("precision", i * p + j + 1) * (1 if i == j else 2)
    return total


def _given_length() -> F.Column:
    p = len(FEATURES)
    off = F.col(FEATURES[0]) - F.element_at("center", 1)
    return _distance() - off * off * F.element_at("precision", p * p + 1)


def fitted(rows: DataFrame, fraction: float, rounds: int) -> DataFrame:
    """rows (lang_key, source_key, features) -> one model a group: center, precision, scale."""
    keys = ["lang_key", "source_key"]
    schema = "lang_key string, source_key string"
    p = len(FEATURES)
    small = lambda table, name: broadcast_within(materialize(table, name), BROADCAST_GROUPS)
    middles = small(rows.groupBy(*keys).agg(*(F.percentile_approx(f, 0.5, 10000).alias(f"m_{f}") for f in FEATURES)), "middles")
    spreads = rows.join(middles, keys).groupBy(*keys).agg(*(F.first(f"m_{f}").alias(f"m_{f}") for f in FEATURES), *(F.percentile_approx(F.abs(F.col(f) - F.col(f"m_{f}")), 0.5, 10000).alias(f"s_{f}") for f in FEATURES))
    precision = [(1 / (F.pow(1.4826 * F.col(f"s_{f}"), F.lit(2)) + t * t) if i == j else F.lit(0.0)) for i, (f, t) in enumerate(zip(FEATURES, TOLERANCE, strict=True)) for j in range(p)]
    model = small(spreads.select(*keys, F.array(*(f"m_{f}" for f in FEATURES)).alias("center"), F.array(*precision, precision[0]).alias("precision")), "model")
    for _ in range(rounds):
        measured = rows.join(model, keys).withColumn("d2", _distance())
        bound = measured.groupBy(*keys).agg(F.percentile_approx("d2", fraction, 10000).alias("bound"))
        near = measured.join(small(bound, "bound"), keys).filter("d2 <= bound")
        sums = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f"a_{f}") for f in FEATURES), *(F.sum(F.col(f) * F.col(g)).alias(f"b_{f}_{g}") for f in FEATURES for g in FEATURES))
        sums = sums.select(*keys, "n", F.array(*(f"a_{f}" for f in FEATURES)).alias("first"), F.array(*(f"b_{f}_{g}" for f in FEATURES for g in FEATURES)).alias("second"))
        model = small(_inverted(sums, schema), "model")
    scale = rows.join(model, keys).groupBy(*keys).agg(F.greatest(F.lit(1.0), F.percentile_approx(_distance(), 0.5, 10000) / MEDIAN_CHI2_5).alias("scale"))
    return materialize(model.join(scale, keys), "model")


def judge(docs: DataFrame, fraction: float = 0.75, rounds: int = 4, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Statistics and verdict of every document.

    Returns doc_id, the statistics, base_failed (fewer than 50 words, or repeated three-word windows
    over half of them), distance (squared, given the length; null for base failures) and kept.
    Estimates are made from documents that pass the base rules.

    Null and empty texts have no words and fail. Null languages or sources are groups of their own.
    Repeated rows count as often as they come and are judged alike; an empty table gives an empty
    result. Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = statistics(rows, "doc_id long, lang string, source string")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialize(features(rows.withColumn("base_failed", failed)), "statistics")
    # keys that tell null from any string
    key = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("="), c))
    rows = rows.withColumns({"lang_own": key("lang"), "source_own": key("source")})
    good = rows.filter("not base_failed")
    sizes = good.groupBy("lang_own", "source_own").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy("lang_own").agg(F.sum("n").alias("n_lang"))
    enough = sizes.join(langs, "lang_own").select(
        "lang_own", "source_own",
        F.when(F.greatest("n", "n_lang") >= LEAST_ROWS, F.col("lang_own")).otherwise("").alias("lang_key"),
        F.when(F.col("n") >= LEAST_ROWS, F.col("source_own")).otherwise("").alias("source_key"),
    )
    enough = broadcast_within(materialize(enough, "groups"), BROADCAST_GROUPS)
    keyed = good.join(enough, ["lang_own", "source_own"])
    # A language's shared estimate is made from all its documents, the general one from all documents.
    shared = keyed.filter("source_key <> ''").union(_borrowed(good, enough, keyed.columns))
    models = fitted(materialize(shared.select("lang_key", "source_key", *FEATURES), "vectors"), fraction, rounds)
    judged = keyed.join(broadcast_within(models, BROADCAST_GROUPS), ["lang_key", "source_key"]).withColumn("distance", _given_length() / F.col("scale"))
    out = judged.select("doc_id", *STATISTICS, "base_failed", "distance", (F.col("distance") <= cut).alias("kept"))
    bad = rows.filter("base_failed").select("doc_id", *STATISTICS, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return out.unionByName(bad)


def _borrowed(good: DataFrame, enough: DataFrame, columns: list[str]) -> DataFrame:
    """All documents of languages, or all documents, whose shared estimate some small group uses."""
    used = enough.filter("source_key = ''").select("lang_key").distinct()
    langs = good.join(used.select(F.col("lang_key").alias("lang_own")), "lang_own", "left_semi").withColumns({"lang_key": F.col("lang_own"), "source_key": F.lit("")})
    every = good.withColumns({"lang_key": F.lit(""), "source_key": F.lit("")}).join(used.filter("lang_key = ''"), "lang_key", "left_semi")
    return langs.select(*columns).union(every.select(*columns))
