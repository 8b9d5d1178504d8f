"""Content-defined blocks: how repeated windows are found without shipping every window.

Every window of `window` units (words or bytes) has one anchor, the smallest hash among its
`gram`-unit grams (the leftmost on ties), so equal windows have equal anchors at equal places.
Successive windows with the same anchor form a block, about (window - gram) / 2 windows long on
average. Two blocks with equal content repeat all their windows, so one row a block tells which
windows repeat, and only blocks that share an anchor but differ need their windows compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import RangeHash

LOW = np.uint64((1 << 24) - 1)
#: Units handled at once; a longer text is cut into overlapping pieces, which only cuts blocks in two.
PIECE = 1 << 22


@dataclass
class Blocks:
    """text: index of the text; start: first unit in the text; n: number of windows; anchor, content: hashes."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _minimum_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of `width` hashes the place of its smallest one, leftmost on ties."""
    key = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
    done = 1
    while done < width:
        by = min(done, width - done)
        key = np.minimum(key[:-by], key[by:])
        done += by
    return (key & LOW).astype(np.int64)


def blocks(units: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Blocks:
    """Blocks of all texts; units are bytes or word hashes, bounds the texts' limits in them."""
    if len(units) > PIECE:
        parts = []
        for i in range(len(bounds) - 1):
            for a in range(int(bounds[i]), max(int(bounds[i]) + 1, int(bounds[i + 1]) - window + 1), PIECE - window + 1):
                b = min(a + PIECE, int(bounds[i + 1]))
                got = _blocks(units[a:b], np.array([0, b - a]), window, gram)
                got.text += i
                got.start += a - int(bounds[i])
                parts.append(got)
        # pieces overlap by window - 1 units: each window start belongs to one piece
        return Blocks(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("text", "start", "n", "anchor", "content"))) if parts else _empty()
    return _blocks(units, bounds, window, gram)


def _empty() -> Blocks:
    return Blocks(*(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)))


def _blocks(units: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Blocks:
    n = len(units)
    if n < window:
        return _empty()
    at = np.arange(n - gram + 1)
    ranges = RangeHash(units)
    hashes = ranges.loose(at, at + gram)  # anchors only bring windows together
    place = _minimum_places(hashes, window - gram + 1)
    lengths = np.diff(bounds)
    valid = np.zeros(n + 1, np.int32)  # +1 where a text's windows begin, -1 behind them
    long = lengths >= window
    np.add.at(valid, bounds[:-1][long], 1)
    np.add.at(valid, bounds[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: len(place)]) > 0)
    if not len(starts):
        return _empty()
    mine = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(starts)))
    first = starts[head]
    text = np.searchsorted(bounds, first, "right") - 1
    anchor = hashes[mine[head]]
    content = ranges.of(first, first + size + (window - 1)) ^ ((mine[head] - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Blocks(text, first - bounds[text], size, anchor, content)


def repeated_blocks(occurrences: DataFrame) -> DataFrame:
    """occurrences (anchor, content, doc_id, start, n) -> rows of anchors that occur twice or more.

    Anchors are counted with partial aggregation on one long a row; only rows of repeated anchors
    take part in what follows.
    """
    counted = occurrences.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("anchor")
    # written first: the join then has plain exchanges, and a hot anchor's rows can be split
    return occurrences.join(materialize(counted, "anchors"), "anchor", "left_semi")


def judged_blocks(rows: DataFrame) -> DataFrame:
    """rows (anchor, content, doc_id, start, n) -> the same with `first` and `first_start` (smallest doc_id
    with this content, and where it has it) and `contents` (how many the anchor has: with two, windows may
    repeat across them).

    The contents are judged and written first; the rows then meet them in a plain join, whose large
    partitions can be split.
    """
    firsts = rows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start")).alias("least"))
    firsts = firsts.select("anchor", "content", F.col("least.doc_id").alias("first"), F.col("least.start").alias("first_start"))
    counts = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents"))
    return rows.join(materialize(firsts.join(counts, "anchor"), "contents"), ["anchor", "content"])
