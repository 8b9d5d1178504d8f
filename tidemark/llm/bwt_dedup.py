"""Substring dedup in bytes: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A corpus has too many bytes for one suffix array, so candidate text is first gathered by content:
byte blocks (see anchors.py) whose anchor occurs once hold no repeat and are dropped, and a block
that repeats an earlier block whole is covered at once. What is left, the distinct blocks that share
an anchor, meets by anchor in bounded pieces. For each piece the transform is built and common
prefixes of its suffixes are derived breadth first, by increasing length, each step extending all
intervals backward by one byte; the expansion stops at the minimum length, and places without a
common prefix by then share at least that many bytes.

An anchor with more than `hot` distinct blocks isn't gathered: its windows are compared as rows, by
hash and bytes, with partial aggregation, which no group size can hurt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Blocks, blocks, judged_blocks, repeated_blocks
from .relative_parse import OCCURRENCES, _documents, merge_ranges, named
from .store import drop, materialize
from .text import signed, steps, trimmed

GRAM = 28
#: Distinct blocks of one anchor that are gathered; beyond it windows are compared as rows.
HOT = 4096
#: Bytes of candidate text under one transform, unless one anchor has more.
PIECE_BYTES = 1 << 20


def _once(got: Blocks) -> np.ndarray:
    """True for blocks that don't repeat an earlier block of their own text."""
    order = np.lexsort((got.start, got.content, got.anchor, got.text))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (got.text[a] != got.text[b]) | (got.anchor[a] != got.anchor[b]) | (got.content[a] != got.content[b])
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def byte_occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row for each block of each document; `again` if it repeats an earlier block of the document whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = batch.column("doc_id"), batch.column("name")
            for part in steps(batch.column("text")):
                got = blocks(part.data, part.bounds, window, gram)
                place = pa.array(part.first + got.text)
                yield pa.RecordBatch.from_pydict({"anchor": signed(got.anchor), "content": signed(got.content), "doc_id": ids.take(place), "name": names.take(place), "start": got.start.astype(np.int32), "n": got.n.astype(np.int32), "again": ~_once(got)})

    return docs.mapInArrow(trimmed(run), f"{OCCURRENCES}, again boolean")


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes ordered by at least their first `length` symbols: prefix doubling from 4 symbols on."""
    n = len(symbols)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = symbols
    key = (padded[:n] << 27) | (padded[1 : n + 1] << 18) | (padded[2 : n + 2] << 9) | padded[3 : n + 3]
    have = 4
    while True:
        order = np.argsort(key)  # ties are equal beyond the length that counts
        if have >= length:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - have] = rank[have:] + 1
        key = rank * (n + 1) + ahead
        have *= 2


def common_prefix_breaks(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at k if suffixes k-1 and k of the order share fewer than `length` symbols.

    Level by level: an interval of suffixes with a common prefix of l symbols, found at level l,
    sets the common prefix at its right end unless a shorter one was set there; only such intervals
    are extended backward, so every place is set once.
    """
    n = len(symbols)
    last = symbols[order - 1]  # the transform; position 0 wraps to the final separator
    column = np.argsort(last.astype(np.uint16), kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    step[column] = np.arange(n)
    lead = last[column]  # first symbols of the suffixes in order
    keys = lead * n + column  # ascending: places by (symbol, place of the rest)
    alphabet = np.unique(last)
    broken = np.zeros(n + 1, bool)
    broken[0] = broken[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        wide = np.flatnonzero(size > 4 * len(alphabet))
        symbol = np.tile(alphabet, len(wide))
        lefts = [np.searchsorted(keys, symbol * n + np.repeat(low[wide], len(alphabet)))]
        rights = [np.searchsorted(keys, symbol * n + np.repeat(high[wide], len(alphabet)))]
        narrow = np.flatnonzero(size <= 4 * len(alphabet))
        low, size = low[narrow], size[narrow]
        ends = np.cumsum(size)
        # members of an interval with the same symbol before them step to successive places
        which = np.repeat(np.arange(len(low)), size)
        at = np.sort(which * n + step[np.arange(len(which)) + np.repeat(low - (ends - size), size)]) - which * n
        if len(at):
            head = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (lead[at[1:]] != lead[at[:-1]])))
            lefts.append(at[head])
            rights.append(at[np.append(head[1:], len(at)) - 1] + 1)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        # left ends are breaks already or become so with their neighbour's right end in this level
        fresh = (left < right) & ~broken[right]
        low, high = left[fresh], right[fresh]
        broken[high] = True
        if not len(low):
            break
    return broken[:n]


def repeated_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, window: int, name: np.ndarray | None = None) -> np.ndarray:
    """(place, text) of all windows of the given blocks which a smaller doc has, or the same document earlier.

    Documents are told apart by doc and name; of those that share a doc none is smaller.
    """
    name = np.zeros(len(doc), np.int64) if name is None else name
    lengths = np.array([len(t) for t in texts])
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    first = np.cumsum(lengths + 1) - (lengths + 1)
    symbols[first + lengths] = 0
    order = suffix_order(symbols, window)
    group = np.cumsum(common_prefix_breaks(symbols, order, window))
    text = np.repeat(np.arange(len(texts)), lengths + 1)[order]
    offset = order - first[text]
    whole = np.flatnonzero(offset + window <= lengths[text])
    group, text, offset = group[whole], text[whole], offset[whole]
    place = start[text] + offset
    by = np.lexsort((place, name[text], doc[text], group))
    changed = lambda *keys: np.flatnonzero(np.append(True, np.any([k[by[1:]] != k[by[:-1]] for k in keys], axis=0))) if len(by) else np.zeros(0, np.int64)
    least = lambda head: by[np.repeat(head, np.diff(np.append(head, len(by))))]
    first, own = least(changed(group)), least(changed(group, doc[text], name[text]))
    # a place is later only than a different one
    later = (doc[text[by]] != doc[text[first]]) | (place[by] != place[own])
    return np.stack([offset[by[later]], text[by[later]]])


def _block_texts(docs: DataFrame, listed: DataFrame, window: int) -> DataFrame:
    """listed (doc_id, name, start, n, anchor, hot) -> the bytes of each block."""
    at = listed.groupBy("doc_id", "name").agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").cast(pa.binary()), batch.column("at")
            for i, (doc_id, name) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("name").to_pylist(), strict=True)):
                text, flat = texts[i].as_py(), at[i].values
                start, n, anchor, hot = (flat.field(k).to_pylist() for k in range(4))
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "doc_id": [doc_id] * len(n), "name": [name] * len(n), "start": pa.array(start, pa.int32()), "hot": hot, "part": [text[a : a + k + window - 1] for a, k in zip(start, n, strict=True)]})

    return docs.join(at, ["doc_id", "name"]).mapInArrow(trimmed(run), "anchor long, doc_id long, name long, start int, hot boolean, part binary")


def _expanded(parts: DataFrame, window: int, tasks: int) -> DataFrame:
    """Repeated windows among gathered blocks: anchors meet in tasks, a bounded piece at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        doc, name, start = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        offset, text = repeated_windows([r[3] for r in rows], doc, start, window, name)
        return pa.RecordBatch.from_pydict({"doc_id": doc[text], "name": name[text], "start": (start[text] + offset).astype(np.int32), "n": np.ones(len(text), np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for anchor, doc_id, name, start, part in zip(*(batch.column(k).to_pylist() for k in ("anchor", "doc_id", "name", "start", "part")), strict=True):
                if size >= PIECE_BYTES and anchor != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((doc_id, name, start, part))
                size += len(part)
                last = anchor
        if rows:
            yield solve(rows)

    return parts.select("anchor", "doc_id", "name", "start", "part").repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(run), "doc_id long, name long, start int, n int")


def _compared(parts: DataFrame, window: int) -> DataFrame:
    """Repeated windows of blocks under hot anchors, a row for each window; exact for any group size."""
    at = F.explode(F.sequence(F.lit(0), F.length("part") - window))
    rows = parts.select("doc_id", "name", "start", "part", at.alias("offset"))
    # the substring is taken after the explode: positions count bytes of a binary column
    rows = rows.select("doc_id", "name", (F.col("start") + F.col("offset")).alias("start"), F.expr(f"substring(part, offset + 1, {window})").alias("bytes"))
    rows = rows.select("doc_id", "name", "start", F.sha2("bytes", 256).alias("content"))
    keys = ["content", "doc_id", "name"]
    own = rows.groupBy(*keys).agg(F.min("start").alias("own"), F.count(F.lit(1)).alias("times"))
    firsts = own.groupBy("content").agg(F.min("doc_id").alias("first"), F.sum("times").alias("all")).filter(F.col("all") > 1).drop("all")
    judged = materialize(own.join(firsts, "content").drop("times"), "windows")
    return rows.join(judged, keys).filter("doc_id > first or start > own").select("doc_id", "name", F.col("start").cast("int"), F.lit(1).alias("n"))


def repeated_ranges(docs: DataFrame, window: int, gram: int, hot: int = HOT) -> DataFrame:
    """(doc_id, name, start, n): runs of n windows from byte `start` that also start earlier, in a smaller document or
    in the same one. Texts are cut into blocks once, and the blocks written."""
    spark = docs.sparkSession
    every = materialize(byte_occurrences(docs, window, gram), "occurrences")
    own = materialize(every.filter("again").select("doc_id", "name", "start", "n"), "own")
    rows = materialize(repeated_blocks(every.filter("not again and doc_id is not null").drop("again")), "blocks")
    drop(every)
    judged = materialize(judged_blocks(rows), "judged")
    found = judged.filter("doc_id > first").select("doc_id", "name", "start", "n")
    edges = judged.filter("doc_id = first and contents > 1").withColumn("hot", F.col("contents") > hot)
    parts = materialize(_block_texts(docs, edges, window), "parts")
    cold = _expanded(parts.filter("not hot"), window, int(spark.conf.get("spark.sql.shuffle.partitions")))
    windows = materialize(cold.unionByName(_compared(parts.filter("hot"), window)), "windows")
    return own.unionByName(found).unionByName(windows)


def remove(docs: DataFrame, window: int = 100, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start. Returns one row per document:
    doc_id, n_bytes, n_removed, n_spans, spans (array of byte ranges), kept (binary) and kept_sha256.

    Null and empty texts have no bytes; texts under `window` bytes are kept whole. Repeated rows (same
    id and text) are judged alike, against other ids and themselves; different texts that share an id likewise,
    each with its own places. Rows with a null id are compared with none but themselves. Extra columns are ignored.
    """
    docs = named(_documents(docs, id_col, text_col))
    ranges = repeated_ranges(docs, window, gram).groupBy(F.col("doc_id").alias("known_id"), F.col("name").alias("known_name")).agg(F.collect_list(F.struct("start", "n")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, column = batch.column("doc_id"), batch.column("at"), batch.column("text")
            for part in steps(column):
                out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256")}
                for i in range(len(part)):
                    own = part.data[part.bounds[i] : part.bounds[i + 1]]
                    listed = at[part.first + i]
                    start, n = (listed.values.field(k).to_numpy(zero_copy_only=False) if listed.is_valid else np.zeros(0, np.int32) for k in range(2))
                    start, end = merge_ranges(start.astype(np.int64), (start + n + (window - 1)).astype(np.int64))
                    marks = np.zeros(len(own), bool)
                    for a, b in zip(start, end, strict=True):
                        marks[a:b] = True
                    kept = own[~marks].tobytes()
                    for k, v in zip(out, (len(own), int(marks.sum()), len(start), [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)], kept, hashlib.sha256(kept).hexdigest()), strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(part)), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    # null ids too: these rows have repeats of their own
    placed = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("name") == F.col("known_name")), "left").select("doc_id", "text", "at")
    return placed.mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
