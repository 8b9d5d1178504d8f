"""Substring dedup by relative Lempel-Ziv parsing, in words.

The reference is the corpus itself, cut into content-defined blocks (see anchors.py). The index has one
entry for each content: the smallest document that holds it, and where. Every block of every document
is looked up in it; a hit in a smaller document is a phrase (place, length, reference document, reference
place). Where a phrase ends inside a block, the block shares its anchor with reference blocks but not its
content; the windows across such boundaries are indexed and looked up one by one, so that no repeated
window is missed. A document is then factored greedily from its first word on: phrases that go on in the
same reference are joined, and of those that cover the next word the one that reaches farthest becomes the
factor; words that no phrase covers are literals. Words of factors are removed: every phrase has at least
`window` words.

No step holds a group in one task: contents and windows are counted by partial aggregation (the smallest
document each), and the joins back are plain equi-joins that AQE can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import blocks, judged_blocks, repeated_blocks
from .store import materialize
from .text import signed, steps, trimmed, window_hashes, word_hashes, words

GRAM = 12
#: `name` is a hash of the text: documents that share an id are told apart by it.
OCCURRENCES = "anchor long, content long, doc_id long, name long, start int, n int"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def named(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with `name`. Rows of one id and text are alike in everything."""
    return docs.withColumn("name", F.xxhash64("text"))


def merge_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as maximal ones, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    head = np.flatnonzero(new)
    return start[head], end[np.append(head[1:] - 1, len(start) - 1)]


def word_occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """One row for every block of every document; needs columns doc_id, name and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "name"))
            for part in steps(batch.column("text")):
                found = words(part)
                got = blocks(word_hashes(part, found), found.first, window, gram)
                yield pa.RecordBatch.from_pydict({"anchor": signed(got.anchor), "content": signed(got.content), "doc_id": ids[part.first + got.text].astype(np.int64), "name": names[part.first + got.text].astype(np.int64), "start": got.start.astype(np.int32), "n": got.n.astype(np.int32)})

    return docs.mapInArrow(trimmed(run), OCCURRENCES)


def _boundary_windows(texts: DataFrame, window: int) -> DataFrame:
    """texts (doc_id, name, text, at: array of start, n, anchor) -> a row for each listed window with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, at = *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "name")), batch.column("at")
            for part in steps(batch.column("text")):
                found = words(part)
                hashes = window_hashes(word_hashes(part, found), window)
                listed = at.slice(part.first, len(part))
                flat = listed.flatten()
                start, n, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                text = np.repeat(np.arange(len(part)), listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                which = np.repeat(np.arange(len(n)), n)
                first = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                base = found.first[text[which]] + first
                yield pa.RecordBatch.from_pydict({"anchor": anchor[which].astype(np.int64), "content": signed(hashes[base]), "doc_id": ids[part.first + text[which]].astype(np.int64), "name": names[part.first + text[which]].astype(np.int64), "start": first.astype(np.int32), "n": np.ones(len(which), np.int32)})

    return texts.mapInArrow(trimmed(run), OCCURRENCES)


PHRASES = "array<struct<start:int,end:int,ref_doc:long,ref_start:int>>"


def phrases(docs: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """(doc_id, name, start, n, ref_doc, ref_start): runs of n windows from word `start` on that also start in the
    smaller document ref_doc, at its word ref_start."""
    rows = materialize(repeated_blocks(word_occurrences(docs, window, gram)), "blocks")
    judged = materialize(judged_blocks(rows), "judged")
    columns = ["doc_id", "name", "start", "n", F.col("first").alias("ref_doc"), F.col("first_start").alias("ref_start")]
    found = judged.filter("doc_id > first").select(*columns)
    edges = judged.filter("doc_id = first and contents > 1").groupBy("doc_id", "name").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("at"))
    windows = materialize(_boundary_windows(docs.join(edges, ["doc_id", "name"]), window), "windows")
    index = windows.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.max("doc_id").alias("last")).filter("least.doc_id < last")
    index = index.select("anchor", "content", F.col("least.doc_id").alias("first"), F.col("least.start").alias("first_start"))
    return found.unionByName(windows.join(index, ["anchor", "content"]).filter("doc_id > first").select(*columns))


def factored(start: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, window: int) -> list[dict[str, int]]:
    """Greedy factors, in order and disjoint, of a document with these phrases."""
    shift = ref_start - start
    order = np.lexsort((start, shift, ref_doc))
    start, end, ref_doc, shift = start[order], (start + n + (window - 1))[order], ref_doc[order], shift[order]
    # phrases that meet in the same reference at the same distance are one
    new = np.ones(len(start), bool)
    new[1:] = (ref_doc[1:] != ref_doc[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(end, head) if len(head) else end
    start, ref_doc, shift = start[head], ref_doc[head], shift[head]
    out, done, best = [], 0, -1
    by = np.argsort(start, kind="stable").tolist()
    i = 0
    while i < len(by) or best >= 0:
        while i < len(by) and start[by[i]] <= done:
            best = by[i] if best < 0 or end[by[i]] > end[best] else best
            i += 1
        if best >= 0 and end[best] > done:
            out.append({"start": int(done), "end": int(end[best]), "ref_doc": int(ref_doc[best]), "ref_start": int(done + shift[best])})
            done, best = int(end[best]), -1
        elif i < len(by):
            done, best = int(start[by[i]]), -1
        else:
            break
    return out


def parse(docs: DataFrame, window: int = 50, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Factors and what is left of every document.

    Returns one row per document: doc_id, n_words, n_removed, factors (array of word ranges start, end with
    the reference document ref_doc and the word ref_start where it has them), kept (the kept words joined by
    one space) and kept_sha256.

    Null or empty texts have no words; a text shorter than `window` keeps all its words. Of repeated
    rows (same doc_id and text) none counts as smaller than the other, nor of different texts that share a
    doc_id; each of these keeps its own words. Rows with a null id are judged against no other and removed
    from nothing. Extra columns are ignored.
    """
    docs = named(_documents(docs, id_col, text_col))
    found = phrases(docs.filter("doc_id is not null"), window, gram).groupBy("doc_id", "name").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("at"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column("doc_id"), batch.column("text").cast(pa.binary()).fill_null(b""), batch.column("at")
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "factors", "kept", "kept_sha256")}
            for i, text in enumerate(texts):
                own = text.as_py().split()  # bytes.split() cuts at 0x20 and 0x09-0x0D only
                factors = factored(*(at[i].values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)), window) if at[i].is_valid else []
                left, a = [], 0
                for f in factors:
                    left += own[a : f["start"]]
                    a = f["end"]
                kept = b" ".join(left + own[a:])
                for k, v in zip(out, (len(own), sum(f["end"] - f["start"] for f in factors), factors, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["factors"], kind), pa.array(out["kept"], pa.string()), pa.array(out["kept_sha256"], pa.string())], ["doc_id", *out])

    return docs.join(found, ["doc_id", "name"], "left").mapInArrow(trimmed(run), f"doc_id long, n_words long, n_removed long, factors {PHRASES}, kept string, kept_sha256 string")
