"""Token ids in files: frequency-ranked ids, byte-aligned variable-length codes, separate control bytes.

File format. A token file is a Parquet table of blocks with a folder for each shard; shards are ascending
ranges of documents, and the files of a shard hold its blocks by ascending offset (if a shard has several
files, each has a part of its blocks, told by the offsets). Spark's commit protocol writes it, so lost tasks
leave no half file. Each block holds whole documents:

- `doc_ids`, `counts`: the documents and their numbers of ids,
- `control`: two bits an id, four ids a byte, low bits first: bytes of the code less one,
- `data`: the codes, little-endian, 1 to 4 bytes each, where a code is the id's rank by frequency
  (0 for the most frequent), so that most ids take one byte,
- `shard`, `offset`: the shard of the block and the number of ids before it in the shard.

Beside it `ranks` lists the ids by rank (at most one row an id of the vocabulary).
Decoding looks control bytes up in a table of lengths and gathers codes with numpy.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relative_parse import _documents
from .store import arrow_batches, drop, materialize, new_path
from .text import Lookup, Texts, range_hashes, steps, trimmed

#: Bytes of the four codes that a control byte announces.
LENGTHS = np.array([[((c >> s) & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
#: Documents and ids that a block holds at most; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_IDS = 512, 1 << 19
#: Chunks that a worker remembers; it forgets all of them beyond.
REMEMBERED = 1 << 19
#: Second hash of a chunk, compared whenever the first is found.
MARK = 0x2545F491
#: Documents that a task holds at once.
AT_ONCE = 2048
#: Bytes that, after a space, certainly begin a visible character: no control, no white space, and none
#: of the lead bytes C2, E1, E2 and E3 that white space beyond ASCII has.
STARTS = np.zeros(256, bool)
STARTS[0x21:] = True
STARTS[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def pack(codes: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit codes."""
    codes = codes.astype("<u4")
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = codes.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n codes of (control, data)."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


class ChunkEncoder:
    """Encodes texts by their chunks between spaces, each chunk once.

    A byte-level pre-tokenizer starts anew at a space that a visible character follows, so chunks cut
    there are encoded alike wherever they stand. Chunks are found and hashed with numpy; only chunks that
    a worker has not met, or has forgotten, reach the tokenizer, many in one string that is cut by the
    byte lengths of its ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.keys = self.marks = np.zeros(0, np.uint64)
        self.old, self.new = Lookup(self.keys), Lookup(self.keys)
        self.settled = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        places = self.old.find(keys)
        left = np.flatnonzero(places < 0)
        more = self.new.find(keys[left])
        places[left] = np.where(more >= 0, more + self.settled, -1)
        return places

    def _learn(self, keys: np.ndarray, marks: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> None:
        """New chunks, heads of texts last (they begin without a space, so each is encoded alone)."""
        order = np.argsort(head, kind="stable")
        keys, marks, start, end, head = keys[order], marks[order], start[order], end[order], head[order]
        self.marks = np.concatenate([self.marks, marks])
        n = int((~head).sum())
        runs = [_gathered(data, start[i : min(n, i + 256)], end[i : min(n, i + 256)]) for i in range(0, n, 256)]
        runs += [_gathered(data, start[i : i + 1], end[i : i + 1]) for i in range(n, len(keys))]
        # some at a time: what the tokenizer returns takes a hundred times the text
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for i in range(0, len(runs), 32) for e in self.tokenizer.encode_batch_fast(runs[i : i + 32], add_special_tokens=False)])
        cuts = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(end - start)) + 1
        self.first = np.concatenate([self.first, self.first[-1] + cuts])
        self.ids, self.keys = np.concatenate([self.ids, ids]), np.concatenate([self.keys, keys])
        if len(self.keys) > 2 * self.settled:  # rarely: the large table is built anew
            self.settled, self.old, self.new = len(self.keys), Lookup(self.keys), Lookup(self.keys[:0])
        else:
            self.new = Lookup(self.keys[self.settled :])

    def _places(self, keys: np.ndarray, marks: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Where each chunk is remembered; those that aren't are encoded."""
        places = self._find(keys)
        if (missing := np.flatnonzero(places < 0)).size:
            new, one = np.unique(keys[missing], return_index=True)
            one = missing[one]
            self._learn(new, marks[one], data, start[one], end[one], head[one])
            places[missing] = self._find(keys[missing])
        return places

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids by text)."""
        if len(self.keys) > REMEMBERED:
            self._forget()
        data, bounds = texts.data, texts.bounds
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & STARTS[data[1:]] if len(data) > 1 else False
        inner = bounds[1:-1]
        cut[inner[inner > 0] - 1] = False  # a text's final space starts nothing
        heads = bounds[:-1][np.diff(bounds) > 0]
        cut[heads] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))[: len(start)]
        head = np.zeros(len(data) + 1, bool)
        head[heads] = True
        head = head[start]
        # a head without a space differs from nothing else: its bytes differ from those of inner chunks
        keys, marks = range_hashes(data, start, end), range_hashes(data, start, end, MARK)
        places = self._places(keys, marks, data, start, end, head)
        if (self.marks[places] != marks).any():  # chunks with one key: both hashes tell them apart
            self._forget()
            places = self._places(keys ^ (marks * np.uint64(0xD6E8FEB86659FD93)), marks, data, start, end, head)
        counts = self.first[places + 1] - self.first[places]
        ends = np.cumsum(counts)
        source = np.arange(int(counts.sum())) + np.repeat(self.first[places] - (ends - counts), counts)
        by_text = np.searchsorted(start, bounds)
        return self.ids[source], np.diff(np.append(0, ends)[by_text])


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    n = end - start
    at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
    return data[at].tobytes().decode("utf-8")


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


RAW = "doc_id long, shard int, offset long, n int, ids binary"


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Documents in ascending order with their ids: shard, ids before it in the shard, number, ids as 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for batch in batches:
            for part in steps(batch.column("text")):
                ids, counts = own.encode(part)
                ends = np.cumsum(counts + 1)
                whole = np.full(int(ends[-1]), end_id, "<u4")
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                rows = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), pa.array(np.full(len(counts), shard), pa.int32()), pa.array(before + ends - counts - 1, pa.int64()), pa.array(counts + 1, pa.int32()), rows.cast(pa.binary())], ["doc_id", "shard", "offset", "n", "ids"])
                before += int(ends[-1])

    ordered = docs.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(trimmed(run), RAW)


def _binary(column: pa.Array, dtype: str) -> np.ndarray:
    """All values of a binary column end to end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view(dtype) if data is not None and len(column) else np.zeros(0, dtype)


def ranked(raw: DataFrame) -> list[int]:
    """Ids by falling frequency, then id. Collected: at most one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            counts = np.bincount(_binary(batch.column(0), "<u4"))
            if len(counts) > len(total):
                counts, total = total, counts
            total[: len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int64), "times": total[used].astype(np.int64)})

    rows = raw.select("ids").mapInArrow(trimmed(run), "id long, times long").groupBy("id").agg(F.sum("times").alias("times")).collect()
    return [r["id"] for r in sorted(rows, key=lambda r: (-r["times"], r["id"]))]


BLOCK = "shard int, offset long, doc_ids array<long>, counts array<int>, control binary, data binary"


@dataclass
class TokenFiles:
    """Where a written corpus is: paths of the blocks and of the ranks."""

    blocks: str
    ranks: str


def write(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every text, append `end_id` and write the ids in ascending order of the ids.

    Null texts are empty: their only id is the end id. Rows with a null id come first; rows with equal
    ids are ordered by a hash of their texts. Empty tables give files without blocks.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    with arrow_batches(spark, AT_ONCE):
        raw = materialize(encoded(_documents(docs, id_col, text_col), tokenizer_path, end_id), "raw-ids", compression="zstd")
    with arrow_batches(spark, AT_ONCE):
        order = ranked(raw)
    rank_of = np.zeros(max(order, default=0) + 1, np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)  # four bytes for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, n = batch.column("shard").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            codes = shared.value[_binary(batch.column("ids"), "<u4")]
            ends = np.cumsum(n)
            a = 0
            while a < len(n):
                b = max(a + 1, min(a + BLOCK_DOCS, int(np.searchsorted(shard, shard[a], "right")) if (np.diff(shard) >= 0).all() else a + 1, int(np.searchsorted(ends, ends[a] - n[a] + BLOCK_IDS, "right"))))
                control, data = pack(codes[ends[a] - n[a] : ends[b - 1]])
                yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int32()), batch.column("offset").slice(a, 1), pa.array([batch.column("doc_id").slice(a, b - a).to_pylist()], pa.list_(pa.int64())), pa.array([n[a:b]], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "offset", "doc_ids", "counts", "control", "data"])
                a = b

    files = TokenFiles(f"{path}/blocks", f"{path}/ranks")
    spark.createDataFrame([(order,)], "ids array<long>").write.parquet(files.ranks)
    with arrow_batches(spark, AT_ONCE):
        packed = raw.mapInArrow(trimmed(run), BLOCK).sortWithinPartitions("shard", "offset")
        packed.write.option("compression", "zstd").partitionBy("shard").parquet(files.blocks)
    drop(raw)
    return files


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Documents decoded from the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    ranks = spark.read.parquet(files.ranks).first()["ids"]
    shared = spark.sparkContext.broadcast(np.array(ranks, "<u4"))
    blocks = spark.read.schema(BLOCK).parquet(files.blocks)
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("ids"))
    # one row a shard: as many as the writing job had tasks
    shift = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shift"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i] for k in ("doc_ids", "counts", "control", "data", "offset", "shift")}
                n = row["counts"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = shared.value[unpack(row["control"].as_py(), row["data"].as_py(), int(n.sum()))]
                ends = np.cumsum(n)
                start = row["offset"].as_py() + row["shift"].as_py() + ends - n
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([ids[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.join(F.broadcast(shift), "shard").mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "start", "n_tokens")), sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
