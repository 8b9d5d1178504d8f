"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to `order` bytes. At each context the seen symbols share the
mass by count less one half, and the rest is the escape to the next shorter context (method D). On
escape the symbols seen in the longer context are excluded from the shorter one. A text is lower-cased
(A-Z), begins in a context of end symbols and ends with one, so code lengths of all texts add up to one
probability distribution.

Nothing is pruned, and no task holds the whole trie. A number packs a context and a symbol; words have
numbers too. Documents are packed in runs of some megabytes, and each run lists its distinct numbers with
their training counts once (`listed`). Spark adds these up (`counts`). All contexts that end in the same
three bytes meet in one task, which costs their numbers (`costs`); contexts up to two bytes have at most
2**24 numbers, which is the bound of what every task gets. The costs then go back to the runs that
listed them by a join, but those of the most frequent numbers (`core`, of a fixed size) are broadcast to
save the trip: all others are joined, whatever their count. A run with its costs is scored by look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relative_parse import _documents
from .store import materialize
from .text import Lookup, Texts, signed, steps, trimmed, word_hashes, words

END = 0xFF  # no byte of UTF-8
ORDER = 5
#: Contexts up to so many bytes are sent to every task: at most 2**(8 * (SHORT + 1)) numbers.
SHORT = 2
#: Most frequent numbers of either kind whose costs are broadcast; the costs of all others are joined.
CORE = 1 << 19
#: Bytes of text that a run holds about; a longer document is a run of its own.
RUN_BYTES = 1 << 25
#: Different numbers that a counter holds before it merges them, and that a costing step holds about.
HELD = 1 << 20
#: Words have the sign bit, which numbers of contexts never have; the end token has all bits.
WORD, LAST = np.uint64(1 << 63), np.uint64((1 << 64) - 1)


def packed(texts: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, first): for every byte and end of every text the last order + 1 bytes as one number;
    those of text i are first[i]:first[i + 1]."""
    n = np.diff(texts.bounds)
    first = np.append(0, np.cumsum(n + 1))
    whole = np.full(len(texts.data) + len(texts) * (order + 1), END, np.uint8)
    if len(texts.data):
        whole[np.arange(len(texts.data)) + np.repeat(np.arange(len(texts)) * (order + 1) + order, n)] = texts.data
    code = np.zeros(len(whole) - order, np.uint64)
    for k in range(order + 1):
        code <<= np.uint64(8)
        code |= whole[k : len(whole) - order + k]
    # codes that end in a text's padding belong to no place
    wanted = np.arange(int(first[-1])) + np.repeat(np.arange(len(texts)) * order, n + 1)
    return code[wanted], first


def _distinct(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values with their counts, or summed counts."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values)
        values, counts = values[order], counts[order]
    head = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    if counts is None:
        return values[head], np.diff(np.append(head, len(values)))
    return values[head], np.add.reduceat(counts, head) if len(head) else counts


class _Counter:
    """Distinct numbers with their counts."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray, counts: bool) -> None:
        values, times = _distinct(values)
        self.parts.append((values, times if counts else np.zeros(len(times), np.int64)))
        self.size += len(values)
        if self.size > HELD:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0]) // 2  # merging pays once the parts have doubled

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        return _distinct(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def word_numbers(hashes: np.ndarray) -> np.ndarray:
    return np.minimum(hashes | WORD, LAST - np.uint64(1))


LISTED = "run long, value long, times long, packed binary"


def listed(docs: DataFrame, order: int) -> DataFrame:
    """docs (doc_id, text, learnt) -> for each run its distinct numbers with their training counts, and one
    row with its documents as a compressed Arrow stream."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def flushed(run: int, held: list[pa.RecordBatch], numbers: _Counter) -> Iterator[pa.RecordBatch]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for batch in held:
                stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["run", "value", "times", "packed"])
        values, times = numbers.merged()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), run)), pa.array(signed(values)), pa.array(times), pa.nulls(len(values), pa.binary())], ["run", "value", "times", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size, numbers = TaskContext.get().partitionId() << 32, [], 0, _Counter()
        for batch in batches:
            for part in steps(batch.column("text")):
                low = part.lowered()
                learnt = batch.column("learnt").slice(part.first, len(part)).to_numpy(zero_copy_only=False)
                code, first = packed(low, order)
                found = words(low)
                tokens = np.concatenate([word_numbers(word_hashes(low, found)), np.full(len(part), LAST)])
                of = np.concatenate([found.text_of(), np.arange(len(part))])
                for yes in (True, False):
                    if (learnt == yes).any():
                        numbers.add(code[np.repeat(learnt == yes, np.diff(first))], yes)
                        numbers.add(tokens[learnt[of] == yes], yes)
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(part.bounds.astype(np.int64)), pa.py_buffer(part.data))
                held.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, len(part)), texts.cast(pa.string())], schema=kind))
                size += len(part.data)
                if size > RUN_BYTES:
                    yield from flushed(name, held, numbers)
                    name, held, size, numbers = name + 1, [], 0, _Counter()
        if held:
            yield from flushed(name, held, numbers)

    return docs.select("doc_id", "text", "learnt").mapInArrow(trimmed(run), LISTED)


@dataclass
class Level:
    """Contexts of one length: nodes (context and symbol) with counts, contexts with their figures."""

    nodes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray  # occurrences of the context
    distinct: np.ndarray  # symbols seen there
    below: np.ndarray  # what these symbols count in the next shorter context


def level(j: int, nodes: np.ndarray, counts: np.ndarray, shorter: Level | None) -> Level:
    """Level of contexts of j bytes, from all their nodes in ascending order, and the level before it."""
    context, counts = nodes >> np.uint64(8), counts.astype(np.float64)
    head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(nodes) else np.zeros(0, np.int64)
    total, below = np.zeros(0), np.zeros(len(head))
    if len(head):
        total = np.add.reduceat(counts, head)
        if shorter is not None:  # every node has its shorter one: that was counted as often at least
            below = np.add.reduceat(shorter.counts[np.searchsorted(shorter.nodes, nodes & np.uint64((1 << 8 * j) - 1))], head)
    return Level(nodes, counts, context[head], total, np.diff(np.append(head, len(nodes))).astype(np.float64), below)


class Model:
    """Successive levels, from the context of no bytes on, ready to cost numbers."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels
        self.nodes = [Lookup(x.nodes) for x in levels]
        self.contexts = [Lookup(x.contexts) for x in levels]

    def cost(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each packed number after the others."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        # what the longer context excludes: mass and number of symbols
        mass, symbols = np.zeros(len(code)), np.zeros(len(code))
        for j in range(len(self.levels) - 1, -1, -1):
            own = self.levels[j]
            if not len(own.nodes):
                continue
            key = code[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            place, where = self.nodes[j].find(key), self.contexts[j].find(key >> np.uint64(8))
            known = where >= 0
            total = np.where(known, own.total[where] - mass, 0.0)
            fresh = np.where(known, own.distinct[where] - symbols, 0.0)
            usable = known & (total > 0)
            hit = (place >= 0) & usable
            out[left[hit]] += np.log10((own.counts[place[hit]] - 0.5) / total[hit])
            escaped = usable & ~hit
            out[left[escaped]] += np.log10(0.5 * fresh[escaped] / total[escaped])
            rest = ~hit
            mass, symbols = np.where(known, own.below[where], mass)[rest], np.where(known, own.distinct[where], symbols)[rest]
            left = left[rest]
        # nothing knows the symbol: those never seen share what is left evenly
        out[left] -= np.log10(np.maximum(256 - symbols, 1))
        return out


def _summed(values: np.ndarray, times: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of contexts of j bytes from those of longer ones."""
    return _distinct(values & np.uint64((1 << 8 * (j + 1)) - 1), times)


def short_levels(counts: DataFrame, order: int) -> list[Level]:
    """Levels of contexts up to SHORT bytes: at most 2**(8 * (SHORT + 1)) rows come to the driver."""
    top = min(order, SHORT)
    rows = counts.filter("times > 0").groupBy(F.col("value").bitwiseAND(F.lit((1 << 8 * (top + 1)) - 1)).alias("value")).agg(F.sum("times").alias("times")).toArrow()
    values, times = rows["value"].to_numpy().astype(np.uint64), rows["times"].to_numpy()
    out: list[Level] = []
    for j in range(top + 1):
        out.append(level(j, *_summed(values, times, j), out[-1] if out else None))
    return out


def costs(counts: DataFrame, order: int) -> DataFrame:
    """counts (value, times) of numbers -> (value, times, cost). Numbers whose contexts end alike meet in one task,
    which costs some at a time; numbers with times 0 are only asked."""
    shared = counts.sparkSession.sparkContext.broadcast(short_levels(counts, order))

    def solve(values: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        own = list(shared.value)
        seen = times > 0
        for j in range(len(own), order + 1):
            own.append(level(j, *_summed(values[seen], times[seen], j), own[-1]))
        return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(times), pa.array(Model(own).cost(values))], ["value", "times", "cost"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("value").to_numpy().astype(np.uint64), batch.column("times").to_numpy(), batch.column("ending").to_numpy()))
            if sum(len(h[0]) for h in held) >= HELD:
                value, times, ending = (np.concatenate([h[k] for h in held]) for k in range(3))
                cut = int(np.searchsorted(ending, ending[-1]))  # the last ending may go on
                if cut:
                    yield solve(value[:cut], times[:cut])
                held = [(value[cut:], times[cut:], ending[cut:])]
        if held:
            yield solve(*(np.concatenate([h[k] for h in held]) for k in range(2)))

    ending = F.shiftrightunsigned("value", 8).bitwiseAND(F.lit((1 << 8 * (SHORT + 1)) - 1))
    rows = counts.withColumn("ending", ending).repartition("ending").sortWithinPartitions("ending")
    return rows.mapInArrow(trimmed(run), "value long, times long, cost double")


def most_frequent(table: DataFrame, most: int) -> int:
    """Least bound, of 2**(k / 8) rounded down, so that at most `most` rows have times beyond it."""
    step = F.when(F.col("times") > 0, F.ceil(8 * F.log2("times"))).otherwise(-1).alias("step")  # some 500 rows
    above = 0
    for r in sorted(table.groupBy(step).count().collect(), key=lambda r: -r["step"]):
        above += r["count"]
        if above > most:
            return int(2 ** (r["step"] / 8))
    return -1


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


class _Costs:
    """Costs by number; look-ups are built where they are used."""

    def __init__(self, values: np.ndarray, cost: np.ndarray) -> None:
        self.values, self.cost, self.places = values, cost, None

    def __getstate__(self) -> tuple:
        return self.values, self.cost

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, whether the number is here)."""
        self.places = self.places or Lookup(self.values)
        at = self.places.find(values)
        return self.cost[at] if len(self.cost) else np.zeros(len(at)), at >= 0


def score(docs: DataFrame, order: int = ORDER, core: int = CORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Code length of every document under a model of those that aren't held out.

    Returns doc_id, held_out (crc32 of the id as text mod 7 is 2), n_tokens (words and one end), n_known
    (tokens seen in training), train_tokens, base_score (add-one unigram log10 probability of the tokens)
    and score (log10 probability of the lower-cased text under the model). `core` doesn't change results.

    Null texts are empty: one end token, and the cost of the end symbol. A null id isn't held out.
    Repeated rows are scored and counted as often as they come. Without training rows every symbol
    costs 1/256. An empty table gives an empty result. Extra columns are ignored.
    """
    docs = _documents(docs, id_col, text_col).withColumn("learnt", ~held_out())
    runs = materialize(listed(docs, order), "runs")
    asked = runs.filter("packed is null").select("run", "value", "times")
    counts = materialize(asked.groupBy("value").agg(F.sum("times").alias("times")), "counts")
    tokens = counts.filter("value < 0")
    sums = tokens.agg(F.count_if(F.col("times") > 0).alias("v"), F.coalesce(F.sum("times"), F.lit(0)).alias("n")).first()
    train_tokens, size = int(sums["n"]), float(np.log10(sums["n"] + sums["v"] + 1))
    parts = [costs(counts.filter("value >= 0"), order), tokens.withColumn("cost", F.log10(F.col("times") + 1.0))]
    table = materialize(parts[0].unionByName(parts[1]), "costs")
    bounds = [most_frequent(table.filter(kind), core) for kind in ("value >= 0", "value < 0")]
    frequent = F.col("times") > F.when(F.col("value") >= 0, bounds[0]).otherwise(bounds[1])
    known = table.filter(frequent).select("value", "cost").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(_Costs(np.ascontiguousarray(known["value"].to_numpy()).view(np.uint64), known["cost"].to_numpy()))
    left = asked.select("run", "value").join(F.broadcast(table.filter(frequent).select("value")), "value", "left_anti")
    joined = left.join(table.filter(~frequent).select("value", "cost"), "value")

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        core, rest = shared.value, _Costs(np.ascontiguousarray(answers["value"].to_numpy()).view(np.uint64), answers["cost"].to_numpy())

        def found(values: np.ndarray) -> np.ndarray:
            cost, hit = core.find(values)
            miss = np.flatnonzero(~hit)
            cost[miss], hit = rest.find(values[miss])
            if not hit.all():
                raise RuntimeError("a run asks for a number that it did not list")
            return cost

        out = []
        for row in texts["packed"]:
            for batch in pa.ipc.open_stream(row.as_buffer()):
                for part in steps(batch.column(1)):
                    low = part.lowered()
                    words_in = words(low)
                    logs = found(word_numbers(word_hashes(low, words_in)))
                    end = found(np.array([LAST]))[0]
                    of = words_in.text_of()
                    n_known = np.bincount(of[logs > 0], minlength=len(part)) + (end > 0)
                    logged = np.bincount(of, weights=logs, minlength=len(part)) + end
                    code, first = packed(low, order)
                    whole = np.add.reduceat(found(code), first[:-1])
                    out.append(pa.table([batch.column(0).slice(part.first, len(part)), pa.array(words_in.counts + 1), pa.array(n_known), pa.array(logged), pa.array(whole)], names=["doc_id", "n_tokens", "n_known", "logged", "score"]))
        return pa.concat_tables(out)

    docs_of = runs.filter("packed is not null").select(F.col("run").alias("own"), "packed").groupBy("own")
    scored = docs_of.cogroup(joined.groupBy("run")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, logged double, score double")
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logged") - F.col("n_tokens") * size).alias("base_score"), "score",
    )
