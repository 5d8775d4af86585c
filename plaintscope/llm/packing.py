"""Documents packed into sequences of bounded size by vector best fit.

A piece needs three resources of a sequence: its tokens, one document place, and its attention
cost (the square of its tokens). All three follow from its length, so pieces of one length are
alike and the choice of bins runs over a histogram of lengths, which has a row a length at most:
longest pieces first, each into the open bin that is tightest for it under every constraint, and
bins in the same state are alike, too. The answer is a short table of runs ("pieces 100 to 250 of
length 31 go, four a sequence, to sequences 7000 onward, behind the first 880 tokens"). Each
piece finds its place by its number among the pieces of its length; these numbers are counted
task by task, so no length, however common, is numbered in one task.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plaintscope.llm.textarrays import pieces as text_pieces
from plaintscope.llm.word_units import coder_of
from plaintscope.session import checkpoint_dir, small_side

BATCH_PIECES = 2000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, attention cost. None is no limit."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> list[tuple[int, int]]:
        """(power of the length that a piece needs, capacity) of each resource that can run out.

        Every piece has a token at least, and a sum of squares is at most the square of the
        sum: so many documents, or so much attention, cannot run out before the tokens do.
        """
        if self.tokens < 1 or self.documents is not None and self.documents < 1 or self.attention is not None and self.attention < 1:
            raise ValueError("a sequence must hold one document of one token")
        found = [(1, self.tokens)]
        if self.documents is not None and self.documents < self.tokens:
            found.append((0, self.documents))
        if self.attention is not None and self.attention < self.tokens ** 2:
            found.append((2, self.attention))
        return found

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that fits in a sequence."""
        return min(self.tokens, math.isqrt(self.attention) if self.attention is not None else self.tokens)


@dataclass(frozen=True)
class Run:
    """Pieces `first` to `last` (excluded) of a length, `each` a sequence from `sequence` on, from place `offset` on."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def best_fit(counts: dict[int, int], capacity: Capacity, choose: str = "norm", weights: list[float] | None = None) -> tuple[list[Run], int]:
    """(runs, number of sequences) for so many pieces of each length.

    Pieces go, longest first, into the open bin that is tightest for them: of those with room in
    every resource, the one with the least weighted norm of what would be left ("norm") or the
    least weighted dot product of the need and what is left ("dot"). Once chosen, a bin takes
    pieces of this length while they fit. A resource weighs by the share of bins that it alone
    would need, unless `weights` (in order of `Capacity.limits`) says otherwise. Ties go to the
    bin that was opened first.
    """
    if choose not in ("norm", "dot"):
        raise ValueError(f"no such choice: {choose}")
    limits = capacity.limits()
    power, full = [p for p, _ in limits], np.array([c for _, c in limits], float)
    demand = [sum(n * length ** p for length, n in counts.items()) / c for p, c in limits]
    weight = np.array(weights if weights is not None else demand, float)
    open_bins: dict[tuple[int, ...], deque[tuple[int, int, int]]] = defaultdict(deque)  # what is left -> (sequence, bins, tokens so far)
    runs: list[Run] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        need = [length ** p for p in power]
        if any(n > c for n, (_, c) in zip(need, limits)):
            raise ValueError(f"a piece of {length} tokens fits in no sequence")
        placed, left = 0, counts[length]
        while left:
            state = _tightest(open_bins, need, full, weight, choose)
            if state is None:
                state = tuple(c for _, c in limits)
                fresh = -(-left // _times(state, need))
                open_bins[state].append((sequences, fresh, 0))
                sequences += fresh
            start, bins, used = open_bins[state].popleft()
            each = _times(state, need)
            filled = min(bins, left // each)
            taken = filled * each
            after = lambda k: tuple(r - k * n for r, n in zip(state, need))
            rest = bins - filled
            if filled:
                _keep(open_bins, after(each), (start, filled, used + each * length))
            if rest and 0 < left - taken:  # the last few share one more bin
                _keep(open_bins, after(left - taken), (start + filled, 1, used + (left - taken) * length))
                rest, taken = rest - 1, left
            if rest:
                open_bins[state].appendleft((start + bins - rest, rest, used))
            elif not open_bins[state]:
                del open_bins[state]
            runs.append(Run(length, placed, placed + taken, start, each, used))
            placed, left = placed + taken, left - taken
    return runs, sequences


def _times(state: tuple[int, ...], need: list[int]) -> int:
    return min(r // n for r, n in zip(state, need))


def _keep(open_bins: dict, state: tuple[int, ...], bins: tuple[int, int, int]) -> None:
    if min(state) > 0:
        open_bins[state].append(bins)


def _tightest(open_bins: dict, need: list[int], full: np.ndarray, weight: np.ndarray, choose: str) -> tuple[int, ...] | None:
    if not open_bins:
        return None
    states = list(open_bins)
    left = np.array(states, np.int64)
    fits = np.flatnonzero((left >= np.array(need)).all(axis=1))
    if not len(fits):
        return None
    if choose == "norm":
        score = (weight * ((left[fits] - need) / full) ** 2).sum(axis=1)
    else:
        score = (weight * (left[fits] / full) * (np.array(need) / full)).sum(axis=1)
    return states[int(fits[np.argmin(score)])]


PIECE = "key bigint, piece int, start bigint, length bigint, ids binary, part int, place bigint"
PIECE_ARROW = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                         ("ids", pa.binary()), ("part", pa.int32()), ("place", pa.int64())])


def cut(tokens: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `longest` tokens, but for the first one."""
    first = (tokens - 1) % longest + 1
    return [(0, first), *((k, longest) for k in range(first, tokens, longest))]


def write_pieces(docs: DataFrame, tokenizer, path: str, end_id: int, longest: int, key: str = "doc_id", text: str = "text") -> None:
    """The pieces of all documents with their ids, each numbered among those of its length in its task."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = coder_of(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], coder.kind)
        rows: list[tuple] = []
        for batch in batches:
            for at, stop in text_pieces(batch.column("text")):
                keys = batch.column("key").slice(at, stop - at).to_pylist()
                for k, ids in zip(keys, coder.encode(batch.column("text").slice(at, stop - at))):
                    ids = np.concatenate((ids, end))
                    for number, (start, length) in enumerate(cut(len(ids), longest)):
                        rows.append((k, number, start, length, ids[start:start + length].tobytes(), part, seen[length]))
                        seen[length] += 1
                        if len(rows) >= BATCH_PIECES:
                            yield _batch(rows)
                            rows = []
        if rows:
            yield _batch(rows)

    docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(encoded, PIECE).write.parquet(path)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), PIECE_ARROW)], schema=PIECE_ARROW)


def write_packed(
    docs: DataFrame, tokenizer, path: str, end_id: int, capacity: Capacity = Capacity(), key: str = "doc_id", text: str = "text",
    choose: str = "norm", weights: list[float] | None = None,
) -> int:
    """Pack all documents into sequences below `path`; returns the number of sequences.

    A document is its token ids and `end_id`. One that is longer than a sequence holds is cut
    into pieces of that size, the first of which may be shorter; no other is cut. Null texts are
    empty, that is one piece of the end id; null keys are documents like others; repeated rows
    are repeated documents; pieces of equal length are interchangeable; an empty table gives no
    sequence. Other columns are not used, whatever their names. Very long texts are encoded whole
    and make many pieces. Two Parquet tables are written: `pieces`, and `sequences` with one row
    (sequence_id, n_tokens, pieces: offset, key, piece, start, length, ids as little-endian
    integers of two bytes, or four for a vocabulary beyond 65,536) each.
    """
    spark = docs.sparkSession
    write_pieces(docs, tokenizer, f"{path}/pieces", end_id, capacity.piece, key, text)
    made = spark.read.parquet(f"{path}/pieces")
    # A row for each task and length; the window over the tasks of one length has a row a task.
    by_task = made.groupBy("part", "length").count()
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row a length
    runs, sequences = best_fit(histogram, capacity, choose, weights)
    table = spark.createDataFrame(
        [(r.length, r.first, r.last, r.sequence, r.each, r.offset) for r in runs],
        "run_length bigint, first bigint, last bigint, sequence bigint, each bigint, used bigint")
    ranked = made.join(small_side(base), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    mine = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    behind = F.col("rank") - F.col("first")
    placed = ranked.join(small_side(table), mine).select(
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"), "length",
        F.struct((F.col("used") + F.pmod(behind, F.col("each")) * F.col("length")).alias("offset"),
                 "key", "piece", "start", "length", "ids").alias("item"))
    alone = placed.filter(F.col("length") == capacity.tokens).select("sequence_id", F.col("length").alias("n_tokens"), F.array("item").alias("pieces"))
    # A sequence has `capacity.tokens` tokens at most, so a group is small.
    shared = placed.filter(F.col("length") < capacity.tokens).groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list("item")).alias("pieces"))
    alone.unionByName(shared).write.parquet(f"{path}/sequences")
    return sequences


def read_pieces(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row for each piece with its sequence, its place there and its ids, from the sequences."""
    rows = spark.read.parquet(f"{path}/sequences").select("sequence_id", F.explode("pieces").alias("p"))
    return rows.select(F.col("p.key").alias(key), "p.piece", "p.start", "p.length", "p.ids", "sequence_id", "p.offset")


def digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per piece, from the sequences: ids before it in its document, its length, the crc32 of its
    ids as little-endian unsigned 32-bit integers, its place."""

    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for k in range(0, len(batch), BATCH_PIECES):
                yield pa.array([zlib.crc32(unpacked(raw, n).tobytes()) for raw, n in zip(
                    batch.field("ids").slice(k, BATCH_PIECES).to_pylist(), batch.field("length").slice(k, BATCH_PIECES).to_pylist())], pa.int64())

    crc = F.arrow_udf(summed, "bigint")(F.struct("ids", "length"))
    return read_pieces(spark, path, key).select(key, "piece", "start", "length", crc.alias("ids_crc32"), "sequence_id", "offset")


def unpacked(raw: bytes, count: int) -> np.ndarray:
    """The ids of `count` tokens as unsigned 32-bit integers."""
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype("<u4")


def sequence_ids(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence in one list, as a trainer reads them."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [unpacked(b"".join(parts), n) for parts, n in zip(batch.column("parts").to_pylist(), batch.column("n_tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int64())).cast(pa.list_(pa.int32()))], ["sequence_id", "ids"])

    rows = spark.read.parquet(f"{path}/sequences").select("sequence_id", "n_tokens", F.col("pieces.ids").alias("parts"))
    return rows.mapInArrow(joined, "sequence_id bigint, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/packed-{uuid.uuid4().hex}"
