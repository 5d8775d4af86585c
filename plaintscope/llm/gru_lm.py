"""Log-likelihood of whole texts under a gated recurrent language model.

Counts cover every training token: each task counts its words, Spark adds the counts. The
commonest words (HEAD_WORDS at most, by a threshold on the count) travel to the scoring tasks
with their counts; all rarer words of a text are looked up by a join.

The model is a GRU in numpy. Its output is factored: a class given the state, then a word given
the class and the state. OUTPUT_WORDS of the commonest words fill classes of CLASS_WORDS; one
class more stands for every other word, whose share inside it is (c + 1) / (N' + V' + 1) by the
counts. Training is back-propagation truncated to WINDOW tokens, the state carried on to the
next window of a segment of a text. The training texts are parted by hash into ROUNDS shares, one a round, so the network
learns from each text once. Every task of a round trains on its texts from the same start, the
parameters are averaged by tokens over all tasks, and the next round begins from the average.
The texts of a round are dealt over tasks by their volume, so a task has TASK_TOKENS to learn
from, however the input is parted.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.llm.textarrays import LOWER, SPACED, Words, flat, mix, pieces
from plaintscope.session import checkpoint_dir, stage

HEAD_WORDS = 500_000    # words whose counts are sent to the scoring tasks, at most
PREFIX = 18             # bits of a value by which it is looked up
CLASSES, CLASS_WORDS = 32, 64
OUTPUT_WORDS = CLASSES * CLASS_WORDS
RARE_INPUTS = 128       # input vectors shared by all other words, by hash
SIZE = 24               # of word vectors and of the state
WINDOW = 32             # tokens of truncated back-propagation
SEGMENT = 64 * WINDOW   # tokens of a text that are learned from one after the other
BATCH = 96              # lanes of texts trained side by side
SCORED = 512            # texts of similar length scored side by side
ROUNDS = 8              # training rounds, each over another share of the training texts, together over all
TASK_TOKENS = 1_000_000  # about so many tokens of a round are learned by a task
RATE = 0.01
MOVED = 1 << 13         # parameters moved at a time
PIECE_BYTES = 8 << 20   # of texts learned from or scored side by side
COUNT_ROWS = 1 << 20    # counts a task holds before it hands them to Spark

END = np.uint64(mix(np.array([0x656E64], np.uint64))[0])  # the value of the end token


def held_out(key: Column) -> Column:
    """Texts that nothing is learned from: crc32 of the id as text leaves 2 by 7."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of all tokens, each text's words and then one end, and the texts' offsets."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for start, stop in pieces(texts):
        data, offsets = flat(texts.slice(start, stop - start))
        words = Words(LOWER[data], offsets, SPACED)
        values.append(np.insert(words.values(), words.first[1:], END))
        sizes.append(words.per_text + 1)
    return np.concatenate(values), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(value, n) of every token of `docs`; values are 64-bit hashes of lower-cased words."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def add() -> pa.RecordBatch:
            nonlocal held, size
            value = np.concatenate([v for v, _ in held])
            n = np.concatenate([c for _, c in held])
            value, at = np.unique(value, return_inverse=True)
            n = np.bincount(at, n, len(value)).astype(np.int64)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["value", "n"])

        for batch in batches:
            texts = batch.column(0)
            for start, stop in pieces(texts, PIECE_BYTES):
                held.append(np.unique(tokens(texts.slice(start, stop - start))[0], return_counts=True))
                size += len(held[-1][0])
                if size > COUNT_ROWS:
                    yield add()
        if held:
            yield add()

    return docs.select(text).mapInArrow(counted, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))


class Head:
    """The commonest words, by falling count, and what the others are in sum."""

    def __init__(self, values: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((values, -counts))
        self.values, self.counts = values[order], counts[order]
        self.total, self.distinct = total, distinct
        self.sorted = np.argsort(self.values)
        self.by_value = self.values[self.sorted]
        self.begins = np.searchsorted(self.by_value, np.arange(1 << PREFIX, dtype=np.uint64) << np.uint64(64 - PREFIX)).astype(np.int32)
        top = self.counts[:OUTPUT_WORDS]
        self.rest = total - int(top.sum()) + distinct - len(top) + 1  # N' + V' + 1

    def ranks(self, values: np.ndarray) -> np.ndarray:
        """Place of each value among the head words, -1 for others. Values are hashes, so few begin with the same bits."""
        if not len(self.values):
            return np.full(len(values), -1)
        last = len(self.by_value) - 1
        at = np.minimum(self.begins[(values >> np.uint64(64 - PREFIX)).astype(np.int64)], last)
        found = self.by_value[at]
        behind = np.flatnonzero((found < values) & (at < last))
        while len(behind):
            at[behind] += 1
            found[behind] = self.by_value[at[behind]]
            behind = behind[(found[behind] < values[behind]) & (at[behind] < last)]
        return np.where(found == values, self.sorted[at], -1)

    def inputs(self, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Row of the word vector: its own for output words, a shared one for the others."""
        return np.where((ranks >= 0) & (ranks < OUTPUT_WORDS), ranks, OUTPUT_WORDS + (values % np.uint64(RARE_INPUTS)).astype(np.int64))


def read_head(counts: DataFrame) -> Head:
    """`counts` must be staged. Buckets of the count, eight to a doubling, give the smallest
    count of which all words still number HEAD_WORDS at most."""
    bucket = F.floor(F.log2("n") * 8)
    table = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    left, least = HEAD_WORDS, math.inf
    for row in sorted(table, reverse=True):
        if row.words > left:
            break
        left, least = left - row.words, row.b
    chosen = counts.filter(bucket >= least) if least < math.inf else counts.limit(0)
    found = chosen.toPandas()
    return Head(found["value"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64),
                sum(r.tokens for r in table), sum(r.words for r in table))


SHAPES = {
    "vectors": (OUTPUT_WORDS + RARE_INPUTS, SIZE), "into": (SIZE, 3 * SIZE), "into_bias": (3 * SIZE,), "over": (SIZE, 3 * SIZE),
    "over_bias": (SIZE,), "classes": (SIZE, CLASSES + 1), "class_bias": (CLASSES + 1,), "words": (CLASSES, SIZE, CLASS_WORDS),
    "word_bias": (CLASSES, CLASS_WORDS),
}


def unpack(flat_parameters: np.ndarray) -> dict[str, np.ndarray]:
    """Named views of one long vector."""
    views, at = {}, 0
    for name, shape in SHAPES.items():
        size = math.prod(shape)
        views[name] = flat_parameters[at:at + size].reshape(shape)
        at += size
    return views


def initial(head: Head) -> np.ndarray:
    """Small random weights; biases that make the untrained model the word frequencies."""
    rng = np.random.default_rng(9)
    vector = (rng.normal(size=sum(map(math.prod, SHAPES.values()))) * 0.1).astype(np.float32)
    p = unpack(vector)
    top = np.zeros(OUTPUT_WORDS)
    known = min(OUTPUT_WORDS, len(head.counts))
    top[:known] = head.counts[:known]
    top = top.reshape(CLASSES, CLASS_WORDS)
    p["word_bias"][:] = np.where(top > 0, np.log(np.maximum(top, 1)), -60) - np.log(np.maximum(top.sum(1, keepdims=True), 1))
    p["class_bias"][:] = np.log(np.append(top.sum(1), head.rest) + 1e-9) - math.log(head.total + head.distinct + 1)
    for name in ("words", "classes"):
        p[name] *= 0.1
    p["into_bias"][:], p["over_bias"][:] = 0, 0
    return vector


class Gru:
    """Inside, steps are worked on numbers x texts, so that every part of a gate is one run of memory. What enters a step is the
    word vector, the state and a 1 for the biases; a product gives the sums of the gates z and r, of what r lets through and of
    the new state."""

    def __init__(self, vector: np.ndarray):
        self.vector, self.p, self.kept, self.fixed = vector, unpack(vector), {}, None

    def fix(self) -> Gru:
        """From now on the parameters stay as they are: weights are put together once."""
        self.fixed = self.negated(self.step_weights()), self.output_weights()
        return self

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array of any content, valid until the same name is asked for again."""
        size, held = math.prod(shape), self.kept.get(name)
        if held is None or held.size < size:
            held = self.kept[name] = np.empty(size, self.vector.dtype)
        return held[:size].reshape(shape)

    def step_weights(self) -> np.ndarray:
        p, s = self.p, SIZE
        weights = np.zeros((4 * s, 2 * s + 1), self.vector.dtype)
        weights[:2 * s, :s], weights[3 * s:, :s] = p["into"].T[:2 * s], p["into"].T[2 * s:]
        weights[:3 * s, s:2 * s] = p["over"].T
        weights[:, 2 * s] = np.concatenate((p["into_bias"][:2 * s], p["over_bias"], p["into_bias"][2 * s:]))
        return weights

    @staticmethod
    def negated(weights: np.ndarray) -> np.ndarray:
        """Those of the gates times -1, for 1 / (1 + exp(-x))."""
        weights = weights.copy()
        weights[:2 * SIZE] *= -1
        return weights

    def output_weights(self) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        return np.concatenate((p["classes"], p["class_bias"][None])), np.concatenate((p["words"], p["word_bias"][:, None]), axis=1)

    def run(self, inputs: np.ndarray, state: np.ndarray, weights: np.ndarray | None = None, keep: bool = False):
        """What enters each step and one after them (steps + 1 x numbers x texts), the last state by itself (texts x numbers), the gates
        and sums, and the new states. All but the last state are valid until the next run."""
        s, (steps, n) = SIZE, inputs.shape
        if weights is None:
            weights = self.fixed[0] if self.fixed else self.negated(self.step_weights())
        entering = self.room("entering", steps + 1, 2 * s + 1, n)
        entering[:steps, :s] = self.p["vectors"].take(inputs, axis=0).transpose(0, 2, 1)
        entering[0, s:2 * s], entering[:, 2 * s] = state.T, 1
        sums, made = (self.room(name, steps if keep else 1, m, n) for name, m in (("sums", 4 * s), ("made", s)))
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
            for t in range(steps):
                at = t if keep else 0
                u, new, after = sums[at], made[at], entering[t + 1, s:2 * s]
                np.matmul(weights, entering[t], out=u)
                gate = u[:2 * s]
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(u[s:2 * s], u[2 * s:3 * s], out=new)
                new += u[3 * s:]
                np.tanh(new, out=new)
                np.subtract(entering[t, s:2 * s], new, out=after)
                after *= u[:s]
                after += new
        return entering, entering[steps, s:2 * s].T.copy(), sums, made

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, learn: dict | None = None, at: np.ndarray | None = None):
        """Natural log of the class-factored probability of each target (its rank; OUTPUT_WORDS
        or more: the class of other words). `at`: the row of its state, if not the target's own. With `learn`, gradients of
        the negative sum are added to it and those by the states are returned too."""
        p, s = self.p, SIZE
        by_class, by_word = self.fixed[1] if self.fixed else self.output_weights()
        kind = np.minimum(targets // CLASS_WORDS, CLASSES).astype(np.int16)
        order = np.argsort(kind, kind="stable")
        kind, word = kind[order], targets[order] % CLASS_WORDS
        edges = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        parts = [(k, slice(edges[k], edges[k + 1])) for k in range(CLASSES) if edges[k] < edges[k + 1]]
        rows = order if at is None else at[order]
        own = self.room("own", len(targets), s + 1)
        own[:, :s], own[:, s] = states.take(rows, axis=0), 1

        def classes() -> np.ndarray:
            return np.matmul(own, by_class, out=self.room("share", len(own), CLASSES + 1))

        def words() -> np.ndarray:
            logits = self.room("within", edges[CLASSES], CLASS_WORDS)
            for k, part in parts:
                np.matmul(own[part], by_word[k], out=logits[part])
            return logits

        def softmax(logits: Callable[[], np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(log probabilities of the targets, the gradient by the logits)."""
            share = logits()
            cell, cells, ones = np.arange(len(share)) * share.shape[1] + target, share.reshape(-1), np.ones(share.shape[1], share.dtype)
            found = cells.take(cell)
            with np.errstate(over="ignore"):
                np.exp(share, out=share)
            total = share @ ones
            if not (total.min(initial=1) > 1e-30 and total.max(initial=1) < 1e30):
                logits()
                share -= share.max(axis=1, keepdims=True)
                found = cells.take(cell)
                np.exp(share, out=share)
                total = share @ ones
            found -= np.log(total)
            if learn is not None:
                share *= (1 / total)[:, None]
                cells[cell] -= 1
            return found, share

        found, share = softmax(classes, kind)
        some, within = softmax(words, word[:edges[CLASSES]])
        found[:len(some)] += some
        result = np.empty_like(found)
        result[order] = found
        if learn is None:
            return result
        by = own.T @ share
        learn["classes"] += by[:s]
        learn["class_bias"] += by[s]
        back = share @ p["classes"].T
        by, turned, more = np.zeros_like(by_word), p["words"].transpose(0, 2, 1).copy(), self.room("more", len(some), s)
        for k, part in parts:
            np.matmul(own[part].T, within[part], out=by[k])
            np.matmul(within[part], turned[k], out=more[part])
        learn["words"] += by[:, :s]
        learn["word_bias"] += by[:, s]
        back[:len(some)] += more
        above = np.zeros_like(states)
        above[rows] = back
        return result, above

    def window_gradient(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, state: np.ndarray):
        """(gradient vector of the negative log-likelihood, its value, the last state) of one window."""
        s, (steps, n) = SIZE, inputs.shape
        gradient = np.zeros_like(self.vector)
        g, weights = unpack(gradient), self.step_weights()
        entering, last, sums, new = self.run(inputs, state, self.negated(weights), keep=True)
        at = np.flatnonzero(live)
        result, above = self.log_probabilities(by_token(entering), targets.reshape(-1)[at], g, at)
        above = above.reshape(steps, n, s)
        z, r = sums[:, :s], sums[:, s:2 * s]
        new_by, z_by, r_by = (self.room(name, steps, s, n) for name in ("new_by", "z_by", "r_by"))
        np.subtract(1, z, out=r_by)
        np.multiply(new, new, out=new_by)
        np.subtract(1, new_by, out=new_by)
        new_by *= r_by
        np.subtract(entering[:steps, s:2 * s], new, out=z_by)
        z_by *= z
        z_by *= r_by
        np.subtract(1, r, out=r_by)
        r_by *= r
        r_by *= sums[:, 2 * s:3 * s]
        by, back = self.room("by", steps, 4 * s, n), self.room("back", steps, 2 * s, n)  # by the sums, and by what enters
        carried, d, turned = np.zeros((s, n), gradient.dtype), np.empty((s, n), gradient.dtype), weights[:, :2 * s].T.copy()
        for t in range(steps - 1, -1, -1):
            here, by_new = by[t], by[t, 3 * s:]
            np.add(carried, above[t].T, out=d)
            np.multiply(d, new_by[t], out=by_new)
            np.multiply(d, z_by[t], out=here[:s])
            np.multiply(by_new, r_by[t], out=here[s:2 * s])
            np.multiply(by_new, r[t], out=here[2 * s:3 * s])
            np.matmul(turned, here, out=back[t])
            carried = back[t, s:]
            d *= z[t]
            carried += d
        found = np.matmul(by, entering[:steps].transpose(0, 2, 1)).sum(axis=0)
        g["over"] += found[:3 * s, s:2 * s].T
        g["over_bias"] += found[2 * s:3 * s, 2 * s]
        found = np.delete(found, slice(2 * s, 3 * s), axis=0)
        g["into"] += found[:, :s].T
        g["into_bias"] += found[:, 2 * s]
        inputs, rows = inputs.reshape(-1), back[:, :s].transpose(1, 0, 2).reshape(s, -1).astype(np.float64)
        g["vectors"] += np.stack([np.bincount(inputs, row, len(g["vectors"])) for row in rows]).T
        return gradient, -float(result.sum()), last


def by_token(entering: np.ndarray) -> np.ndarray:
    """The states after each step, (steps and texts) x numbers."""
    return entering[1:, SIZE:2 * SIZE].transpose(0, 2, 1).reshape(-1, SIZE)


def windows(inputs: np.ndarray, targets: np.ndarray, offsets: np.ndarray, chosen: np.ndarray):
    """Windows of the chosen texts side by side, longest first: (texts still live, first step or
    not, inputs, targets, live mask), steps x texts. The input of a step is the token before
    it, the end token before the first."""
    length = np.diff(offsets)[chosen]
    order = np.argsort(-length, kind="stable")
    chosen, length = chosen[order], length[order]
    begin = offsets[:-1][chosen]
    for start in range(0, int(length[0]) if len(length) else 0, WINDOW):
        n = int(np.searchsorted(-length, -start, "left"))
        steps = np.arange(start, min(start + WINDOW, int(length[0])))
        live = steps[:, None] < length[None, :n]
        at = np.where(live, begin[None, :n] + steps[:, None], 0)
        yield chosen[:n], start, inputs[at], targets[at], live


def side_by_side(inputs: np.ndarray, targets: np.ndarray, offsets: np.ndarray, width: int, rng: np.random.Generator):
    """Windows of all texts in `width` lanes of about equal length, so that they stay full: (lanes that
    go on, those of them that begin a text, inputs, targets, live mask), steps x lanes.

    A text of more than SEGMENT tokens is learned from in segments of as many, each as a text of its
    own. A segment goes to the lane with the fewest windows, the longest first; each lane then takes
    its segments in random order, one after the other, a new one in a new window.
    """
    many = -(-np.diff(offsets) // SEGMENT)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    offsets = np.append(np.repeat(offsets[:-1], many) + at * SEGMENT, offsets[-1])
    length = np.diff(offsets)
    count = -(-length // WINDOW)
    filled = [(0, k) for k in range(width)]
    lane = np.empty(len(length), np.int64)
    for text in np.argsort(-count, kind="stable").tolist():
        used, k = filled[0]
        lane[text] = k
        heapq.heapreplace(filled, (used + int(count[text]), k))
    order = np.lexsort((rng.random(len(length)), lane))
    before = np.cumsum(count[order]) - count[order]
    first = np.flatnonzero(np.diff(lane[order], prepend=-1))
    before -= np.repeat(before[first], np.diff(np.append(first, len(order))))
    text = np.repeat(order, count[order])
    part = np.arange(len(text)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
    row = np.repeat(before, count[order]) + part
    start, size = (np.zeros((int(row.max(initial=-1)) + 1, width), np.int64) for _ in range(2))
    start[row, lane[text]] = offsets[text] + part * WINDOW
    size[row, lane[text]] = np.minimum(WINDOW, length[text] - part * WINDOW)
    fresh = np.zeros(size.shape, np.bool_)
    fresh[row, lane[text]] = part == 0
    for begin, long, new in zip(start, size, fresh):
        lanes = np.flatnonzero(long)
        live = np.arange(long.max())[:, None] < long[lanes]
        at = np.where(live, begin[lanes] + np.arange(len(live))[:, None], 0)
        yield lanes, new[lanes], inputs[at], targets[at], live


def prepared(texts: pa.Array, head: Head):
    """(values, ranks, inputs shifted by one token, targets, offsets) of a piece of texts."""
    value, offsets = tokens(texts)
    rank = head.ranks(value)
    own = head.inputs(value, rank)
    shifted = np.empty_like(own)
    shifted[1:] = own[:-1]
    end = np.array([END])
    shifted[offsets[:-1]] = head.inputs(end, head.ranks(end))[0]
    targets = np.where((rank >= 0) & (rank < OUTPUT_WORDS), rank, OUTPUT_WORDS)
    return value, rank, shifted, targets, offsets


class Adam:
    """Adam on gradients that are `scale` times too long: the means are kept as plain sums with falling weights."""

    def __init__(self, size: int, scale: float = 1):
        self.sum, self.squares, self.step, self.scale = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, scale

    def move(self, vector: np.ndarray, gradient: np.ndarray) -> None:
        self.step += 1
        rate = RATE * math.sqrt(1 - 0.99 ** self.step) / (1 - 0.9 ** self.step)
        for start in range(0, len(vector), MOVED):  # a run of each array stays in the processor's cache
            part = slice(start, start + MOVED)
            found, total, squares = gradient[part], self.sum[part], self.squares[part]
            total *= 0.9
            total += found
            change = found * found
            squares *= 0.99
            squares += change
            np.sqrt(squares, out=change)
            change += 1e-7 * self.scale  # 1e-8 beside the root of the mean, which is a hundredth of the sum
            np.divide(total, change, out=change)
            change *= rate
            vector[part] -= change


def rounds(docs: DataFrame) -> DataFrame:
    """`docs` (key, text) with the round of each row, written once in a folder a round, so that a round reads its own rows only."""
    path = f"{checkpoint_dir(docs.sparkSession)}/rounds-{uuid.uuid4().hex}"
    docs.withColumn("round", F.pmod(F.xxhash64("key", "text"), F.lit(ROUNDS)).cast("int")).write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.parquet(path)


def share(docs: DataFrame, k: int, total: int) -> DataFrame:
    """The k-th of ROUNDS shares of `docs` (key, text; `total` tokens in all), in tasks of similar volume.

    Rows are dealt in turn, so equal rows do not meet in one task; inside a task they go by
    hash, so a repeated task learns in the same order.
    """
    part = docs.withColumn("place", F.xxhash64("key", "text")).filter(F.pmod("place", F.lit(ROUNDS)) == k)
    return part.repartition(math.ceil(total / ROUNDS / TASK_TOKENS)).sortWithinPartitions("place").drop("place")


def train(docs: DataFrame, text: str, head, start: np.ndarray) -> np.ndarray:
    """One round over `docs`: all tasks begin at `start`, the result is the average by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(start)

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Gru(sent.value.copy()), 0
        adam = Adam(len(model.vector), BATCH * WINDOW)  # small windows move it less
        for batch in batches:
            texts = batch.column(0)
            for a, b in pieces(texts, PIECE_BYTES):  # many texts, so that the lanes get about equally long
                _, _, inputs, targets, offsets = prepared(texts.slice(a, b - a), head.value)
                seen += len(targets)
                states = np.zeros((BATCH, SIZE), np.float32)
                for lanes, new, x, y, live in side_by_side(inputs, targets, offsets, BATCH, np.random.default_rng(len(targets))):
                    gradient, _, states[lanes] = model.window_gradient(x, y, live, np.where(new[:, None], np.float32(0), states[lanes]))
                    adam.move(model.vector, gradient)
        if seen:
            yield pa.RecordBatch.from_pydict({"sums": [np.append(model.vector.astype(np.float64) * seen, seen).tobytes()]})

    sums = docs.select(text).mapInArrow(learned, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums))
    total = sums.treeAggregate(0.0, np.add, np.add)
    return (total[:-1] / total[-1]).astype(np.float32) if np.ndim(total) else start  # no row leaves the 0


def score_piece(texts: pa.Array, head: Head, model: Gru) -> pa.RecordBatch:
    """Sums of each text over the tokens whose counts are in the head, and its other tokens.

    tokens; head: of them in the head; base: sum of ln(c + 1) of these; model: sum of ln of the
    class-factored probability of all tokens plus ln((c + 1) / (N' + V' + 1)) of those in the
    class of other words; rest: (value, n) of the tokens not in the head, to be looked up.
    """
    value, rank, inputs, targets, offsets = prepared(texts, head)
    n = len(texts)
    text = np.repeat(np.arange(n), np.diff(offsets))
    known = rank >= 0
    weight = np.zeros(len(value))
    weight[known] = np.log(head.counts[rank[known]] + 1.0)
    base = np.bincount(text, weight, n)
    inner = np.where(targets == OUTPUT_WORDS, np.where(known, weight, 0) - math.log(head.rest), 0)
    total = np.bincount(text, inner, n)
    order = np.argsort(-np.diff(offsets), kind="stable")
    for begin in range(0, n, SCORED):
        state = None
        for chosen, first, x, y, live in windows(inputs, targets, offsets, order[begin:begin + SCORED]):
            state = np.zeros((len(chosen), SIZE), np.float32) if first == 0 else state[:len(chosen)]
            entering, state, _, _ = model.run(x, state)
            at = np.flatnonzero(live)
            found = model.log_probabilities(by_token(entering), y.reshape(-1)[at], at=at)
            total[chosen] += np.bincount(at % len(chosen), found, len(chosen))
    owner, other = text[~known], value[~known]
    order = np.lexsort((other, owner))
    owner, other = owner[order], other[order]
    new = np.ones(len(owner), np.bool_)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    at = np.flatnonzero(new)
    rest = pa.StructArray.from_arrays([pa.array(other[at].view(np.int64)), pa.array(np.diff(np.append(at, len(owner))))], ["value", "n"])
    sizes = np.bincount(owner[at], minlength=n)
    return pa.RecordBatch.from_arrays([
        pa.array(np.diff(offsets)), pa.array(np.bincount(text, known, n).astype(np.int64)), pa.array(base), pa.array(total),
        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), rest),
    ], ["tokens", "head", "base", "model", "rest"])


def log_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null texts are empty: one end token. Rows with a null key are learned from. Repeated rows
    are learned from and scored each. Without training texts every count is 0 and both scores
    are 0. An empty table gives an empty one; other columns are not used.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    training = rows.filter(~held_out(F.col("key")))
    counts = stage(count_tokens(training, "text"))
    head = read_head(counts)
    shared, vector = spark.sparkContext.broadcast(head), initial(head)
    if head.total:
        dealt = rounds(training)
        for k in range(ROUNDS):
            vector = train(share(dealt.filter(F.col("round") == k).drop("round"), k, head.total), "text", shared, vector)
    sent = spark.sparkContext.broadcast(vector)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(sent.value).fix()
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in pieces(batch.column("text"), PIECE_BYTES):
                found = score_piece(batch.column("text").slice(a, b - a), shared.value, model)
                ids = np.arange(row, row + b - a, dtype=np.int64) + (part << 40)
                row += b - a
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("key").slice(a, b - a), *found.columns],
                                                 ["row", "key", *found.schema.names])

    kind = rows.schema["key"].dataType.simpleString()
    # Staged: a row keeps its number whatever is computed again later.
    found = stage(rows.mapInArrow(scored, f"row bigint, key {kind}, tokens bigint, head bigint, base double, model double, "
                                          "rest array<struct<value:bigint,n:bigint>>"))
    looked_up = found.select("row", F.inline("rest")).join(counts.withColumnRenamed("n", "c"), "value", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"))
    ln10, room = math.log(10), math.log(head.total + head.distinct + 1)
    more = F.coalesce("more", F.lit(0.0))
    return found.join(looked_up, "row", "left").select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), F.col("tokens").alias("n_tokens"),
        (F.col("head") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(head.total).cast("bigint").alias("train_tokens"),
        ((F.col("base") + more - F.col("tokens") * room) / ln10).alias("base_score"),
        ((F.col("model") + more) / ln10 if head.total else F.lit(0.0)).alias("score"))
