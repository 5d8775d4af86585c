"""Texts of an Arrow batch as one byte array, words as ranges in it, and the UDF form all operators share.

Text work runs as Arrow UDFs (column in, struct column out): Spark splits the rows, other
columns never leave the JVM, and a lost executor only repeats its own splits. A batch is cut
into pieces of at most CHUNK_BYTES of text (a longer text is a piece of its own), so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

CHUNK_BYTES = 1 << 20

# Bytes that end a word: white space as in [\x20\x09-\x0D].
SPACED = np.ones(256, np.bool_)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
# Bytes of a word once A-Z are lower-cased: 0-9, a-z and all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, np.bool_)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) rows of at most `limit` bytes of text each, one row at least."""
    if not len(texts):
        return
    _, offsets = flat(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield start, stop
        start = stop


def text_udf(work: Callable[[pa.Array], pa.Array], schema: str, limit: int = CHUNK_BYTES):
    """`work` on text pieces as a Spark function of a text column.

    Marked nondeterministic so that the optimizer neither copies nor moves the call: each
    text is worked on once.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start, stop in pieces(texts, limit):
                yield work(texts.slice(start, stop - start))

    return F.arrow_udf(run, schema).asNondeterministic()


def with_result(df, column: str, value: Column):
    """`df` plus a result column. An input column of that name (in any case) is replaced."""
    return df.drop(*[c for c in df.columns if c.lower() == column.lower()]).withColumn(column, value)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0xD1B54A32D192ED03)


class Words:
    """Words of many texts: byte ranges, the text of each, and a 64-bit value of each.

    Equal words have equal values; different ones differ but for a chance of 2**-64 or so.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        keep = kind[data]
        before = np.empty_like(keep)
        before[1:] = keep[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        self.starts = np.flatnonzero(keep & ~before)
        after = np.empty_like(keep)
        after[:-1] = keep[1:]
        last = offsets[1:][offsets[1:] > 0] - 1
        after[last] = False
        self.ends = np.flatnonzero(keep & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # words before each text
        self.per_text = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.per_text)
        self.keep, self.data = keep, data

    def __len__(self) -> int:
        return len(self.starts)

    def values(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        power = np.full(int(lengths.max()), STEP)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        weighted = BYTE_VALUE[self.data[self.keep]] * power[place]
        return mix(np.add.reduceat(weighted, at) + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring offsets; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array of consecutive runs of `values`."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def covered(start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """Mask of 0..size-1 with everything inside any [start, stop) set."""
    steps = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(stop, minlength=size + 1)[: size + 1]
    return np.cumsum(steps[:size]) > 0
