"""Token ids of a byte-level BPE tokenizer file, with each distinct stretch of text encoded once.

The tokenizer's pattern always ends a token before a blank or line feed that follows other than
white space, and between an ASCII letter or digit and an ASCII mark after it: no alternative of the
pattern matches across such a place, and none looks behind. A text cut there has the ids of its
parts, one after the other. The parts of many texts are found, hashed (64 bits) and told apart as
arrays; new ones go to the library many at a time as one text, in which a token that begins with a
blank or line feed begins a part. The settings this rests on are checked when the file is loaded;
under others, and for texts with added tokens, whole texts are encoded.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from plaintscope.llm.textarrays import BYTE_VALUE, STEP, flat, mix

KNOWN_PARTS = 1_000_000
AT_ONCE = 500
TOKENIZER_BYTES = 64 << 20
BLANK, FEED = "Ġ", "Ċ"  # how byte-level vocabularies write a blank and a line feed

_CODES = np.arange(256)
GAP = (_CODES == 0x20) | (_CODES == 0x0A)
SPACE = GAP | ((_CODES >= 0x09) & (_CODES <= 0x0D)) | ((_CODES >= 0x1C) & (_CODES <= 0x1F))
ALNUM = ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
MARK = (_CODES > 0x20) & (_CODES < 0x7F) & ~ALNUM
# UTF-8 of white space beyond ASCII: two fixed bytes and the range of the last.
WIDE_SPACES = [(0xC2, None, 0x85, 0x85), (0xC2, None, 0xA0, 0xA0), (0xE1, 0x9A, 0x80, 0x80), (0xE2, 0x80, 0x80, 0x8A),
               (0xE2, 0x80, 0xA8, 0xA9), (0xE2, 0x80, 0xAF, 0xAF), (0xE2, 0x81, 0x9F, 0x9F), (0xE3, 0x80, 0x80, 0x80)]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which a part begins, those of the texts (but empty ones) among them."""
    before = data[:-1]
    ends = ~SPACE[before]  # a character that is no white space ends here
    for first, second, least, most in WIDE_SPACES:
        last = 1 if second is None else 2
        at = np.flatnonzero(data[:len(data) - last] == first)
        at = at[(data[at + last] >= least) & (data[at + last] <= most)]
        if second is not None:
            at = at[data[at + 1] == second]
        ends[(at + last)[at + last < len(ends)]] = False
    begins = np.zeros(len(data), np.bool_)
    begins[1:] = (GAP[data[1:]] & ends) | (MARK[data[1:]] & ALNUM[before])
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


def part_values(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit values of the parts that begin at `starts` and cover all bytes."""
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    power = np.full(int(lengths.max()), STEP)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return mix(np.add.reduceat(BYTE_VALUE[data] * power[place], starts) + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class UnitCoder:
    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_str(raw.decode())
        told = json.loads(raw)
        before = told.get("pre_tokenizer") or {}
        self.added = [t["content"].encode() for t in told.get("added_tokens") or ()]
        self.separable = (
            told.get("normalizer") is None and told["model"].get("type") == "BPE" and not told["model"].get("dropout")
            and not told.get("truncation") and not told.get("padding")
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True))
        names = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(names.values(), default=0) < 1 << 16 else "<u4")
        self.begins = np.zeros(max(names.values(), default=0) + 1, np.bool_)
        self.begins[[k for token, k in names.items() if token[:1] in (BLANK, FEED)]] = True
        self.forget()

    def forget(self) -> None:
        """Known parts: their sorted values, and where the ids of each begin and how many there are."""
        self.values, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        data, offsets = flat(texts)
        content = data.tobytes()
        if not self.separable or any(a in content for a in self.added):
            return self.whole([t or "" for t in texts.to_pylist()])
        if not len(data):
            return [np.zeros(0, self.kind)] * len(texts)
        if len(self.values) > KNOWN_PARTS:
            self.forget()
        starts = cuts(data, offsets)
        distinct, at, part = np.unique(part_values(data, starts), return_index=True, return_inverse=True)
        self.learn(distinct, at, content, starts)
        place = np.searchsorted(self.values, distinct)
        counts = self.count[place][part]
        sums = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[np.repeat(self.first[place][part] - sums[:-1], counts) + np.arange(sums[-1])]
        ends = sums[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def learn(self, distinct: np.ndarray, at: np.ndarray, content: bytes, starts: np.ndarray) -> None:
        """Encode those of the distinct parts, found at part `at` of the content, that are not known."""
        place = np.minimum(np.searchsorted(self.values, distinct), max(len(self.values) - 1, 0))
        new = np.flatnonzero(self.values[place] != distinct) if len(self.values) else np.arange(len(distinct))
        if not len(new):
            return
        data, at = np.frombuffer(content, np.uint8), at[new]
        begin, stop = starts[at], np.append(starts[1:], len(content))[at]
        # Those that can stand beside others: one blank or line feed, before something that ends in no white space.
        beside = GAP[data[begin]] & (stop > begin + 1) & ~SPACE[data[stop - 1]] & (np.add.reduceat(GAP[data], starts, dtype=np.int64)[at] == 1)
        order = np.argsort(~beside, kind="stable")
        new, begin, stop = new[order], begin[order].tolist(), stop[order].tolist()
        parts = [content[a:b] for a, b in zip(begin, stop)]
        joined = int(beside.sum())
        ids, sizes = [], []
        for k in range(0, joined, AT_ONCE):
            some = parts[k:min(k + AT_ONCE, joined)]
            ids += self.whole([b"".join(some).decode()])
            places = np.flatnonzero(self.begins[ids[-1]])
            if len(places) != len(some):
                raise ValueError("this tokenizer's tokens do not tell where a blank stands")
            sizes.append(np.diff(np.append(places, len(ids[-1]))))
        alone = self.whole([p.decode() for p in parts[joined:]])
        sizes = np.concatenate([*sizes, np.array([len(a) for a in alone], np.int64)])
        added = np.concatenate([*ids, *alone])
        if self.used + len(added) > len(self.ids):
            self.ids = np.concatenate((self.ids[:self.used], np.zeros(len(self.ids) + 2 * len(added), self.kind)))
        self.ids[self.used:self.used + len(added)] = added
        first = self.used + np.cumsum(sizes) - sizes
        self.used += len(added)
        rising = np.argsort(new)  # as `distinct` is sorted
        place = np.searchsorted(self.values, distinct[new[rising]])
        self.first = np.insert(self.first, place, first[rising])
        self.count = np.insert(self.count, place, sizes[rising])
        self.values = np.insert(self.values, place, distinct[new[rising]])


_CODERS: dict[int, UnitCoder] = {}


def coder_of(shared) -> UnitCoder:
    content = shared.value
    if hash(content) not in _CODERS:
        _CODERS.clear()
        _CODERS[hash(content)] = UnitCoder(content)
    return _CODERS[hash(content)]


def share_tokenizer(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast; only the driver reads the path."""
    with open(path, "rb") as file:
        content = file.read()
    if len(content) > TOKENIZER_BYTES:
        raise ValueError(f"a tokenizer file of {len(content)} bytes is not broadcast")
    return spark.sparkContext.broadcast(content)
