"""Token ids as compressed segments with random access.

Format. A data set is a folder with two Parquet tables, so any store Spark can write holds it:

- `dictionary`: one row, the bytes of the shared zstandard dictionary and their sha256.
- `segments`: one row per segment with the range of keys in it, its place in the order
  (part, segment), the ids before it in its part, its totals, and `body`:

      magic "IDZ1" | bytes an id (2 or 4) | sha256 of the dictionary | n
      n keys (int64) | n null flags (byte) | n id counts (uint64) | n + 1 frame offsets (uint64)
      n zstandard frames, one a document: its little-endian ids

Each document is compressed by itself with the shared dictionary, so one short document is
read by decompressing one frame; the offset table finds it.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from plaintscope.session import checkpoint_dir, small_side

SAMPLE_DOCS = 2000        # documents the dictionary is trained on, at most
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SEGMENT_BYTES = 4 << 20   # a segment is closed beyond so many compressed bytes ...
SEGMENT_DOCS = 20_000     # ... or documents
CACHE_WORDS = 400_000
TOKENIZER_BYTES = 64 << 20
MAGIC = b"IDZ1"
HEAD = struct.Struct("<4sB32sQ")


WORD_END = "</w>"
# Between a letter and a mark, which this tokenizer's pattern always parts. Not before the
# quote, which may begin a contraction, nor the characters of special tokens.
MARK_AFTER_LETTER = re.compile(r"(?<=[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff])(?=[!-&(-/:;=?@\[-`{}~])")


class WordCoder:
    """Packed ids of texts. Blanks and line feeds end words for this tokenizer whatever stands
    around them, so the library encodes each distinct word once and the parts are joined.

    A Latin-1 text without special tokens is first lower-cased, as the library would, and gets
    a blank between letters and marks, which changes none of its ids but leaves fewer distinct
    words. A word of letters is one run, of which only the last token carries the word end:
    many of them go to the library as one text and are told apart by it. Other words go alone.
    """

    def __init__(self, raw: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_str(raw.decode())
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.last = np.zeros(self.library.get_vocab_size() + 1, np.bool_)
        self.last[[k for token, k in self.library.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the cache before this one, so that common words stay

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        split = [self.simpler(t or "").replace("\n", " ").split(" ") for t in texts]
        self.learn([w for w in set().union(*split) if w not in self.cache])
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    @staticmethod
    def simpler(text: str) -> str:
        if "<|" in text:
            return text
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return MARK_AFTER_LETTER.sub(" ", text.lower())

    def learn(self, words: list[str]) -> None:
        letters, others = [], []
        for word in words:
            if word in self.older:
                self.cache[word] = self.older[word]
            elif word.isalpha() and max(word) <= "\u00ff":
                letters.append(word)
            else:
                others.append(word)
        self.letters(letters)
        for word, found in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False)):
            self.cache[word] = np.array(found.ids, self.kind).tobytes()

    def letters(self, words: list[str], at_once: int = 500) -> None:
        texts = [" ".join(words[k:k + at_once]) for k in range(0, len(words), at_once)]
        at = 0
        for found in self.library.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, self.kind)
            packed, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
            for start, stop in zip([0, *ends], ends):
                self.cache[words[at]] = packed[start:stop]
                at += 1
        if at != len(words):
            raise ValueError("this tokenizer does not mark the ends of words")


_CODERS: dict[int, WordCoder] = {}


def coder_of(shared) -> WordCoder:
    raw = shared.value
    if hash(raw) not in _CODERS:
        _CODERS.clear()
        _CODERS[hash(raw)] = WordCoder(raw)
    return _CODERS[hash(raw)]


def share_tokenizer(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast; only the driver reads the path."""
    with open(path, "rb") as file:
        raw = file.read()
    if len(raw) > TOKENIZER_BYTES:
        raise ValueError(f"a tokenizer file of {len(raw)} bytes is not broadcast")
    return spark.sparkContext.broadcast(raw)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of serialized id arrays; their plain bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


class Segment:
    """Documents of one segment while it is written."""

    def __init__(self):
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, key: int | None, count: int, frame: bytes) -> None:
        self.keys.append(key)
        self.counts.append(count)
        self.frames.append(frame)
        self.size += len(frame)

    def body(self, width: int, digest: bytes) -> bytes:
        keys = np.array([k or 0 for k in self.keys], "<i8")
        nulls = np.array([k is None for k in self.keys], np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(f) for f in self.frames]))).astype("<u8")
        return b"".join([HEAD.pack(MAGIC, width, digest, len(keys)), keys.tobytes(), nulls.tobytes(),
                         np.array(self.counts, "<u8").tobytes(), offsets.tobytes(), *self.frames])


class SegmentReader:
    """The documents of a segment body; frames are decompressed one by one when asked for."""

    def __init__(self, body: bytes, dictionary: bytes):
        magic, width, digest, n = HEAD.unpack_from(body)
        if magic != MAGIC:
            raise ValueError("not a segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        at = HEAD.size
        self.body, self.kind = body, np.dtype("<u2" if width == 2 else "<u4")
        keys = np.frombuffer(body, "<i8", n, at)
        nulls = np.frombuffer(body, np.uint8, n, at + 8 * n)
        self.keys = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist())]
        self.counts = np.frombuffer(body, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(body, "<u8", n + 1, at + 17 * n).astype(np.int64) + at + 17 * n + 8 * (n + 1)
        self.open = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, k: int) -> np.ndarray:
        raw = self.open.decompress(self.body[self.offsets[k]:self.offsets[k + 1]])
        return np.frombuffer(raw, self.kind)


def write_ids(docs: DataFrame, tokenizer, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, each followed by `end_id`, in ascending order of key.

    Null keys come first; equal keys are ordered by text; null texts are empty; repeated rows
    are repeated documents. An empty table gives a data set without segments. Other columns
    are not used. The texts are range-partitioned by (key, hash of the text), so one key with
    many rows is spread too, and each task writes its range in segments of bounded size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    total = rows.select("key").count()
    scale = 1 << 20
    share = min(scale, -(-SAMPLE_DOCS * scale // max(total, 1)))
    sample = rows.filter(F.pmod(F.xxhash64("key", "text"), F.lit(scale)) < share).limit(SAMPLE_DOCS)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"ids": pa.array(coder.encode(batch.column("text").to_pylist()), pa.binary())})

    samples = [bytes(r.ids) for r in sample.mapInArrow(serialized, "ids binary").collect()]
    dictionary = train_dictionary(sorted(s for s in samples if s))
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "sha256 string, body binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = coder_of(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], coder.kind).tobytes()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        number, before, open_segment = 0, 0, Segment()

        def close() -> pa.RecordBatch:
            nonlocal number, before, open_segment
            done, tokens = open_segment, sum(open_segment.counts)
            known = [k for k in done.keys if k is not None]
            row = {"part": part, "segment": number, "least": min(known, default=None), "most": max(known, default=None),
                   "docs": len(done.keys), "before": before, "tokens": tokens, "body": done.body(coder.width, digest)}
            number, before, open_segment = number + 1, before + tokens, Segment()
            return pa.RecordBatch.from_pylist([row], schema=SEGMENT_ARROW)

        for batch in batches:
            keys, texts = batch.column("key").to_pylist(), batch.column("text")
            for at in range(0, len(keys), 256):
                for k, packed in zip(keys[at:at + 256], coder.encode(texts.slice(at, 256).to_pylist())):
                    packed += end
                    open_segment.add(k, len(packed) // coder.width, press.compress(packed))
                    if open_segment.size >= SEGMENT_BYTES or len(open_segment.keys) >= SEGMENT_DOCS:
                        yield close()
        if open_segment.keys:
            yield close()

    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")
    ranged.mapInArrow(segments, SEGMENT_SCHEMA).write.parquet(f"{path}/segments")


SEGMENT_SCHEMA = "part int, segment int, least bigint, most bigint, docs bigint, before bigint, tokens bigint, body binary"
SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("least", pa.int64()), ("most", pa.int64()),
                           ("docs", pa.int64()), ("before", pa.int64()), ("tokens", pa.int64()), ("body", pa.binary())])


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().body)  # DICTIONARY_BYTES at most


def read_ids(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """(key, ids) of the documents in `path`; with `only`, of these keys, opening no other
    segment's body and decompressing no other document."""
    dictionary, wanted = _dictionary(spark, path), None if only is None else frozenset(only)
    rows = spark.read.parquet(f"{path}/segments")
    if wanted is not None:
        near = [(F.col("least") <= k) & (F.col("most") >= k) for k in wanted]
        rows = rows.filter(_any(near))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                segment = SegmentReader(body.as_py(), dictionary)
                at = [k for k, key in enumerate(segment.keys) if wanted is None or key in wanted]
                for some in (at[i:i + 500] for i in range(0, len(at), 500)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([segment.keys[k] for k in some], pa.int64()),
                         pa.array([segment.ids(k).astype(np.int32) for k in some], pa.list_(pa.int32()))], ["key", "ids"])

    return rows.select("body").mapInArrow(opened, "key bigint, ids array<int>")


def _any(conditions):
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, ids of all documents before it, its ids, and the
    crc32 of those ids as little-endian unsigned 32-bit integers."""
    dictionary = _dictionary(spark, path)
    rows = spark.read.parquet(f"{path}/segments")
    # One row per writing task: the running total over the parts is a window of that many rows.
    parts = rows.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("part"), F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("base"))
    placed = rows.select("part", "body", "before").join(small_side(base), "part").select("body", (F.col("before") + F.col("base")).alias("start"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, start in zip(batch.column("body"), batch.column("start").to_pylist()):
                segment = SegmentReader(body.as_py(), dictionary)
                ids = [segment.ids(k) for k in range(len(segment))]
                sizes = np.array([len(i) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(segment.keys, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(summed, f"{key} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
