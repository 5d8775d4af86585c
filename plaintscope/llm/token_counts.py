"""Token counts of a piece model, with huge texts encoded in overlapping chunks.

A text of up to CHUNK code points is encoded at once. A longer one is encoded in chunks that
overlap. Neighbouring encodings are spliced at a boundary that both have and that is proven
stable: a blank after another character. No piece of the vocabulary holds a blank after another
character (checked when the model is loaded), so no merge ever crosses such a place, and what
stands on one side of it cannot change the pieces on the other. As a guard the pieces of the
whole stretch before the splice must be equal in both encodings. If the overlap has no such
place, or the pieces differ, the overlap is doubled, up to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintscope.llm.textarrays import flat, pieces, with_result

CHUNK = 16_384    # code points encoded at once
OVERLAP = 512     # first overlap of two chunks
LIMIT = 4096      # tokens beyond which a text is over the limit
MODEL_BYTES = 64 << 20
BLANK = "▁"  # how the vocabulary writes a blank


class PieceModel:
    def __init__(self, raw: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(a != BLANK and b == BLANK for name in names for a, b in zip(name, name[1:])):
            raise ValueError("a piece holds a blank after another character: there is no proven splice place")

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def pieces_of(self, text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:stop] encoded by itself, and the code points at which they begin."""
        found = self.model.encode(text[start:stop], return_type="offset_mapping")
        begins = np.fromiter((a for a, _ in found["offsets"]), np.int64, len(found["ids"]))
        return np.array(found["ids"], np.int64), begins + start

    def from_proven(self, text: str, place: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from the text's start or a stable place on. The model puts a blank before
        whatever it encodes, so the blank at a stable place is left to it."""
        ids, begins = self.pieces_of(text, place + (place > 0), stop)
        begins[:1] = place
        return ids, begins

    def long_count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
        """(tokens, chunks, times an overlap was widened) of a text encoded in chunks."""
        size, total, chunks, widened = len(text), 0, 1, 0
        done, stop = 0, min(chunk, size)  # pieces that begin before `done` are counted
        ids, begins = self.from_proven(text, 0, stop)
        while stop < size:
            lap, place, end = overlap, None, min(stop + chunk, size)
            while place is None and stop - lap > done:
                later, later_begins = self.pieces_of(text, stop - lap, end)
                place = splice(text, stop - lap, stop, ids, begins, later, later_begins)
                widened += place is None
                lap *= 2
            if place is None:  # nothing shared since the last proven place: one chunk from there, twice as long
                end = min(stop + max(chunk, stop - done), size)
                ids, begins = self.from_proven(text, done, end)
            else:
                total += int(np.searchsorted(begins, place) - np.searchsorted(begins, done))
                done, ids, begins = place, later, later_begins
            stop = end
            chunks += 1
        return total + len(ids) - int(np.searchsorted(begins, done)), chunks, widened


def splice(text: str, start: int, stop: int, ids, begins, later, later_begins) -> int | None:
    """The last stable place in text[start:stop] at which both encodings begin a piece, if the
    pieces between it and the stable place before it are equal in both."""
    places = [p for p in range(start + 1, stop) if text[p] == " " and text[p - 1] not in (" ", BLANK)][-2:]
    if len(places) < 2:
        return None
    first, last = places
    a, b = np.searchsorted(begins, places)
    c, d = np.searchsorted(later_begins, places)
    if begins[a:a + 1].tolist() != [first] or later_begins[c:c + 1].tolist() != [first]:
        return None
    if b < len(begins) and begins[b] != last or d < len(later_begins) and later_begins[d] != last:
        return None
    return last if np.array_equal(ids[a:b], later[c:d]) else None


_MODELS: dict[int, PieceModel] = {}


def model_of(shared) -> PieceModel:
    raw = shared.value
    if hash(raw) not in _MODELS:
        _MODELS.clear()
        _MODELS[hash(raw)] = PieceModel(raw)
    return _MODELS[hash(raw)]


def share_model(spark: SparkSession, path: str):
    """The model file as a broadcast; only the driver reads the path."""
    with open(path, "rb") as file:
        raw = file.read()
    if len(raw) > MODEL_BYTES:
        raise ValueError(f"a model file of {len(raw)} bytes is not broadcast")
    return spark.sparkContext.broadcast(raw)


def count(texts: pa.Array, model: PieceModel, chunk: int = CHUNK, overlap: int = OVERLAP) -> pa.Array:
    _, offsets = flat(texts)
    values = [t or "" for t in texts.to_pylist()]
    tokens, chunks, widened = [0] * len(values), [1] * len(values), [0] * len(values)
    short = [k for k, t in enumerate(values) if len(t) <= chunk]
    for k, n in zip(short, model.counts([values[k] for k in short]) if short else ()):
        tokens[k] = n
    for k, t in enumerate(values):
        if len(t) > chunk:
            tokens[k], chunks[k], widened[k] = model.long_count(t, chunk, overlap)
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(offsets)), pa.array(tokens, pa.int64()), pa.array(chunks, pa.int32()), pa.array(widened, pa.int32())],
        ["n_bytes", "n_tokens", "chunks", "widened"])


def with_token_counts(
    docs: DataFrame, model, text: str = "text", out: str = "counted", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """`docs` plus struct(n_bytes, n_tokens, chunks, widened, over_limit) of each whole text.

    `model` is a broadcast of `share_model`. Null texts count as empty, with no bytes and no
    tokens. Every row is counted for itself; an empty table gives an empty one; an input
    column called as `out` is replaced.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = model_of(model)
        for texts in batches:
            for start, stop in pieces(texts):
                yield count(texts.slice(start, stop - start), ready, chunk, overlap)

    schema = "struct<n_bytes:bigint, n_tokens:bigint, chunks:int, widened:int>"
    counted = with_result(docs, out, F.arrow_udf(run, schema).asNondeterministic()(F.col(text)))
    return counted.withColumn(out, F.col(out).withField("over_limit", F.col(out)["n_tokens"] > limit))
