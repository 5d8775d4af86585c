"""Ranked lexical search by hashed max-sketches.

Index: one row a document with its number of terms, a sketch, and its terms (64-bit hashes) with
their counts. The sketch has two rows of coordinates, each by other bits of the hash; a coordinate
is the largest count among the terms that hash to it. A term's impact rises with its count in the
document, so the impact of that maximum is the maximum of the impacts, whatever the corpus
statistics are by the time of the search. A row is at least four times as wide as the document
has distinct terms, and the lesser of a term's two coordinates bounds its count, so a term that the
document lacks seldom adds to the bound.

Search: items are searched in blocks. A task looks up the coordinates of all terms of a block in
its sketches at once; weighted sums give an upper bound of every (document, item) score. For each
item, documents are scored exactly from their terms by falling bound until the next bound is below
the worst of the best scores so far. What the tasks found is merged to the best of all.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plaintscope.llm.textarrays import ALNUM, LOWER, Words, flat, mix, pieces
from plaintscope.session import checkpoint_dir

BEST = 10
ROWS = 2               # of coordinates in a sketch
LOAD = 4               # coordinates a distinct term in each row, at least
LEAST_WIDTH = 64
UNBOUNDED = 255        # a count the sketch does not hold: its impact counts as the largest possible
LARGEST = 1_000_000    # no impact reaches it
BLOCK_ITEMS = 256      # items searched in one pass, about ...
BLOCK_BYTES = 1 << 20  # ... and bytes of their text
CELLS = 1 << 22        # (document, term) pairs whose bounds are computed at once
FIRST = 16             # documents scored exactly for an item before the threshold is looked at again
INDEX = "key bigint, n bigint, sketch binary, terms binary, counts binary"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text; then, text by text, the text, the hash and the count of each distinct term)."""
    data, offsets = flat(texts)
    words = Words(LOWER[data], offsets, ALNUM)
    value = words.values()
    own = value ^ mix((words.text + 1).astype(np.uint64))  # differs between texts
    _, first, counts = np.unique(own, return_index=True, return_counts=True)
    order = np.argsort(words.text[first], kind="stable")
    first = first[order]
    return words.per_text, words.text[first], value[first], counts[order]


def coordinate(terms: np.ndarray, width: np.ndarray | int, row: int) -> np.ndarray:
    """Place of each term in a row of a sketch, whose width is a power of two."""
    return ((terms >> np.uint64(32 * row)) & np.asarray(width - 1, np.uint64)).astype(np.int64)


def sketches(text: np.ndarray, terms: np.ndarray, counts: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(all sketches one after the other, row after row, their offsets)."""
    distinct = np.bincount(text, minlength=texts)
    width = np.full(texts, LEAST_WIDTH, np.int64)
    wide = distinct * LOAD > LEAST_WIDTH
    width[wide] = 1 << np.ceil(np.log2(distinct[wide] * LOAD)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(ROWS * width)))
    found, held = np.zeros(offsets[-1], np.uint8), np.minimum(counts, UNBOUNDED).astype(np.uint8)
    for row in range(ROWS):
        np.maximum.at(found, offsets[text] + row * width[text] + coordinate(terms, width[text], row), held)
    return found, offsets


def binaries(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary array: `values` cut at `offsets` (in values)."""
    at = (offsets * values.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary array and where each row's begin."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = memoryview(data)[offsets[0]:offsets[-1]] if data is not None else b""
    return np.frombuffer(raw, kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def write_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Index every whole text of `docs`. Null texts have no terms; null keys and repeated rows are
    documents of their own; an empty table gives an empty index; other columns are not used. A very
    long text is one row of the index, in proportion to its distinct terms."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in pieces(batch.column("text")):
                texts = batch.column("text").slice(at, stop - at)
                n, owner, terms, counts = terms_of(texts)
                found, offsets = sketches(owner, terms, counts, len(texts))
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(at, stop - at), pa.array(n.astype(np.int64)), binaries(offsets, found),
                     binaries(ends, terms), binaries(ends, counts.astype(np.uint32))], ["key", "n", "sketch", "terms", "counts"])

    docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(indexed, INDEX).write.parquet(path)


@dataclass
class Block:
    """Items to search for in one pass, and what the corpus says of their terms."""

    terms: np.ndarray          # sorted hashes of all their terms
    columns: list[np.ndarray]  # of each item: places of its terms ...
    times: list[np.ndarray]    # ... and how often it has each
    documents: int = 0         # with a term
    total: int = 0             # terms of all documents
    weight: np.ndarray | None = None

    def middles(self, n: np.ndarray) -> np.ndarray:
        """Each document's m, from its number of terms."""
        if 75 * int(n.max(initial=0)) * self.documents < 2**63:
            return 25 + 75 * n * self.documents // self.total
        return np.array([25 + 75 * x * self.documents // self.total for x in n.tolist()], np.int64)

    def weigh(self, holding: np.ndarray) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * d + 1))) for d in holding.tolist()], np.int64)


def block_of(texts: list[str | None]) -> Block:
    _, item, hashes, counts = terms_of(pa.array(texts, pa.string()))
    terms = np.unique(hashes)
    place = np.searchsorted(terms, hashes)
    cuts = np.searchsorted(item, np.arange(1, len(texts)))
    return Block(terms, np.split(place, cuts), np.split(counts.astype(np.int64), cuts))


def known(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which `terms` are in the sorted vocabulary, their places in it)."""
    place = np.minimum(np.searchsorted(vocabulary, terms), max(len(vocabulary) - 1, 0))
    found = np.flatnonzero(vocabulary[place] == terms) if len(vocabulary) else np.zeros(0, np.int64)
    return found, place[found]


def impact(counts: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * middle)


class Best:
    """The best documents of each item so far: by falling score, then rising key, nulls last."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.scores = [np.zeros(0, np.int64)] * items
        self.keys = [np.zeros(0, np.int64)] * items
        self.null = [np.zeros(0, np.bool_)] * items

    def threshold(self, item: int) -> int:
        """A document below it cannot be among the best."""
        scores = self.scores[item]
        return int(scores[-1]) if len(scores) >= self.best else 1

    def add(self, item: int, scores: np.ndarray, keys: np.ndarray, null: np.ndarray) -> None:
        use = scores >= self.threshold(item)
        scores, keys, null = (np.concatenate((a[item], b[use])) for a, b in ((self.scores, scores), (self.keys, keys), (self.null, null)))
        order = np.lexsort((keys, null, -scores))[:self.best]
        self.scores[item], self.keys[item], self.null[item] = scores[order], keys[order], null[order]


class Documents:
    """Rows of the index, as a task searches them."""

    def __init__(self, batch: pa.RecordBatch, block: Block):
        self.block = block
        self.null = batch.column("key").is_null().to_numpy(zero_copy_only=False)
        self.keys = batch.column("key").fill_null(0).to_numpy(zero_copy_only=False)
        self.middle = block.middles(batch.column("n").to_numpy(zero_copy_only=False))
        self.sketch, self.sketch_at = numbers(batch.column("sketch"), np.uint8)
        self.terms, self.terms_at = numbers(batch.column("terms"), np.uint64)
        self.counts, _ = numbers(batch.column("counts"), np.uint32)

    def bounds(self, rows: np.ndarray, width: int, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores (row, item) of documents whose sketches have this width."""
        table = np.concatenate([self.sketch[a:a + ROWS * width] for a in self.sketch_at[rows]]).reshape(-1, ROWS, width)
        counts = np.minimum.reduce([table[:, row][:, coordinate(self.block.terms, width, row)] for row in range(ROWS)])
        value = counts.astype(np.float32)
        value /= 1000 * value + 8 * self.middle[rows, None].astype(np.float32)
        value *= 1_000_000_000
        value[counts == UNBOUNDED] = LARGEST
        # A sum of k numbers that are not negative is off by k roundings at most.
        return (value @ weights) * np.float32(1 + 2.4e-7 * (max(map(len, self.block.columns), default=0) + 8)) + 1

    def exact(self, rows: np.ndarray) -> np.ndarray:
        """Impacts (row, term of the block) of some documents."""
        sizes = self.terms_at[rows + 1] - self.terms_at[rows]
        at = np.repeat(self.terms_at[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        found, place = known(self.block.terms, self.terms[at])
        owner = np.repeat(np.arange(len(rows)), sizes)[found]
        impacts = np.zeros((len(rows), len(self.block.terms)), np.int32)
        impacts[owner, place] = impact(self.counts[at[found]].astype(np.int64), self.middle[rows][owner])
        return impacts

    def search(self, best: Best, weights: np.ndarray) -> int:
        """Add the best documents; returns how many (document, item) scores were computed exactly."""
        widths, scored = np.diff(self.sketch_at) // ROWS, 0
        for width in np.unique(widths):
            same = np.flatnonzero(widths == width)
            step = max(1, CELLS // max(len(self.block.terms), ROWS * int(width), len(self.block.columns)))
            for k in range(0, len(same), step):
                scored += self.rescore(same[k:k + step], self.bounds(same[k:k + step], int(width), weights), best)
        return scored

    def rescore(self, rows: np.ndarray, bounds: np.ndarray, best: Best) -> int:
        block, scored, batch = self.block, 0, FIRST
        row_of = np.full(len(rows), -1)
        impacts = np.zeros((0, len(block.terms)), np.int32)
        queues = {}
        for item in range(len(block.columns)):
            near = np.flatnonzero(bounds[:, item] >= best.threshold(item)) if len(block.columns[item]) else ()
            if len(near):
                queues[item] = near[np.argsort(-bounds[near, item])]
        while queues:
            chosen = {}
            for item, queue in queues.items():
                head = queue[:batch]
                head = head[bounds[head, item] >= best.threshold(item)]
                if len(head):
                    chosen[item] = head
            if not chosen:
                break
            new = np.unique(np.concatenate(list(chosen.values())))
            new = new[row_of[new] < 0]
            row_of[new] = np.arange(len(impacts), len(impacts) + len(new))
            impacts = np.concatenate((impacts, self.exact(rows[new])))
            for item, head in chosen.items():
                columns = block.columns[item]
                scores = impacts[row_of[head][:, None], columns].astype(np.int64) @ (block.weight[columns] * block.times[item])
                best.add(item, scores, self.keys[rows[head]], self.null[rows[head]])
                scored += len(head)
            queues = {item: queues[item][batch:] for item in chosen if len(queues[item]) > batch}
            batch *= 4
        return scored


def search(
    index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", best: int = BEST, key: str = "doc_id",
    block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, key, score): the `best` documents of an index for each row of `items`.

    Equal scores are ranked by key, nulls last; documents without a term of the item, or of score
    0, are left out. Null and empty item texts find nothing; rows with a null or repeated id are
    searched for like others; empty items or an empty index give no rows. Items are searched in
    blocks of about `block_items` rows and `block_bytes` of text, so what is broadcast does not
    grow with them; each block is one pass over the index. Other columns are not used.
    """
    spark = index.sparkSession
    size = items.agg(F.count("*"), F.sum(F.octet_length(item_text))).first()
    blocks = max(1, -(-size[0] // block_items), -(-(size[1] or 0) // block_bytes))
    statistics = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    kind = items.schema[item_id].dataType
    found = spark.createDataFrame([], f"{item_id} {kind.simpleString()}, rank int, {key} bigint, score bigint")
    asked = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("passage")).filter("passage IS NOT NULL")
    for k in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id", "passage"), F.lit(blocks)) == k) if blocks > 1 else asked
        rows = part.collect()
        block = block_of([r.passage for r in rows])
        if not len(block.terms) or not statistics[1]:
            continue
        block.documents, block.total = statistics[0], statistics[1]
        block.weigh(document_counts(index, block.terms))
        names = spark.createDataFrame([(n, r.id) for n, r in enumerate(rows)], f"item int, id {kind.simpleString()}")
        ranked = best_of(index, block, best).join(F.broadcast(names), "item")
        found = found.unionByName(ranked.select(F.col("id").alias(item_id), "rank", F.col("key").alias(key), "score"))
    return found


def document_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents of the index that hold each of these (sorted) terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            total += np.bincount(known(shared.value, numbers(batch.column("terms"), np.uint64)[0])[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "documents": total[at]})

    sums = index.select("terms").mapInArrow(counted, "term bigint, documents bigint").groupBy("term").agg(F.sum("documents").alias("documents"))
    found = np.zeros(len(terms), np.int64)
    for r in sums.collect():
        found[r.term] = r.documents
    return found


def best_of(index: DataFrame, block: Block, best: int) -> DataFrame:
    """(item, rank, key, score) of one block; item is its place in the block."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value
        weights = np.zeros((len(ready.terms), len(ready.columns)), np.float32)
        for item, (columns, times) in enumerate(zip(ready.columns, ready.times)):
            weights[columns, item] = ready.weight[columns] * times
        kept = Best(len(ready.columns), best)
        for batch in batches:
            Documents(batch, ready).search(kept, weights)
        sizes = [len(s) for s in kept.scores]
        keys, null = np.concatenate(kept.keys), np.concatenate(kept.null)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()), pa.array(keys, pa.int64(), mask=null), pa.array(np.concatenate(kept.scores))],
            ["item", "key", "score"])

    each = index.mapInArrow(searched, "item int, key bigint, score bigint")
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("key")]
    # At most `best` rows a task and item. A first round ranks them in slices, so that an item's rows of very many tasks do not meet in one.
    slices = Window.partitionBy("item", F.pmod(F.xxhash64("key", "score"), F.lit(16))).orderBy(*order)
    some = each.withColumn("r", F.row_number().over(slices)).filter(F.col("r") <= best).drop("r")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= best)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/lexical-{uuid.uuid4().hex}"
