"""Near duplicates by word shingles: a chosen-path similarity join with exact verification.

1. Every text becomes the set of its shingles of five words (64-bit hashes), the set a digest
   and SAMPLED min-hash tokens. Equal digests are one class, represented by its first row.
2. A run splits the representatives on one sampled token (sometimes two, as many as 1 / SIMILARITY
   in the mean): those that share it stay together. A bucket of LEAF_SIZE or fewer is compared
   by brute force on the sampled tokens; a larger one is split again on a token chosen by its
   path. What is still large after DEPTH splits is compared in blocks, pair by pair of blocks.
   RUNS runs make the chance to part a pair of similarity 0.8 each time less than 1 - RECALL.
3. The candidate links give groups. Inside a group every pair is compared exactly on the whole
   sets, in blocks again where the group is large, so that links are counted and no list of
   pairs is ever made. Links joining different texts connect the final classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plaintscope.llm.components import connected_components
from plaintscope.llm.textarrays import LOWER, SPACED, Words, flat, mix, pieces, text_udf
from plaintscope.session import small_side, stage

SHINGLE = 5
SIMILARITY = 0.8
SAMPLED = 64        # min-hash tokens of a set
LEAF_SIZE = 32
DEPTH = 4
RECALL = 0.999
BLOCK = 512         # rows of a block where a bucket or group is large
MARGIN = 4          # standard deviations that an estimate may fall short of SIMILARITY

COIN = mix(np.arange(1, 2 * SAMPLED + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
FACTOR = mix(np.arange(101, 101 + SAMPLED, dtype=np.uint64)) | np.uint64(1)
LEAST_ESTIMATE = SIMILARITY - MARGIN * math.sqrt(SIMILARITY * (1 - SIMILARITY) / SAMPLED)


def meet_chance(similarity: float, depth: int) -> float:
    """Chance that a pair shares a path of `depth` splits, one sampled token or two at each."""
    more, chance = 1 / SIMILARITY - 1, 1.0
    for _ in range(depth):
        part = 1 - similarity * chance
        chance = 1 - ((1 - more) * part + more * part * part)
    return chance


RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - meet_chance(SIMILARITY, DEPTH)))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts in text order, offsets of the texts in them).

    Words are parted by white space, A-Z lower-cased. A text of fewer than five words is one
    shingle; one without words has none.
    """
    data, offsets = flat(texts)
    words = Words(LOWER[data], offsets, SPACED)
    value, n = words.values(), len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    place = np.arange(n) - words.first[:-1][words.text]
    left = words.per_text[words.text] - place
    size = np.minimum(words.per_text, SHINGLE)[words.text]
    shingle = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        shifted = np.zeros(n, np.uint64)
        shifted[:n - k] = value[k:]
        shingle += np.where(k < size, mix(shifted + np.uint64(k + 1)) * FACTOR[k], np.uint64(0))
    at = left >= size
    text, shingle = words.text[at], mix(shingle[at])
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), np.bool_)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    return shingle, np.searchsorted(text, np.arange(len(texts) + 1))


def digest(shingle: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, 0 for an empty one."""
    out = []
    for factor in (FACTOR[10], FACTOR[11]):
        total = np.zeros(len(shingle) + 1, np.uint64)
        np.cumsum(mix(shingle * factor), out=total[1:])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def sampled_tokens(shingle: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """sets x SAMPLED min-hash tokens; zeros for empty sets."""
    tokens = np.zeros((len(offsets) - 1, SAMPLED), np.uint32)
    some = np.diff(offsets) > 0
    if len(shingle):
        for k in range(SAMPLED):
            tokens[some, k] = np.minimum.reduceat((((shingle ^ COIN[k]) * FACTOR[k]) >> np.uint64(32)).astype(np.uint32), offsets[:-1][some])
    return tokens


def children(path: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) one split further. The path alone chooses the tokens to split on."""
    coin = mix(path)
    first = (coin % np.uint64(SAMPLED)).astype(np.int64)
    again = mix(coin + np.uint64(1))
    twice = (again >> np.uint64(11)).astype(np.float64) / 2.0 ** 53 < 1 / SIMILARITY - 1
    second = (first + 1 + (mix(again) % np.uint64(SAMPLED - 1)).astype(np.int64)) % SAMPLED
    rows = np.arange(len(path))

    def child(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix(mix(coin[which] + COIN[SAMPLED + at]) ^ tokens[which, at].astype(np.uint64))

    more = rows[twice]
    return np.concatenate((rows, more)), np.concatenate((child(rows, first), child(more, second[twice])))


def token_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SAMPLED)


def set_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, d1, d2, size, tokens) for every row of `docs`; row is a number given here."""
    kind = docs.schema[key].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                shingle, offsets = shingle_sets(batch.column(1).slice(a, b - a))
                d1, d2 = digest(shingle, offsets)
                tokens = sampled_tokens(shingle, offsets)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + b - a)), batch.column(0).slice(a, b - a), pa.array(d1), pa.array(d2),
                    pa.array(np.diff(offsets)), pa.array([t.tobytes() for t in tokens], pa.binary())],
                    ["row", "key", "d1", "d2", "size", "tokens"])
                row += b - a

    return docs.select(key, text).mapInArrow(made, f"row bigint, key {kind}, d1 bigint, d2 bigint, size bigint, tokens binary")


def first_split(sets: DataFrame) -> DataFrame:
    """(rep, path) of every run after its first split."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, RUNS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            tokens, rep = token_matrix(batch.column("tokens")), batch.column("rep").to_numpy()
            for root in roots:
                rows, paths = children(np.full(len(rep), root), tokens)
                yield pa.RecordBatch.from_arrays([pa.array(rep[rows]), pa.array(paths.view(np.int64))], ["rep", "path"])

    return sets.select("rep", "tokens").mapInArrow(split, "rep bigint, path bigint")


def next_split(bucket_rows: DataFrame) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column("path").to_numpy().view(np.uint64)
            rows, paths = children(path, token_matrix(batch.column("tokens")))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("rep").to_numpy()[rows]), pa.array(paths.view(np.int64))], ["rep", "path"])

    return bucket_rows.select("path", "rep", "tokens").mapInArrow(split, "rep bigint, path bigint")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """(path, rep, n) of buckets with two representatives or more, staged."""
    rows = stage(rows)
    size = stage(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"))  # staged, so that a skewed join can be split
    return stage(rows.join(size, "path").select("path", "rep", "n"))


def in_blocks(rows: DataFrame, group: str, item: str, size: str, block: int = BLOCK) -> DataFrame:
    """`rows` plus (one, two): the pair of blocks of its group that the row is compared in.

    A group of up to `block` rows is one block paired with itself. A larger one is cut into
    k blocks by hash; every row goes to the k pairs that hold its block, so that each pair of
    rows meets at least once and no task gets more than about two blocks.
    """
    k = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(item), k).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda j: F.struct(
        F.least("__own", j).alias("one"), F.greatest("__own", j).alias("two")))
    return rows.withColumn("__k", k).withColumn("__own", own).withColumn("__pair", F.explode(pairs)).select(
        *rows.columns, F.col("__own").alias("own"), F.col("__pair.one").alias("one"), F.col("__pair.two").alias("two"))


def forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of `count` nodes under edges (a, b)."""
    label = np.arange(count)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def similar_pairs(start: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of equal bucket whose sampled tokens agree enough to connect every bucket
    as all such pairs would. `start` holds the first row of each bucket and the row count.
    """
    least = math.ceil(LEAST_ESTIMATE * SAMPLED)
    left, right = [], []
    sizes = np.diff(start)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes[group] <= LEAF_SIZE
    for gap in range(1, LEAF_SIZE):
        a = np.flatnonzero(small[:-gap] & (group[:-gap] == group[gap:]))
        if not len(a):
            break
        for at in np.array_split(a, -(-len(a) // 50_000)):
            near = at[(tokens[at] == tokens[at + gap]).sum(axis=1) >= least]
            left.append(near)
            right.append(near + gap)
    for g in np.flatnonzero(sizes > LEAF_SIZE):
        own = np.arange(start[g], start[g + 1])
        # All rows like the first one are connected by it; only the others meet every row.
        like = (tokens[own] == tokens[own[0]]).sum(axis=1) >= least
        left.append(own[like])
        right.append(np.full(int(like.sum()), own[0]))
        for other in own[~like]:
            near = own[(tokens[own] == tokens[other]).sum(axis=1) >= least]
            left.append(near)
            right.append(np.full(len(near), other))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def by_group(columns: list[str], work, schema: str):
    """`work` on whole groups of sorted rows: a mapInArrow function for rows sorted by `columns`.
    It gets a record batch of whole groups and the first row of each; several small groups
    come together, so the cost of a call is shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            start = edges(table)
            if len(start) > 1:
                yield from work(table.slice(0, start[-1]).combine_chunks(), start)
                table = table.slice(start[-1])
            held = table
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks(), np.array([0, held.num_rows]))

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, np.bool_)
        new[0] = True
        for c in columns:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    return run


def candidate_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) that connect representatives of similar sampled tokens inside each bucket."""
    def linked(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.unique(np.append(start, table.num_rows))
        tokens, rep = token_matrix(table.column("tokens")), table.column("rep").to_numpy()
        left, right = similar_pairs(start, tokens)
        label = forest(len(rep), left, right)
        other = np.flatnonzero(label != np.arange(len(rep)))
        yield pa.RecordBatch.from_arrays([pa.array(rep[other]), pa.array(rep[label[other]])], ["a", "b"])

    rows = in_blocks(buckets, "path", "rep", "n").join(sets.select("rep", "tokens"), "rep")
    order = ["path", "one", "two"]
    sorted_rows = rows.select(*order, "rep", "tokens").repartition(*order).sortWithinPartitions(*order, "rep")
    return sorted_rows.mapInArrow(by_group(order, linked, "a bigint, b bigint"), "a bigint, b bigint").distinct()


def verified_links(groups: DataFrame, similarity: float) -> DataFrame:
    """Exact comparison inside candidate groups.

    `groups`: component, n, rep, copies, text. Gives rows (rep, root, links): partial sums of
    the copies linked to `rep` (its own not counted) and a representative `root` that it is
    connected to (itself, if to none).
    """
    share = Fraction(similarity).limit_denominator(10_000)
    above, below = share.numerator, share.numerator + share.denominator

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", ignore_index=True)
        shingle, offsets = shingle_sets(pa.array(frame["text"], pa.string()))
        n, size = len(frame), np.diff(offsets)
        both = intersections(shingle, offsets)
        near = both * below >= above * (size[:, None] + size[None, :])
        np.fill_diagonal(near, False)
        one, two, own = frame["one"].iloc[0], frame["two"].iloc[0], frame["own"].to_numpy()
        if one != two:  # pairs inside a block are compared where the block meets itself
            near &= own[:, None] != own[None, :]
        label = forest(n, *np.nonzero(near))
        rep = frame["rep"].to_numpy()
        return pd.DataFrame({"rep": rep, "root": rep[label], "links": near @ frame["copies"].to_numpy()})

    rows = in_blocks(groups, "component", "rep", "n")
    return rows.groupBy("component", "one", "two").applyInPandas(compared, "rep bigint, root bigint, links bigint")


def intersections(shingle: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sets x sets: shingles in common, by products of slabs of the incidence matrix."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    _, column, times = np.unique(shingle, return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float64)
    both[np.arange(n), np.arange(n)] = np.diff(offsets)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    kept = np.unique(column)
    column = np.searchsorted(kept, column)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for first in range(0, len(kept), width):
        a, b = np.searchsorted(column, (first, first + width))
        slab = np.zeros((n, min(width, len(kept) - first)), np.float32)
        slab[owner[a:b], column[a:b] - first] = 1
        product = slab @ slab.T
        np.fill_diagonal(product, 0)
        both += product
    return both


def digest_udf():
    def digests(texts: pa.Array) -> pa.Array:
        d1, d2 = digest(*shingle_sets(texts))
        return pa.StructArray.from_arrays([pa.array(d1), pa.array(d2)], ["d1", "d2"])

    return text_udf(digests, "struct<d1:bigint, d2:bigint>")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: key, class_id, copy_id, n_links, and row, class, d1, d2 for callers.

    copy_id: least key of the rows with the same shingle set. class_id: least key of the rows
    connected by links of `similarity` or more. n_links: other rows linked to this one, copies
    included. Texts without words (null, empty, white space) link to nothing and are classes of
    their own. Rows with a null key take part; a class of only such rows has a null id. Repeated
    rows are copies of each other. An empty table gives an empty one; other columns are not used.
    """
    rows = stage(set_rows(docs, key, text))
    with_words = rows.filter("size > 0")
    classes = with_words.groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("key").alias("copy_id"))
    classes = stage(classes)
    sets = stage(with_words.join(classes.select(F.col("rep").alias("row"), "rep"), "row").select("rep", "tokens"))

    leaves, rows_of_level = [], first_split(sets)
    for depth in range(1, DEPTH + 1):
        buckets = shared_buckets(rows_of_level)
        leaves.append(buckets if depth == DEPTH else buckets.filter(F.col("n") <= LEAF_SIZE))
        large = buckets.filter(F.col("n") > LEAF_SIZE)
        if depth == DEPTH or large.isEmpty():
            break
        rows_of_level = next_split(large.join(sets, "rep"))
    links = candidate_links(reduce(DataFrame.unionByName, leaves), sets)
    candidates = stage(connected_components(links).withColumnRenamed("node", "rep"))

    members = classes.join(candidates, "rep").select("d1", "d2", "rep", "copies", "component")
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n"))
    members = stage(members.join(sizes, "component"))
    found = docs.select(F.col(text).alias("text")).withColumn("d", digest_udf()(F.col("text"))).select("text", "d.d1", "d.d2")
    texts = found.join(small_side(members), ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("component", "n", "rep", "copies", "text")
    compared = stage(verified_links(texts, similarity))
    joined = stage(connected_components(compared.select(F.col("rep").alias("a"), F.col("root").alias("b"))))
    links_of = compared.groupBy("rep").agg(F.sum("links").alias("links"))

    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(links_of, "rep", "left").select(
        "d1", "d2", "rep", "copies", "copy_id", F.coalesce("component", "rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    named = stage(named)
    ids = named.groupBy("class").agg(F.min("copy_id").alias("class_id"))
    named = named.join(ids, "class")
    alone = rows.filter("size = 0").select(
        "key", F.col("key").alias("class_id"), F.col("key").alias("copy_id"), F.lit(0).cast("bigint").alias("n_links"), "row", F.col("row").alias("class"), "d1", "d2")
    with_links = with_words.select("row", "key", "d1", "d2").join(named, ["d1", "d2"]).select(
        "key", "class_id", "copy_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "row", "class", "d1", "d2")
    return with_links.unionByName(alone).withColumnRenamed("key", key)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with one row of each class: the one of least key (null last), then of least digest.

    Rows are told apart by key and digest. The rows to drop are joined against the texts by a
    broadcast if they prove few enough, else by a shuffle. Rows equal in both to the one kept
    (repeated rows) are reduced to one at the end, where there are any.
    """
    found = stage(near_duplicates(docs, key, text, **settings).select(F.col(key).alias("key"), "class", "d1", "d2"))
    order = F.struct(F.col("key").isNull(), "key", "d1", "d2")
    best = found.groupBy("class").agg(F.min(order).alias("best"))
    triple = found.groupBy("class", "key", "d1", "d2").agg(F.count("*").alias("same")).join(best, "class")
    triple = stage(triple.select(F.col("key").alias("__key"), F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "same", (order == F.col("best")).alias("first")))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__d.d1") == F.col("__d1")) & (F.col("__d.d2") == F.col("__d2"))
    marked = docs.withColumn("__d", digest_udf()(F.col(text)))
    kept = marked.join(small_side(triple.filter("NOT first").select("__key", "__d1", "__d2")), same, "left_anti")
    repeated = triple.filter("first AND same > 1 AND (__d1 != 0 OR __d2 != 0)").select("__key", "__d1", "__d2", F.lit(True).alias("__again"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    told = kept.join(small_side(repeated), same, "left")
    once = told.filter("__again").dropDuplicates(["__key", "__d1", "__d2"])
    return told.filter("__again IS NULL").unionByName(once).select(*docs.columns)
