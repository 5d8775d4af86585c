"""Quality scores: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Each text becomes a short vector of statistics. cos(w x + b) with normal w approximates a
Gaussian kernel, so a linear fit on such features is a kernel fit of fixed size. Every
partition sums its part of the normal equations, the parts are added in a tree, and the
driver solves one system of FEATURES + 1 unknowns. Raw scores of labelled rows kept out of
the fit are binned, made monotone by pooling, and give the map from raw score to probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plaintscope.llm.quality_rules import SYMBOL, repeated_lines
from plaintscope.llm.textarrays import SPACED, Words, flat, mix, per_text, text_udf, with_result
from plaintscope.session import stage

FEATURES = 256         # random features
WIDTH = 3.0            # kernel width, in standard deviations of the statistics
RIDGE = 1e-3           # per labelled row
CALIBRATION_FOLD = 5   # one labelled row in so many calibrates, the others fit
BINS = 2000            # bins of raw scores for the calibration
SEED = 20240601

STATISTICS = (
    "words", "word_bytes", "distinct_words", "distinct_pairs", "same_as_before", "commonest_word", "symbols", "bars",
    "exclamations", "other_marks", "upper", "digits", "beyond_ascii", "lines", "repeated_lines", "upper_words",
)


def _is(*ranges: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(256, np.bool_)
    for a, b in ranges:
        mask[a:b + 1] = True
    return mask


UPPER, LOWER_CASE, DIGIT = _is((65, 90)), _is((97, 122)), _is((48, 57))
MARKS = _is((33, 47), (58, 64), (91, 96), (123, 126)) & ~SYMBOL


def statistics(texts: pa.Array) -> pa.Array:
    data, offsets = flat(texts)
    words = Words(data, offsets, SPACED)
    count, size = words.per_text.astype(np.float64), np.diff(offsets).astype(np.float64)
    n, per_char = np.maximum(count, 1), lambda mask: per_text(mask[data], offsets) / np.maximum(size, 1)
    value = words.values()
    own = value ^ mix((words.text + 1).astype(np.uint64))

    follows = np.zeros(len(words), np.bool_)
    follows[1:] = words.text[1:] == words.text[:-1]
    same = follows.copy()
    same[1:] &= value[1:] == value[:-1]
    pair = own.copy()
    pair[1:] = mix(own[1:] * np.uint64(3) + own[:-1])
    distinct, commonest = _distinct(own, words.text, len(texts))
    pairs, _ = _distinct(pair[follows], words.text[follows], len(texts))
    upper_at = np.zeros(len(words), np.bool_)
    if len(words):
        big = np.concatenate(([0], np.cumsum(UPPER[data])))
        small = np.concatenate(([0], np.cumsum(LOWER_CASE[data])))
        upper_at = (big[words.ends] - big[words.starts] > 1) & (small[words.ends] == small[words.starts])
    letters = np.maximum(per_text((UPPER | LOWER_CASE)[data], offsets), 1)
    lines = per_text(data == 10, offsets) + 1.0
    again = np.fromiter((repeated_lines(t) for t in texts.to_pylist()), np.float64, len(texts))
    rare = lambda x: np.log(x + 1e-3)
    columns = [
        np.log1p(count), np.log1p(per_text(words.keep, offsets) / n), distinct / n, pairs / np.maximum(count - 1, 1),
        rare(per_text(same, words.first) / n), rare(commonest / n), rare(per_char(SYMBOL)), rare(per_char(_is((124, 124)))),
        rare(per_char(_is((33, 33)))), rare(per_char(MARKS)), rare(per_text(UPPER[data], offsets) / letters), rare(per_char(DIGIT)),
        rare(per_char(_is((128, 255)))), np.log1p(count / lines), rare(again / lines), rare(per_text(upper_at, words.first) / n),
    ]
    return pa.StructArray.from_arrays([pa.array(c.astype(np.float64)) for c in columns], list(STATISTICS))


def _distinct(values: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text and the count of its commonest one (values differ between texts)."""
    _, first, count = np.unique(values, return_index=True, return_counts=True)
    most = np.zeros(texts)
    np.maximum.at(most, text[first], count)
    return np.bincount(text[first], minlength=texts).astype(np.float64), most


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray      # calibration: raw scores ...
    share: np.ndarray    # ... and the probability at each

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(size=(x.shape[1], FEATURES)) / WIDTH
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        scaled = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(scaled @ w + b)
        z *= np.sqrt(2 / FEATURES)
        return np.concatenate((z, np.ones((len(x), 1))), axis=1)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_scores(x), self.raw, self.share)


def matrix(batch: pa.StructArray | pa.RecordBatch) -> np.ndarray:
    columns = batch.flatten() if isinstance(batch, pa.StructArray) else [batch.column(c) for c in STATISTICS]
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1) if len(columns) else np.zeros((0, 0))


def pooled(rows: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Monotone shares for (raw score, rows, positives) in order of raw score: neighbours that
    fall are pooled. Half a row of each kind is added to a pool, so no share is 0 or 1."""
    pools: list[list[float]] = []
    for raw, n, positive in rows:
        pools.append([raw * n, n, positive])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    share = [(p + 0.5) / (n + 1) for _, n, p in pools]
    return np.array([r / n for r, n, _ in pools]), np.maximum.accumulate(share)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model | None:
    """A model from statistics (`key`, `statistics`) and labels, or None if there is nothing to learn.

    Labels of one id are averaged; null labels and ids, and held-out rows, are left out. All
    remaining labelled rows take part.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).alias("__id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    rows = measured.join(known, measured[key] == known["__id"]).select(
        "statistics.*", "label", (F.pmod(F.xxhash64("__id"), F.lit(CALIBRATION_FOLD)) == 0).alias("calibrates"))
    rows = stage(rows)
    moments = rows.agg(F.count("*"), *[f(c) for c in STATISTICS for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1::2], float), np.array(moments[2::2], float)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        n = 0
        for batch in batches:
            z = model.features(matrix(batch))
            left += z.T @ z
            right += z.T @ batch.column("label").to_numpy()
            n += len(z)
        if n:
            yield pa.RecordBatch.from_pydict({"sums": [np.concatenate((left.ravel(), right, [n])).tobytes()]})

    parts = rows.filter(~F.col("calibrates")).mapInArrow(equations, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums))
    if parts.isEmpty():
        return None
    total = parts.treeReduce(np.add)
    size = FEATURES + 1
    left, right, n = total[:size * size].reshape(size, size), total[size * size:-1], total[-1]
    model.weights = np.linalg.solve(left + RIDGE * n * np.eye(size), right)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"raw": model.raw_scores(matrix(batch)), "label": batch.column("label")})

    raw = rows.filter("calibrates").mapInArrow(scored, "raw double, label double")
    bins = raw.groupBy(F.floor(F.col("raw").try_cast("double") * (BINS // 4)).alias("bin")).agg(
        F.avg("raw").alias("raw"), F.count("*").alias("n"), F.sum("label").alias("positive"))
    table = [(r.raw, r.n, r.positive) for r in bins.orderBy("bin").collect()]
    if table:
        model.raw, model.share = pooled(table)
    else:  # too few rows to calibrate with
        model.raw, model.share = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def with_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", out: str = "quality",
) -> DataFrame:
    """`docs` plus struct(held_out, score, predicted).

    Two passes over the texts: the first takes the statistics of all rows and keeps, narrow and
    staged, those of labelled ones to learn from; the second scores every row. No text is
    shuffled or stored.
    Only the text is an input of the score. Null and empty texts are scored like any other, by
    their (zero) statistics. With no labels to learn from every score is 0.5. Rows with a null
    id are scored and not learned from; repeated rows are scored alike; empty tables give an
    empty one; an input column called as `out` is replaced.
    """
    schema = "struct<" + ", ".join(f"{c}:double" for c in STATISTICS) + ">"
    measured = docs.select(key, text_udf(statistics, schema)(F.col(text)).alias("statistics"))
    model = fit(measured, labels, key, label)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(matrix(statistics(texts))))

    score = F.lit(0.5) if model is None else text_udf(scored, "double")(F.col(text))
    found = with_result(docs, out, F.struct(held_out(F.col(key)).alias("held_out"), score.alias("score")))
    return found.withColumn(out, F.col(out).withField("predicted", F.when(F.col(out)["score"] >= 0.5, 1).otherwise(0)))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rows of `docs` that score 0.5 or more, with their columns as they were."""
    mark = "__quality"
    return with_quality(docs, labels, out=mark, **settings).filter(F.col(mark)["predicted"] == 1).select(*docs.columns)
