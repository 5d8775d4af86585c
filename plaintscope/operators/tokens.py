"""Token arrays against tables: stop tables, stem tables, word frequencies, samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.ml.feature import StopWordsRemover

from plaintscope.functions import fixed_values as fv
from plaintscope.functions.text import remove_stops, strip
from plaintscope.operators.ordered import top_per_group
from plaintscope.session import cols, stage


# Stop tables up to this size are used as a set of literals: another plan, the same rows.
LISTED_TERMS = 5_000


# Tables of so many rows and bytes travel to the tasks; of a larger one only what occurs in the text.
LOOKUP_ROWS, LOOKUP_BYTES = 1_000_000, 64 << 20


def _in_tasks(table: DataFrame, max_rows: int):
    """A broadcast of the table's columns as Arrow arrays; None if it is too large."""
    size = table.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in table.columns)), F.lit(0))).first()
    if size[0] > max_rows or size[1] > LOOKUP_BYTES:
        return None
    held = table.toArrow()
    return table.sparkSession.sparkContext.broadcast([held.column(c).combine_chunks() for c in table.columns])


def _lookup(df: DataFrame, tokens: str, table: DataFrame, max_rows: int):
    """The table for the tasks (see `_in_tasks`), or, of a larger one, its rows for the distinct
    tokens of `df`; None if these are too many as well. `table` has a column `token`."""
    shared = _in_tasks(table, max_rows)
    if shared is None:
        said = df.select(F.explode(tokens).alias("token")).distinct()
        shared = _in_tasks(stage(table.join(said, "token", "left_semi")), max_rows)
    return shared


def _changed(df: DataFrame, tokens: str, shared, change) -> DataFrame:
    """`df` with new token arrays, made where the rows are. `change` gets a batch's tokens and the
    table's columns, and returns the new tokens and which of the old ones stay."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, lengths = batch.flatten(), batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, stays = change(flat, *shared.value)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            offsets = np.concatenate(([0], np.cumsum(stays)))[ends].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), values, mask=batch.is_null())

    return df.withColumn(tokens, F.arrow_udf(run, "array<string>").asNondeterministic()(F.col(tokens)))


def _rewrite(df: DataFrame, tokens: str, change) -> DataFrame:
    """Explode token arrays, let `change` filter or rename `token`, put them back in order.

    Rows are told apart by a digest of all their columns, so blank, null or repeated ids merge
    nothing and gather nowhere. Equal rows are folded into one with a count, map-side, and
    unfolded at the end. Only (row, place, token) goes through `change`; texts and other
    columns stay with the folded rows. A null array stays null.
    """
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    digest = F.struct(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b"))
    folded = df.groupBy(digest.alias("__row")).agg(F.first(row).alias("__all"), F.count(F.lit(1)).alias("__times"))
    whole = folded.select("__row", "__times", *[F.col(f"__all.c{i}").alias(c) for i, c in enumerate(df.columns)])
    long = whole.select("__row", F.posexplode(tokens).alias("at", "token"))
    back = change(long).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "token")))["token"].alias("__new"))
    joined = whole.join(back, "__row", "left").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    changed = F.when(F.col(tokens).isNotNull(), F.coalesce("__new", F.array().cast("array<string>")))
    return joined.select(*[changed.alias(c) if c == tokens else F.col(c) for c in df.columns])


def drop_tokens(df: DataFrame, tokens: str, stops: DataFrame, term: str = "term", max_listed: int = LISTED_TERMS,
                max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Remove stop words held in a table of any size; repeats of other tokens, null tokens and
    null arrays stay.

    A table of up to `max_listed` terms becomes a set inside the expression; a larger one travels
    to the tasks, cut to what occurs in the text if it must be. In neither case does a text move.
    Only if more than `max_rows` of its terms occur are the tokens anti-joined. All give the same
    rows.
    """
    terms = stage(stops.select(F.col(term).alias("token")).filter(F.col(term).isNotNull()).distinct())
    listed = terms.limit(max_listed + 1).collect()
    if len(listed) <= max_listed:
        return df.withColumn(tokens, remove_stops(tokens, [r.token for r in listed]))
    shared = _lookup(df, tokens, terms, max_rows)
    if shared is None:
        return _rewrite(df, tokens, lambda long: long.join(terms, "token", "left_anti"))

    def change(flat: pa.Array, stop: pa.Array) -> tuple[pa.Array, np.ndarray]:
        stays = pc.index_in(flat, value_set=stop, skip_nulls=True).is_null()
        return flat.filter(stays), stays.to_numpy(zero_copy_only=False)

    return _changed(df, tokens, shared, change)


def apply_stems(df: DataFrame, tokens: str, stems: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Replace each token by its stem from a (token, stem) table; unknown tokens stay.

    The table travels to the tasks, cut to the tokens that occur if it must be, and no text moves.
    Only if more than `max_rows` of its tokens occur are the tokens joined instead.
    """
    table = stage(stems.filter(F.col("token").isNotNull()).groupBy("token").agg(F.min("stem").alias("stem")))
    shared = _lookup(df, tokens, table, max_rows)
    if shared is None:
        return _rewrite(df, tokens, lambda long: long.join(table, "token", "left").select("__row", "at", F.coalesce("stem", "token").alias("token")))

    def change(flat: pa.Array, token: pa.Array, stem: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return pc.coalesce(stem.take(pc.index_in(flat, value_set=token, skip_nulls=True)), flat), np.ones(len(flat), np.int64)

    return _changed(df, tokens, shared, change)


def stem_with(tokens: Column, stemmer) -> Column:
    """Hook for a stemmer library: `stemmer` maps one pandas Series of token lists to
    another and runs Arrow-batched inside the tasks."""
    return F.pandas_udf(stemmer, "array<string>")(tokens)


def word_frequencies(df: DataFrame, groups: str | list[str], tokens: Column) -> DataFrame:
    """Occurrences per group and term, combined map-side before the shuffle."""
    groups = cols(groups)
    return df.select(*groups, F.explode(tokens).alias("term")).groupBy(*groups, "term").agg(
        F.count(F.lit(1)).alias("n")
    )


def top_words(df: DataFrame, groups: str | list[str], tokens: Column, n: int = fv.TOP_WORDS) -> DataFrame:
    return top_per_group(
        word_frequencies(df, groups, tokens), groups, [F.col("n").desc(), F.col("term").asc()], n, ["term"]
    )


def build_stopwords(lists: dict[str, list[str]] | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """(category, term) rows, lower-cased, trimmed, blanks and repeats removed."""
    if isinstance(lists, dict):
        rows = [(name, word) for name, words in lists.items() for word in words]
        lists = spark.createDataFrame(rows, "category string, term string")
    return (
        lists.select("category", strip(F.lower("term")).alias("term"))
        .filter(F.col("term") != "")
        .distinct()
    )


def stopword_terms(stops: DataFrame) -> DataFrame:
    return stops.select("term").distinct()


def stopword_sizes(stops: DataFrame) -> DataFrame:
    return stops.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def default_stopwords(spark: SparkSession, language: str = "turkish") -> DataFrame:
    """The list shipped with Spark, as a base to add own categories to."""
    words = StopWordsRemover.loadDefaultStopWords(language)
    return build_stopwords({f"spark_{language}": words}, spark)


def stable_sample(df: DataFrame, key: str, n: int = 3, seed: int = fv.SEED, pool: Column | None = None) -> DataFrame:
    """`n` rows chosen by hash order of (seed, key): same rows on every run and cluster.

    With a pool the rows come from it alone, fewer if it is smaller than n; only an empty
    pool is replaced by the whole table.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    outside = F.lit(0) if pool is None else F.when(F.coalesce(pool, F.lit(False)), 0).otherwise(1)
    if pool is None:
        return df.orderBy(digest, key).limit(n)
    # An existing pool is never topped up with outsiders; only an empty one is replaced.
    # The window sees the n chosen rows only.
    chosen = df.withColumn("__out", outside).orderBy("__out", digest, key).limit(n)
    best = F.min("__out").over(Window.partitionBy(F.lit(0)))
    return chosen.withColumn("__best", best).filter("__out = __best").select(*df.columns)
