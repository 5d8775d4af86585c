"""The analysis end to end: each step reads tables and leaves a parquet stage or report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintscope.functions import fixed_values as fv, text as X
from plaintscope.functions.scalars import binarise
from plaintscope.operators import classify as M, distribution as D, profile as P, reports as R, tokens as K, topics as T
from plaintscope.operators.categories import category_counts, category_share, split_keywords, top_categories
from plaintscope.session import spread, stage
from plaintscope.sources import sinks
from plaintscope.sources.complaints import load_sources, with_derived


def collect(spark: SparkSession, paths: dict[str, str], names: dict[str, str], out: str) -> DataFrame:
    """Sources, tagged, stacked and derived, as the raw stage."""
    whole = spread(load_sources(spark, paths, names), "id")
    raw = with_derived(whole).withColumn("resolved", binarise("is_resolved", fv.RESOLVED))
    sinks.write_table(raw, out)
    return spark.read.parquet(out)


def profile(raw: DataFrame, out: str, mapping: DataFrame | None = None) -> dict[str, DataFrame]:
    """Null report, summary and chart tables, written as CSV reports and returned."""
    resolved = F.col("resolved") == 1
    tables = {
        "null_report": P.null_profile(raw, "group_key", "satisfaction", "keywords", "company_reply"),
        "summary": P.summary(raw, "group_key", resolved, "satisfaction", "n_words", "view_count"),
        "precheck": P.quality_precheck(raw, "group_key", resolved, "satisfaction"),
        **R.chart_tables(raw, "group_key", resolved, "satisfaction", "month", "company_reply", "view_count",
                         ["satisfaction", "keywords", "company_reply", "view_count"]),
    }
    if mapping is not None:
        counts = category_counts(raw, mapping, "group_key", split_keywords("keywords"))
        tables["categories"] = top_categories(category_share(stage(counts), "group_key"), "group_key")
    for name, table in tables.items():
        sinks.write_report(table, f"{out}/{name}")
    return tables


def clean(
    raw: DataFrame, out: str, stops: list[str] | DataFrame, stems: DataFrame | None = None,
    stemmer: Callable | None = None, key: str = "id", locale: str | None = "tr",
) -> DataFrame:
    """Tokens with and without stemming; texts that clean to nothing are dropped.

    Stop words may be a list or a table, stems a (token, stem) table or a batch stemmer.
    """
    as_list = stops if isinstance(stops, list) else []
    df = raw.withColumn("tokens", X.word_tokens("full_text", as_list, locale=locale))
    if not isinstance(stops, list):
        df = K.drop_tokens(df, "tokens", stops)
    df = df.withColumn("stemmed", F.col("tokens"))
    if stems is not None:
        df = K.apply_stems(df, "stemmed", stems)
    elif stemmer is not None:
        df = df.withColumn("stemmed", K.stem_with(F.col("stemmed"), stemmer))
    df = df.withColumn("stemmed", X.min_token_len("stemmed"))
    df = df.withColumns({"clean_text": X.join_tokens("stemmed"), "n_clean_words": F.size("stemmed")})
    sinks.write_table(df.filter(X.min_len("clean_text", 3)), out)
    return raw.sparkSession.read.parquet(out)


def find_topics(cleaned: DataFrame, out: str, groups: list[str], key: str = "id", **options) -> dict[str, DataFrame]:
    """Topic search per group: assignments, word table and nested results."""
    spark = cleaned.sparkSession
    scores, words, assigned, sizes = [], [], [], []
    for g in groups:
        found = T.search_k(cleaned.filter(F.col("group_key") == g), key, "tokens", **options)
        if found is None:
            continue
        tag = F.lit(g).alias("group_key")
        scores.append(found.scores.select(tag, "k", "coherence"))
        words.append(T.topic_words(spark, found.model, found.terms).select(tag, "topic", "rank", "term"))
        assigned.append(T.assign_topic(found.model, found.vectors, key).select(key, tag, "topic"))
        sizes.append((g, found.n_docs, len(found.terms)))
        sinks.save_model(found.model, f"{out}/models/{g}")
    if not scores:
        return {}
    union = lambda frames: stage(reduce(DataFrame.unionByName, frames))
    scores, words, assigned = union(scores), union(words), union(assigned)
    listed = words.groupBy("group_key", "topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term")))["term"].alias("words")
    )
    size_rows = spark.createDataFrame(sizes, "group_key string, n_docs bigint, vocab_size bigint")
    sinks.write_topic_json(sinks.topic_results(scores, listed, size_rows), f"{out}/topics_json")
    table = T.topic_table(words, scores)
    sinks.write_report(table, f"{out}/topic_words")
    sinks.write_table(assigned, f"{out}/assigned")
    return {"table": table, "assigned": assigned, "counts": T.topic_counts(listed, assigned, "group_key"),
            "scores": T.coherence_compare(scores)}


def classify(cleaned: DataFrame, out: str, key: str = "id", **options) -> tuple[DataFrame, list[M.GroupModels]]:
    """The model grid on the stemmed texts; models and leaderboard are saved."""
    docs = cleaned.select("group_key", key, "resolved", X.feature_tokens("clean_text").alias("features"))
    results = M.train_grid(docs, "group_key", key, "resolved", "features", **options)
    for r in results:
        for name, model in r.models.items():
            sinks.save_model(model, f"{out}/models/{r.group}/{name}")
        sinks.write_table(r.terms, f"{out}/models/{r.group}/terms")
    board = stage(M.leaderboard(results))
    sinks.write_report(board, f"{out}/leaderboard")
    return board, results


def compare(cleaned: DataFrame, board: DataFrame, out: str, results: list[M.GroupModels] = (),
            topic_counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """KPI table, dashboard and hypothesis report."""
    resolved = F.col("resolved") == 1
    texts = {
        "H3": R.accuracy_lines(board),
        "H4": R.trend_lines(P.monthly_trend(P.monthly_counts(cleaned, "group_key", "month"), "group_key", "month")),
        "H5": R.gap_lines(P.class_gap(cleaned, "group_key", "resolved", "satisfaction")),
    }
    if topic_counts is not None:
        texts["H1"] = R.topic_lines(topic_counts)
    heavy = [
        M.feature_top(r.models["logistic_regression"], r.terms).withColumn("group_key", F.lit(r.group)) for r in results
    ]
    if heavy:
        texts["H2"] = R.term_lines(reduce(DataFrame.unionByName, heavy))
    tables = {
        "kpi": P.kpi_table(cleaned, "group_key", resolved, "satisfaction", "n_words", "view_count"),
        "dashboard": R.dashboard(cleaned, "group_key", resolved, "satisfaction", "month", "view_count"),
        "word_counts": D.histogram(cleaned, "group_key", "n_words"),
        "top_words": K.top_words(cleaned, "group_key", F.col("stemmed")),
        "hypotheses": R.hypothesis_report(**texts),
    }
    for name, table in tables.items():
        sinks.write_report(table, f"{out}/{name}")
    return tables
