"""The registered queries of this subpackage with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintscope.llm import byte_bpe, chat_format, decontamination, gru_lm, jaccard_join, lexical_search, packing, quality_classifier, quality_rules, token_counts, token_files, url_filter, whitening, word_units
from plaintscope.llm.queries_sql import OP1_SQL, OP2_SQL, OP4_SQL, OP10_SQL, OP13_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op1_repetition", OP1_SQL)
def op1(spark, folder):
    found = quality_rules.with_repetition(table(spark, folder, "documents", "doc_id", "text"))
    m = F.col("repetition")
    return found.select("doc_id", *[m[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words")])


@query("op2_decontamination", OP2_SQL)
def op2(spark, folder):
    found = decontamination.with_contamination(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))
    m = F.col("contamination")
    return found.select(
        "doc_id", m["n_words"].alias("n_words"), m["n_hit"].alias("n_hit"), F.size(m["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"), m["contaminated"].alias("contaminated"))


@query("op3_byte_bpe")
def op3(spark, folder):
    ranks = byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(byte_bpe.with_round_trip(table(spark, folder, "documents", "doc_id", "text"), ranks))


@query("op4_chat_format", OP4_SQL)
def op4(spark, folder):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations", *extra.columns).unionByName(extra)
    return chat_format.digests(chat_format.format_conversations(turns))


@query("op5_token_counts")
def op5(spark, folder):
    model = token_counts.share_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    counted = token_counts.with_token_counts(table(spark, folder, "documents", "doc_id", "text"), model)
    m = F.col("counted")
    return counted.select("doc_id", *[m[c].alias(c) for c in ("n_bytes", "n_tokens", "over_limit")])


@query("op10_url_filter", OP10_SQL)
def op10(spark, folder):
    judged = url_filter.with_verdict(table(spark, folder, "pages", "page_id", "url"))
    return judged.select("page_id", "judged.*")


@query("op8_quality_classifier")
def op8(spark, folder):
    scored = quality_classifier.with_quality(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))
    return scored.select("doc_id", "quality.*")


@query("op7_token_files")
def op7(spark, folder):
    tokenizer = token_files.share_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    path = token_files.new_folder(spark)
    token_files.write_ids(table(spark, folder, "documents", "doc_id", "text"), tokenizer, path, end_id=1)
    return token_files.digests(spark, path)


@query("op9_gru_lm")
def op9(spark, folder):
    return gru_lm.log_likelihood(table(spark, folder, "documents", "doc_id", "text"))


@query("op6_jaccard_join")
def op6(spark, folder):
    found = jaccard_join.near_duplicates(table(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "class_id", "copy_id", "n_links")


@query("op11_whitening")
def op11(spark, folder):
    whitened = whitening.with_whitening(table(spark, folder, "embeddings", "vec_id", "embedding"))
    return whitening.components(whitened)


@query("op12_packing")
def op12(spark, folder):
    tokenizer = word_units.share_tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
    path = packing.new_folder(spark)
    capacity = packing.Capacity(tokens=1024, documents=1024, attention=1024 * 1024)
    packing.write_packed(table(spark, folder, "documents", "doc_id", "text"), tokenizer, path, end_id=2, capacity=capacity)
    return packing.digests(spark, path)


@query("op13_lexical_search", OP13_SQL)
def op13(spark, folder):
    path = lexical_search.new_folder(spark)
    lexical_search.write_index(table(spark, folder, "documents", "doc_id", "text"), path)
    return lexical_search.search(spark.read.parquet(path), table(spark, folder, "benchmark", "item_id", "text"))
