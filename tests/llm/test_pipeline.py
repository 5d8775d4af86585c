import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
import test_byte_bpe as bpe
import test_decontamination as dc
import test_jaccard_join as jj


def ok(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(k):
        seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        return len({p for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for p in range(i, i + k)})

    return not (len(w) < 50 or 100 * inside(3) > 50 * len(w) or 100 * inside(8) > 30 * len(w) or inside(101))


def test_stages_against_brute_force(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns, name
            seen.append({r.doc_id for r in docs.collect()})
            assert docs.count() == len(seen[-1])
    wrong = [k for k, q in labels.items() if (k in seen[0]) != bool(q) and zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(wrong) <= 0.1 * len(labels)
    assert seen[1] == {k for k in seen[0] if ok(texts[k])}
    assert seen[2] == {c for _, c, _, _ in jj.brute([(k, texts[k]) for k in seen[1]])}
    assert seen[3] == {k for k in seen[2] if not dc.brute(texts[k], bench)[3]}
    last = {r.doc_id: list(r.ids) for r in docs.collect()}
    assert last == {k: bpe.THEIRS.encode_ordinary(texts[k]) for k in seen[3]}


def test_run_and_names(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_stages_on_null_empty_and_extra(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", "s", 0), (None, "word " * 60, "en", "s", 300)]
    for name, given in (("empty", []), ("odd", rows)):
        docs = spark.createDataFrame(given, schema)
        for column in ("quality", "repetition", "class_id", "contamination", "encoded"):
            docs = docs.withColumn(column, F.lit("x"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns = docs.columns
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.columns == columns
        assert docs.count() == 0
