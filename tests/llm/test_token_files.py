import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from plaintscope.llm import queries, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
CODER = token_files.WordCoder(open(PATH, "rb").read())


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*" \n\t'seΣσ<|>", "\u0301", "\u00a0", "<|endoftext|>", "<|ENDOFTEXT|>", "Word", "éÀ", "!!", ".", "1", "İ", "µªº"])), max_size=40))
def test_words_by_themselves_give_the_ids_of_the_text(parts):
    text = "".join(parts)
    assert np.frombuffer(CODER.encode([text])[0], CODER.kind).tolist() == whole(text)


def test_files_against_plain_encoding(spark, small):
    got = {r.doc_id: r for r in queries.QUERIES["op7_token_files"](spark, small).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()):
        ids = whole(r.text) + [1]
        g = got.pop(r.doc_id)
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_cases_and_single_documents(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_DOCS", 3)
    shared = token_files.share_tokenizer(spark, PATH)
    rows = [(4, "four"), (None, "no key"), (2, None), (3, ""), (1, "same"), (1, "same"), (1, "other"), (9, "long " * 100_000)]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, start int")
    path = token_files.new_folder(spark)
    token_files.write_ids(docs, shared, path, end_id=1)
    back = sorted(((r.key is not None, r.key or 0, list(r.ids)) for r in token_files.read_ids(spark, path).collect()))
    assert back == sorted((k is not None, k or 0, whole(t) + [1]) for k, t in rows)
    only = token_files.read_ids(spark, path, [4, 1]).collect()
    assert sorted(r.key for r in only) == [1, 1, 1, 4]
    got = sorted(token_files.digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2, 3, 4, 9]
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))


def test_empty_table_and_foreign_dictionary(spark):
    shared = token_files.share_tokenizer(spark, PATH)
    path = token_files.new_folder(spark)
    token_files.write_ids(spark.createDataFrame([], "doc_id long, text string"), shared, path, end_id=1)
    assert token_files.digests(spark, path).count() == 0
    segment = token_files.Segment()
    segment.add(1, 0, b"")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.SegmentReader(segment.body(2, b"x" * 32), b"y")
