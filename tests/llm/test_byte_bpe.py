import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from plaintscope.llm import byte_bpe, queries
from plaintscope.llm.textarrays import flat

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(open(PATH, "rb").read())
OURS = byte_bpe.Bpe(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECE = regex.compile(public_tokenizers.PATTERN)

HARD = ["", " ", "  ", " \n", "\n \n a", "a  b", "a \n\n b", "I'll don't we've 's's 'saw x''s '' 're've 'r 'v", "' s", " 's", "a'", "'",
        " x 　 y", "é'd 12ab ½Ⅷ", "..!? ''ll", "<|endoftext|>", "\r\n\r\n", "漢字 と\tかな", "😀 😀😀", "a" * 300, " " * 200 + "x", "ab" * 150 + "!"]


def split(texts):
    data, offsets = flat(pa.array(texts, pa.string()))
    starts = byte_bpe.boundaries(data, offsets).tolist()
    edges = sorted({*starts, *offsets.tolist()})
    return [[data[a:b].tobytes().decode() for a, b in zip(edges, edges[1:]) if lo <= a < hi]
            for lo, hi in zip(offsets[:-1], offsets[1:])]


def test_boundaries_are_those_of_the_pattern():
    assert split(HARD) == [PIECE.findall(t) for t in HARD]
    assert split(["".join(HARD)] * 3) == [PIECE.findall("".join(HARD))] * 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aé 1½'strevlmd\n\t.! ")) , max_size=40), max_size=6))
def test_boundaries_of_any_text(texts):
    assert split(texts) == [PIECE.findall(t) for t in texts]


def test_transition_functions_are_few_and_compose():
    scan = byte_bpe.Scan()
    assert len(scan.after) < 1000
    f, g = 3, 5
    assert [scan.after[scan.then[f, g], s] for s in range(9)] == [scan.after[g, scan.after[f, s]] for s in range(9)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_ids_and_round_trip(texts):
    texts = texts + HARD
    counts, ids, ends = OURS.encode(*flat(pa.array(texts, pa.string())))
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, text in enumerate(texts):
        own = ids[at[k]:at[k + 1]]
        assert own.tolist() == THEIRS.encode_ordinary(text)
        assert OURS.decode(own).tobytes() == text.encode()
        if text:
            assert ends[at[k + 1] - 1] == len(text.encode())


def test_frame_cases(spark):
    shared = byte_bpe.share_ranks(spark, PATH)
    rows = [(1, None, "x"), (2, "", "x"), (3, "Same text, twice.", "x"), (3, "Same text, twice.", "x"), (None, "héllo 'll", "x"), (5, "long " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, encoded string")
    done = byte_bpe.with_bytes(byte_bpe.with_ids(docs, shared), shared)
    got = {r.doc_id: r for r in done.collect()}
    assert len(done.collect()) == 6
    for _, (key, text, _) in enumerate(rows):
        assert list(got[key].encoded.ids) == THEIRS.encode_ordinary(text or "")
        assert bytes(got[key].decoded) == (text or "").encode()
    assert byte_bpe.with_ids(docs.limit(0), shared).count() == 0
    digest = {r.doc_id: r for r in byte_bpe.digests(byte_bpe.with_round_trip(docs, shared)).collect()}
    assert all(digest[k].decoded_sha256 == hashlib.sha256((t or '').encode()).hexdigest() for k, t, _ in rows)
    assert digest[2].n_tokens == 0 and digest[1].ids_sha256 == digest[2].ids_sha256


def test_wrong_offsets_are_refused(spark):
    shared = byte_bpe.share_ranks(spark, PATH)
    bad = spark.createDataFrame([([1, 2], [1, 9])], "ids array<int>, ends array<int>")
    with pytest.raises(Exception, match="do not belong together"):
        byte_bpe.with_bytes(bad, shared, "ids", "ends").collect()


def test_query_against_the_library(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op3_byte_bpe"](spark, small).collect()
    assert sorted(tuple(r) for r in rows) == sorted(
        (k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for k, t in texts.items() for ids in [THEIRS.encode_ordinary(t)])
