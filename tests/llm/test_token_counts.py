import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from plaintscope.llm import queries, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
OURS = token_counts.PieceModel(open(PATH, "rb").read())
WHOLE = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "a", "é", "漢", " ", "  ", "\n", "▁", "😀", "<s>", ". ", "'s", "12", "\t"]), max_size=120).map("".join),
       st.integers(1, 40), st.integers(1, 12))
def test_chunks_give_the_count_of_the_whole(text, chunk, overlap):
    assert OURS.long_count(text, chunk, overlap)[0] == len(WHOLE.encode(text))


def test_text_without_a_splice_place_is_widened():
    text = "x" * 3000 + " tail of words " * 100
    tokens, chunks, widened = OURS.long_count(text, 256, 32)
    assert tokens == len(WHOLE.encode(text)) and widened and chunks > 2


def test_a_vocabulary_without_proof_is_refused(monkeypatch):
    class Fake:
        def __init__(self, model_proto):
            pass

        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda k: "a▁b")

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Fake)
    with pytest.raises(ValueError, match="no proven splice place"):
        token_counts.PieceModel(b"")


def test_query_and_cases(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op5_token_counts"](spark, small).collect()}
    for r in rows:
        n = len(WHOLE.encode(r.text))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 4096)
    model = token_counts.share_model(spark, PATH)
    cases = [(1, None), (2, ""), (3, "twice"), (3, "twice"), (None, "é"), (5, "many words " * 30_000)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in cases], "doc_id long, text string, counted int")
    found = sorted(((r.doc_id, r.counted.n_bytes, r.counted.n_tokens) for r in token_counts.with_token_counts(docs, model).collect()), key=str)
    assert found == sorted(((k, len((t or "").encode()), len(WHOLE.encode(t or ""))) for k, t in cases), key=str)
    assert token_counts.with_token_counts(docs.limit(0), model).count() == 0
