"""Packing beside the library's ids, sequential best fit, and every constraint."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plaintscope.llm import packing, queries, word_units
from plaintscope.llm.packing import Capacity, best_fit, cut
from plaintscope.llm.word_units import UnitCoder, share_tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    with open(FILE, "rb") as file:
        return UnitCoder(file.read())


def sequential(lengths, capacity):
    """Sequences that plain best fit, longest first, needs for the tokens alone."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def laid_out(runs):
    """sequence -> [(offset, length)] of a table of runs."""
    found = defaultdict(list)
    for r in runs:
        for k in range(r.last - r.first):
            found[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    return found


def fits(bins, capacity):
    for places in bins.values():
        places.sort()
        assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()  # without gaps
        sizes = [n for _, n in places]
        assert sum(sizes) <= capacity.tokens
        assert capacity.documents is None or len(sizes) <= capacity.documents
        assert capacity.attention is None or sum(n * n for n in sizes) <= capacity.attention


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_sequential_best_fit(seed):
    rng = random.Random(seed)
    lengths = [min(100, int(rng.paretovariate(0.7)) + rng.randrange(3)) for _ in range(rng.randrange(1, 900))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, sequences = best_fit(counts, Capacity(100))
    assert sequences == sequential(lengths, 100) == len(laid_out(runs))
    assert {n: sum(r.last - r.first for r in runs if r.length == n) for n in counts} == counts
    fits(laid_out(runs), Capacity(100))


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(4))
def test_every_constraint_holds(seed, choose):
    rng = random.Random(seed)
    capacity = Capacity(200, rng.choice([2, 5, 30]), rng.choice([10_000, 15_000]))
    counts = {rng.randrange(1, capacity.piece + 1): rng.randrange(1, 60) for _ in range(40)}
    runs, sequences = best_fit(counts, capacity, choose)
    assert {n: sum(r.last - r.first for r in runs if r.length == n) for n in counts} == counts
    fits(laid_out(runs), capacity)
    least = max(sum(n * k for n, k in counts.items()) / capacity.tokens, sum(counts.values()) / capacity.documents,
                sum(n * n * k for n, k in counts.items()) / capacity.attention)
    assert least <= sequences == len(laid_out(runs)) <= 1.5 * least + 2


def test_no_pieces_and_wrong_arguments():
    assert best_fit({}, Capacity()) == ([], 0)
    with pytest.raises(ValueError):
        best_fit({5: 1}, Capacity(4))
    with pytest.raises(ValueError):
        best_fit({1: 1}, Capacity(4), "first")
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_ids_are_the_library_s(coder):
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "　", "a", "the", "'s", "'ll", ".", ",", "!!", "12", "é", "中",
                "​", "🙂", "<|", " ", " ", " ", "Z", "_", "\x00", "²", "ʰ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(14))) for _ in range(20_000)]
    for k in range(0, len(texts), 500):
        some = texts[k:k + 500]
        assert all(map(np.array_equal, coder.encode(pa.array(some)), coder.whole(some)))
    assert coder.separable and coder.used


def test_known_parts_are_forgotten_and_learned_anew(coder, monkeypatch):
    monkeypatch.setattr(word_units, "KNOWN_PARTS", 50)
    for k in range(20):
        some = [f"Some words {k} and more, {k * 7919} of {j}!" for j in range(30)]
        assert all(map(np.array_equal, coder.encode(pa.array(some)), coder.whole(some)))
        assert len(coder.values) < 300


def test_other_settings_are_encoded_whole(coder):
    changed = Tokenizer.from_file(FILE)
    changed.pre_tokenizer.add_prefix_space = True
    other = UnitCoder(changed.to_str().encode())
    assert not other.separable
    for some in (other, coder):
        texts = ["a b", None, "x <|endoftext|>y\n <|endoftext|>"]
        assert all(map(np.array_equal, some.encode(pa.array(texts)), some.whole([t or "" for t in texts])))
    assert [len(i) for i in coder.encode(pa.array([None, ""], pa.string()))] == [0, 0] and coder.encode(pa.array([], pa.string())) == []


def check(rows, texts, library):
    """Every document whole, in pieces cut as asked, and sequences without gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for k, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [(r.start, r.length) for r in mine] == cut(len(ids), 1024)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    for places in by_sequence.values():
        places.sort(key=lambda r: r.offset)
        assert [r.offset for r in places] == np.cumsum([0, *(r.length for r in places)])[:-1].tolist()
        assert sum(r.length for r in places) <= 1024
    return len(by_sequence)


def test_query_against_library_and_sequential_packing(spark, small, library):
    found = queries.QUERIES["op12_packing"](spark, small)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert check(rows, texts, library) == sequential([r.length for r in rows], 1024)


def test_null_empty_long_repeated_and_extra_columns(spark, library):
    texts = {1: None, 2: "", 3: "word " * 50_000, 4: "a\n\n b", 5: "x" * 3000, **{k: "same text" for k in range(10, 400)}}
    docs = spark.createDataFrame([(k, t, 1, "p") for k, t in texts.items()], "doc_id long, text string, length int, ids string")
    nulls = spark.createDataFrame([(None, "no key", 1, "p")] * 2, docs.schema)
    path = packing.new_folder(spark)
    tokenizer = share_tokenizer(spark, FILE)
    packing.write_packed(docs.unionByName(nulls).repartition(5), tokenizer, path, end_id=2)
    rows = packing.digests(spark, path).collect()
    assert sum(r.doc_id is None for r in rows) == 2
    whole = {r.sequence_id: r.ids for r in packing.sequence_ids(spark, path).collect()}
    for r in packing.read_pieces(spark, path).collect():
        assert np.array(whole[r.sequence_id][r.offset:r.offset + r.length], "<u2").tobytes() == bytes(r.ids)
    assert len(rows) - 2 == sum(len(cut(len(library.encode(t or "", add_special_tokens=False).ids) + 1, 1024)) for t in texts.values())


def test_empty_table(spark):
    path = packing.new_folder(spark)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.write_packed(docs, share_tokenizer(spark, FILE), path, end_id=2) == 0
    assert packing.digests(spark, path).count() == 0 == packing.sequence_ids(spark, path).count()
    assert packing.read_pieces(spark, path).filter(F.col("length") > 0).count() == 0


def test_tight_documents_and_attention(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path, capacity = packing.new_folder(spark), Capacity(512, 3, 150_000)
    packing.write_packed(docs, share_tokenizer(spark, FILE), path, end_id=2, capacity=capacity, choose="dot")
    bins = defaultdict(list)
    for r in packing.digests(spark, path).collect():
        bins[r.sequence_id].append((r.offset, r.length))
    fits(bins, capacity)
