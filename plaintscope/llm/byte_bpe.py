"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The text is split as by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without regular expressions. Each code point becomes a symbol (its class, with what its next
neighbours say already folded in). A symbol is a function from the state before it to the
state after it. Functions compose associatively and only a few hundred different ones arise, so
a run of text is one small number: all blocks of the text are composed side by side, a short
scan over the blocks gives the state each starts in, and a last sweep gives every state.
Whether a piece begins at a code point follows from the state before it and its symbol.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plaintscope.llm.textarrays import flat, lists, text_udf, with_result

CACHE_PIECES = 400_000  # merged pieces a worker remembers before it starts anew
VOCABULARY_BYTES = 64 << 20

# Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# States: what the text so far ends in.
TEXT, LETTER, NUMBER, OTHER, WHITE, BLANK, ONE_MORE, TWO_MORE, DONE = range(9)
STATES = 9
# Symbols. A quote may begin a contraction of one or two more letters; white space may be the
# last of a run before other text (it then stands apart from the run) or not.
NEW_TEXT, A_LETTER, A_NUMBER, AN_OTHER, QUOTE_1, QUOTE_2, WHITE_IN, WHITE_LAST, BLANK_IN, BLANK_LAST = range(10)
SYMBOLS = 10
BLOCK = 256
NEVER = 1 << 31  # rank of a pair that is no token


def classes() -> np.ndarray:
    """Symbol of each code point by its class alone."""
    kind = {"L": A_LETTER, "N": A_NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], AN_OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = WHITE_IN
    table[0x20] = BLANK_IN
    return table


def step(state: int, symbol: int) -> int:
    if symbol == NEW_TEXT:
        return TEXT
    if state == TWO_MORE:
        return ONE_MORE
    if state == ONE_MORE:
        return DONE
    if symbol in (QUOTE_1, QUOTE_2) and state not in (OTHER, BLANK):
        return ONE_MORE if symbol == QUOTE_1 else TWO_MORE
    return {A_LETTER: LETTER, A_NUMBER: NUMBER, WHITE_IN: WHITE, WHITE_LAST: WHITE,
            BLANK_IN: BLANK, BLANK_LAST: BLANK}.get(symbol, OTHER)


def begins(state: int, symbol: int) -> bool:
    """A piece begins at a code point of this symbol if the text before is in this state."""
    if state == TEXT or symbol == NEW_TEXT:
        return True
    if state in (ONE_MORE, TWO_MORE):
        return False
    if state == DONE:
        return True
    if symbol in (WHITE_IN, BLANK_IN):
        return state not in (WHITE, BLANK)
    if symbol in (WHITE_LAST, BLANK_LAST):
        return True
    if state == BLANK:
        return False
    return step(state, symbol) != state


class Scan:
    """The functions that symbols generate, and their composition."""

    def __init__(self):
        found = [tuple(step(s, x) for s in range(STATES)) for x in range(SYMBOLS)]
        found = list(dict.fromkeys([*found, tuple(range(STATES))]))
        number = {f: k for k, f in enumerate(found)}
        self.of_symbol = np.array([number[tuple(step(s, x) for s in range(STATES))] for x in range(SYMBOLS)], np.uint16)
        generators = [found[k] for k in sorted(set(self.of_symbol.tolist()))]
        for f in found:  # grows while it runs
            for g in generators:
                if (h := tuple(g[s] for s in f)) not in number:
                    number[h] = len(found)
                    found.append(h)
        self.same = number[tuple(range(STATES))]
        self.after = np.array(found, np.uint8)  # function, state -> state
        self.then = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.uint16)
        self.begins = np.array([[begins(s, x) for x in range(SYMBOLS)] for s in range(STATES)])

    def states_before(self, symbols: np.ndarray) -> np.ndarray:
        """State before each symbol; the first one is in state TEXT."""
        n = len(symbols)
        rows = -(-n // BLOCK)
        f = np.full(rows * BLOCK, self.same, np.uint16)
        f[:n] = self.of_symbol[symbols]
        f = np.ascontiguousarray(f.reshape(rows, BLOCK).T)
        whole = f[0]
        for k in range(1, BLOCK):
            whole = self.then[whole, f[k]]
        gap = 1  # scan over the blocks by doubling
        while gap < rows:
            whole = np.concatenate((whole[:gap], self.then[whole[:-gap], whole[gap:]]))
            gap *= 2
        state = np.full(rows, TEXT, np.uint8)
        state[1:] = self.after[whole[:-1], TEXT]
        before = np.empty((BLOCK, rows), np.uint8)
        for k in range(BLOCK):
            before[k] = state
            state = self.after[f[k], state]
        return before.T.reshape(-1)[:n]


_TABLES: list = []


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of the texts begin."""
    if not _TABLES:
        _TABLES.extend((classes(), Scan()))
    table, scan = _TABLES
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each code point
    symbol = table[points]
    first = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    starts_text = np.zeros(len(points) + 3, np.bool_)
    starts_text[first] = True
    starts_text[len(points):] = True

    def ahead(k: int) -> np.ndarray:
        """The code point k further on, 0 beyond the text."""
        point = np.zeros(len(points), np.uint32)
        point[:-k] = points[k:]
        for j in range(1, k + 1):
            point[starts_text[j:len(points) + j]] = 0
        return point

    one = np.zeros(len(points), np.uint8)
    one[:-1] = symbol[1:]
    ends = starts_text[1:len(points) + 1]
    last = ~ends & (one != WHITE_IN) & (one != BLANK_IN)
    symbol = np.where(((symbol == WHITE_IN) | (symbol == BLANK_IN)) & last, symbol + 1, symbol)
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        next_1, next_2 = ahead(1)[quotes], ahead(2)[quotes]
        symbol[quotes[np.isin(next_1, [ord(c) for c in "stmd"])]] = QUOTE_1
        for a, b in ("re", "ve", "ll"):
            symbol[quotes[(next_1 == ord(a)) & (next_2 == ord(b))]] = QUOTE_2

    # One symbol more in front of each text leads to state TEXT whatever was before.
    spread = np.insert(symbol, first, NEW_TEXT)
    before = scan.states_before(spread)
    opens = np.delete(scan.begins[before, spread], first + np.arange(len(first)))
    return at[opens]


class Bpe:
    """Merging by rank and the bytes of each id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.forget()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, k in ranks.items():
            tokens[k] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def forget(self) -> None:
        """Cache of merged pieces: number of each, and for each number where its ids begin."""
        self.cache: dict[bytes, int] = {}
        self.begin, self.cached_ids, self.cached_ends = array("q", [0]), array("i"), array("i")

    def number(self, piece: bytes) -> int:
        known = self.cache.get(piece)
        if known is None:
            known, end = len(self.cache), 0
            for part in self.merge(piece):
                end += len(part)
                self.cached_ids.append(self.ranks[part])
                self.cached_ends.append(end)
            self.begin.append(len(self.cached_ids))
            self.cache[piece] = known
        return known

    def merge(self, piece: bytes) -> list[bytes]:
        """Parts after joining the pair of lowest rank, leftmost first, until none is left."""
        if piece in self.ranks:
            return [piece]
        ranks = self.ranks
        if len(piece) > 64:
            return self.merge_long(piece)
        parts = [piece[k:k + 1] for k in range(len(piece))]
        scores = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while scores and (best := min(scores)) < NEVER:
            at = scores.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
        return parts

    def merge_long(self, piece: bytes) -> list[bytes]:
        """The same with a heap and neighbour links, for pieces of any length."""
        n, ranks = len(piece), self.ranks
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray([1]) * n
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, end = heapq.heappop(heap)
            if not alive[k] or stop[k] >= n or stop[stop[k]] != end or not alive[stop[k]]:
                continue
            gone = stop[k]
            alive[gone] = 0
            stop[k] = end
            if end < n:
                before[end] = k
                if (r := ranks.get(piece[k:stop[end]])) is not None:
                    heapq.heappush(heap, (r, k, stop[end]))
            if k and (r := ranks.get(piece[before[k]:end])) is not None:
                heapq.heappush(heap, (r, before[k], end))
        out, k = [], 0
        while k < n:
            out.append(piece[k:stop[k]])
            k = stop[k]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids a text, ids, byte position in its text at which each id ends)."""
        starts = boundaries(data, offsets)
        texts = len(offsets) - 1
        if not len(starts):
            return np.zeros(texts, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        edges = np.append(starts, len(data))
        column = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        if len(self.cache) > CACHE_PIECES:
            self.forget()
        numbers = np.fromiter(map(self.number, column.dictionary.to_pylist()), np.int64, len(column.dictionary))
        which = numbers[column.indices.to_numpy(zero_copy_only=False)]
        begin = np.array(self.begin)
        count = begin[which + 1] - begin[which]
        pick = runs(begin[which], count)
        piece_of_text = np.searchsorted(starts, offsets)
        local = starts - np.repeat(offsets[:-1], np.diff(piece_of_text))
        total = np.concatenate(([0], np.cumsum(count)))
        return np.diff(total[piece_of_text]), np.array(self.cached_ids)[pick], np.array(self.cached_ends)[pick] + np.repeat(local, count).astype(np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[runs(self.starts[ids], self.lengths[ids])]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), one after another."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - total + counts, counts)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 of the bytes, a space, the rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def share_ranks(spark: SparkSession, path: str):
    """The rank file as a broadcast; only the driver reads the path."""
    with open(path, "rb") as file:
        raw = file.read()
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"a rank file of {len(raw)} bytes is not broadcast")
    return spark.sparkContext.broadcast(raw)


_MODELS: dict[int, Bpe] = {}


def model_of(shared) -> Bpe:
    """The model of a broadcast rank file, built once a worker."""
    raw = shared.value
    if hash(raw) not in _MODELS:
        _MODELS.clear()
        _MODELS[hash(raw)] = Bpe(read_ranks(raw))
    return _MODELS[hash(raw)]


def encode_texts(texts: pa.Array, bpe: Bpe) -> list[pa.Array]:
    """Lists of ids and of end positions."""
    counts, ids, ends = bpe.encode(*flat(texts))
    return [lists(counts, pa.array(ids)), lists(counts, pa.array(ends))]


def decode_lists(id_lists: pa.Array, end_lists: pa.Array, bpe: Bpe) -> pa.Array:
    """Bytes of each list of ids. The kept end positions say how many bytes each id fills; ids
    that do not fill them raise an error."""
    counts = np.diff(id_lists.offsets.to_numpy())
    tokens = id_lists.flatten().to_numpy(zero_copy_only=False)
    stops = end_lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    last = np.cumsum(counts)
    begin = np.concatenate(([0], stops[:-1]))[:len(stops)]
    begin[(last - counts)[counts > 0]] = 0
    if len(stops) != len(tokens) or not np.array_equal(stops - begin, bpe.lengths[tokens]):
        raise ValueError("ids and end offsets do not belong together")
    size = np.zeros(len(counts), np.int64)
    size[counts > 0] = stops[last[counts > 0] - 1]
    at = np.concatenate(([0], np.cumsum(size)))
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(bpe.decode(tokens))]).cast(pa.binary())


def with_ids(docs: DataFrame, ranks, text: str = "text", out: str = "encoded") -> DataFrame:
    """`docs` plus struct(ids array<int>, ends array<int>): the ids of each whole text without
    special tokens, and the byte position in the text at which each id ends.

    `ranks` is a broadcast of `share_ranks`. Null and empty texts have empty arrays. Every
    row is encoded for itself; an empty table gives an empty one; an input column called as
    `out` is replaced.
    """
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(encode_texts(texts, model_of(ranks)), ["ids", "ends"])

    return with_result(docs, out, text_udf(run, "struct<ids:array<int>, ends:array<int>>")(F.col(text)))


def with_round_trip(docs: DataFrame, ranks, text: str = "text", out: str = "encoded") -> DataFrame:
    """As `with_ids`, and in the same pass over each piece of text the bytes that the ids decode
    to, as a third field `decoded`."""
    def run(texts: pa.Array) -> pa.Array:
        bpe = model_of(ranks)
        ids, ends = encode_texts(texts, bpe)
        return pa.StructArray.from_arrays([ids, ends, decode_lists(ids, ends, bpe)], ["ids", "ends", "decoded"])

    return with_result(docs, out, text_udf(run, "struct<ids:array<int>, ends:array<int>, decoded:binary>")(F.col(text)))


def with_bytes(encoded: DataFrame, ranks, ids: str = "encoded.ids", ends: str = "encoded.ends", out: str = "decoded") -> DataFrame:
    """`encoded` plus the bytes of its stored ids and end offsets (see `decode_lists`).
    Null ids decode to no bytes; an input column called as `out` is replaced.
    """
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bpe = model_of(ranks)
        for id_lists, end_lists in batches:
            for at in range(0, len(id_lists), 200):
                yield decode_lists(id_lists.slice(at, 200), end_lists.slice(at, 200), bpe)

    blank = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    return with_result(encoded, out, F.arrow_udf(run, "binary").asNondeterministic()(blank(ids), blank(ends)))


def digests(encoded: DataFrame, key: str = "doc_id", column: str = "encoded", keep_ids: bool = False) -> DataFrame:
    """Per row of `with_round_trip`: number of ids, digest of the decimal ids joined by a space,
    digest of the decoded bytes; with `keep_ids`, the ids as well."""
    ids = F.col(column)["ids"]
    return encoded.select(
        key, F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(column)["decoded"], 256).alias("decoded_sha256"), *([ids.alias("ids")] if keep_ids else []))
