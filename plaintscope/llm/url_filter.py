"""URL verdicts by a bit-parallel wildcard automaton.

Every rule is a glob over "host" + "path". `*` stands for any characters but "/", `**` for any
characters at all. All globs lie side by side in one long bit string of 64-bit words; one bit
says that the text read so far may end at that place of that glob. A character moves all bits
at once: shift, keep the places that take this character (Shift-And), and keep the places
whose wildcard takes it. Many URLs are moved together, one character at a time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plaintscope.llm.textarrays import flat, pieces, with_result

ALLOW, BLOCK = "allow", "block"

# (verdict, host, path): fits the host and its subdomains if the path starts so.
HOST_RULES = (
    (ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"),
)
# Globs over the canonical URL for what no host rule decides; any that fits blocks.
BLOCK_GLOBS = (
    "adult-*/**", "*.adult-*/**", "cheap-pills.*/**", "*.cheap-pills.*/**", "*casino*/**", "*porn*/**",
    "**/wp-login*", "**/phpmyadmin*", "**.exe", "**.zip",
)


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(hosts, paths). Host: after the first "://" up to "/", "?", "#" or the end, A-Z
    lower-cased; path: from there up to "?", "#" or the end. No "://": both empty."""
    hosts, paths = [], []
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        _, scheme, rest = raw[a:b].partition(b"://")
        rest = rest.partition(b"#")[0].partition(b"?")[0] if scheme else b""
        host, slash, path = rest.partition(b"/")
        hosts.append(host.lower())
        paths.append(slash + path)
    return hosts, paths


class Globs:
    """Globs as masks: which places take a byte, and which wildcards stay on it."""

    def __init__(self, globs: Sequence[bytes]):
        # A glob is a row of literal bytes; place k says k of them were read. A wildcard
        # before literal k is a loop on place k.
        self.count = len(globs)
        starts, ends, takes, loops, at = [], [], [], [], 0
        for glob in globs:
            starts.append(at)
            k = 0
            while k < len(glob):
                if glob[k:k + 2] == b"**":
                    loops.append((at, True))
                    k += 2
                elif glob[k:k + 1] == b"*":
                    loops.append((at, False))
                    k += 1
                else:
                    takes.append((at + 1, glob[k]))
                    at += 1
                    k += 1
            ends.append(at)
            at += 1
        self.words = -(-max(at, 1) // 64)
        self.take = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.first = self._mask(starts)
        self.ends = np.array(ends, np.int64)
        for place, byte in takes:
            self.take[byte] |= self._mask([place])
        for place, anything in loops:
            mask = self._mask([place])
            self.loop |= mask
            if not anything:
                self.loop[ord("/")] &= ~mask
        for place, anything in loops:  # a place can carry both kinds
            if anything:
                self.loop[ord("/")] |= self._mask([place])

    def _mask(self, places: Sequence[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for p in places:
            mask[p // 64] |= np.uint64(1) << np.uint64(p % 64)
        return mask

    def match(self, texts: list[bytes]) -> np.ndarray:
        """texts x globs: the glob fits the whole text."""
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")  # those still being read stay in front
        ranked, raw = length[order], np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(length) - length)[order]
        state = np.tile(self.first, (len(texts), 1))
        live = len(texts)
        for k in range(int(ranked[0]) if len(texts) else 0):
            while live and ranked[live - 1] <= k:
                live -= 1
            byte = raw[begin[:live] + k]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.take[byte]) | (now & self.loop[byte])
        fits = np.empty((len(texts), self.count), np.bool_)
        fits[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1)
        return fits


def host_globs(host: str, path: str) -> tuple[bytes, bytes]:
    """The host itself and any subdomain, with any end of the path."""
    return f"{host}{path}**".encode(), f"*.{host}{path}**".encode()


@functools.lru_cache(maxsize=8)
def compiled(rules: tuple, globs: tuple) -> Globs:
    return Globs([g for _, host, path in rules for g in host_globs(host, path)] + [g.encode() for g in globs])


def judge(urls: pa.Array, rules: tuple, globs: tuple) -> pa.Array:
    hosts, paths = canonical(*flat(urls))
    fits = compiled(rules, globs).match([h + p for h, p in zip(hosts, paths)])
    by_rule = fits[:, 0:2 * len(rules):2] | fits[:, 1:2 * len(rules):2]
    blocked = fits[:, 2 * len(rules):].any(axis=1) if globs else np.zeros(len(urls), np.bool_)
    weight = np.array([len(host) + len(path) for _, host, path in rules], np.int64)
    best = np.where(by_rule, weight, -1)
    chosen = best.argmax(axis=1) if len(rules) else np.zeros(len(urls), np.int64)
    some = best.max(axis=1) >= 0 if len(rules) else np.zeros(len(urls), np.bool_)
    names = np.array([host + path for _, host, path in rules] or [""], object)
    verdicts = np.array([v for v, _, _ in rules] or [""], object)
    return pa.StructArray.from_arrays([
        pa.array(hosts, pa.binary()).cast(pa.string()), pa.array(paths, pa.binary()).cast(pa.string()),
        pa.array(np.where(some, names[chosen], None), pa.string()),
        pa.array(np.where(some, verdicts[chosen], np.where(blocked, BLOCK, ALLOW)), pa.string()),
    ], ["host", "path", "rule", "verdict"])


def with_verdict(
    pages: DataFrame, url: str = "url", out: str = "judged", rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    globs: Sequence[str] = BLOCK_GLOBS,
) -> DataFrame:
    """`pages` plus struct(host, path, rule, verdict).

    The longest fitting rule decides (the first of equal length); without one, any fitting
    glob blocks and anything else is allowed. A null url or one without "://" has empty host
    and path, which no given rule fits. Repeated rows get equal results, an empty table gives
    an empty one, an input column called as `out` is replaced. Rules are arguments of the
    job, not rows of a table, so their size is the caller's.
    """
    rules, globs = tuple(tuple(r) for r in rules), tuple(globs)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            for start, stop in pieces(urls):
                yield judge(urls.slice(start, stop - start), rules, globs)

    schema = "struct<host:string, path:string, rule:string, verdict:string>"
    return with_result(pages, out, F.arrow_udf(run, schema).asNondeterministic()(F.col(url)))
