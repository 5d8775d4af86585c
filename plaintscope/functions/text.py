"""Text normalisation as Column expressions: no UDF, one projection after Catalyst.

Character classes are spelled out because Java's ``\\w``, ``\\s`` and ``\\d`` are
ASCII-only; the spelled form keeps every letter of every script and means the same
in other regular-expression engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x{85}"
WS = f"[{SPACE}]+"
NOT_WS = f"[^{SPACE}]+"
WORD = r"[\p{L}\p{N}_]"
URL = f"http{NOT_WS}|www\\.{NOT_WS}"
MENTION = f"@{WORD}+"
DIGITS = r"\p{Nd}+"
PUNCTUATION = f"[^\\p{{L}}\\p{{N}}_{SPACE}]"
# What is left of a text once digits, punctuation and "_" became blanks: runs of
# letters and non-decimal numerals.
TOKEN = r"[\p{L}\p{Nl}\p{No}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def evaluate_once(c: Column, build: Callable[[Column], Column]) -> Column:
    """`build(c)` with `c` evaluated a single time however often `build` uses it.

    Array lambdas are interpreted, and there repeated subexpressions are not shared.
    """
    return F.transform(F.array(c), build)[0]


def lower(c: Column | str, locale: str | None = None) -> Column:
    """Lower case; ``locale="tr"`` maps İ→i and I→ı as Turkish does."""
    if locale is None:
        return F.lower(_c(c))
    return F.collate(F.lower(F.collate(_c(c), locale)), "UTF8_BINARY")


def remove_urls(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), URL, " ")


def remove_mentions(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), MENTION, " ")


def remove_digits(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), DIGITS, " ")


def remove_punctuation(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), PUNCTUATION, " ")


def underscores_to_spaces(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("_"), F.lit(" "))


def strip(c: Column | str) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(_c(c), f"^{WS}|{WS}$", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), WS, " "))


def tokenise(c: Column | str) -> Column:
    """White-space tokens, no phantom empty ones; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(_c(c), F.lit("")), F.lit(NOT_WS), F.lit(0))


def join_tokens(tokens: Column | str, sep: str = " ") -> Column:
    return F.array_join(_c(tokens), sep)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(NOT_WS))


def char_count(c: Column | str) -> Column:
    return F.length(F.coalesce(_c(c), F.lit("")))


def remove_stops(tokens: Column | str, stops: Sequence[str]) -> Column:
    """Drop stop words, keep repeats. For a list of bounded size; a stop *table* of any
    size goes through `operators.tokens.drop_tokens`."""
    words = sorted(set(stops))
    if not words:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: t.isNull() | ~t.isin(words))


def min_token_len(tokens: Column | str, longer_than: int = 2) -> Column:
    return F.filter(_c(tokens), lambda t: F.length(t) > longer_than)


def word_tokens(
    c: Column | str,
    stops: Sequence[str] = (),
    longer_than: int = 2,
    locale: str | None = None,
) -> Column:
    """The whole normaliser, text to tokens.

    Lower-case, drop links and mentions, then read off the token runs. Taking runs of
    `TOKEN` in one pass equals blanking digits, punctuation and underscores in turn
    and splitting; the minimum length rides along in the same match because a greedy
    run is never cut short.
    """
    # Most texts hold neither a link nor a mention; a substring test is cheaper than a regex pass.
    unlinked = evaluate_once(
        lower(F.coalesce(_c(c), F.lit("")), locale),
        lambda t: F.when(t.contains("http") | t.contains("www."), remove_urls(t)).otherwise(t),
    )
    cleaned = evaluate_once(unlinked, lambda t: F.when(t.contains("@"), remove_mentions(t)).otherwise(t))
    runs = F.regexp_extract_all(cleaned, F.lit(f"{TOKEN}{{{longer_than + 1},}}"), F.lit(0))
    return remove_stops(runs, stops)


def clean_text(
    c: Column | str,
    stops: Sequence[str] = (),
    longer_than: int = 2,
    locale: str | None = None,
) -> Column:
    return join_tokens(word_tokens(c, stops, longer_than, locale))


def has_text(c: Column | str) -> Column:
    return _c(c).isNotNull() & (strip(c) != "")


def min_len(c: Column | str, longer_than: int) -> Column:
    return F.length(strip(F.coalesce(_c(c), F.lit("")))) > longer_than


def feature_tokens(c: Column | str) -> Column:
    """Tokens of two or more word characters, lower-cased, for n-gram features."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(f"{WORD}{{2,}}"), F.lit(0))


def ngrams(tokens: Column | str, low: int = 1, high: int = 2) -> Column:
    """All word n-grams for n in low..high, shortest first, joined with a blank."""

    def build(words: Column) -> Column:
        size = F.size(words)
        parts = [words] if low == 1 else []
        grams = words
        for k in range(1, high):
            left = F.greatest(size - k, F.lit(0))
            grams = F.zip_with(
                F.slice(grams, 1, left), F.slice(words, k + 1, left), lambda a, b: F.concat_ws(" ", a, b)
            )
            if k + 1 >= low:
                parts.append(grams)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return evaluate_once(_c(tokens), build)
