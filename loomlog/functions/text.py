"""Column functions that turn a raw log line into its template.

Everything here is an expression over built-in functions, so it runs inside the
JVM, batch or streaming, with no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which words survive, so they must not drift.
MIN_WORD_BYTES = 3
MAX_WORD_BYTES = 20
HEX_WORD_BYTES = 8
ENTROPY_WORD_BYTES = 12
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_PATTERN = r"(\p{IsAlphabetic}+)"
PAIR_PATTERN = "(?s)(?=(..))"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(text: Column | str) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` equals that on pure ASCII and is much faster than ``translate``,
    which only the lines with wider characters pay for.
    """
    text = _col(text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def _ascii_letters(word: Column) -> Column:
    return F.char_length(word) - F.char_length(F.translate(word, UPPER + LOWER, ""))


def _high_entropy(word: Column) -> Column:
    # distinct characters / bytes > 0.85, kept in whole numbers
    return (F.octet_length(word) >= ENTROPY_WORD_BYTES) & (
        F.size(F.array_distinct(F.split(word, ""))) * 20 > F.octet_length(word) * 17
    )


def is_nonsense(word: Column | str) -> Column:
    """True for tokens that look like ids, hashes or random text.

    Usable on any token column; the digit rules only matter for tokens that were
    not produced by :func:`words`, which are alphabetic throughout.
    """
    word = _col(word)
    n = F.octet_length(word)
    digits = F.char_length(word) - F.char_length(F.translate(word, "0123456789", ""))
    return (
        (n > MAX_WORD_BYTES)
        | (n < MIN_WORD_BYTES)
        | (digits > F.floor(n / 2))
        | ((n > HEX_WORD_BYTES) & word.rlike("^[0-9a-fA-F]+$"))
        | (_ascii_letters(word) < F.ceil(n / 2))
        | _high_entropy(word)
    )


def _keep_alphabetic(word: Column) -> Column:
    """``not is_nonsense`` for a token known to be alphabetic and lower-case.

    The tests run cheapest first; an all-ASCII token is all letters, so only a
    token with wider characters has its ASCII letters counted.
    """
    n = F.octet_length(word)
    return (
        n.between(MIN_WORD_BYTES, MAX_WORD_BYTES)
        & ((n == F.char_length(word)) | (_ascii_letters(word) >= F.ceil(n / 2)))
        & ((n <= HEX_WORD_BYTES) | ~word.rlike("^[a-f]+$"))
        & ~_high_entropy(word)
    )


def words(line: Column | str, word_filter: bool = True) -> Column:
    """Alphabetic runs of at least three UTF-8 bytes, in order, repeats kept."""
    tokens = F.regexp_extract_all(ascii_lower(line), F.lit(WORD_PATTERN), F.lit(0))
    if word_filter:
        return F.filter(tokens, _keep_alphabetic)
    return F.filter(tokens, lambda w: F.octet_length(w) >= MIN_WORD_BYTES)


def normalize(line: Column | str, word_filter: bool = True) -> Column:
    """The template text of a line: its words joined by single spaces.

    Empty when the line has no word; words hold no space, so
    ``split(normalize(line), ' ')`` gives them back.
    """
    return F.array_join(words(line, word_filter), " ")


def template_words(normalized_text: Column | str) -> Column:
    """The word list behind a non-empty template text."""
    return F.split(_col(normalized_text), " ")


def bigrams(text: Column | str) -> Column:
    """Adjacent character pairs, repeats and spaces kept.

    A text under two bytes is its own only element; a single wide character has
    no pair. Splitting into characters once keeps long texts linear, where
    ``substring(text, i, 2)`` would scan from the start for every pair. ASCII texts take their pairs
    from one pattern, without a step per pair.
    """
    text = _col(text)
    chars = F.split(text, "")
    n = F.char_length(text)
    pairs = F.zip_with(
        F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b)
    )
    return (
        F.when(F.octet_length(text) < 2, F.array(text))
        .when(n < 2, F.array().cast("array<string>"))
        .when(F.octet_length(text) == n, F.regexp_extract_all(text, F.lit(PAIR_PATTERN), F.lit(1)))
        .otherwise(pairs)
    )


def with_template(df, word_filter: bool = True, line: str = "line"):
    """Add ``normalized_text`` and drop the lines that have no word.

    The text comes out of a one-element generator instead of a projection below
    a filter: Catalyst would push such a filter under the projection and run the
    tokenizer twice per line.
    """
    text = normalize(line, word_filter)
    kept = F.filter(F.array(text), lambda t: t != "")
    return df.select("*", F.explode(kept).alias("normalized_text"))
