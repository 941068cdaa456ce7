"""T1-T6 text cleaning and the SQL forms of the token stages.

All are built-in Column expressions (JVM side, inside whole-stage codegen).
Java regex classes (``\\w``, ``\\W``, ``\\d``, ``\\s``) are ASCII-only, which
the cleaning rules rely on: ``café`` loses its accented letter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from reviewlens.functions.constants import (
    DIGITS_PATTERN,
    NON_WORD_PATTERN,
    PUNCT_COLLAPSE_PATTERN,
    TOKEN_GAP_PATTERN,
)
from reviewlens.functions.stopwords import ENGLISH_STOP_WORDS


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combine_text(text: str | Column, summary: str | Column) -> Column:
    """T1 + T2: ``lower(concat_ws(' ', text, summary))``; nulls skipped, never null."""
    return F.lower(F.concat_ws(" ", _c(text), _c(summary)))


def collapse_punctuation(c: str | Column) -> Column:
    """Runs of ``- ? ! , .`` and spaces become one space."""
    return F.regexp_replace(_c(c), PUNCT_COLLAPSE_PATTERN, " ")


def remove_digits(c: str | Column) -> Column:
    """T4: drop digit runs."""
    return F.regexp_replace(_c(c), DIGITS_PATTERN, "")


def remove_non_word(c: str | Column) -> Column:
    """T5: drop characters that are neither word characters nor white space."""
    return F.regexp_replace(_c(c), NON_WORD_PATTERN, "")


def clean_text(c: str | Column) -> Column:
    """T3 -> T4 -> T5 in the order the model notebook applies them."""
    return remove_non_word(remove_digits(collapse_punctuation(c)))


def text_length(c: str | Column) -> Column:
    """Length in characters (code points)."""
    return F.length(_c(c))


def tokenize(c: str | Column, pattern: str = TOKEN_GAP_PATTERN) -> Column:
    """N1 SQL form of ``RegexTokenizer(pattern='\\W')``: lower-case, split on
    the gap pattern, drop empty tokens. Null text gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), pattern), "")


def remove_stop_words(tokens: str | Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
                      case_sensitive: bool = False) -> Column:
    """N2 / N14 SQL form of ``StopWordsRemover`` (case-insensitive by default)."""
    words = F.array(*[F.lit(w if case_sensitive else w.lower()) for w in stop_words])
    if case_sensitive:
        return F.filter(_c(tokens), lambda t: ~F.array_contains(words, t))
    return F.filter(_c(tokens), lambda t: ~F.array_contains(words, F.lower(t)))


def normalize_tokens(tokens: str | Column) -> Column:
    """Per-token normaliser - lower-case, keep ASCII letters only, drop empties."""
    cleaned = F.transform(_c(tokens), lambda t: F.regexp_replace(F.lower(t), "[^a-z]", ""))
    return F.filter(cleaned, lambda t: t != "")


def ngrams(tokens: str | Column, n: int = 2) -> Column:
    """N4 SQL form of ``NGram(n)``: space-joined windows of ``n`` tokens;
    fewer than ``n`` tokens give an empty array."""
    arr = _c(tokens)
    if n == 1:
        return arr
    starts = F.sequence(F.lit(0), F.size(arr) - n)
    windows = F.transform(
        starts, lambda i: F.array_join(F.slice(arr, i + 1, n), " ")
    )
    return F.when(F.size(arr) >= n, windows).otherwise(F.array().cast("array<string>"))


def explode_tokens(df, keys, tokens: str | Column, alias: str = "token", with_position: bool = False):
    """One row per array element, for non-empty arrays (same rows as ``explode``).

    Written as ``explode_outer`` + a null filter: for a plain ``explode`` the
    optimizer infers ``size(tokens) > 0`` and pushes it below exchanges into the
    scan, which evaluates the whole tokenising expression a second time there.
    """
    arr = _c(tokens)
    if with_position:
        gen = F.posexplode_outer(arr).alias("pos", alias)
    else:
        gen = F.explode_outer(arr).alias(alias)
    return df.select(*[F.col(k) for k in keys], gen).where(F.col(alias).isNotNull())
