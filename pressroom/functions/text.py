"""Text scalars as Spark column expressions.

All but ``nfkc`` are JVM built-ins and stay inside whole-stage codegen.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's ``str.split()`` splits on Unicode white space and on the
# information separators \x1c-\x1f; Java's ``(?U)\s`` lacks the latter.
WS = r"[\s\x1c-\x1f]"
_STRIP_RE = rf"(?U)^{WS}+|{WS}+$"
_WORD_RE = r"(?U)[^\s\x1c-\x1f]+"  # a word: a run of characters outside WS

# Tokens: runs of letters, digits and underscore, or a single other
# non-space symbol.  Written with \pL / \pN so Java and RE2 agree.
TOKEN_RE = r"[\pL\pN_]+|[^\pL\pN_\s]"
SENTENCE_SPLIT_RE = r"[.!?]+\s+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def article_length(text: Column | str) -> Column:
    """Length in code points (pandas ``str.len``)."""
    return F.length(_c(text)).cast("long")


def strip_ws(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), _STRIP_RE, "")


def word_count(text: Column | str) -> Column:
    """``len(text.split())``.

    The number of maximal non-white-space runs, counted by one regex pass:
    no stripped copy of the text and no array of words (a blank text has
    none).  The expression is a single call, so when the optimizer repeats
    it in a filter and a projection the text is still scanned once per use.
    """
    return F.regexp_count(_c(text), F.lit(_WORD_RE)).cast("long")


def sentence_count(text: Column | str) -> Column:
    """T4: sentences are the non-blank pieces between terminator runs
    (``[.!?]+`` followed by white space); newline tokens are not sentences."""
    s = strip_ws(text)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, SENTENCE_SPLIT_RE))).cast("long")


def token_count(text: Column | str) -> Column:
    """T5: word tokens plus punctuation tokens; newlines are not tokens."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(TOKEN_RE), 0)).cast("long")


def newlines_to_blanks(text: Column | str) -> Column:
    """The text handed to language identification."""
    return F.translate(_c(text), "\n", " ")


def round4(x: Column | str) -> Column:
    """Scores rounded to 4 digits, half away from zero like Python on
    the decimal value (``bround`` would be banker's rounding)."""
    return F.round(_c(x), 4)


@F.pandas_udf(T.StringType())
def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if isinstance(v, str) else v)


def nfkc(text: Column | str) -> Column:
    """NFKC normalisation.

    Spark has no normalize built-in, so this is an Arrow-batched pandas UDF.
    ASCII is NFKC-stable: such rows are sent to Python as nulls (a null costs
    one bit in the Arrow batch) and keep their JVM value.
    """
    t = _c(text)
    non_ascii = F.when(t.rlike(r"[^\x00-\x7F]"), t)
    return F.coalesce(_nfkc_batch(non_ascii), t)
