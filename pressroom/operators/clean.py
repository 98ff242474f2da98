"""Cleaning filters (C1, C2, C4, C5, C6) and the stage audit (K9).

One narrow stage: every predicate is a built-in expression, so Catalyst
fuses them into a single whole-stage-codegen filter over the scan.  Language
identification (C3) lives in ``operators.langid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config
from pressroom.functions.text import article_length, sentence_count, word_count
from pressroom.operators import sentences


def with_text_stats(df: DataFrame, text: str = "article") -> DataFrame:
    """Add ``article_length`` (T2) and ``word_count``."""
    return df.withColumns({
        "article_length": article_length(text),
        "word_count": word_count(text),
    })


def length_ok(cfg: Config = DEFAULT, col: str = "article_length") -> Column:
    """Length in [min, max], inclusive."""
    return F.col(col).between(cfg.min_article_len, cfg.max_article_len)


def words_ok(cfg: Config = DEFAULT, col: str = "word_count") -> Column:
    """Words in [min, max], inclusive; no maximum means unbounded."""
    c = F.col(col) >= cfg.min_article_words
    if cfg.max_article_words is not None:
        c = c & (F.col(col) <= cfg.max_article_words)
    return c


def language_ok(cfg: Config = DEFAULT, col: str = "language") -> Column:
    """C4: keep the configured languages."""
    return F.col(col).isin(list(cfg.allowed_languages))


def filter_length(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return df.where(length_ok(cfg, "article_length"))


def filter_words(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return df.where(words_ok(cfg, "word_count"))


def filter_sentences(df: DataFrame, cfg: Config = DEFAULT, text: str = "article",
                     abbreviations: list[str] | None = None) -> DataFrame:
    """At least ``min_article_sentences`` sentences (off in C6, as in the reference).
    With ``abbreviations``, a loaded model, their full stops end no sentence."""
    n = sentence_count(text) if abbreviations is None else sentences.sentence_count(text, abbreviations)
    return df.where(n >= cfg.min_article_sentences)


def select_sites(df: DataFrame, sites: str | list[str] | None, exact: bool = False,
                 col: str = "site") -> DataFrame:
    """``'all'``/None keeps everything; else a comma list.

    ``exact`` is the scrape-stage rule (site equals a listed name); otherwise
    the clean-stage rule (a listed name is a substring of the site).
    """
    if sites is None or sites == "all":
        return df
    names = sites.split(",") if isinstance(sites, str) else list(sites)
    if exact:
        return df.where(F.col(col).isin(names))
    cond = F.lit(False)
    for n in names:
        cond = cond | F.col(col).contains(n)
    return df.where(cond)


def stage_audit(df: DataFrame, cfg: Config = DEFAULT, lang_col: str | None = "language",
                text: str = "article", by: str = "site") -> DataFrame:
    """K9: row count after each cleaning filter, per site, in one pass.

    The reference logs ``len(df)`` after every mask (a job per stage); this is
    a single aggregation with conditional counts.
    """
    n = article_length(text)
    w = word_count(text)
    c1 = n.between(cfg.min_article_len, cfg.max_article_len)
    c2 = c1 & (w >= cfg.min_article_words)
    if cfg.max_article_words is not None:
        c2 = c2 & (w <= cfg.max_article_words)
    aggs = [F.count(F.lit(1)).alias("n_input"),
            F.count_if(c1).alias("n_length_ok"),
            F.count_if(c2).alias("n_words_ok")]
    if lang_col is not None:
        aggs.append(F.count_if(c2 & F.col(lang_col).isin(list(cfg.allowed_languages)))
                    .alias("n_language_ok"))
    return df.groupBy(by).agg(*aggs)
