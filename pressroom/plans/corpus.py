"""Corpus-level plans over the ``documents`` binding: clean (C6), audit (K9),
statistics (G*).  Each is a function ``(spark, sf_dir, cfg) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config
from pressroom.operators import clean as C
from pressroom.operators import stats as G
from pressroom.sources.tables import articles_from_documents


def articles_with_stats(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """Articles + ``article_length`` + ``word_count`` (the notebook's loader)."""
    return C.with_text_stats(articles_from_documents(spark, sf_dir, cfg))


def length_word_filtered(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """C1 then C2 (the cheap part of C6, before language identification)."""
    a = articles_with_stats(spark, sf_dir, cfg)
    return C.filter_words(C.filter_length(a, cfg), cfg)


def flagship(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """Length statistics per site after the length and word filters (G1 over C1+C2)."""
    return G.describe(length_word_filtered(spark, sf_dir, cfg), "article_length", "domain")


# Test binding: the driver's documents are en/fr/de/es; the reference keeps
# hu/cs/sk.  Queries over ``documents`` keep two of the present languages so
# the language filter has rows on both sides.
DOCS_CFG = Config(allowed_languages=("fr", "de"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2-T5 and T8 per article."""
    from pressroom.functions import text as X
    a = articles_from_documents(spark, sf_dir)
    return a.select("uuid",
                    X.article_length("article").alias("article_length"),
                    X.word_count("article").alias("word_count"),
                    X.sentence_count("article").alias("sentence_count"),
                    X.token_count("article").alias("token_count"),
                    F.length(X.newlines_to_blanks("article")).cast("long").alias("lid_length"),
                    F.instr(X.newlines_to_blanks("article"), "\n").cast("long").alias("lid_newline_at"))


def nfkc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC over every article; reports lengths before and after."""
    from pressroom.functions.text import nfkc
    a = articles_from_documents(spark, sf_dir)
    n = nfkc(F.col("article"))
    return a.select("uuid", F.length("article").cast("long").alias("n_before"),
                    F.length(n).cast("long").alias("n_after"),
                    (n != F.col("article")).alias("changed"))


def stage_counts(spark: SparkSession, sf_dir: str, cfg: Config = DOCS_CFG) -> DataFrame:
    """K9 with the given language column (``lang``) standing in for C3."""
    a = articles_from_documents(spark, sf_dir, cfg)
    return C.stage_audit(a, cfg, lang_col="lang")


def sentence_filtered(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """C5 after C1+C2: uuids of articles with at least three sentences."""
    return C.filter_sentences(length_word_filtered(spark, sf_dir, cfg), cfg).select("uuid", "site")


def site_selection(spark: SparkSession, sf_dir: str, sites: str = "src1,src2",
                   exact: bool = False) -> DataFrame:
    """Substring (clean stage) or exact (scrape stage) site selection; counts per site."""
    a = articles_from_documents(spark, sf_dir)
    return C.select_sites(a, sites, exact=exact).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


def raw_vs_clean(spark: SparkSession, sf_dir: str, value: str, cfg: Config = DEFAULT) -> DataFrame:
    """Describe of raw and length/word-cleaned articles, per domain."""
    raw = articles_with_stats(spark, sf_dir, cfg)
    clean = C.filter_words(C.filter_length(raw, cfg), cfg)
    return G.stage_compare({"raw": raw, "clean": clean}, value, "domain")


def language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled documents, identify every article."""
    from pressroom.operators import langid as L
    a = articles_from_documents(spark, sf_dir)
    profile, langs = L.train(a, "article", "lang")
    return L.identify(a, profile, langs, "uuid", "article", "language")


def clean(spark: SparkSession, sf_dir: str, cfg: Config = DOCS_CFG) -> DataFrame:
    """C1 -> C2 -> C3 -> C4 -> drop helper columns.

    Language identification runs only on rows that passed the cheap filters
    (the reference's order), joined back on uuid.
    """
    from pressroom.operators import langid as L
    a = articles_from_documents(spark, sf_dir, cfg)
    profile, langs = L.train(a, "article", "lang")
    kept = C.filter_words(C.filter_length(C.with_text_stats(a), cfg), cfg)
    lid = L.identify(kept, profile, langs, "uuid", "article", "language")
    out = L.filter_languages(kept.join(lid, "uuid"), cfg.allowed_languages)
    return out.drop("language", "word_count", "article_length")


def clean_with_model(articles: DataFrame, model, cfg: Config = DOCS_CFG) -> DataFrame:
    """C6 by a stored language model: C1 -> C2 -> C3 -> C4, map-only; a row that repeats an id is
    judged by its own text."""
    from pressroom.operators import langid as L
    from pressroom.operators import trigrams as T
    kept = C.filter_words(C.filter_length(C.with_text_stats(articles), cfg), cfg)
    named = kept.withColumn("language", T.language(articles.sparkSession, F.col("article"), model))
    return L.filter_languages(named, cfg.allowed_languages).drop("language", "word_count", "article_length")
