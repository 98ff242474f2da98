"""Crawl-index and page-level URL operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions import urls as U

DEFAULT_ALLOWED_MIMES = ("text/html", "application/xhtml+xml")


def filter_blocked_urls(pages: DataFrame, rules=U.BAD_URL_RULES, url_col: str = "url") -> DataFrame:
    """Keep pages whose URL matches no blocklist rule."""
    return pages.where(~U.is_blocked(F.col(url_col), rules))


def with_domain_and_site(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """U2 + U3 as columns."""
    d = U.registered_domain(F.col(url_col))
    return pages.withColumn("domain", d).withColumn("site", U.site_key(F.col("domain")))


def allowed_mimes_table(spark: SparkSession, mimes=DEFAULT_ALLOWED_MIMES) -> DataFrame:
    return spark.createDataFrame([(m,) for m in mimes], "mime string")


def filter_mime(index: DataFrame, allowed: DataFrame, mime_col: str = "mime") -> DataFrame:
    """Left-semi join on the allowed MIME list.

    The list is a configuration file of a handful of types, so broadcasting
    it is bounded by construction; the index side is never shuffled.
    """
    return index.join(F.broadcast(allowed.select(F.col("mime").alias(mime_col))), mime_col, "left_semi")


def dedup_index_urls(index: DataFrame, url_col: str = "url", order_col: str = "page_id") -> DataFrame:
    """Newest capture per canonical URL.

    ``max_by`` over a group-by is order independent (``dropDuplicates`` keeps
    an arbitrary row) and partially aggregated, so a URL captured a million
    times folds map-side.
    """
    key = U.canonical_url(F.col(url_col))
    cols = [c for c in index.columns]
    return (index.withColumn("canonical_url", key)
            .groupBy("canonical_url")
            .agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("r"))
            .select("canonical_url", "r.*"))


def with_listed_site(pages: DataFrame, site_list: DataFrame) -> DataFrame:
    """Add ``listed_site``, the site of the longest listed prefix of the URL (scheme and
    ``www.`` aside) that ends at a segment; null where none does.

    A URL's own prefixes are exploded and met by equality, so the list may be of any size."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^(?:[a-z][a-z0-9+.-]*://)?(?:www\.)?", ""), r"/+$", "")
    path = F.regexp_replace(bare(F.col("url")), r"[?#].*$", "")
    steps = F.split(path, "/")
    own = pages.where(F.col("url").isNotNull()).select("url").distinct().select(
        "url", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)),
                                     lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("prefix"))
    listed = site_list.groupBy(bare(F.col("url_prefix")).alias("prefix")).agg(F.min("site").alias("listed_site"))
    best = own.join(listed, "prefix").groupBy("url").agg(F.max_by("listed_site", F.length("prefix")).alias("listed_site"))
    return pages.join(best, "url", "left")
