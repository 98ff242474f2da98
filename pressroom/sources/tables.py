"""Driver tables and the adapters that bind them to the corpus data model.

Data model (see SURVEY 1.1):

* articles(uuid string, article string, domain string, url string,
           date_of_creation timestamp_ntz, cc_date timestamp_ntz, site string, lang string)
* pages(page_id long, url string, html string) (+ domain, site, cc_date when derived)
* predictions(uuid string, generated string, article string)

Timestamps are ``timestamp_ntz``: the reference's dates are naive, and
DuckDB's ``TIMESTAMP`` is naive too, so values compare without a zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crawl_date(doc_id: Column, cfg: Config = DEFAULT) -> Column:
    """Adapter: ``documents`` has no date, so crawl date = epoch + doc_id days."""
    return F.timestamp_add("DAY", doc_id, F.lit(cfg.crawl_epoch).cast("timestamp_ntz"))


def site_of(domain: Column) -> Column:
    """Site key is the text before the first dot of the domain, per row."""
    return F.substring_index(domain, ".", 1)


def articles_from_documents(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT,
                            with_lang: bool = True) -> DataFrame:
    """Bind ``documents`` to the article schema.

    uuid = doc_id as text, article = text, domain = source, site = U3(domain),
    cc_date = epoch + doc_id days.  ``date_of_creation`` is the crawl date too,
    the documents carry no publication date.
    """
    d = read_table(spark, sf_dir, "documents")
    cols = [
        F.col("doc_id").cast("string").alias("uuid"),
        F.col("text").alias("article"),
        F.col("source").alias("domain"),
        F.concat(F.lit("https://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        crawl_date(F.col("doc_id"), cfg).alias("date_of_creation"),
        crawl_date(F.col("doc_id"), cfg).alias("cc_date"),
        site_of(F.col("source")).alias("site"),
    ]
    if with_lang:
        cols.append(F.col("lang"))
    return d.select(*cols)


def pages_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def prediction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter for ROUGE input: a turn is the generated text, the turn before it
    in the same conversation is the reference.

    Expressed as an equi-join on (conv_id, turn - 1) rather than a window
    ``lag``: a window would put a whole conversation in one task, the join
    shuffles by key and survives a conversation holding a third of all rows.
    """
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    gen = c.select("conv_id", "turn", F.col("text").alias("generated"))
    ref = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("article"))
    return (gen.join(ref, ["conv_id", "turn"], "inner")
            .select(F.concat_ws("_", "conv_id", "turn").alias("uuid"), "generated", "article"))
