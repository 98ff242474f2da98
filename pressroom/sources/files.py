"""File sources: article JSON lines (S2, S3), predictions (S5), the URL rule
file (S6), the site list (S7) and the encoded dataset (S8).

Schemas are declared: gzip JSON is not splittable, and inference would read
it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("article", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("date_of_creation", T.TimestampNTZType()),
    T.StructField("cc_date", T.TimestampNTZType()),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("generated", T.StringType()),
    T.StructField("article", T.StringType()),
])

ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_articles(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_SCHEMA) -> DataFrame:
    """S2 + S3: article JSON lines, gzip or plain; ``site`` from a ``site=``
    partition directory when present, else from the file name
    (``{site}.jsonl.gz``, as the reference names its files)."""
    df = (spark.read.schema(schema).option("timestampNTZFormat", ISO).option("recursiveFileLookup", "false")
          .json(path))
    if "site" in df.columns:
        return df
    fname = F.col("_metadata.file_name")
    return df.select("*", F.regexp_extract(fname, r"^(.*?)(\.jsonl)?(\.gz)?$", 1).alias("site"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction JSON lines (uuid, generated[, article])."""
    return spark.read.schema(PREDICTION_SCHEMA).json(path)


def read_url_rules(spark: SparkSession, path: str) -> list[str]:
    """One pattern per line, trimmed; blank lines skipped.  The file is a
    short configuration list, collected to compile one regular expression."""
    rows = spark.read.text(path).select(F.trim("value").alias("p")).where(F.col("p") != "").collect()
    return [r["p"] for r in rows]


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """``SITE|URL`` lines -> (site, url_prefix)."""
    return spark.read.schema("site string, url_prefix string").option("sep", "|").csv(path)


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """Reload a saved encoded dataset (K7)."""
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files, plain or gzip."""
    return spark.read.text(path)
