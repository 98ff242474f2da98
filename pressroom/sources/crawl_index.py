"""Crawl-index lines (I1, I2): a sort key, a 14-digit capture time and JSON fields.

    com,example)/news 20210724103200 {"url": "https://example.com/news", "mime": "text/html", ...}

The key is the URL with its host's labels reversed, so that all captures of a host,
and of a domain, lie next to each other; scheme, ``www.``, port, fragment, letter case and
closing slash are not part of it.  An index is written range-partitioned by
key and time, as it is published, and read line by line: any number of files and splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.operators.index import filter_mime
from pressroom.sources.files import read_lines

FIELDS = ("url", "mime", "mime-detected", "status", "digest", "length", "offset", "filename")
_JSON = "struct<" + ", ".join(f"`{f}`: string" for f in FIELDS) + ">"
_TIME = "yyyyMMddHHmmss"


def sort_key(url: Column) -> Column:
    """The index key of a URL; null where it has no host."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"#.*$", "")
    host = F.regexp_extract(bare, r"^(?:[a-z][a-z0-9+.-]*://)?+(?:[^/?@]*@)?(?:www\d*\.)?([^/?:@]+)", 1)
    path = F.regexp_extract(bare, r"^(?:[a-z][a-z0-9+.-]*://)?+[^/?]*(.*)$", 1)
    path = F.when(path.rlike(r"^/*$"), F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(host != "", F.concat(labels, F.lit(")"), path))


def write_index(captures: DataFrame, path: str) -> None:
    """Write captures (url, captured timestamp, and any of the fields) as index lines in key order.
    Captures without a key or time are left out; null fields are absent from the JSON."""
    fields = [F.col(f).cast("string").alias(f) for f in FIELDS if f in captures.columns]
    rows = captures.select(sort_key(F.col("url")).alias("key"), F.date_format("captured", _TIME).alias("time"),
                           F.to_json(F.struct(*fields)).alias("json")).dropna(subset=["key", "time"])
    rows.repartitionByRange("key", "time").sortWithinPartitions("key", "time", "json") \
        .select(F.concat_ws(" ", "key", "time", "json").alias("value")) \
        .write.option("compression", "gzip").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, captured, url, mime, mime_detected, status, digest, length, offset, filename) of every line
    that has a key, a time and JSON; other lines are dropped."""
    line = r"^(\S+) (\d{14}) (\{.*\})\s*$"
    parts = read_lines(spark, path).select(*[F.regexp_extract("value", line, k).alias(n) for k, n in ((1, "key"), (2, "time"), (3, "json"))])
    rows = parts.where("key <> ''").withColumn("f", F.from_json("json", _JSON))
    captured = F.try_to_timestamp("time", F.lit(_TIME)).cast("timestamp_ntz")
    return rows.where(F.col("f").isNotNull()).select(
        "key", captured.alias("captured"), "f.url", "f.mime", F.col("f.mime-detected").alias("mime_detected"),
        F.try_to_number("f.status", F.lit("999")).cast("int").alias("status"), "f.digest",
        F.expr("try_cast(f.length AS bigint)").alias("length"), F.expr("try_cast(f.offset AS bigint)").alias("offset"), "f.filename")


def newest_captures(index: DataFrame) -> DataFrame:
    """Of each key the newest capture; ties go to the larger (filename, offset, digest).  A
    partially aggregated maximum, so a key captured a million times folds where it is read."""
    order = F.struct("captured", F.coalesce("filename", F.lit("")), F.coalesce("offset", F.lit(-1)), F.coalesce("digest", F.lit("")))
    rest = [c for c in index.columns if c != "key"]
    return index.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("key", "r.*")


def wanted_captures(index: DataFrame, allowed: DataFrame) -> DataFrame:
    """I1, then I2: the newest capture of each key among those of an allowed MIME type."""
    return newest_captures(filter_mime(index, allowed))
