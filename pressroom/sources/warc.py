"""WARC page scan (S1 with U4, U5, U6) as a distributed read.

``spark.read.text`` with ``lineSep = "WARC/1.0\\r\\n"`` yields one row per
record (Hadoop codecs decompress ``.warc.gz``; one gzip file is one task, where
``sources/warc_members.py`` reads ranges of it).
The text source keeps the raw bytes, so ``cast(value as binary)`` recovers
them even when a body is not UTF-8.  Headers are parsed with
``regexp_extract``; the record block is cut by ``Content-Length``, which
also drops the record's trailing CRLFs, and the HTTP header ends at the
first blank line of the block (U4).  The body is decoded as UTF-8 when valid,
else as Latin-1 (U5).  Only ``response`` records carry a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.urls import crawl_timestamp, decode_payload

RECORD_SEP = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"


def _header(name: str):
    return F.regexp_extract(F.col("value"), rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1)


def read_warc_records(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, url, warc_date, block binary) per WARC record."""
    return parse_records(spark.read.option("lineSep", RECORD_SEP).text(path))


def parse_records(raw: DataFrame) -> DataFrame:
    """(warc_type, url, warc_date, block binary) per record of ``value``, its bytes as a string."""
    rec = raw.where(F.col("value").contains("WARC-Type:"))
    head_end = F.instr(F.col("value"), BLANK)  # WARC headers are ASCII: char pos = byte pos
    length = _header("Content-Length").try_cast("int")  # none or a malformed one: a null block
    block = F.substring(F.col("value").cast("binary"), head_end + 4, length)
    return rec.select(
        _header("WARC-Type").alias("warc_type"),
        _header("WARC-Target-URI").alias("url"),
        _header("WARC-Date").alias("warc_date"),
        block.alias("block"))


def read_warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages (page_id, url, cc_date, html) from WARC response records.

    ``page_id`` is a hash of the url, the date as it is written and the body: deterministic
    across retries, and wide enough that no two pages share it.  A repeated record, equal
    in all three, is one page; other captures of a url are pages of their own.
    """
    return pages_of(read_warc_records(spark, path))


def pages_of(records: DataFrame) -> DataFrame:
    """The pages of parsed records, each once."""
    r = records.where((F.col("warc_type") == "response") & (F.col("url") != ""))
    http_end = F.instr(F.col("block").cast("string"), BLANK)  # HTTP headers are ASCII too
    body = F.when(http_end > 0, F.expr("substring(block, instr(cast(block as string), '\r\n\r\n') + 4)"))
    p = r.select("url", "warc_date", crawl_timestamp(F.col("warc_date")).alias("cc_date"),
                 decode_payload(body).alias("html"))
    body_hash = F.coalesce(F.sha2("html", 256), F.lit("none"))
    return p.select(F.sha2(F.concat_ws("|", "url", "warc_date", body_hash), 256).alias("page_id"),
                    "url", "cc_date", "html").dropDuplicates(["page_id"])
