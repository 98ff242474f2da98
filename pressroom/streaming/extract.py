"""The extract stage under Structured Streaming.

The reference scrapes crawl files one after another and appends articles.
That stage is stateless per page, so it runs as a streaming query: a file
source over page files (Parquet here; WARC via ``read_warc_pages`` in the
batch path), ``foreachBatch`` running the same extraction plan as the batch
job, and the idempotent article append (K1) as the sink.  Together with the
checkpoint location this gives exactly-once output: a replayed micro-batch
re-derives the same deterministic ids and the anti-join skips them.

A micro-batch takes files up to a number of bytes, not of files: each has a plan
and two appends of its own, so that many small files cost as little as few large
ones, and what a micro-batch keeps is bounded however many files wait.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pressroom.plans import scrape
from pressroom.sinks.writers import append_articles
from pressroom.sources.site_rules import ALL_RULES

#: Bytes of page files that a micro-batch takes; a larger file is one by itself.
BATCH_BYTES = 256 * 1024 * 1024

PAGES_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def start_extract_stream(spark: SparkSession, pages_path: str, out_path: str, checkpoint: str,
                         rules=ALL_RULES, url_rules=None, max_files: int | None = None,
                         available_now: bool = True, batch_bytes: int = BATCH_BYTES):
    """Start the streaming extract; returns the ``StreamingQuery``.  A micro-batch takes
    files of ``batch_bytes`` together, or ``max_files`` files if that is given."""
    from pressroom.functions.urls import BAD_URL_RULES
    ur = BAD_URL_RULES if url_rules is None else url_rules
    limit = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", batch_bytes)
    src = spark.readStream.schema(PAGES_SCHEMA).option(*limit).parquet(pages_path)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        ex = scrape.extract(batch, rules, ur).persist()  # articles and rejects from one extraction
        try:
            append_articles(scrape.articles(ex), out_path)
            append_articles(scrape.rejects(ex).withColumnRenamed("page_id", "uuid")
                            .selectExpr("cast(uuid as string) as uuid", "url", "site", "reject_reason"),
                            out_path.rstrip("/") + "_rejects")
        finally:
            ex.unpersist()

    w = src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
