"""The streaming extract: what a micro-batch takes, and its rows whatever it takes."""

import pytest

from pressroom.plans import scrape
from pressroom.sources import files as FS
from pressroom.streaming.extract import PAGES_SCHEMA, start_extract_stream

COLS = ["uuid", "article", "domain", "url", "date_of_creation", "cc_date", "site"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Four files of three pages each: articles, one page without a body, one of an unknown site, one null."""
    path = str(tmp_path_factory.mktemp("stream") / "pages")
    for f in range(4):
        rows = [(3 * f + k, f"http://www.example.com/{3 * f + k}", f"<p>no</p><article><p>text {f} &eacute;&#150; {k}</p></article>") for k in range(3)]
        if f == 1:
            rows[0] = (rows[0][0], rows[0][1], "<p>no article</p>")
        if f == 2:
            rows[0] = (rows[0][0], "http://nowhere.net/1", rows[0][2])
        if f == 3:
            rows[0] = (rows[0][0], rows[0][1], None)
        spark.createDataFrame(rows, PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def _ran(spark, pages, top, checkpoint="ck", **limit):
    """Numbers of pages of the micro-batches, the stored articles, the stored rejects."""
    q = start_extract_stream(spark, pages, str(top / "out"), str(top / checkpoint), **limit)
    q.awaitTermination()
    taken = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    rejects = spark.read.schema("uuid string, reject_reason string").json(str(top / "out_rejects"))
    return taken, sorted(FS.read_articles(spark, str(top / "out")).select(*COLS).collect()), sorted(rejects.collect())


def test_many_small_files_are_one_micro_batch(spark, pages, tmp_path):
    taken, articles, rejects = _ran(spark, pages, tmp_path)
    assert taken == [12]
    assert articles == sorted(scrape.articles(scrape.extract(spark.read.parquet(pages))).select(*COLS).collect())
    assert len(articles) == 9 and all("é– " in a["article"] for a in articles)
    assert sorted(r["reject_reason"] for r in rejects) == ["missing_article", "missing_article", "unknown_site"]
    # another run over the same pages appends nothing
    assert _ran(spark, pages, tmp_path, "ck2") == (taken, articles, rejects)


def test_a_micro_batch_is_bounded_and_the_rows_are_the_same(spark, pages, tmp_path):
    size = max(r["length"] for r in spark.read.format("binaryFile").load(f"{pages}/*.parquet").select("length").collect())
    taken, articles, rejects = _ran(spark, pages, tmp_path, batch_bytes=3 * size)
    assert 1 < len(taken) < 4 and sum(taken) == 12
    assert articles == sorted(scrape.articles(scrape.extract(spark.read.parquet(pages))).select(*COLS).collect())
    assert len(rejects) == 3
