"""Extraction on hand-made pages, one per site rule and fallback."""

import datetime as dt
from collections import Counter

import pytest

from pressroom.plans import scrape

PAGES = {
    # telex: body, date from p.history--original, lead link removed, figure.image removed
    1: ("https://telex.hu/belfold/2021/07/24/cikk",
        """<html><body><div class="top"><p class="history--original">2021. július 24. 10:32</p></div>
        <div class="article-html-content"><p>Első bekezdés a cikkben.</p>
        <figure class="image"><figcaption>képaláírás</figcaption></figure>
        <p><a href="/legfrissebb"><strong>Friss hírek itt</strong></a> és még szöveg.</p>
        <table><tr><td>táblázat</td></tr></table>
        <div><div>Belső <b>doboz</b> tartalom.</div></div></div></body></html>"""),
    # telex live blog: rejected before anything else
    2: ("https://telex.hu/kulfold/2021/07/24/elo",
        """<html><body><div class="liveblog"></div><div class="article-html-content"><p>x y z</p></div></body></html>"""),
    # index: lead (div.cikk-torzs > p > strong) dropped from the body, date cut at "Módosítva"
    3: ("https://index.hu/gazdasag/2021/07/25/cikk",
        """<html><body><div class="datum">2021. július 25. 08:15 Módosítva: 2021. július 25. 09:00</div>
        <div class="cikk-torzs"><p><strong>Vezető bekezdés.</strong></p><p>Törzs szöveg itt.</p>
        <div class="cikk-bottom-box">hirdetés</div></div></body></html>"""),
    # index: second body rule and the fallback date when the first date text is blank
    4: ("https://index.hu/sport/2021/07/26/cikk",
        """<html><body><span class="ido"> </span><time class="t-asd_share-date_date">2021-07-26 12:00</time>
        <div class="text"><p>Második szabály szerinti törzs.</p></div></body></html>"""),
    # ac24: fourth body rule, scripts and figures removed, date from time.published
    5: ("https://www.ac24.cz/zpravy/clanek",
        """<html><body><time class="published">24. července 2021 14:05</time>
        <div class="component-inner"><p>Text článku.</p><script>var a = "</p>";</script>
        <figure><img src="a.jpg"><figcaption>popisek</figcaption></figure><p>Konec.</p></div></body></html>"""),
    # parlamentnilisty: images and polls removed
    6: ("https://www.parlamentnilisty.cz/arena/clanek",
        """<html><body><div class="time">25. 7. 2021 9:30</div>
        <section class="article-content"><p>Úvod <img src="x.png"> textu.</p>
        <section class="poll">anketa</section><p>Závěr.</p></section></body></html>"""),
    # missing body
    7: ("https://www.ac24.cz/zpravy/prazdny", "<html><body><div class='other'>nic</div></body></html>"),
    # unknown site
    8: ("https://news.sample.net/x", "<html><body><article>text</article></body></html>"),
    # blocked URL never reaches extraction
    9: ("https://telex.hu/cimke/valami", "<html><body><div class='article-html-content'>x</div></body></html>"),
}


@pytest.fixture(scope="module")
def extracted(spark):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id long, url string, html string")
    return {r.page_id: r for r in scrape.extract(pages).collect()}


def test_blocked_url_is_dropped(extracted):
    assert 9 not in extracted


def test_telex(extracted):
    r = extracted[1]
    assert r.reject_reason is None and r.site == "telex" and r.domain == "telex.hu"
    assert "Első bekezdés a cikkben." in r.article
    assert "képaláírás" not in r.article          # figure.image removed
    assert "Friss hírek" not in r.article         # p > a[href] > strong removed
    assert "és még szöveg." in r.article
    assert "táblázat" not in r.article            # every table removed
    assert "Belső doboz tartalom." in r.article   # nested divs kept whole
    assert r.date_of_creation == dt.datetime(2021, 7, 24, 10, 32)


def test_liveblog_rejected(extracted):
    assert extracted[2].reject_reason == "invalid_page"


def test_index_lead_and_modified(extracted):
    r = extracted[3]
    assert r.reject_reason is None
    assert "Vezető bekezdés" not in r.article and "Törzs szöveg itt." in r.article
    assert "hirdetés" not in r.article
    assert r.date_of_creation == dt.datetime(2021, 7, 25, 8, 15)


def test_index_fallbacks(extracted):
    r = extracted[4]
    assert r.article == "Második szabály szerinti törzs."
    assert r.date_of_creation == dt.datetime(2021, 7, 26, 12, 0)


def test_ac24(extracted):
    r = extracted[5]
    assert r.article == "Text článku.\n\nKonec."
    assert r.date_of_creation == dt.datetime(2021, 7, 24, 14, 5)


def test_parlamentnilisty(extracted):
    r = extracted[6]
    assert "anketa" not in r.article and "Úvod textu." in r.article.replace("  ", " ")
    assert r.date_of_creation == dt.datetime(2021, 7, 25, 9, 30)


def test_missing_and_unknown(extracted):
    assert extracted[7].reject_reason == "missing_article"
    assert extracted[8].reject_reason == "unknown_site"


def test_ids_are_deterministic(spark, extracted):
    pages = spark.createDataFrame([(1, PAGES[1][0], PAGES[1][1])], "page_id long, url string, html string")
    again = scrape.extract(pages).collect()[0]
    assert again.uuid == extracted[1].uuid


ODD = {
    1: "<article>1 < 2 and more</article>",
    2: """<article><a title="a>b" href='x'>link</a> it's</article>""",
    3: "<article>seen<div class=ad>advert</div></article>",
    4: "<div><nav>menu</div><article>kept text</article>",
    5: "<article>Caf&eacute; &#337; &#x151; &#128; &#x1F600; &unknown; &amp;lt; a & b</article>",
    6: "<article><p title=it's>first<p>second</b></article></article> after",
    7: "<article>open <b>to the end",
}
ODD_TEXT = {1: "1 < 2 and more", 2: "link it's", 3: "seen", 4: "kept text", 5: "Café ő ő € 😀 &unknown; &lt; a & b",
            6: "first\n\nsecond", 7: "open to the end"}


def test_odd_markup(spark):
    pages = spark.createDataFrame([(k, "https://example.com/a", h) for k, h in ODD.items()], "page_id long, url string, html string")
    assert {r.page_id: r.article for r in scrape.extract(pages).collect()} == ODD_TEXT


def test_child_selector_knows_unclosed_parents(spark):
    body = '<div class="article-html-content">{}</div>'
    html = {1: body.format('<p>a<br><i>b<div><a href="/legfrissebb"><strong>stays</strong></a></div>'),
            2: body.format('<div><i>x</div><p><a href=/legfrissebb><strong>goes</strong></a>rest</p>')}
    pages = spark.createDataFrame([(k, "https://telex.hu/x/y", h) for k, h in html.items()], "page_id long, url string, html string")
    out = {r.page_id: r.article for r in scrape.extract(pages).collect()}
    assert "stays" in out[1] and "goes" not in out[2] and "rest" in out[2]


DATES = ["2021. július 24., szombat 10:32", "2021. július 24. v 10:32", "2021. július 24. | 10:32", "2021. július 24. – 10:32",
         "24/07/2021 10:32", "24. července 2021 v 10:32", "24th July 2021, 10:32", "July 24th, 2021 at 10:32",
         "2021.07.24. szombat 10:32", "2021-07-24T10:32:00"]


def test_dates_with_time(spark):
    from pressroom.functions.dates import parse_human_date
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(d,) for d in DATES], "d string").select("d", parse_human_date(F.col("d")).alias("t")).collect()
    assert {r.d: r.t for r in rows} == {d: dt.datetime(2021, 7, 24, 10, 32) for d in DATES}


def test_layouts_hold_every_page_s_whole_article(spark, smoke_dir):
    from pressroom.plans.registry import QUERIES, whole_layout_pages
    n = spark.read.parquet(f"{smoke_dir}/pages.parquet").count()
    plain = {r.url: r.article for r in QUERIES["h12_extract_articles"](spark, smoke_dir).collect()}
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{smoke_dir}/pages.parquet").collect()}
    assert whole_layout_pages(spark, smoke_dir).count() == 10 * n
    rows = QUERIES["h2_h12_site_layouts_whole"](spark, smoke_dir).where("reject_reason is null").collect()
    assert Counter(r.page_id % 10 for r in rows) == dict.fromkeys((0, 2, 3, 4, 5, 6), n)
    met = [(plain[pages[r.page_id // 10]], r.article) for r in rows if pages[r.page_id // 10] in plain]
    assert met and all(a and a in b for a, b in met)


def test_relative_dates_as_seen_at_the_crawl(spark):
    from datetime import datetime
    page = '<html><body><time class="published">{}</time><div class="component-inner"><p>Text.</p></div></body></html>'
    said = {1: "včera v 14:05", 2: "před 2 hodinami", 3: "24. července 2021 14:05", 4: "brzy"}
    rows = [(k, "https://www.ac24.cz/zpravy/clanek", page.format(x), datetime(2021, 8, 1, 1, 30)) for k, x in said.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, cc_date timestamp_ntz")
    got = {r.page_id: r.date_of_creation for r in scrape.extract(pages, relative_dates=True).collect()}
    assert got == {1: datetime(2021, 7, 31, 14, 5), 2: datetime(2021, 7, 31, 23, 30), 3: datetime(2021, 7, 24, 14, 5), 4: None}
    assert scrape.extract(pages).where("date_of_creation is not null").count() == 1


def test_a_page_stays_one_row(spark):
    """Tokens are neither rows of a shuffle and a window nor joined back to their pages."""
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id long, url string, html string")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plan = text(scrape.extract(pages))
    assert "posexplode" not in plan and "Join" not in plan and "Aggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Window [") == 1
    # a condition on the result doesn't work the texts out a second time
    assert text(scrape.articles(scrape.extract(pages))).count("array_join") == plan.count("array_join")


def test_pages_of_one_id_share_their_texts(spark):
    page = '<div class="article-html-content">{}</div>'
    rows = [(1, "https://telex.hu/x/a", page.format("one <b>two</b><table>gone</table>")), (1, "https://telex.hu/x/b", page.format("ein ")),
            (1, "https://nowhere.org/x", "<article>not asked for</article>"), (None, "https://telex.hu/x/c", page.format("no id")),
            (2, "https://telex.hu/x/d", None), (3, "https://telex.hu/x/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.url[-1]: (r.article, r.reject_reason) for r in scrape.extract(pages).collect()}
    assert got == {"a": ("ein one", None), "b": ("ein one", None), "x": (None, "unknown_site"), "c": (None, "missing_article"),
                   "d": (None, "missing_article"), "e": (None, "missing_article")}


def test_coverage_is_linear_and_exact(spark):
    """Elements within each other, side by side, and none, over a page of many tokens."""
    from pyspark.sql import functions as F
    from pressroom.operators import html as H
    n = 200_000
    spans = {1: [(3, 9), (4, 5), (12, 12)], 2: [], 3: [(k, k + 1) for k in range(0, n - 1, 4)]}
    df = spark.createDataFrame(list(spans.items()), "k int, spans array<struct<pos:int,end:int>>")
    got = {r.k: r.c for r in df.select("k", H.coverage(F.col("spans"), F.lit(n)).alias("c")).collect()}
    assert got[2] == [] and [i for i, x in enumerate(got[1]) if x] == [3, 4, 5, 6, 7, 8, 9, 12]
    assert [i for i, x in enumerate(got[3]) if x] == [i for i in range(n) if i % 4 in (0, 1)]


def test_named_references_keep_their_characters(spark):
    from html.entities import html5
    from pyspark.sql import functions as F
    from pressroom.operators.html import decode_entities
    rows = [(k, v) for k, v in html5.items() if k.endswith(";")]
    df = spark.createDataFrame(rows, "k string, v string").select("k", "v", decode_entities(F.concat(F.lit("a&"), "k", F.lit("b"))).alias("got"))
    assert df.where(F.col("got") != F.concat(F.lit("a"), "v", F.lit("b"))).count() == 0
