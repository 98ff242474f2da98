"""Crawl-index lines and public-suffix rules on odd rows."""

import datetime as dt
import gzip

from pyspark.sql import functions as F

from pressroom.operators import domains as DM
from pressroom.operators import index as I
from pressroom.sources import crawl_index as CI


def test_sort_keys(spark):
    want = {"https://www.Example.com/News/": "com,example)/news", "http://a.b.example.com:8080/x?q=1#f": "com,example,b,a)/x?q=1",
            "example.org": "org,example)/", "http://u:p@example.org//": "org,example)/", "https://www2.example.org/?": "org,example)/?",
            "": None, None: None, "http:///x": None}
    rows = spark.createDataFrame([(u,) for u in want], "url string").select("url", CI.sort_key(F.col("url")).alias("k")).collect()
    assert {r["url"]: r["k"] for r in rows} == want


def test_index_lines(spark, tmp_path):
    path = tmp_path / "cdx-00000.gz"
    lines = ['org,a)/ 20210724103200 {"url": "http://a.org/", "mime": "text/html", "status": "200", "length": "12", "offset": "5", "filename": "f"}',
             'org,a)/ 20210725103200 {"url": "https://a.org", "mime": "text/html", "status": "abc", "length": "x", "extra": {"n": 1}}',
             'org,a)/ 20210726103200 {"url": "https://a.org", "mime": "image/png"}', "org,a)/ 2021 {}", "", "no line at all",
             'org,b)/ 20219924103200 {"url": "http://b.org/", "mime": "text/html"}', 'org,c)/ 20210724103200 {"url": "http://c.org/"}']
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines))
    rows = {(r["key"], r["captured"]): r for r in CI.read_index(spark, str(path)).collect()}
    assert len(rows) == 5 and rows["org,b)/", None]["url"] == "http://b.org/"
    first = rows["org,a)/", dt.datetime(2021, 7, 24, 10, 32)]
    assert (first["status"], first["length"], first["offset"], first["filename"]) == (200, 12, 5, "f")
    bad = rows["org,a)/", dt.datetime(2021, 7, 25, 10, 32)]
    assert bad["status"] is None and bad["length"] is None
    got = CI.wanted_captures(CI.read_index(spark, str(path)), I.allowed_mimes_table(spark)).collect()
    assert {(r["key"], r["url"]) for r in got} == {("org,a)/", "https://a.org"), ("org,b)/", "http://b.org/")}


def test_index_is_written_in_key_order(spark, tmp_path):
    rows = [(f"https://h{k % 7}.example.com/p{k}", dt.datetime(2021, 7, 24, k % 24), "text/html") for k in range(200)]
    rows += [(None, dt.datetime(2021, 7, 24), "text/html"), ("http://x.org", None, "text/html")]
    CI.write_index(spark.createDataFrame(rows, "url string, captured timestamp, mime string"), str(tmp_path / "ix"))
    files = sorted((tmp_path / "ix").glob("*.gz"))
    lines = [line for f in files for line in gzip.open(f, "rt").read().splitlines()]
    assert len(lines) == 200 and [x.split(" ")[:2] for x in lines] == sorted(x.split(" ")[:2] for x in lines)
    assert CI.read_index(spark, str(tmp_path / "ix")).count() == 200


def test_suffix_rules_of_all_kinds(spark, tmp_path):
    (tmp_path / "rules.dat").write_text("// comment\n com \n\nCO.UK trailing words\nuk\n*.ck\n!www.ck\ncom\n*.a.jp\njp\n")
    rules = DM.read_suffix_rules(spark, str(tmp_path / "rules.dat"))
    assert {(r["suffix"], r["kind"]) for r in rules.collect()} == {("com", "plain"), ("co.uk", "plain"), ("uk", "plain"), ("ck", "wild"),
                                                                   ("www.ck", "except"), ("a.jp", "wild"), ("jp", "plain")}
    want = {"x.y.com": ("com", "y.com"), "com": ("com", "com"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "c.uk": ("uk", "c.uk"),
            "q.r.ck": ("r.ck", "q.r.ck"), "r.ck": ("r.ck", "r.ck"), "ck": ("ck", "ck"), "a.www.ck": ("ck", "www.ck"), "z.b.a.jp": ("b.a.jp", "z.b.a.jp"),
            "a.jp": ("jp", "a.jp"), "no.rule": ("rule", "no.rule"), "one": ("one", "one"), "1.2.3.4": (None, "1.2.3.4"), "[::1]": (None, "[::1]"),
            "dot.com.": ("com", "dot.com")}
    hosts = spark.createDataFrame([(h,) for h in [*want, "x.y.com", None, ""]], "host string")
    got = DM.registered_domains(hosts, rules).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in got} == want and len(got) == len(want)
    pages = spark.createDataFrame([(1, "http://x.y.com/a"), (1, "http://x.y.com/a"), (2, None), (3, "http://bad host/"), (None, "https://b.co.uk")],
                                  "page_id long, url string")
    rows = [(r["page_id"], r["domain"], r["site"]) for r in DM.with_registered_domain(pages, rules).collect()]
    assert sorted(rows, key=str) == sorted([(1, "y.com", "y"), (1, "y.com", "y"), (2, None, None), (3, None, None), (None, "b.co.uk", "b")], key=str)
    assert DM.with_registered_domain(pages.limit(0), rules).count() == 0
