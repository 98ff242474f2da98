"""Edge cases and properties: cleaning bounds, Unicode
word splitting, dedup semantics against brute force, split sizes, ROUGE-L
against a dynamic programme, WARC decoding, human dates."""

import datetime as dt
import gzip
import itertools
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from pressroom.config import Config
from pressroom.functions import text as X
from pressroom.functions.dates import parse_human_date
from pressroom.operators import clean as C
from pressroom.operators import dedup as D
from pressroom.operators import minhash as M
from pressroom.operators import rouge as R
from pressroom.operators import split as S
from pressroom.sources.warc import read_warc_pages


# --------------------------------------------------------------------------- cleaning

def test_length_and_word_bounds(spark):
    rows = [("a", "x" * 199), ("b", "x" * 200), ("c", "x" * 15000), ("d", "x" * 15001),
            ("e", " ".join(["w"] * 14) + "y" * 200), ("f", " ".join(["w"] * 15) + "y" * 200)]
    df = C.with_text_stats(spark.createDataFrame(rows, "uuid string, article string"))
    ok_len = {r.uuid for r in C.filter_length(df).collect()}
    assert ok_len == {"b", "c", "e", "f"}
    ok_words = {r.uuid for r in C.filter_words(df.where(F.col("uuid").isin("e", "f"))).collect()}
    assert ok_words == {"f"}


WS_SAMPLES = ["a b", "  lead and trail  ", "x", "\n\n", "one\u2029two  three\x1f", "a b", "a\x1cb\x1dc", "tab\tnew\nline", "", "   ",
              "em space", "ideo　graphic", "line sep"]


def test_word_count_equals_python_split(spark):
    df = spark.createDataFrame([(s,) for s in WS_SAMPLES], "t string")
    got = [r.n for r in df.select(X.word_count("t").alias("n")).collect()]
    assert got == [len(s.split()) for s in WS_SAMPLES]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁ Ｆｕｌｌ",), ("plain",)], "t string")
    got = [r.n for r in df.select(X.nfkc(F.col("t")).alias("n")).collect()]
    assert got == ["fi Full", "plain"]


# --------------------------------------------------------------------------- dedup

BASE = ("A quiet morning settled over the harbour while fishermen mended nets and "
        "gulls argued over scraps near the old stone pier at the edge of town. ")


def _variants():
    rnd = random.Random(7)
    words = BASE.split()
    out = []
    for i in range(6):
        w = list(words)
        for _ in range(i):
            w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(1000))
        out.append(" ".join(w) * 3)
    return out


def _brute_losers(sig_rows, meta, cfg):
    sig = {r.uuid: r.sig for r in sig_rows}
    r = cfg.rows_per_band
    losers = set()
    for a, b in itertools.permutations(sig, 2):
        share = any(sig[a][i * r:(i + 1) * r] == sig[b][i * r:(i + 1) * r] for i in range(cfg.num_bands))
        agree = sum(x == y for x, y in zip(sig[a], sig[b]))
        if share and agree >= cfg.min_agree and meta[b] > meta[a]:
            losers.add(a)
    return losers


def test_losers_match_brute_force(spark):
    texts = _variants() + [BASE * 3, BASE * 3, BASE * 3, "Completely different text about mountains " * 9]
    rows = [(f"u{i:02d}", t, dt.datetime(2021, 7, 1 + (i % 4))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "uuid string, article string, cc_date timestamp_ntz")
    cfg = Config()
    got = {r.uuid for r in D.near_duplicate_losers(df, cfg=cfg).collect()}
    sigs = M.signatures(df, cfg=cfg).collect()
    meta = {u: (d, u) for u, _, d in rows}
    assert got == _brute_losers(sigs, meta, cfg)
    # three identical texts leave one, and it is the newest copy
    copies = [u for u, t, _ in rows if t == BASE * 3]
    newest = max(copies, key=lambda u: meta[u])
    assert newest not in got and set(copies) - {newest} <= got


def test_signature_plan_shingles_each_text_once(spark):
    """The keyed signature table explodes shingles in one place only; the
    copy keys come from a narrow pass and meet the signatures on id."""
    rows = [(f"u{i}", t, dt.datetime(2021, 7, 1)) for i, t in enumerate(_variants())]
    df = spark.createDataFrame(rows, "uuid string, article string, cc_date timestamp_ntz")
    ks = D.keyed_signatures(df, materialize=False)
    plan = ks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1
    assert ks.count() == len(rows)


def test_losers_are_older_and_independent_of_partitions(spark):
    texts = _variants()
    rows = [(f"u{i}", t, dt.datetime(2021, 7, 1)) for i, t in enumerate(texts)]  # equal dates: uuid decides
    df = spark.createDataFrame(rows, "uuid string, article string, cc_date timestamp_ntz")
    a = {r.uuid for r in D.near_duplicate_losers(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = {r.uuid for r in D.near_duplicate_losers(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    assert "u5" not in a  # the largest uuid never loses on a date tie


# --------------------------------------------------------------------------- split

@pytest.mark.parametrize("n", [0, 1, 9, 10, 37])
def test_split_sizes(spark, n):
    rows = [(f"id{i}", "s") for i in range(n)] + [(f"o{i}", "other") for i in range(5)]
    df = spark.createDataFrame(rows, "uuid string, site string")
    out = S.assign_split(df).where(F.col("site") == "s").groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in out}
    c1, c2 = int(0.8 * n), int((0.8 + 0.1) * n)
    want = {"train": c1, "valid": c2 - c1, "test": n - c2}
    assert {k: v for k, v in want.items() if v} == got


def test_split_keeps_every_row_with_wide_columns(spark):
    """Ranks are a function of the rows: evaluated twice, with texts and without
    exchange reuse, every row comes back once and each site's ranks are 1..n."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = docs.select(F.col("doc_id").cast("string").alias("uuid"), F.col("source").alias("site"), "text") \
        .unionByName(spark.createDataFrame([("n1", None, "x"), ("n2", None, "y")], "uuid string, site string, text string"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = S.assign_split(df.repartition(5)).select("uuid", "site", "rank", "group_n", "text").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(rows) == len({r["uuid"] for r in rows}) == 1002
    for site in {r["site"] for r in rows}:
        own = sorted(r["rank"] for r in rows if r["site"] == site)
        assert own == list(range(1, len(own) + 1))
        assert {r["group_n"] for r in rows if r["site"] == site} == {len(own)}


@pytest.mark.parametrize("url,want", [
    ("http://abc.net.au/x", "abc.net.au"), ("http://www.news.co.jp", "news.co.jp"), ("http://1.2.3.4/", "1.2.3.4"),
    ("http://co.uk/", "co.uk"), ("https://m.telex.hu/a?b", "telex.hu"), ("http://localhost/", "localhost"),
    ("http://a.b.blogs.example.com", "example.com"), ("http://bad host/%zz", None), (None, None)])
def test_registered_domain_never_fails(spark, url, want):
    from pressroom.functions import urls as U
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(U.registered_domain(F.col("url")).alias("d")).first()["d"] == want


def test_registered_domain_with_more_suffixes(spark):
    from pressroom.functions import urls as U
    df = spark.createDataFrame([("http://x.me.blogs.example.com/",)], "url string")
    assert df.select(U.registered_domain(F.col("url"), ("blogs.example.com",)).alias("d")).first()["d"] == "me.blogs.example.com"


def test_copies_below_one_shingle_lose_too(spark):
    rows = [(f"u{i}", t, dt.datetime(2021, 7, 1 + i)) for i, t in enumerate(["short", "short", "other", ""])]
    df = spark.createDataFrame(rows, "uuid string, article string, cc_date timestamp_ntz")
    assert [(r["uuid"], r["winner"]) for r in D.near_duplicate_losers(df).collect()] == [("u0", "u1")]


def test_split_is_reproducible(spark):
    df = spark.createDataFrame([(f"id{i}", "s") for i in range(50)], "uuid string, site string")
    a = {r.uuid: r.split for r in S.assign_split(df).collect()}
    b = {r.uuid: r.split for r in S.assign_split(df.repartition(7)).collect()}
    assert a == b


# --------------------------------------------------------------------------- ROUGE

def _lcs_dp(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_lcs_bit_parallel(spark):
    """Against the dynamic programme: sides around whole words of the bit vector, few and many distinct tokens, null and empty sides."""
    draw = random.Random(3)
    rows = [(None, ["a"]), (["a"], None), ([], []), (["x"] * 180, ["x"] * 180), (["a"], ["b"]), (["a", None, "b"], ["a", "b"])]
    for _ in range(250):
        n, m = draw.choice([(0, 5), (5, 0), (59, 61), (60, 60), (120, 121), (200, 333), (7, 3), (1, 1)])
        few = draw.choice([2, 5, 50])
        rows.append(tuple([str(draw.randrange(few)) for _ in range(k)] for k in (n, m)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<string>, b array<string>")
    out = df.select("k", R.lcs_length(F.col("a"), F.col("b")).alias("n"))
    assert {r["k"]: r["n"] for r in out.collect()} == {k: _lcs_dp(a or [], b or []) for k, (a, b) in enumerate(rows)}
    assert "Python" not in out._jdf.queryExecution().toString()


def test_rouge_edge_cases(spark):
    pairs = spark.createDataFrame([("empty", "", "a b c"), ("same", "árvíztűrő tükörfúrógép", "árvíztűrő tükörfúrógép")],
                                  "uuid string, generated string, article string")
    s = {r.uuid: r for r in R.rouge_scores(pairs).collect()}
    assert s["empty"].rouge1_fmeasure == 0.0 and s["empty"].rougeL_recall == 0.0
    assert s["same"].rouge1_fmeasure == 1.0 and s["same"].rouge2_fmeasure == 1.0 and s["same"].rougeL_fmeasure == 1.0
    # the ASCII tokenizer splits Hungarian words at accented letters
    a = R.rouge_n(pairs.where("uuid = 'same'"), 1, ascii=True).collect()[0]
    assert a.rouge1_fmeasure == 1.0


# --------------------------------------------------------------------------- WARC and dates

def test_warc_keeps_every_capture_of_a_url(spark):
    d = tempfile.mkdtemp(prefix="warc-")
    def record(date, body):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://a.b/c\r\n" + date \
            + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    second, part = b"WARC-Date: 2021-07-24T10:32:00Z\r\n", b"WARC-Date: 2021-07-24T10:32:00.5Z\r\n"
    records = [record(date, body) for date in (second, part, b"") for body in (b"one", b"two")]
    with gzip.open(f"{d}/a.warc.gz", "wb") as f:
        f.write(b"".join(records * 2))
    got = read_warc_pages(spark, d).collect()
    assert sorted(r.html for r in got) == ["one"] * 3 + ["two"] * 3
    assert len({r.page_id for r in got}) == 6


def test_warc_utf8_and_latin1(spark):
    d = tempfile.mkdtemp(prefix="warc-")

    def rec(url, date, body):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n"
                f"Content-Length: {len(http)}\r\n\r\n").encode()
        return head + http + b"\r\n\r\n"
    with gzip.open(f"{d}/a.warc.gz", "wb") as f:
        f.write(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n")
        f.write(rec("https://telex.hu/a", "2021-07-24T10:00:00Z", "<p>árvíztűrő</p>".encode("utf-8")))
        f.write(rec("https://index.hu/b", "2021-07-25T11:30:00Z", "<p>café</p>".encode("latin-1")))
    got = {r.url: r for r in read_warc_pages(spark, d).collect()}
    assert set(got) == {"https://telex.hu/a", "https://index.hu/b"}
    assert got["https://telex.hu/a"].html == "<p>árvíztűrő</p>"
    assert got["https://index.hu/b"].html == "<p>café</p>"
    assert got["https://index.hu/b"].cc_date == dt.datetime(2021, 7, 25, 11, 30)


DATES = [
    ("2021. július 24. 10:32", dt.datetime(2021, 7, 24, 10, 32)),
    ("2021. júl. 24.", dt.datetime(2021, 7, 24)),
    ("24. července 2021 8:05", dt.datetime(2021, 7, 24, 8, 5)),
    ("24. júla 2021, 18:00", dt.datetime(2021, 7, 24, 18, 0)),
    ("July 24, 2021 10:32", dt.datetime(2021, 7, 24, 10, 32)),
    ("24.07.2021 10:32", dt.datetime(2021, 7, 24, 10, 32)),
    ("2021-07-24T10:32:15", dt.datetime(2021, 7, 24, 10, 32, 15)),
    ("no date here", None),
    ("2021. február 30.", None),
]


def test_human_dates(spark):
    df = spark.createDataFrame([(s,) for s, _ in DATES], "t string")
    got = [r.d for r in df.select(parse_human_date(F.col("t")).alias("d")).collect()]
    assert got == [d for _, d in DATES]


def test_rule_file_and_site_list(spark, tmp_path):
    from pressroom.functions.urls import BAD_URL_RULES, blocklist_pattern
    from pressroom.sources.files import read_site_list, read_url_rules
    rules = tmp_path / "bad_index.txt"
    rules.write_text("\n".join(BAD_URL_RULES) + "\n\n")
    got = read_url_rules(spark, str(rules))
    assert tuple(got) == BAD_URL_RULES
    pat = blocklist_pattern(got)
    df = spark.createDataFrame([("https://www.telex.hu/rss/x",), ("https://telex.hu/belfold/x",),
                                ("http://index.hu/24ora/?tol=2021&ig=2022",)], "url string")
    blocked = [r.b for r in df.select(F.col("url").rlike(pat).alias("b")).collect()]
    assert blocked == [True, False, True]
    sites = tmp_path / "sites.txt"
    sites.write_text("telex|telex.hu/*\nindex|index.hu/*\n")
    assert [tuple(r) for r in read_site_list(spark, str(sites)).collect()] == [("telex", "telex.hu/*"), ("index", "index.hu/*")]


def test_hot_text_is_split_and_whole(spark):
    """One text in a third of the rows, a bucket of near copies, short texts: each row once, the newest copy kept."""
    from pressroom.operators import dedup as D
    n = 3000
    a = spark.range(n).select(
        F.col("id").cast("string").alias("uuid"),
        F.when(F.col("id") % 3 == 0, "the hot text").when(F.col("id") % 3 == 1, "tiny").otherwise(
            F.concat(F.lit("own "), F.col("id").cast("string"))).alias("article"),
        F.expr("timestamp_ntz'2021-01-01 00:00:00' + make_dt_interval(0, id)").alias("cc_date"))
    rows = D.exact_duplicates(a).collect()
    assert len(rows) == n and len({r.uuid for r in rows}) == n
    newest = {0: "2997", 1: "2998"}
    assert all(r.kept_uuid == newest.get(int(r.uuid) % 3, r.uuid) and r.is_kept == (r.uuid == r.kept_uuid) for r in rows)
    # the join that brings the newest copy back is keyed by text and salt
    plan = D.exact_duplicates(a)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Join Inner" in plan
    in_salt = a.groupBy("article", F.pmod(F.xxhash64("uuid"), F.lit(D.SALTS)).alias("s")).count()
    assert in_salt.agg(F.max("count")).first()[0] < n / 3 / 20


def test_relative_dates(spark):
    from datetime import datetime

    from pressroom.functions.dates import parse_relative_date
    now = datetime(2021, 3, 31, 10, 32, 5)
    want = {
        "2 hours ago": datetime(2021, 3, 31, 8, 32, 5), "An hour ago": datetime(2021, 3, 31, 9, 32, 5),
        "před  3 dny": datetime(2021, 3, 28, 10, 32, 5), "před hodinou": datetime(2021, 3, 31, 9, 32, 5),
        "pred 2 týždňami": datetime(2021, 3, 17, 10, 32, 5), "5 perce": datetime(2021, 3, 31, 10, 27, 5),
        "egy hónapja": datetime(2021, 2, 28, 10, 32, 5), "1 year ago": datetime(2020, 3, 31, 10, 32, 5),
        "Tegnap 23:59": datetime(2021, 3, 30, 23, 59), "VČERA v 7:05": datetime(2021, 3, 30, 7, 5),
        " yesterday ": datetime(2021, 3, 30, 10, 32, 5), "today at 25:00": None, "hours ago": None, "perce": None,
        "před hodinami": None, "2 blue ago": None, "ago": None, "": None, "2021. július 24.": None, "9999 days ago": None}
    rows = spark.createDataFrame([(t, now) for t in [*want, None]] + [("ma", None)], "t string, now timestamp_ntz")
    got = [(r.t, r.now, r.d) for r in rows.select("t", "now", parse_relative_date(F.col("t"), F.col("now")).alias("d")).collect()]
    assert {t: d for t, n, d in got if n and t is not None} == want
    assert all(d is None for t, n, d in got if t is None or n is None)


def test_relative_dates_pass_over_a_text_once_per_pattern(spark):
    """Blanks, a day's word, a time ago: three replacements, however many groups are used, and no other search
    but that for a number's digits."""
    from pressroom.functions.dates import parse_relative_date
    rows = spark.range(1).select(F.lit("now").alias("t"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("now"), "id")
    df = rows.repartition(2).select(parse_relative_date(F.concat("t", "id"), F.col("now")).alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 3
    assert plan.count("regexp_extract(") == 0
    assert plan.lower().count("rlike(") <= 1


def test_signature_minima_reach_no_shuffle_by_slot(spark):
    """A document of a batch is one row when ids are brought together, not one per slot; rows of one id count as one
    text, and stretches of a long text make the signature of the whole."""
    import hashlib
    rnd = random.Random(5)
    texts = {u: "".join(rnd.choice("abcé dž") for _ in range(n)) for u, n in (("a", 900), ("b", 8), ("c", 9), (None, 40))}
    rows = [*texts.items(), ("a", "a second text of the same id"), ("a", None), ("d", None), (None, "short")]
    df = spark.createDataFrame(rows, "uuid string, article string").repartition(3)
    sig = M.signatures(df)
    plan = sig._jdf.queryExecution().optimizedPlan().toString()
    assert "slot" not in plan.split("Aggregate")[-1] and plan.count("Aggregate") == 1

    def low(u):
        out = {}
        for t in (t.encode() for v, t in rows if v == u and t is not None):
            for i in range(len(t) - 8):
                h = int(hashlib.md5(t[i:i + 9].hex().upper().encode()).hexdigest()[:8], 16)
                out[h % 200] = min(h, out.get(h % 200, h))
        return out

    def check(got):
        assert sorted(got, key=str) == sorted([u for u in {v for v, _ in rows} if low(u)], key=str)
        for u, r in got.items():
            mins = low(u)
            assert r.n_slots == len(mins)
            assert all(r.sig[s] == h for s, h in mins.items())

    check({r.uuid: r for r in sig.collect()})
    stretch, M.STRETCH = M.STRETCH, 50
    try:
        check({r.uuid: r for r in M.signatures(df).collect()})
    finally:
        M.STRETCH = stretch
