"""Fill-in-middle, graph search and periodic runs: brute force, odd and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressroom.llm import common, op13_runs
from pressroom.llm.op5_substring import boundaries, repeated_spans, without_repeats
from pressroom.llm.op11_fill_middle import Matcher, fill_in_middle, restored, transform
from pressroom.llm.op12_graph_search import nearest
from pressroom.llm.op13_runs import collapse_runs, find_runs, ntt, planted, squared_differences
from pressroom.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.01"
DOCS = ("doc_id long, text string, lang string, n long, form string, output string, runs string, collapsed string, h string")
LONG = "one two three " * 40_000


def odd_docs(spark):
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "x"), (4, "a <P> b"), (5, "é ő 漢字 😀 x"), (6, LONG), (7, LONG), (7, LONG),
             (7, "other text"), (None, "no id at all"), (None, None), (None, "a a a a a a a a"), (8, "a\x0bb\x1cc")]
    return spark.createDataFrame([(i, t, "en", 1, "f", "o", "r", "c", "h") for i, t in texts], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- 11 ----------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 9))
def test_units_are_code_points_however_long_the_stretches(text, span):
    short = Matcher(span=span)
    units = short.units(text)
    assert units.n == len(text)
    assert [units.end(k) for k in range(units.n + 1)] == list(range(len(text) + 1))


def test_units_of_several_code_points():
    words = Matcher(r"\s*\S+\s*", span=4)
    units = words.units("one two  three")
    assert units.n == 3 and [units.end(k) for k in range(4)] == [0, 4, 9, 14]
    assert Matcher("ab").units("abc") is None
    assert transform("abc", "1:0", Matcher("ab"))[:2] == (0, "plain")


def brute_middle(doc_id, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(t)
    if t == "" or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]
    return n, "psm", a, b - a, "<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]


def test_fill_in_middle_on_odd_rows(spark):
    docs = odd_docs(spark)
    want = sorted(((r["doc_id"], *brute_middle(r["doc_id"], r["text"])) for r in docs.collect()), key=str)
    rows = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    got = rows.collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=str) == want
    assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in docs.collect())
    assert fill_in_middle(empty_docs(spark)).count() == 0


# --- 12 ----------------------------------------------------------------------
def brute_nearest(rows, k=5):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % 50 == 0:
            a = np.array(v)
            score = [(-float(a @ np.array(w) / (np.linalg.norm(a) * np.linalg.norm(w))), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(score)[:k]]
    return out


def test_graph_search_recall(spark):
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    ids = np.array([r["vec_id"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    # several shards
    found = nearest(common.table(spark, "/root/testdata/sf0.1", "embeddings"), F.col("vec_id") % 50 == 0, shard_bytes=1 << 17).collect()
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = np.flatnonzero(ids % 50 == 0)
    assert len(got) == len(asked)
    met = 0
    for k in asked:
        score = x @ x[k]
        score[k] = -2
        mine = got[ids[k]]
        assert sorted(mine) == [1, 2, 3, 4, 5] and all(abs(score[ids == j][0] - s) < 1e-9 for j, s in mine.values())
        assert [s for _, s in (mine[r] for r in range(1, 6))] == sorted((s for _, s in mine.values()), reverse=True)
        met += len({j for j, _ in mine.values()} & set(ids[np.argsort(-score)[:5]].tolist()))
    assert met / len(asked) / 5 >= 0.95


def test_graph_search_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).round(3).tolist()) for k in range(120)]
    hot = [1.0, 2.0, 0.0, -0.0]
    rows += [(k, hot) for k in range(200, 420)] + [(200, hot), (1000, hot[:3]), (1050, [2.0, 4.0, 0.0]), (1100, None), (1150, []),
                                                  (1200, [0.0] * 4), (1250, [1.0, None, 2.0, 3.0]), (1300, [float("nan")] * 4),
                                                  (1350, [float("inf"), 0.0, 0.0, 1.0]), (None, hot), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, dim int, rank int, score double")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_nearest(exact)
    got = {}
    for r in nearest(df.repartition(5), F.col("vec_id") % 50 == 0, shard_bytes=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in got.items():
        assert [j for j, _ in v] == [j for j, _ in want[q]], q
        assert np.allclose([s for _, s in v], [s for _, s in want[q]], atol=1e-12)
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- 13 ----------------------------------------------------------------------
def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + (j == i)
    return sorted((a, length, q) for (a, length), q in out.items())


def test_transform_of_every_width():
    x = np.random.default_rng(0).integers(0, 65537, (3, 4096)).astype(float)
    for n in (2, 8, 64, 128, 1024, 4096):
        back = ntt(ntt(x[:, :n].copy()), inverse=True)
        assert np.array_equal(back * pow(n, -1, 65537) % 65537, x[:, :n])
    want = [[int(((x[r, :32] - x[r, 100 + k:132 + k]) ** 2 % 65537).sum()) % 65537 for k in range(32)] for r in range(3)]
    assert squared_differences(x[:, :32], x[:, 100:164]).astype(int).tolist() == want


@pytest.mark.parametrize("widest", [4096, 4, 2])
def test_runs_match_brute_force(widest, monkeypatch):
    monkeypatch.setattr(op13_runs, "WIDEST", widest)
    rnd = random.Random(widest)

    def text():
        n, k = rnd.randrange(0, 110), rnd.choice([1, 2, 3, 5])
        w = [rnd.randrange(k) for _ in range(n)]
        if n and rnd.random() < 0.7:
            a, p = rnd.randrange(n), rnd.randrange(1, max(2, n // 4))
            for i in range(a + p, min(n, a + p * rnd.randrange(2, 9) + rnd.randrange(3))):
                w[i] = w[i - p]
        return w

    for _ in range(150):
        texts = [text() for _ in range(rnd.randrange(1, 7))]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = find_runs(np.array([v for t in texts for v in t], np.int64), bounds)
        assert [tuple(r) for r in got.tolist()] == [(k, a, n, q) for k, t in enumerate(texts) for a, n, q in sorted(brute_runs(t), key=lambda r: (r[0], r[2]))]


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_runs_of_every_small_document(spark):
    rows = QUERIES["op13_periodic_runs"](spark, SMALL).collect()
    got = {tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in rows}
    docs = common.table(spark, SMALL, "documents").where("length(text) < 4000").collect()
    assert len(rows) == 1000 and {brute_row(r["doc_id"], r["text"]) for r in docs} <= got
    assert sum(r["n_runs"] > 0 for r in rows) > 30


def test_periodic_runs_on_odd_rows(spark):
    rows = collapse_runs(odd_docs(spark)).collect()
    assert len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert by[0] == by[1] == by[2] == [([], "")] and by[3] == [([], "x")]
    assert by[6] == [([(0, 120_000, 3)], "one two three")]
    assert sorted(by[7]) == sorted([*by[6] * 2, ([], "other text")])
    assert ([(0, 8, 1)], "a") in by[None] and by[8] == [([], "a b\x1cc")]
    assert collapse_runs(empty_docs(spark)).count() == 0
    assert planted(0, "5").tolist() == []


# --- 5: repeated and missing ids ----------------------------------------------------
def brute_spans(rows, min_words):
    """Spans from the chunks of every text, by plain dictionaries; documents are (doc_id, text) pairs."""
    docs = sorted({(i, t) for i, t in rows if t}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    texts_of = {}
    for i, t in docs:
        texts_of.setdefault(i, set()).add(t)
    cut, where = {}, {}
    for d in docs:
        raw = d[1].encode()
        ends = boundaries(raw)
        cut[d] = [(a, b, hashlib.blake2b(raw[a:b], digest_size=16).digest()) for a, b in zip([0, *ends], ends)]
        for _, _, h in cut[d]:
            where.setdefault(h, set()).add(d)
    out = set()
    for d in docs:
        raw, run = d[1].encode(), []
        for c in [*cut[d], None]:
            if c and len(where[c[2]]) > 1:
                run.append(c)
                continue
            if run:
                a, b = run[0][0], run[-1][1]
                begins = [m.start() for m in re.finditer(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]", raw)]
                n = sum(a <= x < b for x in begins)
                if n >= min_words:
                    out.add((d[0], a, b, n))
                run = []
    return out


def test_spans_of_rows_that_repeat_or_lack_a_doc_id(spark):
    rng = random.Random(4)
    passage = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    p, q, r, own = passage(90), passage(120), passage(70), [passage(150) for _ in range(9)]
    rows = [(1, f"{own[0]} {p} {own[1]}"), (1, f"{own[2]} {q}"), (2, f"{p} {own[3]}"), (None, f"{own[4]} {q} {own[5]}"), (None, f"{r} {own[6]}"),
            (3, f"{own[7]} {r}"), (4, own[8]), (4, own[8]), (5, None), (None, None), (6, f"{r} {r}"), ((1 << 62) + 5, f"x {p}")]
    df = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in rows], "doc_id long, text string, cuts string, key long, twice long")
    got = repeated_spans(df).collect()
    assert {(x["doc_id"], x["span_start"], x["span_stop"], x["n_words"]) for x in got} == brute_spans(rows, 20)
    assert len(got) == len(brute_spans(rows, 20)) >= 9 and not any(x["doc_id"] == 4 for x in got)
    left = without_repeats(df)
    assert left.columns == df.columns
    kept = sorted(((x["doc_id"], x["text"], x["cuts"], x["key"]) for x in left.collect()), key=str)
    assert len(kept) == len(rows)
    # each passage stays where it is first, and no word that occurs nowhere else goes
    words = " ".join(t or "" for _, t, _, _ in kept).split()
    assert all(set(o.split()) <= set(words) for o in own) and all(set(x.split()) <= set(words) for x in (p, q, r))
    assert sum(len(t or "") for _, t, _, _ in kept) < sum(len(t or "") for _, t in rows) - 1500
    assert [x for x in kept if x[0] == 4] == [(4, own[8], "c", 1)] * 2


def test_spans_match_brute_force_on_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    got = {(x["doc_id"], x["span_start"], x["span_stop"], x["n_words"]) for x in repeated_spans(docs).collect()}
    assert got == brute_spans([(r["doc_id"], r["text"]) for r in docs.collect()], 20) and got
