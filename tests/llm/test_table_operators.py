"""The training-data operators on small tables: against brute force and SQL, and
on nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from pressroom.llm import common
from pressroom.llm.graph import components
from pressroom.llm.op1_toxicity import score_toxicity
from pressroom.llm.op1_toxicity import train as train_toxicity
from pressroom.llm.op1_toxicity import training_rows
from pressroom.llm.op2_decontaminate import contaminated_pairs
from pressroom.llm.op3_html import extract_main_text, main_text
from pressroom.llm.op4_warc import warc_round_trip
from pressroom.llm.op5_substring import repeated_spans, without_repeats
from pressroom.llm.op6_quality import score_quality
from pressroom.llm.op6_quality import train as train_quality
from pressroom.llm.op7_simhash import links, near_duplicates
from pressroom.llm.op8_tokens import read_tokens, shard_ids, token_files, write_tokens
from pressroom.llm.op9_exact_dedup import exact_duplicates
from pressroom.llm.op10_mixing import mix_sources, settle, targets
from pressroom.llm.registry import ORACLE, QUERIES
from tools.oracle_check import canon

SMALL = "/root/testdata/sf0.01"
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, fp long, root string, key string, "
        "size string, block string, chunks string, recipe string, copies string, score string, html string")

LONG = "some words of a very long text that goes on. " * 4000


def odd_docs(spark):
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Same text  here now"), (5, "Same text here\nnow"),
             (6, LONG), (7, LONG), (7, LONG), (None, "no id at all"), (None, None), (8, "é ő 漢字   x"), (9, "one")]
    extra = ["x"] * 10
    return spark.createDataFrame(
        [(i, t, "en", s, 0, 1, *extra[:9]) for (i, t), s in zip(texts, ["a", None, "b", "a", "a", "b", "a", "b", "b", None, None, "é", "a"])],
        DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


# --- the registered queries with SQL ------------------------------------------
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, smoke_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smoke_dir}/{t}.parquet')")
    df, want = QUERIES[name](spark, smoke_dir), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())


def test_all_queries_are_registered():
    names = list(E.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


# --- 1, 6 --------------------------------------------------------------------
@pytest.mark.parametrize("train,score,threshold", [(train_toxicity, score_toxicity, 0.7), (train_quality, score_quality, 0.5)])
def test_classifiers_on_odd_rows(spark, train, score, threshold):
    docs = common.table(spark, SMALL, "documents")
    labels = common.table(spark, SMALL, "labels")
    noisy = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    model = train(docs, noisy, 400)
    rows = score(odd_docs(spark), model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= threshold) for r in rows)
    for r in rows:
        want = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == want
    seven = [r["score"] for r in rows if r["doc_id"] == 7]
    assert seven[0] == seven[1]
    assert score(empty_docs(spark), model).count() == 0
    untrained = train(empty_docs(spark), labels.limit(0))
    assert score(odd_docs(spark), untrained).count() == 13


def test_training_never_reads_held_out_labels(spark):
    docs, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    spoilt = labels.withColumn("toxic", F.when(common.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert train_toxicity(docs, labels, 300).to_bytes() == train_toxicity(docs, spoilt, 300).to_bytes()


# --- 2 -----------------------------------------------------------------------
def test_contaminated_pairs(spark):
    item = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "y"), (2, None, ""), (3, "", ""), (None, "alpha beta gamma delta epsilon zeta", "")],
                                  "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, "aa " + item + " bb"), (2, None), (3, ""), (4, "w1 w2 w3"), (5, LONG + item), (5, LONG + item),
                                  (None, "Alpha beta gamma delta epsilon zeta!")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, bench).collect())
    assert got == {(1, 1): 2, (5, 1): 4, (None, None): 1}
    # blocks of the query set change nothing
    blocks = Counter((r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, bench, block_tokens=1).collect())
    assert blocks == got
    assert contaminated_pairs(odd_docs(spark), bench.limit(0)).count() == 0
    assert contaminated_pairs(empty_docs(spark), bench).count() == 0


# --- 3, 4 --------------------------------------------------------------------
def odd_pages(spark):
    big = "<article><p>" + "text " * 30_000 + "</p></article>"
    rows = [(1, "http://a", None), (2, "http://b", ""), (3, None, big), (4, "http://d", big), (4, "http://d", big), (5, "http://e", "<p>x"),
            (6, "http://f", "<p>x"), (None, "http://g", big), (None, None, None), (7, "http://h", "é" * 499 + "xx"), (8, "http://i", "é" * 499 + "xx"),
            (9, "u", "y" * 999), (10, "u", "y" * 999), (11, "u", big + "!"), (11, "u", "<p>other")]
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "page_id long, url string, html string, text string, path string, key long")


def test_pages_keep_their_rows(spark):
    rows = extract_main_text(odd_pages(spark)).collect()
    want = Counter((r["page_id"], r["url"], main_text(r["html"])) for r in odd_pages(spark).collect())
    assert Counter((r["page_id"], r["url"], r["text"]) for r in rows) == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract_main_text(odd_pages(spark).limit(0)).count() == 0


def test_warc_round_trip(spark):
    import hashlib
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in odd_pages(spark).collect()]
    want = Counter()
    for page, payload in pages:
        same = [p for p, x in pages if x == payload and p is not None]
        top = max(same) if same and len(payload) >= 1000 and len([1 for _, x in pages if x == payload]) > 1 else None
        revisit = top is not None and page != top
        want[page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    got = warc_round_trip(odd_pages(spark), segment_bytes=700)
    assert Counter(tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()) == want
    assert warc_round_trip(odd_pages(spark).limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------
def test_repeated_spans(spark):
    import random
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    passage = words(60)
    texts = {k: words(80) for k in range(8)}
    for k in (1, 3, 5):
        half = texts[k].split(" ")
        texts[k] = " ".join(half[:30 + k]) + " " + passage + " " + " ".join(half[30 + k:])
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(9, None, ""), (10, "", ""), (7, texts[7], ""), (None, texts[0], "")],
                                 "doc_id long, text string, seq string")
    spans = repeated_spans(docs).collect()
    # a row without doc_id shares the whole text of document 0
    assert {r["doc_id"] for r in spans} == {0, 1, 3, 5, None} and len(spans) == 5
    assert all(r["first_doc_id"] == 0 and r["span_stop"] == len(texts[0].encode()) for r in spans if not r["doc_id"])
    for r in (r for r in spans if r["doc_id"]):
        assert r["first_doc_id"] == 1 and r["is_first"] == (r["doc_id"] == 1)
        piece = texts[r["doc_id"]].encode()[r["span_start"]:r["span_stop"]].decode()
        assert piece.strip() in passage and len(piece.split()) >= 30
    kept = {r["doc_id"]: r["text"] for r in without_repeats(docs.where("doc_id < 9")).collect()}
    assert kept[1] == texts[1] and kept[0] == texts[0]
    assert len(kept[3]) < len(texts[3]) - 100 and kept[3].startswith(texts[3][:40])
    assert repeated_spans(empty_docs(spark)).count() == 0
    assert {r["doc_id"] for r in repeated_spans(odd_docs(spark)).collect()} == {6, 7}


# --- 7 -----------------------------------------------------------------------
def test_links_connect_as_all_pairs_do(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, 12)
    prints = {int(x) for x in base} | {0, -1}
    for x in base:
        for _ in range(40):
            y = int(x) & (1 << 64) - 1
            for _ in range(int(rng.integers(1, 5))):
                y ^= 1 << int(rng.integers(0, 64))
            prints.add(y - (1 << 64) if y >= 1 << 63 else y)
    prints = sorted(prints)
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    for most in (1, 2):
        pairs = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if far(a, b) <= most}
        got = links(spark.createDataFrame([(p,) for p in prints], "fp long"), most)
        found = {(r["a"], r["b"]) for r in got.collect()}
        assert found <= pairs
        assert classes(prints, found) == classes(prints, pairs)
        roots = {r["node"]: r["root"] for r in components(got).collect()}
        assert all((roots.get(a, a) == roots.get(b, b)) for a, b in pairs)
        assert len({roots.get(p, p) for p in prints}) == len(set(classes(prints, pairs).values()))


def classes(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert len({roots[k] for k in range(301)}) == 1 and roots[2000] == roots[2001] != roots[0]
    assert components(edges.limit(0)).count() == 0


def test_near_duplicates_on_odd_rows(spark):
    rows = near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 13
    ids = {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}
    assert ids[0] == ids[1] == ids[2] == 0 and ids[3] == ids[9] == 3 and ids[4] == ids[5] == 4 and ids[6] == ids[7] == 6
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows)
    assert near_duplicates(empty_docs(spark)).count() == 0


# --- 8 -----------------------------------------------------------------------
def test_token_files_hold_every_id(spark, tmp_path):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(
        common.table(spark, "/root/testdata/sf0.001", "documents").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = {}, 0
    for r in sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"]):
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    manifest = write_tokens(docs, str(tmp_path), public_tokenizers.path("byte_bpe_50k.json"), length=64)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_tokens(manifest).collect()}
    assert got == want
    shards = sorted(manifest.collect(), key=lambda r: r["first_id"])
    assert sum(len(x) for s in shards for x in shard_ids(s["path"])) == at
    assert all(s["n_rows"] == -(-s["n_tokens"] // 64) for s in shards)


def test_token_files_spread_rows_without_doc_id(spark, tmp_path):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # so small a table would be one shard
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")
    try:
        manifest = write_tokens(docs.repartition(16), str(tmp_path), public_tokenizers.path("byte_bpe_50k.json"), length=64)
    finally:
        spark.conf.set(merged, before)
    shards = manifest.collect()
    assert sum(s["first_id"] is None for s in shards) > 1
    got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in read_tokens(manifest).collect())
    assert [a for a, _, _ in got] == np.concatenate([[0], np.cumsum([n for _, n, _ in got])[:-1]]).tolist()
    assert [d for _, _, d in got] == sorted(d for _, _, d in got)


def test_training_rows_keep_their_bound_on_repeated_ids(spark):
    docs = spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    for n in (1, 7):
        rows = training_rows(docs.repartition(n), labels, "toxic", 10).collect()
        assert len(rows) == 10 == len({r["doc_id"] for r in rows})
        first = rows if n == 1 else first
        assert sorted(rows) == sorted(first)


def test_token_files_on_odd_rows(spark):
    rows = token_files(odd_docs(spark)).collect()
    assert len(rows) == 13 and [r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)] == [1, 1]
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    assert token_files(empty_docs(spark)).count() == 0


# --- 9 -----------------------------------------------------------------------
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    docs = odd_docs(spark).select("doc_id", "text", "lang", "recipe", "chunks").unionByName(
        common.table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "'' AS recipe", "'' AS chunks"))
    # an identifier that many chunks share must not join different texts
    how = {"identify": lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 8, "0"))} if weak else {}
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(norm(r["text"]), []).append(r["doc_id"])
    want = Counter()
    for r in rows:
        g = groups[norm(r["text"])]
        keep = min((x for x in g if x is not None), default=None)
        want[r["doc_id"], keep, len(g), r["doc_id"] == keep] += 1
    got = exact_duplicates(docs, **how).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert exact_duplicates(empty_docs(spark)).count() == 0


def test_exact_duplicates_run_no_python(spark, smoke_dir):
    plan = QUERIES["op9_exact_dedup"](spark, smoke_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 10 ----------------------------------------------------------------------
def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    open_, out, left = set(names), {}, share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets(spark):
    import random
    rng = random.Random(3)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 50, 700, 10_000]) for s in rng.sample(["a", "B", "é", "z", "漢", "", "ab", None], rng.randrange(1, 8))}
        rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in targets(rows, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(brute_targets(sizes)), sizes


def test_settle_keeps_words_and_is_unbiased():
    rng = np.random.default_rng(0)
    size = np.array([9.0, 7, 5, 4, 4, 2, 1])
    p = np.array([0.3, 0.6, 0.5, 0.2, 0.9, 0.0, 0.7])
    total = np.zeros(len(p))
    for _ in range(6000):
        got, held = settle(p, size, rng)
        assert got @ size == pytest.approx(p @ size)
        assert all(x in (0, 1) for k, x in enumerate(got) if k != held)
        total += got
    assert np.allclose(total / 6000, p, atol=0.03)


def test_mix_sources(spark):
    docs = common.table(spark, SMALL, "documents")
    kw = dict(block_rows=8, fan_in=2)  # many blocks and levels
    rows = mix_sources(docs, **kw).collect()
    again = mix_sources(docs.repartition(7), **kw).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"]) for r in rs)
    assert key(rows) == key(again) and len(rows) == 1000
    text = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in docs.collect()}
    sums, top, sizes = Counter(), Counter(), Counter()
    for r in rows:
        source, size = text[r["doc_id"]]
        assert r["size"] == size and r["taken"] in (0, size, 2 * size)
        sums[source] += r["taken"]
        sizes[source] += size
        top[source] = max(top[source], size)
    want = brute_targets(dict(sizes))
    for r in rows:
        source = text[r["doc_id"]][0]
        assert r["target"] == pytest.approx(want[source]) and r["source_size"] == sizes[source]
    assert all(abs(sums[s] - want[s]) <= top[s] for s in sums)


def test_mix_sources_on_odd_rows(spark):
    rows = mix_sources(odd_docs(spark)).collect()
    assert len(rows) == 13 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert mix_sources(empty_docs(spark)).count() == 0


# --- pipeline ----------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    docs = common.table(spark, SMALL, "documents")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.cut_lineage(stage(spark, docs, SMALL))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == corpus_pipeline.COLUMNS, name
            assert out.count() > 0.7 * before
        if name in ("toxicity", "benchmark_decontamination"):
            gone = {r["doc_id"] for r in docs.join(out, "doc_id", "left_anti").collect()}
            if name == "toxicity":
                labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, SMALL, "labels").collect()}
                known = [labels[d] for d in gone if d in labels]
                assert known and np.mean(known) > 0.9
            else:
                items = [norm(r["text"]) for r in common.table(spark, SMALL, "benchmark").collect()]
                whole = {r["doc_id"] for r in docs.collect() if any(i in norm(r["text"]) for i in items)}
                assert whole and whole <= gone
        if name == "simhash_near_dedup":
            again = near_duplicates(out).collect()
            assert all(r["doc_id"] == r["component_id"] for r in again)
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in out.collect()).values()) == 2
        docs = out
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_judges_rows_by_their_own_text(spark, tmp_path):
    """Rows that share a doc_id, or have none, don't fall or stay with each other."""
    rng = np.random.default_rng(1)
    words = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(6)]
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                              "doc_id long, text string, lang string, source string, n_chars long")
    held = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    near = make([(3, words[0]), (5, words[0]), (5, words[1]), (None, words[2]), (None, words[2]), (None, words[0]),
                 (None, words[3]), (9, words[4]), (9, words[4])])
    want = [(3, words[0]), (5, words[1]), (None, words[2]), (None, words[3]), (9, words[4])]
    assert held(corpus_pipeline.drop_near_duplicates(spark, near, "")) == sorted(want, key=str)

    spark.createDataFrame([(1, words[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = make([(1, words[0]), (1, words[1]), (None, words[0]), (None, words[2]), (None, words[2])])
    want = [(1, words[1]), (None, words[2]), (None, words[2])]
    assert held(corpus_pipeline.decontaminate(spark, leak, str(tmp_path))) == sorted(want, key=str)

    clean = [(k, " ".join(f"c{j}" for j in rng.integers(0, 300, 30)) + (" idiot" if k % 2 else "")) for k in range(300)]
    spark.createDataFrame([(k, k % 2) for k, _ in clean], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bad, good = "you idiot there", "c1 c2 c3 c4"
    rows = [*clean, (0, bad), (None, bad), (None, good)]
    got = held(corpus_pipeline.drop_toxic(spark, make(rows), str(tmp_path)))
    assert got == sorted(((i, t) for i, t in rows if "idiot" not in t), key=str)

    mixed = make([(None, words[0] + f" {k}") for k in range(40)] + [(4, words[1])] * 700 + [(4, words[2])] * 2)
    copies = Counter(held(corpus_pipeline.mix(spark, mixed, "")))
    taken = Counter()
    for r in mix_sources(corpus_pipeline._keyed(mixed), key=corpus_pipeline.KEY).collect():
        taken[r["row_key"]] += r["copies"]
    keys = {(r["doc_id"], r["text"]): r["row_key"] for r in corpus_pipeline._keyed(mixed).collect()}
    assert all(copies[k] == taken[v] for k, v in keys.items()) and sum(copies.values()) > 743


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    for t in ("labels", "benchmark"):
        common.table(spark, SMALL, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({r["doc_id"] for r in rows}) >= 4
    schema = T._parse_datatype_string("doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0, name
