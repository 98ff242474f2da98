"""The stored language model: against a plain count, held-out accuracy, odd rows, versions."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressroom.operators import trigrams as T
from pressroom.plans.registry import QUERIES


def test_model_and_scores_match_a_plain_count(spark, tmp_path):
    rows = [("a", "The cat sat on the mat, the end."), ("b", "Le chat était là; le café!"), ("a", "thin things"), (None, "nothing"), ("b", None)]
    df = spark.createDataFrame(rows, "lang string, article string")
    norm = lambda t: " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t or "").split()) + " "

    def grams(t):
        t = norm(t)
        return [t[i:i + 3] for i in range(len(t) - 2)]

    counts = {g: Counter(x for lang, t in rows if lang == g for x in grams(t)) for g in ("a", "b")}
    v = len(counts["a"] | counts["b"])
    log = lambda lang, n: math.floor(1000 * math.log(n / (sum(counts[lang].values()) + v)) + 0.5)
    T.save_model(T.train(df), str(tmp_path / "m"))
    got = {(r["lang"], r["gram"]): r["weight"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert got == {(lang, g): log(lang, n + 1) for lang, c in counts.items() for g, n in c.items()}
    model = T.load_model(spark, str(tmp_path / "m"))

    def brute(text):
        if not grams(text):
            return None
        total = {lang: sum(n * log(lang, counts[lang][g] + 1) for g, n in Counter(grams(text)).items()) for lang in ("a", "b")}
        return max(("a", "b"), key=lambda x: (total[x], x == "a"))

    texts = ["the hat", "là", "", None, "?!", "x", "été", "that cat " * 40_000, "q" * 200_000]
    out = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.language(spark, F.col("t"), model).alias("l")).collect()
    assert {r["k"]: r["l"] for r in out} == {k: brute(t) for k, t in enumerate(texts)}
    with pytest.raises(Exception, match="exists|EXISTS"):
        T.save_model(T.train(df), str(tmp_path / "m"))


def test_other_versions_are_refused_and_no_rows_teach_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", "some words")], "lang string, article string")
    T.train(df).withColumn("version", F.lit(9)).write.parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="version 9"):
        T.load_model(spark, str(tmp_path / "v"))
    T.save_model(T.train(df.limit(0)), str(tmp_path / "none"))
    model = T.load_model(spark, str(tmp_path / "none"))
    assert df.select(T.language(spark, F.col("article"), model).alias("l")).first()["l"] is None


def test_held_out_articles_are_named_right(spark):
    rows = QUERIES["c3_trigram_language"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    right = sum(r["language"] == r["lang"] for r in rows)
    print("held out:", right, "of", len(rows))
    assert len(rows) > 250 and right / len(rows) > 0.97


def test_words_are_counted_within_a_row(spark):
    """One row per distinct word of a text, before any shuffle; null and empty lists stay without words."""
    from pyspark.sql import functions as F
    from pressroom.operators import langid
    rows = [(["b", "a", "b", "é", "a", "b"],), (["x"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "ws array<string>").select("ws", langid.counted("ws").alias("c"))
    got = [None if r["c"] is None else {(w["word"], w["k"]) for w in r["c"]} for r in df.collect()]
    assert got == [{("a", 2), ("b", 3), ("é", 1)}, {("x", 1)}, None, None]
    articles = spark.createDataFrame([("1", "la la le", "fr"), ("2", "the the of", "en")], "uuid string, article string, lang string")
    profile, langs = langid.train(articles)
    plan = langid.identify(articles, profile, langs)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate [_id" in line and "word" in line.split("]")[0]]
