"""Learned sentence boundaries: planted abbreviations, ordinals, initials, odd texts, the model's bound."""

import pytest
from pyspark.sql import functions as F

from pressroom.config import Config
from pressroom.operators import clean as C
from pressroom.operators import sentences as S


def _corpus(spark):
    """Sentences in which four abbreviations stand often, beside words that end sentences now and then."""
    nouns = ["house", "river", "paper", "city", "market", "garden", "letter", "winter", "doctor", "train"]
    rows = [(k, f"The {nouns[k % 10]} of dr. Kovács met prof. Novák near the {nouns[(k + 3) % 10]}. "
                f"They saw e.g. a {nouns[(k + 5) % 10]} and a {nouns[(k * 7 + 1) % 10]} etc. and left on the 3. května with J. R. Horák by the {nouns[(k + 6) % 10]}. "
                f"Was it a {nouns[(k + 2) % 10]}? It was!") for k in range(300)]
    return spark.createDataFrame([*rows, (300, None), (301, ""), (302, " \n\t ")], "k int, article string")


def test_abbreviations_are_learned_and_end_no_sentence(spark, tmp_path):
    df = _corpus(spark)
    S.save_abbreviations(S.learn_abbreviations(df), str(tmp_path / "m"))
    words = S.load_abbreviations(spark, str(tmp_path / "m"))
    assert {"dr", "prof", "e.g", "etc"} <= set(words)
    assert not set(words) & {"house", "river", "paper", "city", "market", "garden", "letter", "winter", "doctor", "train", "horák", "3"}
    got = {r["k"]: r["n"] for r in df.select("k", S.sentence_count("article", words).alias("n")).collect()}
    assert got == {**{k: 4 for k in range(300)}, 300: None, 301: 0, 302: 0}
    cfg = Config(min_article_sentences=5)
    assert C.filter_sentences(df, cfg).count() == 300  # every full stop ends a sentence
    assert C.filter_sentences(df, cfg, abbreviations=words).count() == 0


def test_single_rules(spark):
    cases = {"He met dr. Who.": 1, "He met DR. Who. (Dr. Who left.)": 2, "On 3. May. Then": 3, "am 3. mai. Then": 2, "J. R. Horák. Yes": 2,
             "Really dr.? Yes": 2, "wait dr... Then": 2, "no end": 1, ".": 1, ". . x": 3, "3.5 is. 4": 2, "end dr.": 1, "a.\nb!\t\tc?": 2,
             "x. " * 3 + "word. " * 50_000: 50_000}
    df = spark.createDataFrame(list(cases.items()), "t string, want int")
    bad = df.withColumn("n", S.sentence_count("t", ["dr"])).where("n <> want").select(F.substring("t", 1, 40), "want", "n").collect()
    assert not bad


def test_no_rows_and_the_models_bound(spark, tmp_path):
    df = spark.createDataFrame([], "article string")
    assert S.learn_abbreviations(df).count() == 0
    assert df.select(S.sentence_count("article", [])).count() == 0
    spark.createDataFrame([("a",), ("b",)], "word string").write.parquet(str(tmp_path / "two"))
    with pytest.raises(ValueError, match="more than 1"):
        S.load_abbreviations(spark, str(tmp_path / "two"), most=1)


def test_each_distinct_token_is_taken_apart_once(spark):
    """Tokens are counted as they stand, before any pattern looks into them."""
    from pressroom.operators import sentences
    df = spark.createDataFrame([("\t Dr. Dr.\u000b(Dr. x) \n y",), ("",), (" \n",), (None,)], "article string").repartition(2)
    out = sentences.learn_abbreviations(df, threshold=-1e9)
    assert [(r["word"], r["stops"], r["others"]) for r in out.collect()] == [("dr", 3, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    lowest = [k for k, line in enumerate(plan) if "Aggregate" in line and "[t#" in line]
    assert lowest and not any("pL" in line for line in plan[lowest[-1] + 1:])


def test_all_abbreviations_are_learned_and_the_strongest_stored(spark, tmp_path):
    """More abbreviations than the stored model holds: t4_abbreviations has them all, the model those of most evidence."""
    import itertools

    import duckdb
    import __spark_entry__ as E
    from tools.oracle_check import canon
    learned = ["".join(w) for w in itertools.islice(itertools.product("ijklmnopqrstuvwxyz", repeat=3), S.SIZE + 300)]
    rows = [(k, " ".join(f"on on {w}. on on on on {w}. on on on on" for w in learned[k::40]), "en", "a.example", 0) for k in range(40)]
    rows += [(40, " ".join(f"{w}." for w in learned[-50:]), "en", "a.example", 0), (41, None, "en", "a.example", 0), (42, "", "en", "a.example", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    for name in ("t4_abbreviations", "t4_c5_learned_sentences"):
        df, want = E.queries()[name](spark, sf), con.sql(E.oracle_sql()[name])
        assert canon(df.columns, df.collect()) == canon(want.columns, want.fetchall())
    assert sorted(r["word"] for r in E.queries()["t4_abbreviations"](spark, sf).collect()) == learned

    found = S.learn_abbreviations(spark.read.parquet(f"{sf}/documents.parquet"), "text")
    got = [(-r["score"], r["word"]) for r in found.collect()]
    assert sorted(w for _, w in got) == learned
    assert got == sorted(got)
    assert [(-r["score"], r["word"]) for r in S.strongest(found).collect()] == got[:S.SIZE]
    S.save_abbreviations(S.strongest(found), f"{sf}/model")
    assert S.load_abbreviations(spark, f"{sf}/model") == sorted(w for _, w in got[:S.SIZE])


def test_words_and_share_have_one_count_of_tokens(spark):
    """The tokens are made and counted once: no condition on words is moved below their count."""
    df = spark.range(500).selectExpr("concat('On dr. ', id, '. at no. 5. ', id) AS article")
    out = S.learn_abbreviations(df, threshold=-1e9)
    assert {(r["word"], r["stops"], r["others"]) for r in out.collect()} == {("dr", 500, 0), ("no", 500, 0)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan
