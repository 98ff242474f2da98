"""Global ranks over range partitions, and rows that repeat an id in encoding and D10."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressroom.operators import encode as EN
from pressroom.operators.rank import global_rank
from pressroom.plans import dedup as DP


@pytest.mark.parametrize("parts", ["1", "8", "23"])
def test_ranks_match_a_sort(spark, parts):
    rnd = random.Random(3)
    # one group holds a third, one key value half of it; order by size down, then name
    rows = [(rnd.choice(["a", "a", "b", None, f"g{k % 40}"]), rnd.choice([1, 1, rnd.randrange(50)]), f"n{k:04d}") for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, size int, name string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        one = {r["name"]: (r["rank"], r["group_n"]) for r in global_rank(df, [F.desc("size"), F.asc("name")]).collect()}
        per = {r["name"]: (r["rank"], r["group_n"]) for r in global_rank(df, [F.desc("size"), F.asc("name")], ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert one == {r[2]: (k + 1, len(rows)) for k, r in enumerate(order)}
    want = {}
    for g in {r[0] for r in rows}:
        mine = [r for r in order if r[0] == g]
        want |= {r[2]: (k + 1, len(mine)) for k, r in enumerate(mine)}
    assert per == want
    assert global_rank(df.limit(0), [F.asc("name")]).count() == 0


def test_no_window_holds_the_rows(spark):
    """The only window is over the counts: rows reach no sort but that of their own range."""
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    plan = global_rank(df, [F.asc("k")])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and plan.index("Window") < plan.index("Aggregate")


def test_rows_that_repeat_an_id_are_encoded_each(spark):
    rows = [("a", "one two", "two three"), ("a", "one two", "two three"), ("a", "four", "one"), ("b", "", "two"), (None, "three", "four")]
    ex = spark.createDataFrame(rows, "uuid string, input string, article string")
    vocab = EN.build_vocab(ex, ["article"])
    ids = {r["word"]: r["id"] for r in vocab.collect()}
    assert ids == {"two": 5, "three": 6, "four": 7, "one": 8}
    enc = EN.encode(ex, vocab)
    got = enc.collect()
    labels = lambda r: tuple(x for x in r["labels"] if x >= 5)
    inputs = lambda r: tuple(x for x in r["input_ids"] if x >= 5)
    assert sorted(((r["uuid"], inputs(r), labels(r)) for r in got), key=str) == sorted(
        ((u, tuple(ids[w] for w in i.split()), tuple(ids[w] for w in a.split())) for u, i, a in rows), key=str)
    assert all(len(r["labels"]) == 512 for r in got)
    back = sorted(((r["uuid"], r["generated"]) for r in EN.decode(enc, "labels", vocab).collect()), key=str)
    assert back == sorted(((u, a) for u, _, a in rows), key=str)


def test_rows_that_repeat_an_id_stay_once_each_in_d10(spark):
    rnd = random.Random(1)
    text = lambda: " ".join(f"w{rnd.randrange(900)}" for _ in range(40))
    rows = [(f"u{k}", text(), dt.datetime(2021, 7, 1 + k % 5), "s" if k % 3 else None) for k in range(10)]
    rows += [rows[3], rows[3], rows[6]]
    df = spark.createDataFrame(rows, "uuid string, article string, cc_date timestamp_ntz, site string")
    out = DP.deduplicate(df).collect()
    assert sorted(r["uuid"] for r in out) == sorted(r[0] for r in rows)
    assert len({(r["uuid"], r["split"]) for r in out}) == 10


def test_words_meet_the_vocabulary_once_a_block(spark):
    """Rows of several blocks, null and empty texts, unknown words; only distinct words of a block are joined."""
    rows = [(f"u{k}", f"w{k % 7} common", "common w3 , w3" if k % 5 else None) for k in range(40)] + [("e", "", "zz")]
    ex = spark.createDataFrame(rows, "uuid string, input string, article string").coalesce(2)
    vocab = spark.createDataFrame([("common", 5), ("w3", 6), (",", 7)], "word string, id int")
    bits, EN.BLOCK_BITS = EN.BLOCK_BITS, 2
    try:
        got = {r["uuid"]: r for r in EN.encode(ex, vocab).collect()}
        back = {r["uuid"]: r["generated"] for r in EN.decode(EN.encode(ex, vocab), "labels", vocab).collect()}
        plan = EN.encode(ex, vocab)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        EN.BLOCK_BITS = bits
    assert "posexplode" not in plan and plan.count("Join") == 1
    ids = {"common": 5, "w3": 6, ",": 7}
    assert len(got) == 41
    for u, i, a in rows:
        assert got[u]["input_ids"][:len(i.split()) + 2] == [2, *[ids.get(w, 1) for w in i.split()], 3]
        assert [x for x in got[u]["labels"] if x != -100] == [2, *[ids.get(w, 1) for w in (a or "").split()], 3]
        assert back[u] == " ".join(w for w in (a or "").split() if w in ids)
