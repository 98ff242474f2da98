"""K1's id index: what an append reads, reruns, dead appends, replaced files, odd ids."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from pressroom.sinks import id_index
from pressroom.sinks import writers as W

SCHEMA = "uuid string, article string, site string, cc_date timestamp_ntz"


def _rows(spark, ids, month=1):
    return spark.createDataFrame([(i, f"text {i}", f"s{len(i or '') % 3}", dt.datetime(2021, month, 5, 10)) for i in ids], SCHEMA)


def _stored(spark, path):
    return sorted((r["uuid"] or "") for r in spark.read.schema(SCHEMA).json(path).collect())


@pytest.mark.parametrize("within", [None, "cc_date"])
def test_reruns_overlaps_and_rows_without_id(spark, tmp_path, within):
    path = str(tmp_path / "store")
    a, b = _rows(spark, ["a", "bb", None, "a"]), _rows(spark, ["bb", "ccc", None, "dd"], month=1)
    for batch in (a, a, b, a, b):
        W.append_articles(batch, path, within=within)
    assert _stored(spark, path) == ["", "a", "bb", "ccc", "dd"]
    W.append_articles(_rows(spark, []), path, within=within)
    assert len(_stored(spark, path)) == 5


def test_an_append_reads_the_ids_of_its_own_months_only(spark, tmp_path):
    path = str(tmp_path / "store")
    for month in range(1, 7):
        W.append_articles(_rows(spark, [f"{month}-{k}" for k in range(50)], month), path, within="cc_date")
    new = _rows(spark, ["6-1", "6-x"], 6)
    have = id_index.stored_ids(new.withColumn("part", id_index.part_of(new, "uuid", "cc_date", "month")), path, "uuid", "cc_date", "month")
    assert have.inputFiles() and all("part=2021-06" in f for f in have.inputFiles())
    assert have.count() == 50
    fresh = _rows(spark, ["7-1"], 7)
    none = id_index.stored_ids(fresh.withColumn("part", F.lit("2021-07")), path, "uuid", "cc_date", "month")
    assert not none.inputFiles() and none.count() == 0


def test_files_of_a_dead_append_and_replaced_files(spark, tmp_path):
    path = str(tmp_path / "store")
    W.append_articles(_rows(spark, ["a", "bb", "ccc"]), path)
    W.append_articles(_rows(spark, ["dddd"]), path)
    # a dead append left ids of a run without covers, and a file that no run knows
    folder = glob.glob(f"{path}/_ids/*")[0]
    spark.createDataFrame([("zz", str(k), "dead") for k in range(id_index.HASH_PARTS)], "uuid string, part string, run string") \
        .write.mode("append").partitionBy("part", "run").parquet(f"{folder}/ids")
    _rows(spark, ["left"]).write.mode("append").partitionBy("site").json(path)
    W.append_articles(_rows(spark, ["left", "zz", "a"]), path)
    assert _stored(spark, path) == ["a", "bb", "ccc", "dddd", "left", "zz"]
    # one site is replaced: its ids are no longer stored, those of the others are
    W.overwrite_by_site(_rows(spark, ["e"]), path)
    held = _stored(spark, path)
    W.append_articles(_rows(spark, ["a", "bb", "ccc", "dddd", "left", "zz"]), path)
    assert held == ["bb", "ccc", "e", "zz"] and _stored(spark, path) == ["a", "bb", "ccc", "dddd", "e", "left", "zz"]


def test_the_same_row_of_an_id_is_kept_on_a_rerun(spark):
    rows = [("a", f"text {k}", "s", dt.datetime(2021, 1, 1)) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {W.one_of_each(df.repartition(n, "article"), "uuid").collect()[0]["article"] for n in (1, 3, 8)}
    assert len(got) == 1


def test_zoned_times_are_refused(spark, tmp_path):
    df = _rows(spark, ["a"]).withColumn("cc_date", F.col("cc_date").cast("timestamp"))
    with pytest.raises(ValueError, match="can't decide a part"):
        id_index.part_of(df, "uuid", "cc_date", "day")
    assert not os.path.exists(str(tmp_path / "none"))
