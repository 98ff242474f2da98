"""C3 with a stored model: naive Bayes on character trigrams, trained once and loaded to score.

Training is an aggregation job: trigrams of the labelled texts are counted per language, and
each language's most frequent ones are kept with integer-scaled log-probabilities.  The
model is a Parquet table of bounded size with its version, written once; scoring holds it in
every task and is map-only: no trigram is shuffled, and a row stays a row whatever its id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.session import cut_lineage, ship_package, spread

VERSION = 1
#: Trigrams kept per language, and the languages that a model may have.
SIZE, MOST_LANGUAGES = 20_000, 200
SCALE = 1000
_ROW = "version int, lang string, gram string, weight long, unseen long"


def plain(text: Column) -> Column:
    """Lower-cased letters, other characters as one blank, a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\PL+", " ")), F.lit(" "))


def train(labelled: DataFrame, text_col: str = "article", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """A model as rows (version, lang, gram, weight, unseen): weights are ``SCALE`` times the logarithm
    of (count + 1) / (the language's trigrams + distinct trigrams), ``unseen`` that of count 0.
    Rows without language or text teach nothing."""
    rows = spread(labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), plain(F.col(text_col)).alias("t")))
    grams = rows.select("lang", F.explode(F.regexp_extract_all("t", F.lit(r"(?s)(?=(.{3}))."), 1)).alias("gram"))
    counts = cut_lineage(grams.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")))
    # one row, and one per language
    distinct = counts.agg(F.count_distinct("gram").alias("v"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("t")).crossJoin(F.broadcast(distinct)).select(
        "lang", (F.col("t") + F.col("v")).cast("double").alias("all"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("place", place).where(F.col("place") <= size)
    log = lambda n: F.round(F.log(n / F.col("all")) * SCALE).cast("long")
    return kept.join(F.broadcast(totals), "lang").select(F.lit(VERSION).alias("version"), "lang", "gram",
                                                         log(F.col("n") + 1).alias("weight"), log(F.lit(1)).alias("unseen"))


def save_model(model: DataFrame, path: str) -> None:
    """The table of a trained model; an existing one is never overwritten."""
    model.write.mode("errorifexists").parquet(path)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    unseen: np.ndarray  # per language
    keys: np.ndarray  # sorted trigrams, three code points in one number
    gains: np.ndarray  # per trigram and language, weight above unseen


def _keys(points: np.ndarray) -> np.ndarray:
    p = points.astype(np.int64)
    return (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]


def load_model(spark: SparkSession, path: str) -> Model:
    """A stored model; its size and version are checked before it is held."""
    table = spark.read.schema(_ROW).parquet(path)
    got = table.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"),
                    F.min("version").alias("low"), F.max("version").alias("high")).first()
    if got["n"] and (got["low"], got["high"]) != (VERSION, VERSION):
        raise ValueError(f"{path}: model version {got['low']} to {got['high']}, expected {VERSION}")
    if got["langs"] > MOST_LANGUAGES or got["n"] > MOST_LANGUAGES * SIZE:
        raise ValueError(f"{path}: {got['n']} trigrams in {got['langs']} languages are too many to hold")
    rows = table.toPandas()
    langs = tuple(sorted(set(rows["lang"])))
    unseen = rows.groupby("lang")["unseen"].first().reindex(langs).to_numpy(np.int64)
    points = np.frombuffer("".join(rows["gram"]).encode("utf-32-le"), "<u4").reshape(-1, 3).astype(np.int64)
    own = (points[:, 0] << 42) | (points[:, 1] << 21) | points[:, 2]
    keys, at = np.unique(own, return_inverse=True)
    gains = np.zeros((len(keys), len(langs)), np.int64)
    which = np.searchsorted(langs, rows["lang"].to_numpy(str)) if langs else np.zeros(0, np.int64)
    gains[at, which] = rows["weight"].to_numpy(np.int64) - rows["unseen"].to_numpy(np.int64)
    return Model(langs, unseen, keys, gains)


def score(text: str, model: Model) -> str | None:
    """The best language of a plain text; the first in order of those that tie, None without trigrams."""
    if len(text) < 3 or not model.langs:
        return None
    total = np.zeros(len(model.langs), np.int64)
    # a long text in stretches that overlap by two characters
    for a in range(0, len(text) - 2, 1 << 16):
        keys = _keys(np.frombuffer(text[a:a + (1 << 16) + 2].encode("utf-32-le"), "<u4"))
        at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        total += model.gains[at[model.keys[at] == keys]].sum(axis=0) + len(keys) * model.unseen
    return model.langs[int(total.argmax())]


def language(spark: SparkSession, text: Column, model: Model) -> Column:
    """The language of each text by the stored model; null for a text without letters."""
    ship_package(spark)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([score(t.as_py(), model) for t in texts], pa.string())

    return F.arrow_udf(run, "string")(plain(text))
