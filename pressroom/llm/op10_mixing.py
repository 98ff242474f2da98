"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted ``target / source size`` times, a number
between 0 and 2.  The whole part is taken outright; the fraction is a copy
probability.  Within a block, two documents at a time pass mass between them, at
random and without bias, until one probability is 0 or 1.  Mass is passed in
words, so each step leaves the block's expected words as they are.  A block ends
with one undecided document at most; those meet in a reduction tree of fixed
fan-in until a source has one left, which a last draw decides.  A source's words
therefore miss its target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD, cut_lineage, table, text_or_empty

EDGE = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, have ``weights``, repeating.  They
    share ``share`` of all words; a target stops at ``most`` times its source's
    size and the excess is reshared by weight until none is above.  Resharing
    ends at target = min(cap, level * weight) with one level for all; the sources
    at their caps are those with the smallest cap per weight, so running sums in
    that order give the level.  The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(below), F.lit(0.0))) \
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))) \
        .withColumn("total", share * F.sum("source_size").over(whole).cast("double"))
    # the level as if all sources before this one were at their caps; the first under its own cap, which has the
    # largest such value, sets it
    per = per.withColumn("try", (F.col("total") - F.col("capped")) / F.col("w_left")) \
        .withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(whole))
    return per.select("source", "source_size",
                      F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Pivotal steps over one block, largest documents first: probabilities, all
    0 or 1 but for one at most, and that one's position or -1."""
    p = p.copy()
    draws = rng.random(len(p)).tolist()
    held = -1
    for j in range(len(p)):
        if p[j] <= EDGE or p[j] >= 1 - EDGE:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        si, sj, pi, pj = size[held], size[j], p[held], p[j]
        up = min((1 - pi) * si, pj * sj)      # words that may pass from j to the held document
        down = min(pi * si, (1 - pj) * sj)    # and the other way
        moved = up if draws[j] * (up + down) < down else -down
        pi, pj = pi + moved / si, pj - moved / sj
        open_i, open_j = EDGE < pi < 1 - EDGE, EDGE < pj < 1 - EDGE
        p[held] = pi if open_i else round(pi)
        p[j] = pj if open_j else round(pj)
        held = held if open_i else j if open_j else -1
    return p, held


def _settled(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        by = ["size", *[c for c in rows.columns if c not in ("sid", "block", "whole", "size", "p", "open")]]
        rows = rows.sort_values(by, ascending=[False] + [True] * (len(by) - 1), kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, level, int(key[0]) & 0xFFFFFFFF, int(key[0]) >> 32 & 0xFFFFFFFF, int(key[1])])
        p, held = settle(rows["p"].to_numpy(), rows["size"].to_numpy(dtype=float), rng)
        rows["p"] = p
        rows["open"] = np.arange(len(rows)) == held
        return rows
    return run


_SCHEMA = "sid long, block long, doc_id long, part int, size long, p double, open boolean"


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                seed: int = 17, block_rows: int = 4096, fan_in: int = 256, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, and
    ``key`` if one is named: a column of strings that tells rows of one doc_id apart.

    ``size`` counts words (null text: 0), ``taken`` is copies times size, and
    copies never exceeds ``most`` rounded up.  All draws are seeded by block and
    blocks are set by hashes of doc_id and text, so reruns agree whatever the partitions
    and rows that repeat a doc_id, or have none, are spread over blocks by their texts.
    A document without words has 0 copies.  Rows that repeat a doc_id and size
    are numbered, so each is decided on its own and which of them is taken is immaterial.
    A null doc_id is a document like any other.  An empty table gives an empty result; other columns than
    doc_id, text and source are not read.
    """
    ship_package(docs.sparkSession)
    own = [key] if key else []
    sized = cut_lineage(docs.select(
        *own, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("print"),
        F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long").alias("size")))
    per = targets(sized, weights, share, most)
    per = per.withColumn("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))) \
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    counts = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per = cut_lineage(per.alias("t").join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")))
                      .select("t.*", F.ceil(F.col("n") / block_rows).cast("long").alias("n_blocks")))
    rated = sized.join(per.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))) \
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "print", F.lit(seed)), "n_blocks")) \
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("rate") + EDGE)).otherwise(F.lit(0)).cast("int")) \
        .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).otherwise(F.lit(0.0)))

    blocks = rated.select("sid", "block", "doc_id", "whole", "size", "p", *own).groupBy("sid", "block") \
        .applyInPandas(_settled(seed, 0), _SCHEMA.replace("part int", "whole int") + "".join(f", {c} string" for c in own))
    first = cut_lineage(blocks)
    still = first.where("open").select("sid", "block", F.col("block").alias("from"), "doc_id", "size", "p")
    top = per.agg(F.max("n_blocks")).first()[0] or 1
    level, fate = 0, []
    schema = "sid long, block long, from long, doc_id long, size long, p double, open boolean"
    while top > 1:
        level += 1
        top = -(-top // fan_in)
        wave = still.withColumn("block", F.floor(F.col("block") / fan_in).cast("long")) \
            .groupBy("sid", "block").applyInPandas(_settled(seed, level), schema)
        wave = cut_lineage(wave)
        fate.append(wave.where("not open").select("sid", "from", "p"))
        still = wave.where("open").drop("open")
    # one undecided document a source is left
    draw = F.pmod(F.xxhash64("sid", "doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    fate.append(still.select("sid", "from", F.when(draw < F.col("p"), 1.0).otherwise(0.0).alias("p")))
    decided = fate[0]
    for x in fate[1:]:
        decided = decided.unionByName(x)
    decided = decided.withColumnRenamed("p", "q")
    rows = first.where("not open").select("sid", "doc_id", "size", "whole", "p", *own).unionByName(
        first.where("open").join(decided.withColumnRenamed("from", "block"), ["sid", "block"])
        .select("sid", "doc_id", "size", "whole", F.col("q").alias("p"), *own))
    copies = (F.col("whole") + F.round("p").cast("int")).alias("copies")
    return rows.join(per.select("sid", "source_size", "target"), "sid") \
        .select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies, *own)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
