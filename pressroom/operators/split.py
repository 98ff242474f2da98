"""Seeded shuffle and reproducible train/valid/test split.

The reference shuffles each site with a seeded sampler and cuts at
``int(0.8 n)`` and ``int(0.9 n)``.  Here the shuffle order is
``md5(seed || uuid)`` (ties by uuid), and the cut points are integer
arithmetic in permille, so no float drift moves a boundary row.

Ranking inside a group without a per-group window: a window partitioned by
site would put a whole site in one task.  Instead a rank is the number of
rows in the group's earlier blocks plus the row's number in its own block.
A block is set by the row itself (for the shuffle, the first digits of its
md5), so counts and numbers agree however often and wherever they are
evaluated; no partition ids, bounds or row positions take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config

# 16**3 blocks a group: a site of 10**9 rows has blocks of 250,000
KEY_DIGITS = 3


def shuffle_key(seed: int, id_col: str = "uuid") -> Column:
    """Deterministic pseudo-random order key."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string")))


def rank_by_blocks(df: DataFrame, group: list[str], block: list[Column], order: list[Column]) -> DataFrame:
    """Add ``rank`` (1-based) of each row within ``group`` in the order of
    ``block`` and then ``order``, and ``group_n``, the group's rows.

    The running sum over blocks has a row per (group, block); the window that
    numbers rows holds one block.  Null is a group and a block like any other.
    Rows that tie in everything are numbered in any order.
    """
    names = [f"_b{k}" for k in range(len(block))]
    marked = df.withColumns(dict(zip(names, block)))
    keys = [*group, *names]
    sizes = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    before = whole.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"{k}_s") for k in keys],
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                         F.sum("_cnt").over(whole).alias("group_n"))
    numbered = marked.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"{k}_s"))
        same = one if same is None else same & one
    return (numbered.join(sizes, same)
            .withColumn("rank", F.col("_off") + F.col("_row"))
            .drop("_row", "_off", *names, *[f"{k}_s" for k in keys]))


def assign_split(df: DataFrame, cfg: Config = DEFAULT, group: str = "site",
                 id_col: str = "uuid") -> DataFrame:
    """``split`` in {train, valid, test} per group, exact sizes."""
    train_pm = round(cfg.train_size * 1000)
    upto_valid_pm = round((cfg.train_size + cfg.valid_size) * 1000)
    keyed = df.withColumn("_key", shuffle_key(cfg.split_seed, id_col))
    ranked = rank_by_blocks(keyed, [group], [F.substring("_key", 1, KEY_DIGITS)], [F.col("_key"), F.col(id_col)])
    cut1 = F.expr(f"(group_n * {train_pm}) div 1000")
    cut2 = F.expr(f"(group_n * {upto_valid_pm}) div 1000")
    split = (F.when(F.col("rank") <= cut1, F.lit("train"))
             .when(F.col("rank") <= cut2, F.lit("valid"))
             .otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("_key")
