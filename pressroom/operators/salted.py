"""Grouping and joining on keys of which one may hold a large part of all rows.

Rows go by (key, salt), the salt being set by the row's own id, and what belongs to the
key is brought to the salts that occur.  So a key of a third of all rows is met in
``SALTS`` tasks, and a key of one row costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts that the rows of one hot key (a text, a bucket, a leader, a token) are split into
SALTS = 64


def salt(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SALTS)).alias("_salt")


def with_newest(df: DataFrame, keys: list[str], id_col: str, ord_col: str, out: str, shared: bool = False) -> DataFrame:
    """Rows of ``df`` with ``out``, the largest ``ord_col`` of their group; with
    ``shared``, only rows of groups of two or more."""
    rows = df.withColumn("_salt", salt(id_col))
    parts = rows.groupBy(*keys, "_salt").agg(F.max(ord_col).alias("_o"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)  # at most SALTS rows
    top = parts.select(*keys, "_salt", F.max("_o").over(group).alias(out), F.sum("_n").over(group).alias("_n"))
    if shared:
        top = top.where("_n > 1")
    return rows.join(top.drop("_n"), [*keys, "_salt"]).drop("_salt")


def meet(rows: DataFrame, table: DataFrame, keys: list[str], id_col: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which holds a row per key at most; ``how`` is inner or left."""
    salted = rows.withColumn("_salt", salt(id_col))
    parts = salted.select(*keys, "_salt").distinct().join(table, keys, how)
    return salted.join(parts, [*keys, "_salt"]).drop("_salt")
