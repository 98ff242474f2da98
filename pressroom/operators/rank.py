"""Ranks of all rows of a table without a task that holds them all.

Two levels: rows are range-partitioned in the order asked for and sorted within their
partition, and each is written with its partition's number and its place there.  Rows are
then counted per partition (and group), the counts of the earlier partitions are summed,
and a rank is that sum plus the place.  The only window runs over the counts, a row
per partition and group.  The written table fixes partitions and places, so a lost
executor can't shift them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.session import cut_lineage

_PLACE = (1 << 33) - 1  # the low bits of monotonically_increasing_id


def global_rank(df: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Add ``rank`` (1-based) of each row in ``order`` within ``group`` (all rows if none) and
    ``group_n``, the group's rows.

    Give narrow rows: all columns are shuffled and written.  Rows that tie in ``order`` lie in
    one partition and are ranked in any order.  Null is a group like any other."""
    group = group or []
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = F.monotonically_increasing_id()
    rows = cut_lineage(ranged.withColumn("_at", at).select(
        *df.columns, F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND(F.lit(_PLACE)).alias("_i")))
    per = rows.groupBy(*group, "_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(*[F.col(g).alias(f"{g}_o") for g in group], F.col("_p").alias("_po"),
                         (before - F.col("_first") + 1).alias("_off"), F.sum("_n").over(whole).alias("group_n"))
    same = F.col("_p") == F.col("_po")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_o"))
    return rows.join(offsets, same).select(*df.columns, (F.col("_off") + F.col("_i")).alias("rank"), "group_n")
