"""Exact set-similarity join with prefix and length filters.

Sets that have ``o`` elements in common at least share one among the first
``n - o + 1`` of each, if all sets list their elements in one order.  The order here is
rarest first over all sets: what a template puts into every text comes last and is seldom in
a prefix, and an element of one set alone links nothing, so work follows the rare
elements that sets share instead of the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.operators.salted import meet, with_newest
from pressroom.session import cut_lineage


def prefixes(tokens: DataFrame, length: Callable[[Column], Column]) -> DataFrame:
    """(id, key, n, token): of each set its first ``length(n)`` elements, rarest first, without
    those of one set alone.

    ``tokens`` is (id, key, token) with distinct elements a set; ``key`` is the set's place in
    the total order of sets and goes along."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    listed = meet(tokens, counts, ["token"], "id").groupBy("id").agg(
        F.any_value("key").alias("key"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("list"))
    n = F.size("list")
    first = listed.select("id", "key", n.alias("n"), F.explode(F.slice("list", F.lit(1), length(n).cast("int"))).alias("e"))
    return first.where("e.df > 1").select("id", "key", "n", F.col("e.token").alias("token"))


def newer_matches(tokens: DataFrame, open_ids: DataFrame, length: Callable[[Column], Column],
                  verify: Callable[[DataFrame], DataFrame], fits: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(x, y): for each set of ``open_ids`` (column id) that has a match with a larger key, one or
    more of its matches.

    Each open set first meets the newest holder of each element of its prefix: at most
    a pair per element, and in a family of alike sets that is the family's newest.
    Only sets still without a match then meet the other newer holders.
    ``verify`` keeps the true pairs of (x, y); ``fits`` compares the sizes of two sets."""
    ok = fits or (lambda nx, ny: F.lit(True))
    p = cut_lineage(prefixes(tokens, length).withColumn("o", F.struct("key", "n", F.col("id").alias("u"))))
    mine = p.join(open_ids.select("id").distinct(), "id", "left_semi")
    lead = with_newest(p, ["token"], "id", "o", "lead").join(open_ids.select("id").distinct(), "id", "left_semi")
    first = lead.where((F.col("key") < F.col("lead.key")) & ok(F.col("n"), F.col("lead.n"))) \
        .select(F.col("id").alias("x"), F.col("lead.u").alias("y")).distinct()
    met = cut_lineage(verify(first))
    left = mine.join(met.select(F.col("x").alias("id")).distinct(), "id", "left_anti")
    other = p.select("token", F.col("id").alias("y"), F.col("key").alias("ykey"), F.col("n").alias("ny"))
    rest = left.select("token", F.col("id").alias("x"), "key", "n").join(other, "token") \
        .where((F.col("key") < F.col("ykey")) & ok(F.col("n"), F.col("ny"))).select("x", "y").distinct()
    return met.unionByName(verify(rest.join(first, ["x", "y"], "left_anti")))
