"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) of longs.

    Each round hooks every node to the smallest (by hash) node among itself and
    its neighbours, follows that pointer once more, and contracts: edges are
    mapped to the pointers' ends, loops and repeats drop out.  Ordering by hash
    keeps pointer chains short, so the edges shrink by a factor per round and the
    number of rounds is logarithmic.  Edges and maps are written to the shared
    folder each round, so a lost executor costs one round's tasks.  Afterwards
    the maps are composed backwards.  Nothing but a row count reaches the driver.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    both = edges.where("a <> b").select("a", "b")
    live = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        hook = live.groupBy("a").agg(F.min(order("b")).alias("m")) \
            .select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["id"].alias("to"))
        hook = cut_lineage(hook)
        twice = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.node")) \
            .select(F.col("x.node").alias("node"), F.col("y.to").alias("to"))
        step = cut_lineage(twice)
        maps.append(step)
        left = live.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        right = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        live = cut_lineage(right.where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct())
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))
    # every node of a later round is an end of an earlier map, so composing from the last map back reaches the root
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for earlier in reversed(maps[:-1]):
        roots = cut_lineage(
            earlier.join(roots.select(F.col("node").alias("to"), "root"), "to", "left")
            .select("node", F.coalesce("root", "to").alias("root")))
    return roots
