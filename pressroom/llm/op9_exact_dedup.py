"""Exact duplicates through content-defined chunk recipes, in DataFrame and SQL
functions only.

A text is cut at places that its own content decides (see ``CHUNK``), so a
document becomes a recipe: the ordered list of its chunks' identifiers.  Each
distinct chunk moves once, to verify that its identifier belongs to it alone;
documents are then compared by their recipes, some hundredths of their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut_lineage, table, text_or_empty

#: A chunk runs to the first blank, at least 256 characters on, that follows one of
#: the letters below; where none comes, it ends after 2,048 characters.
CHUNK = r"(?s).{256,2047}?[hmpüéñ] |.{1,2048}"


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def normalised(text: str = "text") -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def exact_duplicates(docs: DataFrame, identify: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are identical; the smallest
    doc_id stays.  Null texts count as empty; all empty texts form one group.
    Rows that repeat a doc_id and text count each in group_size and are all
    marked kept if that doc_id stays.  A null doc_id stays only where its group
    has no other.  An empty table gives an empty result; columns other than
    doc_id and text are not read.

    ``identify`` maps a chunk to its identifier.  Two different chunks under one
    identifier are found while the distinct chunks are collected; documents that
    hold such a chunk are compared by their whole texts instead.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    chunked = texts.select("doc_id", "norm", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks"))

    # distinct chunks by their bytes; an identifier is verified if one distinct chunk has it
    distinct = chunked.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.lit(1).alias("one"))
    clashes = cut_lineage(distinct.groupBy(identify(F.col("chunk")).alias("id")).count().where("count > 1").select("id"))

    recipes = chunked.select("doc_id", F.transform("chunks", identify).alias("recipe"),
                             F.sha2("norm", 256).alias("text_sha256"))
    plain = F.lit(None).cast("string")
    if clashes.isEmpty():
        recipes = cut_lineage(recipes.withColumn("whole", plain))
    else:
        holders = chunked.select("doc_id", "norm", F.explode("chunks").alias("chunk")) \
            .withColumn("id", identify(F.col("chunk"))).join(clashes, "id", "left_semi") \
            .select(F.sha2("norm", 256).alias("text_sha256"), "norm").distinct() \
            .select("text_sha256", F.col("norm").alias("whole"))
        recipes = cut_lineage(recipes.join(holders, "text_sha256", "left"))

    # null-safe keys: ``whole`` is set for all texts of a group or for none
    keys = ["recipe", F.coalesce("whole", F.lit("")).alias("whole_key")]
    groups = cut_lineage(recipes.select("doc_id", *keys).groupBy("recipe", "whole_key")
                         .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    rows = recipes.select("doc_id", "text_sha256", *keys)
    return rows.join(groups, ["recipe", "whole_key"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
