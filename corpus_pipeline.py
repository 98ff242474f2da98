"""The corpus pipeline: documents through filters to training files.

STAGES are applied in order; each works on all that its predecessor kept, and
all but the last return the columns of ``documents``.  Null texts count as empty
throughout, empty tables give empty results, extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import op1_toxicity as toxicity
from pressroom.llm.common import cut_lineage, table
from pressroom.llm.op2_decontaminate import contaminated_pairs
from pressroom.llm.op7_simhash import first_rows
from pressroom.llm.op8_tokens import token_files
from pressroom.llm.op10_mixing import mix_sources

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names a row by all it holds.  Rows that agree in it are the same row several times.
KEY = "row_key"
#: Copies of a row that one task makes.
PART = 256


def _keyed(docs: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-"))
    own = [part(F.col(c).cast("string")) for c in ("doc_id", "lang", "source", "n_chars")]
    return docs.select(*COLUMNS, F.sha2(F.concat(*own, part(F.sha2("text", 256))), 256).alias(KEY))


def _one_of_each(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keyed ``docs`` named by ``keys`` (key, n and others): those that
    occur once, and one of each that occurs ``n`` times, if there are any."""
    once, again = docs.join(keys.where("n = 1"), KEY), keys.where("n > 1")
    if again.isEmpty():
        return once, None
    # written first: the copies of one row are dealt out by part there, and collapse before they are moved
    return once, cut_lineage(docs.join(again, KEY)).dropDuplicates([KEY])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity machine predicts as toxic go, each by its own text.
    It is trained on labelled rows outside the held-out third."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, that with the smallest doc_id and
    row key; a row without doc_id comes after all others.  Rows that repeat a doc_id
    are in the components of their own texts."""
    keyed = _keyed(docs)
    once, again = _one_of_each(keyed, first_rows(keyed, KEY, width=3, max_bits=2))
    return (once.unionByName(again) if again else once).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    keyed = _keyed(docs)
    gone = contaminated_pairs(keyed, table(spark, sf_dir, "benchmark"), key=KEY).select(KEY).distinct()
    return keyed.join(gone, KEY, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, in rows of its own.  Of the same row
    several times, the copies are counted together."""
    keyed = _keyed(docs)
    taken = cut_lineage(mix_sources(keyed, key=KEY).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")))
    once, again = _one_of_each(keyed, taken.where("copies > 0"))
    if again:
        again = again.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {PART}")))) \
            .repartition(KEY, "part").withColumn("copies", F.least(F.col("copies") - F.col("part") * PART, F.lit(PART)))
        once = once.unionByName(again.drop("part"))
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Arrow stream files; a row per document, read back from them."""
    return token_files(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
    ("token_files", write_token_files),
]

#: Trained models, draws and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
