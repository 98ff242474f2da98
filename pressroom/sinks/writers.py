"""Writers (K1-K7).  Output is partitioned by site (and split) instead of one
file per site; every writer is safe to rerun.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.sinks import id_index

ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def one_of_each(df: DataFrame, id_col: str) -> DataFrame:
    """Of rows with one id the row of the smallest digest, so that reruns keep the same one.
    Rows without id count as one id."""
    digest = F.sha2(F.to_json(F.struct("*")), 256)
    return df.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(F.struct("*"), digest).alias("row")).select("row.*")


def append_articles(df: DataFrame, path: str, id_col: str = "uuid", within: str | None = None, unit: str = "month") -> DataFrame:
    """K1: append gzip JSON lines partitioned by site, ISO dates.

    The reference appends blindly, so a rerun duplicates rows; ids here are
    deterministic (T7), and rows whose id is already stored are skipped by an
    anti-join with the store's id index (``id_index``), so the append is idempotent; of rows with
    one id in a batch, one is written.  ``within`` names a date column that rows of one id
    share: only the ids of the batch's own years, months or days (``unit``) are read then.
    Returns the rows written.
    """
    new = one_of_each(df, id_col)
    if id_index.exists(df.sparkSession, path):
        new = new.withColumn("part", id_index.part_of(df, id_col, within, unit))
        narrow = df.select(id_index.part_of(df, id_col, within, unit).alias("part"))
        have = id_index.stored_ids(narrow, path, id_col, within, unit).alias("have")
        same = F.col(f"new.{id_col}").cast("string").eqNullSafe(F.col(f"have.{id_col}")) & (F.col("new.part") == F.col("have.part"))
        new = new.alias("new").join(have, same, "left_anti").drop("part")
    (new.write.mode("append").partitionBy("site")
     .option("compression", "gzip").option("timestampNTZFormat", ISO).json(path))
    return new


def overwrite_by_site(df: DataFrame, path: str, fmt: str = "json") -> None:
    """K2: replace the sites present in ``df`` only (dynamic partition overwrite)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "gzip").option("timestampNTZFormat", ISO)
     .partitionBy("site").format(fmt).save(path))


def write_splits(df: DataFrame, path: str) -> None:
    """K3: train / valid / test, partitioned by split and site."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "gzip").option("timestampNTZFormat", ISO)
     .partitionBy("split", "site").json(path))


def write_stats_csv(df: DataFrame, path: str) -> None:
    """K4: a statistics table (one row per site or bin: tiny) as one CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metrics_json(df: DataFrame, path: str) -> None:
    """K5: the one-row metrics table as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """K6: prediction JSON lines (Spark writes non-ASCII unescaped)."""
    df.write.mode("overwrite").json(path)


def write_encoded(df: DataFrame, path: str) -> None:
    """K7: encoded dataset as Parquet."""
    df.write.mode("overwrite").parquet(path)


def with_iso_dates(df: DataFrame, cols=("date_of_creation", "cc_date")) -> DataFrame:
    """T9 on a frame: timestamp columns as ISO text."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in cols if c in df.columns})
