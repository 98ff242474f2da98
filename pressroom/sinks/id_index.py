"""The ids that an article store holds (K1), so that an append doesn't read the articles again.

Beside the articles, in ``_ids`` (a name that readers skip), lies a table of their ids alone,
in parts that an id's row decides: a hash of the id, or the year, month or day of a column
that equal ids share.  An append reads only the parts that its own rows fall in; where ids
are made of the crawl date, as T7's are, a new crawl reads none of the earlier ones' ids,
however large the store.

The index is derived from the stored files: ``covers`` names the files of each run of
indexing, and is written after that run's ids.  A file that no run covers (of the last append,
or of one that died half-way) is indexed by the next append; a run that covers a file which
is gone counts no more, and its other files are indexed anew.  So the index never says
less or more than the files, whatever wrote or replaced them.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of an index by hash, and the characters of an ISO date that a unit keeps.
HASH_PARTS = 64
UNITS = {"year": 4, "month": 7, "day": 10}


def exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def part_of(df: DataFrame, id_col: str, within: str | None, unit: str) -> Column:
    """The part that a row's id belongs to.  ``within`` is a date, a time without zone, or ISO
    text: the stored text of a time with a zone depends on the session that wrote it."""
    if within is None:
        return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(HASH_PARTS)).cast("string")
    kind = dict(df.dtypes)[within]
    if kind not in ("string", "date", "timestamp_ntz"):
        raise ValueError(f"{within}: {kind} can't decide a part; use a date, timestamp_ntz or ISO text")
    text = F.col(within) if kind == "string" else F.date_format(within, "yyyy-MM-dd")
    return F.coalesce(F.substring(text, 1, UNITS[unit]), F.lit("none"))


def stored_ids(new: DataFrame, path: str, id_col: str, within: str | None, unit: str) -> DataFrame:
    """(id_col, part) of the stored rows in the parts that ``new``, a frame with ``part``, has."""
    spark = new.sparkSession
    folder = f"{path.rstrip('/')}/_ids/{id_col}-{within or 'hash'}-{unit}"
    runs = _up_to_date(spark, path, folder, id_col, within, unit)
    # by hash every part is wanted; units of time are as many as the batch spans
    wanted = [str(k) for k in range(HASH_PARTS)] if within is None else [r[0] for r in new.select("part").distinct().collect()]
    found = [p for p in (f"{folder}/ids/part={w}" for w in wanted) if exists(spark, p)]
    if not found or not runs:
        return spark.createDataFrame([], f"{id_col} string, part string")
    return spark.read.schema(f"{id_col} string, part string, run string").option("basePath", f"{folder}/ids").parquet(*found) \
        .where(F.col("run").isin(runs)).select(id_col, "part")


def _up_to_date(spark: SparkSession, path: str, folder: str, id_col: str, within: str | None, unit: str) -> list[str]:
    """Index the files that no valid run covers; the valid runs, one an append."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    covers = spark.createDataFrame([], "run string, file string") if not exists(spark, f"{folder}/covers") \
        else spark.read.schema("run string, file string").parquet(f"{folder}/covers")
    stale = covers.join(files, "file", "left_anti").select("run").distinct()
    valid = covers.join(stale, "run", "left_anti")
    runs = [r[0] for r in valid.select("run").distinct().collect()]
    missing = [r[0] for r in files.join(valid, "file", "left_anti").collect()]  # names of the last append's files
    if missing:
        run = uuid.uuid4().hex
        fields = [id_col] if within is None else [id_col, within]
        ids = spark.read.schema(", ".join(f"{c} string" for c in fields)).json(missing)
        ids = ids.select(id_col, part_of(ids, id_col, within, unit).alias("part"), F.lit(run).alias("run"))
        ids.hint("rebalance", F.col("part")).write.mode("append").partitionBy("part", "run").parquet(f"{folder}/ids")
        spark.createDataFrame([(run, f) for f in missing], "run string, file string").coalesce(1) \
            .write.mode("append").parquet(f"{folder}/covers")
        runs.append(run)
    return runs
