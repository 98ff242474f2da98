"""Session helpers: a configured local session for tests and benches, and the
shared checkpoint folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package assumes.  The cluster may override the
# sizes; the semantics-bearing ones (time zone, adaptive execution) are
# set on the session at runtime by ``ensure_conf``.
_RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


SPREAD = "spark.pressroom.spread"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "pressroom", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config(SPREAD, str(shuffle_partitions))
         .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
         # local sessions only: catalog metadata of bucketed cut tables goes to
         # scratch, not the working directory (a cluster names its own)
         .config("spark.sql.warehouse.dir",
                 tempfile.mkdtemp(prefix="pressroom-wh-", dir=os.environ.get("TMPDIR", "/tmp"))))
    for k, v in {**_RUNTIME_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Pin the time zone so timestamps compare equal across engines."""
    for k, v in _RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session that has none (tests) gets a fresh scratch folder of
    its own; on a cluster that is an error, as executors would not share it.
    """
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if cur:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(cur)
        return sc.getCheckpointDir() or cur
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="pressroom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut_lineage(df: DataFrame, bucket_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: reliable storage that survives executor loss, lineage cut,
    computed in a single pass (a Dataset checkpoint computes an unpersisted
    plan twice).

    ``bucket_by`` writes the table bucketed on that column (one bucket per
    shuffle partition) and registers it in the session catalog, so later
    joins on the column shuffle only their other side.
    """
    import uuid
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{tag}"
    if bucket_by is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"pressroom_cut_{tag}"
    df.write.mode("overwrite").option("path", path).bucketBy(n, bucket_by).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition a CPU-heavy input if the session says into how many parts
    (``spark.pressroom.spread``).  That is for inputs in fewer files than there are cores,
    such as one small Parquet file; unset, as it should be where inputs have many
    splits, the input passes through.  The plan depends on the setting alone."""
    parts = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(parts), *keys) if parts else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that
    functions run there wherever the driver was started from."""
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pressroom-py-"), "pressroom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
