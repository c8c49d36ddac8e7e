"""Session settings the operators expect."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession

# Settings that change results (time zone) or protect joins against hot keys.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended SQL settings to a session."""
    for name, value in RECOMMENDED_CONF.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("taskloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TASKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for name, value in RECOMMENDED_CONF.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster the
    setting has to be there, since executors would not see a local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="taskloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df):
    """``df`` as a compressed table in the shared checkpoint folder, for wide rows; their order is not kept.

    A checkpoint keeps whole uncompressed rows and is read in full, a table only in the columns in use.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Writes inside leave no shuffle files behind; else these stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def forgotten(df) -> None:
    """End a table that ``stored`` wrote and nothing reads any more: an empty one takes its place."""
    none = df.sparkSession.createDataFrame([], df.schema)
    none.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(df.stored_at)
