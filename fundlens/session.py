"""Session settings, durable checkpoints and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes: it coalesces small shuffle
# partitions, splits skewed ones and broadcasts only sides it has seen to be small.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_folders: dict[tuple[str, str], str] = {}


def build_session(app: str = "fundlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    ``spark.checkpoint.dir`` names it. Where it is unset a temporary folder is made, which is
    only right on one machine, so a cluster without the setting is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = os.environ.get("FUNDLENS_LOCAL_SCRATCH")
        if root is None:
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            os.environ["FUNDLENS_LOCAL_SCRATCH"] = root
    return root


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives lost executors."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a scratch table, in a folder that is deleted when the driver's JVM ends."""
    root = checkpoint_root(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    folder = _folders.get((root, app))
    if folder is None:
        folder = _folders[root, app] = f"{root}/fundlens-{uuid.uuid4().hex[:12]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what exists can be marked
        files.deleteOnExit(path)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a scratch parquet table and read it back.

    Used where one result feeds several branches: the table is computed once, is columnar (so
    each branch prunes columns and pushes filters) and does not depend on executor memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
