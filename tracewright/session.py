"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def get_session(app: str = "tracewright", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on (event times are UTC)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names, else one of our own.

    Our own folder is only made where nothing is configured and everything runs
    in one process (local tests).
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    own = os.environ.get("TRACEWRIGHT_SCRATCH") or tempfile.mkdtemp(prefix="tracewright-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table once in the shared folder and read it back.

    Cuts the lineage like a checkpoint does, but stays columnar: later readers
    prune columns and see real sizes. Survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again. Only folders that ``settle`` has made are touched."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if re.search(r"-[0-9a-f]{32}$", folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
