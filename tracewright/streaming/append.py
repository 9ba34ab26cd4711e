"""Incremental refresh of a stored log: new source rows arrive, unseen events are appended.

The stored log is append-only: every batch writes its own ``batch=<n>`` folders,
and writes them again the same way when it is repeated after a failure. Objects
keep one row per batch; the latest one counts when the log is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators.build import Tables, build, event_content
from tracewright.plans.log import EventLog
from tracewright.plans.mapping import Mapping
from tracewright.session import settle

PARTS = ("objects", "events", "e2o", "seen")


def _stored(spark: SparkSession, path: str, part: str, before: int) -> DataFrame | None:
    """Rows written by earlier batches; None for the first one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.parquet(f"{path}/{part}").where(F.col("batch") < before)


def append_batch(mapping: Mapping, tables: Tables, path: str, batch: int) -> None:
    """Build the log of a batch and append what is new."""
    log = build(mapping, tables)
    spark = log.spark
    content = event_content(log)
    seen = _stored(spark, path, "seen", batch)
    if seen is not None:
        content = content.join(seen.select("content"), "content", "left_anti")
    fresh = settle(content.groupBy("content").agg(F.min(F.struct("ord", "event_id")).alias("x")).select(
        "content", F.col("x.event_id").alias("event_id")), "fresh-events")
    new_id = F.concat(F.lit("m|"), F.col("content"))
    named = lambda df: df.join(fresh, "event_id").withColumn("ord", F.coalesce("ord", "event_id")).withColumn("event_id", new_id).drop("content")
    writes = {"objects": log.objects,
              "events": named(log.events),
              "e2o": named(log.e2o),
              "seen": fresh.select("content")}
    for part, df in writes.items():
        df.write.mode("overwrite").parquet(f"{path}/{part}/batch={batch}")


def load(spark: SparkSession, path: str) -> EventLog:
    """The log as of the last batch."""
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    objects = read("objects").groupBy("object_id", "object_type", "key").agg(F.max_by("attrs", "batch").alias("attrs"))
    return EventLog(objects, read("events").drop("batch"), read("e2o").drop("batch"))


def refresh(rows: DataFrame, table: str, mapping: Mapping, others: Tables, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a stored log up to date from a stream of rows of one source table; takes what is there, then stops."""
    def one(batch_rows: DataFrame, batch: int) -> None:
        append_batch(mapping, {**others, table: batch_rows}, path, batch)

    return (rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
