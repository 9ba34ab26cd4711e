"""Contiguous shards of nearly equal size.

All rows are put in one global order (hash of the text, document id), so equal
texts stand side by side. The order is cut where the running total of bytes
passes equal targets. The running total comes from totals per range partition
and sums within each partition: no task sees more than its range, and only one
number per partition reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, size, text_crc32, shard and slot of every row.

    ``size`` is the number of UTF-8 bytes plus 1. A row belongs to the shard in
    which the middle of its bytes falls, so a shard misses its target by less
    than one text on either side. ``slot`` numbers the rows of a shard from 0.

    A null text counts as an empty one; null ids come first; repeated rows are
    all kept and take neighbouring slots; an empty table gives no rows. A text
    longer than a whole target fills its shard alone, and shards it jumps over
    stay empty. Other columns of ``docs`` are not looked at.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(whole).alias("text_hash"),
                       (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"))
    order = ["text_hash", "doc_id"]
    ranged = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}))
    ranged = settle(ranged, "shard-ranges")

    totals = sorted(ranged.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())
    before, bytes_before, rows_before = [], 0, 0
    for part, size, n in totals:
        before.append((part, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + size, rows_before + n
    offsets = docs.sparkSession.createDataFrame(before, "part int, bytes_before long, rows_before long")

    w = Window.partitionBy("part").orderBy("line")
    run = (ranged.join(F.broadcast(offsets), "part")      # a row per range partition
           .withColumn("through", F.col("bytes_before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("place", F.col("rows_before") + F.row_number().over(w) - 1)
           .withColumn("shard", F.expr(f"cast(((2 * through - size) * {int(shards)}) div {2 * max(bytes_before, 1)} as int)")))
    firsts = run.groupBy("shard").agg(F.min("place").alias("first_place"))
    return (run.join(F.broadcast(firsts), "shard")        # a row per shard
            .select("doc_id", "text_hash", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")))


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; see ``assign_shards``.

    Rows that agree in id and text are numbered, so that each takes one of
    their slots. Columns of ``docs`` named shard or slot are replaced.
    """
    same = Window.partitionBy("__id", "__hash").orderBy(F.lit(1))
    placed = assign_shards(docs, shards, doc_id, text).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    placed = placed.withColumn("__copy", F.row_number().over(same.orderBy("__shard", "__slot")))
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = (docs.select(*[F.col(c) for c in keep], F.col(doc_id).alias("__of"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
            .withColumn("__no", F.row_number().over(Window.partitionBy("__of", "__text").orderBy(F.lit(1)))))
    on = F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")) & (F.col("__no") == F.col("__copy"))
    return rows.join(placed, on).select(*keep, F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder per shard, rows in the order of their slots within each file."""
    placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
