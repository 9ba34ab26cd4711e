"""Links that the data suggests, and the order in which a process runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.functions.spread import at_rank, ranked_values
from tracewright.operators.build import Tables, main_key_column, union_all
from tracewright.plans.log import EventLog
from tracewright.plans.mapping import EventRule, Mapping, ObjectRule


@dataclass(frozen=True)
class BusinessObject:
    """A confirmed object: key columns of a table, maybe only for some values of a column."""

    name: str
    table: str
    key: tuple[str, ...]
    filter_column: str | None = None
    filter_values: tuple[str, ...] = ()

    def rows(self, tables: Tables) -> DataFrame:
        df = tables[self.table]
        return df.where(S.clean(self.filter_column).isin(list(self.filter_values))) if self.filter_column else df


def reference_links(tables: Tables, events: Sequence[EventRule], objects: Sequence[BusinessObject],
                    linked: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(event, column, object, share): columns under another name that hold an object's numbers.

    A column counts for an event when it is filled exactly where the event's date
    is (at least 99 % of the rows) and at least 80 % of its values are numbers of
    the object; the first object that fits is taken.
    """
    spark = next(iter(tables.values())).sparkSession
    keys = []
    for i, o in enumerate(objects):
        main = main_key_column(ObjectRule(o.name, o.table, o.key), tables[o.table])
        keys.append(o.rows(tables).select(F.lit(i).alias("i"), F.lit(o.name).alias("object"), F.lit(main).alias("main"), S.present(main).alias("value"))
                    .where("value is not null").distinct())
    wanted, frames = [], []
    for e in events:
        own = {o.key[0] for o in objects if o.table == e.table and o.key}
        df = tables[e.table]
        columns = [c for c in df.columns if c != e.timestamp and c not in own and (e.name, c) not in set(linked)]
        if not columns:
            continue
        together = df.agg(*[F.avg((S.filled(e.timestamp) == S.filled(c)).cast("int")).alias(c) for c in columns]).first()
        wanted += [(e.name, c) for c in columns if together[c] is not None and together[c] >= 0.99]
        for c in [c for n, c in wanted if n == e.name]:
            frames.append(df.select(F.lit(e.name).alias("event"), F.lit(c).alias("column"), S.present(c).alias("value"))
                          .where("value is not null AND value <> 'None'").distinct())
    schema = "event string, column string, object string, share double"
    if not frames or not keys:
        return spark.createDataFrame([], schema)
    values = union_all(frames)
    sizes = values.groupBy("event", "column").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("value").rlike(r"^(-?\d+[.,]\d+|\d{4}-\d{2}-\d{2}.*)$")).alias("odd"))
    hits = values.join(union_all(keys), "value").where(F.col("column") != F.col("main")).groupBy("event", "column", "i", "object").agg(F.count(F.lit(1)).alias("k"))
    good = hits.join(sizes, ["event", "column"]).where("n >= 3 AND NOT odd AND k >= 0.8 * n")
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("event", "column").orderBy("i"))).where("r = 1")      # one row per object
    return first.select("event", "column", "object", (F.col("k") / F.col("n")).alias("share"))


def shared_key_links(tables: Tables, events: Sequence[EventRule], objects: Sequence[BusinessObject],
                     linked: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(event, object, share): events whose table holds all key columns of an object and at least 20 % matching values."""
    frames = []
    for e in events:
        df = tables[e.table]
        for o in objects:
            if o.table == e.table or not set(o.key) <= set(df.columns) or (e.name, o.name) in set(linked):
                continue
            mine = df.select(S.object_key(o.key).alias("v")).where("v is not null").distinct()
            theirs = o.rows(tables).select(S.object_key(o.key).alias("v"))
            total = mine.agg(F.count(F.lit(1)).alias("n"))
            found = mine.join(theirs, "v", "left_semi").agg(F.count(F.lit(1)).alias("k"))
            one = F.lit(1).alias("one")
            frames.append(total.select("n", one).join(found.select("k", one), "one").where("n > 0 AND k >= 0.2 * n").select(
                F.lit(e.name).alias("event"), F.lit(o.name).alias("object"), (F.col("k") / F.col("n")).alias("share")))
    if not frames:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "event string, object string, share double")
    return union_all(frames)


def process_order(log: EventLog, mapping: Mapping) -> DataFrame:
    """(kind, name, position): event groups by their middle time (the upper of two), objects by the first group
    that involves them (the one with more groups first), tables by what they feed first."""
    times = log.events.select("event_group", F.unix_timestamp("ts").alias("t"))
    middle = ranked_values(times, ["event_group"], "t").groupBy("event_group").agg(at_rank("t", F.floor(F.col("n") / 2)).alias("t"))
    # one row per event group
    events = middle.withColumn("position", (F.row_number().over(Window.orderBy("t", "event_group")) - 1).cast("double"))
    groups = log.events.select("event_id", "event_group")
    links = log.e2o.select("event_id", "object_type").join(groups, "event_id").groupBy("object_type", "event_group").agg(F.lit(1).alias("x"))
    base = {t: o.name for o in mapping.objects if o.split_column for t in o.output_types()}
    named = F.coalesce(S.lookup(base, F.col("object_type")), F.col("object_type")) if base else F.col("object_type")
    per = links.select(named.alias("name"), "event_group").distinct().join(events, "event_group").groupBy("name").agg(
        F.min("position").alias("p"), F.count(F.lit(1)).alias("k"))
    n = len(mapping.events)
    objects = per.select("name", (F.col("p") + 0.5 - F.col("k") / F.lit(2 * max(n, 1) + 1)).alias("position"))
    feeds = log.spark.createDataFrame([("event", e.name, e.table) for e in mapping.events] + [("object", o.name, o.table) for o in mapping.objects],
                                      "kind string, name string, table string")
    both = events.select(F.lit("event").alias("kind"), F.col("event_group").alias("name"), "position").unionByName(
        objects.select(F.lit("object").alias("kind"), "name", "position"))
    tables = feeds.join(both, ["kind", "name"]).groupBy("table").agg(F.min("position").alias("position"))
    return both.unionByName(tables.select(F.lit("table").alias("kind"), F.col("table").alias("name"), "position"))
