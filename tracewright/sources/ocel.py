"""Object-centric event logs in JSON, and as flat tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.plans import skew
from tracewright.plans.log import EventLog

LINKS_PER_LINE = 10_000
_ATTRIBUTES = "array<struct<name:string,time:string,value:string>>"
OBJECT_SCHEMA = f"id string, type string, attributes {_ATTRIBUTES}"
EVENT_SCHEMA = (f"id string, type string, time string, attributes {_ATTRIBUTES}, "
                "relationships array<struct<objectId:string,qualifier:string>>")
DOCUMENT_SCHEMA = (f"objects array<struct<id:string,type:string,attributes:{_ATTRIBUTES}>>, "
                   f"events array<struct<id:string,type:string,time:string,attributes:{_ATTRIBUTES},"
                   "relationships:array<struct<objectId:string,qualifier:string>>>>")


def _pairs(attrs, time: str | None):
    entry = lambda e: F.struct(e["key"].alias("name"), F.lit(time).alias("time"), e["value"].alias("value"))
    return F.transform(F.array_sort(F.map_entries(attrs)), entry)


def _records(log: EventLog) -> tuple[DataFrame, DataFrame]:
    """Object and event records (see the schemas).

    An event with very many links is continued in further records under the same
    id, so that no single record has to hold them all.
    """
    objects = log.objects.select(F.col("object_id").alias("id"), F.col("object_type").alias("type"),
                       _pairs("attrs", "1970-01-01T00:00:00Z").alias("attributes"))
    sizes = log.e2o.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LINKS_PER_LINE)
    placed = log.e2o.join(sizes, "event_id", "left").withColumn("part", F.pmod(
        F.xxhash64("object_id", "qualifier"), F.coalesce(F.ceil(F.col("n") / LINKS_PER_LINE), F.lit(1))))
    links = placed.groupBy("event_id", "part").agg(F.array_sort(F.collect_list(F.struct(
        F.col("object_id").alias("objectId"), "qualifier"))).alias("relationships"))
    none = F.array().cast("array<struct<objectId:string,qualifier:string>>")
    events = log.events.join(links, "event_id", "left").select(
        F.col("event_id").alias("id"), F.col("activity").alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), _pairs("attrs", None).alias("attributes"),
        F.coalesce("relationships", none).alias("relationships"))
    return objects, events


def write_json(log: EventLog, path: str) -> None:
    """JSON lines: ``objects`` and ``events`` with nested links."""
    objects, events = _records(log)
    objects.write.mode("errorifexists").json(f"{path}/objects")
    events.write.mode("errorifexists").json(f"{path}/events")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one document from records sorted by kind (0: object, 1: event), a batch at a time."""
    line = lambda texts: pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])
    events, first = False, True
    yield line(['{"objects": ['])
    for batch in batches:
        out = []
        for kind, record in zip(batch.column("kind").to_pylist(), batch.column("record").to_pylist(), strict=True):
            if kind and not events:
                out.append('], "events": [')
                events, first = True, True
            out.append(record if first else "," + record)
            first = False
        yield line(out)
    yield line(["]}" if events else '], "events": []}'])


def write_document(log: EventLog, path: str) -> None:
    """Documents with ``objects`` and ``events``, one a partition; together they hold the log, and each can be read by itself.

    Records pass one batch at a time, so no task holds its document.
    """
    kinds = [r.select(F.lit(i).alias("kind"), F.to_json(F.struct(*r.columns)).alias("record")) for i, r in enumerate(_records(log))]
    lines = kinds[0].unionByName(kinds[1]).repartition("record").sortWithinPartitions("kind", "record").mapInArrow(_documents, "value string")
    lines.write.mode("errorifexists").text(path)


def _map(attributes):
    """Attributes as a map; the last value of a name wins, empty values are none."""
    kept = F.filter(attributes, lambda a: a["name"].isNotNull() & a["value"].isNotNull() & (a["value"] != ""))
    names = F.array_distinct(F.transform(kept, lambda a: a["name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(kept, lambda a: a["name"] == n), -1)["value"])
    return F.coalesce(F.map_from_arrays(names, last), F.create_map().cast("map<string,string>"))


def _time(text):
    plain = F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " ")
    return F.date_trunc("second", plain.try_cast("timestamp"))


def to_log(objects: DataFrame, events: DataFrame, hub_types: list[str] | None = None) -> EventLog:
    """Log from object and event records (see the schemas); ``ord`` of an event breaks ties of time."""
    obj = objects.select(F.col("id").alias("object_id"), F.col("type").alias("object_type"),
                         F.regexp_replace("id", r"^[^:]*:", "").alias("key"), _map(F.col("attributes")).alias("attrs"))
    if "ord" not in events.columns:
        events = events.withColumn("ord", F.col("id"))
    timed = events.withColumn("ts", _time(F.col("time")))
    ev = timed.groupBy("id").agg(F.first("type").alias("activity"), F.first("ts").alias("ts"), F.min("ord").alias("ord"),
                                 F.first(_map(F.col("attributes"))).alias("attrs"))
    ev = ev.select(F.col("id").alias("event_id"), "activity", "ts", F.col("activity").alias("event_group"), "ord", "attrs")
    links = timed.select(F.col("id").alias("event_id"), F.col("type").alias("activity"), "ts", "ord",
                         F.explode("relationships").alias("r"))
    types = obj.select("object_id", "object_type")
    e2o = links.select("event_id", F.col("r.objectId").alias("object_id"), F.coalesce("r.qualifier", F.lit("")).alias("qualifier"),
                       "activity", "ts", "ord").join(types, "object_id")
    e2o = e2o.select("event_id", "object_id", "object_type", "qualifier", "activity", "ts", "ord")
    return EventLog(obj, ev, e2o, hub_types=hub_types)


def read_json_lines(spark: SparkSession, path: str) -> EventLog:
    return to_log(spark.read.schema(OBJECT_SCHEMA).json(f"{path}/objects"), spark.read.schema(EVENT_SCHEMA).json(f"{path}/events"))


def read_document(spark: SparkSession, path: str) -> EventLog:
    """JSON documents with ``objects`` and ``events`` (as exported by other tools). The order of the events of a document breaks ties."""
    doc = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    objects = doc.select(F.explode("objects").alias("o")).select("o.*")
    events = doc.select(F.posexplode("events").alias("pos", "e")).select(
        "e.*", F.lpad(F.col("pos").cast("string"), 12, "0").alias("ord"))
    return to_log(objects, events)


def flat_objects(log: EventLog, object_type: str) -> DataFrame:
    """One row per object: attributes, events, first, last, duration_days and its activities as text (400 characters)."""
    links = log.links_of(object_type)
    span = links.groupBy("object_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    # a step takes at least four characters, so the first 101 steps fill the text
    seq = skew.neighbours(links.withColumn("one", F.lit(1)), "object_id", ["ts", "activity", "ord"], running={"seq": "one"},
                          hot=log.hot_objects)
    text = seq.where(F.col("seq") <= 101).groupBy("object_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "activity"))).alias("s")).select(
        "object_id", F.substring(F.array_join(F.transform("s", lambda x: x["activity"]), " > "), 1, 400).alias("activities"))
    days = (F.unix_timestamp("last") - F.unix_timestamp("first")) / fixed.DAY
    return (log.objects_of(object_type).join(span, "object_id", "left").join(text, "object_id", "left")
            .select("object_id", "attrs", F.coalesce("events", F.lit(0)).alias("events"), "first", "last",
                    F.round(days, 1).alias("duration_days"), F.coalesce("activities", F.lit("")).alias("activities")))


def flat_events(log: EventLog) -> DataFrame:
    """One row per event with its attributes and up to 20 of its objects."""
    from tracewright.operators.filters import top_values
    some = log.links.select("event_id", F.col("object_id").alias("value"), F.lit(1).alias("count"))
    names = top_values(some, ["event_id"], 20).groupBy("event_id").agg(
        F.array_join(F.array_sort(F.collect_list("value")), " ").alias("objects"))
    return log.events.join(names, "event_id", "left").select(
        "event_id", "activity", "ts", "attrs", F.coalesce("objects", F.lit("")).alias("objects"))
