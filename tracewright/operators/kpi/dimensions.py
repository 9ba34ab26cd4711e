"""Dimensions a KPI can be broken down by: (object_id, label), '' where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import model
from tracewright.operators.kpi.compile import Definition
from tracewright.plans import skew
from tracewright.plans.log import EventLog


def dimension_values(log: EventLog, object_type: str, d: Definition) -> DataFrame:
    build = {"attribute": _attribute, "related": _related, "event_attribute": _event_attribute,
             "activity": _activity}[d["source"]]
    return build(log, object_type, d)


def _with_empty(log: EventLog, object_type: str, found: DataFrame) -> DataFrame:
    ids = log.objects_of(object_type).select("object_id")
    return ids.join(found, "object_id", "left").select("object_id", F.coalesce("label", F.lit("")).alias("label"))


def _attribute(log, object_type, d):
    return log.objects_of(object_type).select(
        "object_id", F.coalesce(F.trim(F.element_at("attrs", d["attribute"])), F.lit("")).alias("label"))


def related_objects(log: EventLog, object_type: str, other: str) -> DataFrame:
    """(object_id, other_id): linked by an event; without any, linked within the case (never for hubs)."""
    if log.wide and other != object_type:
        # objects of one type are only met by events, so the case adds none
        return log.pairs(object_type, [other]).select(F.col("left_id").alias("object_id"), F.col("object_id").alias("other_id")).distinct()
    own = log.links_of(object_type).select("event_id", "object_id")
    side = log.links_of(other).select("event_id", F.col("object_id").alias("other_id"))
    direct = skew.incidence_join(own, side, "event_id", log.hot_events).select("object_id", "other_id").distinct()
    if other in log.hubs or other == object_type:
        return direct
    far = (model.case_members(log, object_type, [other]).where(F.col("lead_id") != F.col("object_id"))
           .select(F.col("lead_id").alias("object_id"), F.col("object_id").alias("other_id")))
    return direct.unionByName(far.join(direct.select("object_id").distinct(), "object_id", "left_anti"))


def _related(log, object_type, d):
    pairs = related_objects(log, object_type, d["object_type"])
    name = F.element_at("attrs", d["attribute"]) if d.get("attribute") else F.lit(None).cast("string")
    # text after the first ':' of the id, when the attribute is empty
    suffix = F.regexp_replace("other_id", r"^[^:]*:", "")
    others = log.objects_of(d["object_type"]).select(F.col("object_id").alias("other_id"), name.alias("name"))
    found = pairs.join(others, "other_id").select("object_id", F.coalesce(F.nullif(F.trim("name"), F.lit("")), suffix).alias("label")).distinct()
    return _with_empty(log, object_type, found)


def _events(log, object_type, d):
    if d.get("related"):
        return model.case_events(log, object_type)
    return model.own_sequence(log, object_type)


def _event_attribute(log, object_type, d):
    values = F.array_compact(F.array(*[F.nullif(F.element_at("attrs", a), F.lit("")) for a in d.get("attributes") or []]))
    told = log.events.select("event_id", F.explode(values).alias("label"))
    events = _events(log, object_type, d)
    if d.get("activities"):
        events = events.where(F.col("activity").isin(list(d["activities"])))
    found = events.select(F.col("lead_id").alias("object_id"), "event_id").join(told, "event_id").select("object_id", "label").distinct()
    return _with_empty(log, object_type, found)


def _activity(log, object_type, d):
    events = _events(log, object_type, d).where(F.col("activity").isin(list(d.get("activities") or [])))
    found = events.select(F.col("lead_id").alias("object_id"), F.col("activity").alias("label")).distinct()
    return _with_empty(log, object_type, found)


def grouped(log: EventLog, kpi: Definition, rows: DataFrame, d: Definition) -> DataFrame:
    """KPI rows with a label each; objects without any event value are no group."""
    out = rows.join(dimension_values(log, kpi["object_type"], d), "object_id")
    return out.where(F.col("label") != "") if d["source"] in ("event_attribute", "activity") else out
