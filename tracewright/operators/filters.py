"""Case filters: seed objects, their surroundings, and the smaller log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions import scalars as S
from tracewright.plans.log import EventLog, ObjectFrames, WideGroup
from tracewright.session import settle

Filter = dict[str, Any]


# ---- seeds -----------------------------------------------------------------
def attribute_seeds(log: EventLog, object_type: str, attribute: str, values: Sequence[str]) -> DataFrame:
    return log.objects_of(object_type).where(
        F.element_at("attrs", attribute).isin([str(v) for v in values])).select("object_id")


def event_attribute_seeds(log: EventLog, attribute: str, values: Sequence[str]) -> DataFrame:
    """Non-hub objects of the events with one of the values."""
    hit = log.events.where(F.element_at("attrs", attribute).isin([str(v) for v in values])).select("event_id")
    return log.non_hub_links.join(hit, "event_id", "left_semi").select("object_id").distinct()


def start_month_seeds(log: EventLog, object_type: str, months: Sequence[str]) -> DataFrame:
    starts = log.links_of(object_type).groupBy("object_id").agg(F.min("ts").alias("start"))
    return starts.where(S.month("start").isin(list(months))).select("object_id")


def case_days(log: EventLog, object_type: str, scope: str = "object") -> DataFrame:
    """(object_id, days) from first to last event; ``related`` adds the events of linked non-hub objects.

    First and last times travel object -> event -> object, so no pairs of
    objects are formed.
    """
    own = log.links_of(object_type).groupBy("object_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    if scope == "related":
        others = [t for t in log.types if t not in log.hubs and t != object_type]
        side = log.links_of(*others) if log.wide else log.non_hub_links
        span = side.groupBy("object_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        if log.wide:
            linked = log.pairs(object_type, others).distinct().join(span, "object_id").select(F.col("left_id").alias("object_id"), "a", "b")
            own = own.unionByName(linked).groupBy("object_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
            return own.select("object_id", ((F.unix_timestamp("b") - F.unix_timestamp("a")) / fixed.DAY).alias("days"))
        at_event = side.select("event_id", "object_id").join(span, "object_id").groupBy("event_id").agg(
            F.min("a").alias("a"), F.max("b").alias("b"))
        linked = log.links_of(object_type).select("event_id", "object_id").join(at_event, "event_id").select(
            "object_id", "a", "b")
        own = own.unionByName(linked).groupBy("object_id").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return own.select("object_id", ((F.unix_timestamp("b") - F.unix_timestamp("a")) / fixed.DAY).alias("days"))


def duration_seeds(log: EventLog, object_type: str, ranges: Sequence[tuple[float, float | None]],
                   scope: str = "object") -> DataFrame:
    inside = F.lit(False)
    for low, high in ranges:
        ok = F.col("days") >= F.lit(low - 1e-9)
        inside = inside | (ok if high is None else ok & (F.col("days") <= F.lit(high + 1e-9)))
    return case_days(log, object_type, scope).where(inside).select("object_id")


def id_seeds(log: EventLog, object_type: str, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Objects of a list of ids; the list may be a table of any size."""
    if not isinstance(ids, DataFrame):
        return log.objects_of(object_type).where(F.col("object_id").isin([str(i) for i in ids])).select("object_id")
    return log.objects_of(object_type).join(ids.select("object_id"), "object_id", "left_semi").select("object_id")


# ---- the smaller log -------------------------------------------------------
def expand(log: EventLog, seeds: DataFrame, same_type: str | None) -> EventLog:
    """The cases around the seeds.

    Core = seeds and the objects that share an event with one (no hubs, no other
    objects of ``same_type``). Events touching the core stay, with their links to
    the core and to hubs; objects still linked stay, and the seeds.
    """
    seeds = seeds.select("object_id").distinct()
    if log.wide and same_type is not None:
        return expand_wide(log, settle(seeds, "seeds"), same_type)
    seed_events = log.e2o.join(seeds, "object_id", "left_semi").select("event_id").distinct()
    around = log.e2o.where(~F.col("object_type").isin(log.hubs)) if log.hubs else log.e2o
    if same_type is not None:
        around = around.where(F.col("object_type") != same_type)
    core = settle(seeds.unionByName(around.join(seed_events, "event_id", "left_semi").select("object_id")).distinct(), "core")
    hub_rows = F.col("object_type").isin(log.hubs) if log.hubs else F.lit(False)
    touched = log.e2o.join(core, "object_id", "left_semi")
    kept_events = settle(touched.select("event_id").distinct(), "kept-events")
    e2o = touched.where(~hub_rows)
    if log.hubs:
        e2o = e2o.unionByName(log.e2o.where(hub_rows).join(kept_events, "event_id", "left_semi"))
    kept_objects = e2o.select("object_id").unionByName(seeds).distinct()
    out = EventLog(log.objects.join(kept_objects, "object_id", "left_semi"),
                   log.events.join(kept_events, "event_id", "left_semi"), e2o, log.skips, hub_types=log.hubs,
                   unique_links=log.unique_links)
    # no group of the smaller log can be bigger than it was
    out.__dict__["hot_objects"], out.__dict__["hot_events"] = log.hot_objects, log.hot_events
    return out


def expand_wide(log: EventLog, seeds: DataFrame, same_type: str) -> EventLog:
    """``expand`` for seeds of one type, on rows that name their objects.

    A row with a seed stays whole: its other non-hub objects share an event with the
    seed. Rows without one can only stay by an object that also meets a seed elsewhere;
    such objects are looked for by their ids alone, and mostly there are none.
    """
    seed = seeds.select(F.col("object_id").alias("__seed"))
    near = lambda g: [x for x in g.links if x.object_type not in log.hubs and x.object_type != same_type]
    parts, kept = [], []
    for g in log.groups:
        own = next((x for x in g.links if x.object_type == same_type), None)
        if own is not None:
            kept.append(g.base.join(seed, F.when(own.there, own.object_id) == F.col("__seed"), "left_semi"))
            marked = g.base.select(F.when(own.there, own.object_id).alias("__own"), *[F.when(x.there, x.object_id).alias(f"o{i}") for i, x in enumerate(near(g))])
            marked = marked.join(seed, F.col("__own") == F.col("__seed"), "left").withColumn("hit", F.col("__seed").isNotNull())
        else:
            kept.append(None)
            marked = g.base.select(F.lit(False).alias("hit"), *[F.when(x.there, x.object_id).alias(f"o{i}") for i, x in enumerate(near(g))])
        parts += [marked.select(F.col(f"o{i}").alias("object_id"), "hit").where(F.col("object_id").isNotNull()) for i in range(len(near(g)))]
    loose = None
    if parts:
        loose = settle(reduce(DataFrame.unionByName, parts).groupBy("object_id").agg(F.max("hit").alias("a"), F.min("hit").alias("b"))
                       .where(F.col("a") & ~F.col("b")).select(F.col("object_id").alias("__loose")), "loose")
        loose = None if loose.isEmpty() else loose
    groups = []
    for g, rows in zip(log.groups, kept, strict=True):
        out = replace(g, base=g.base.limit(0) if rows is None else rows, plain=False).resolved()
        if loose is not None and near(g):
            out = _with_loose(log, g, out, seed, loose, same_type)
        groups.append(out)
    linked = {}
    for g in groups:
        for x in g.links:
            linked.setdefault(x.object_type, []).append(g.base.where(x.there).select(x.object_id.alias("object_id")))
    linked.setdefault(same_type, []).append(seeds)
    ids = {t: reduce(DataFrame.unionByName, frames).distinct() for t, frames in linked.items()}
    if isinstance(log._objects, ObjectFrames):
        objects = ObjectFrames({t: f.join(ids[t], "object_id", "left_semi") for t, f in log._objects.frames.items() if t in ids}, set())
    else:
        objects = lambda: log.objects.join(reduce(DataFrame.unionByName, ids.values()), "object_id", "left_semi")
    return EventLog(objects, skips=log.skips, hub_types=log.hubs, unique_links=True, groups=tuple(groups))


def _with_loose(log: EventLog, g: WideGroup, out: WideGroup, seed: DataFrame, loose: DataFrame, same_type: str) -> WideGroup:
    """The rows of ``out`` and those without a seed that name a loose object; what such a row names besides it goes, but for hubs."""
    names = [f"o{i}" for i in range(len(g.links))]
    rows = g.base.select(*g.event, g.attrs.alias("attrs"), *[F.when(x.there, x.object_id).alias(n) for n, x in zip(names, g.links, strict=True)])
    inside = []
    for n, x in zip(names, g.links, strict=True):
        if x.object_type == same_type:
            rows = rows.join(seed, F.col(n) == F.col("__seed"), "left_anti")
            if x.object_type not in log.hubs:
                rows = rows.withColumn(n, F.lit(None).cast("string"))
        elif x.object_type not in log.hubs:
            rows = rows.join(loose, F.col(n) == F.col("__loose"), "left").withColumn(n, F.col("__loose")).drop("__loose")
            inside.append(F.col(n))
    more = rows.where(F.coalesce(*inside).isNotNull())
    return replace(out, base=settle(out.base.unionByName(more), "events"))


def seeds_of(log: EventLog, f: Filter, full: EventLog | None = None) -> DataFrame:
    kind = f["kind"]
    if kind == "object":
        return attribute_seeds(log, f["type"], f["attribute"], f["values"])
    if kind == "event":
        return event_attribute_seeds(log, f["attribute"], f["values"])
    if kind == "start_month":
        return start_month_seeds(log, f["type"], f["values"])
    if kind == "duration":
        return duration_seeds(log, f["type"], f["ranges"], f.get("scope", "object"))
    if kind == "ids":
        return id_seeds(log, f["type"], f["ids"])
    if kind in ("dimension", "condition"):
        # chart selections are resolved on the whole log, then applied as a table of ids
        from tracewright.operators.kpi.select import selected_objects
        return id_seeds(log, f["type"], selected_objects(full or log, f))
    raise ValueError(f"unknown filter kind: {kind}")


def apply(log: EventLog, filters: Sequence[Filter]) -> EventLog:
    """All filters one after another, each on the log the previous one left."""
    out = log
    for i, f in enumerate(filters):
        same = f.get("type") if f["kind"] != "event" else None
        out = expand(out, seeds_of(out, f, log), same)
        if i + 1 < len(filters) and out.groups is None:
            hot = out.hot_objects, out.hot_events
            out = out.settled()
            out.__dict__["hot_objects"], out.__dict__["hot_events"] = hot
    return out


def without(filters: Sequence[Filter], kind: str, object_type: str, key: str | None = None) -> list[Filter]:
    """The filters without those a chart started itself: that chart shows all its values."""
    return [f for f in filters if not (f["kind"] == kind and f.get("type") == object_type
                                       and (key is None or f.get("key") == key))]


# ---- catalogue -------------------------------------------------------------
def exploded_attributes(objects: DataFrame) -> DataFrame:
    return objects.select("object_id", "object_type", F.explode("attrs").alias("attribute", "value"))


def latest_attributes(history: DataFrame) -> DataFrame:
    """Latest value of every attribute from rows (object_id, name, time, value): the last one wins."""
    last = history.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("object_id", "name").agg(
        F.max_by("value", F.struct("time", "value")).alias("value"))
    return last.groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))


def filterable_attributes(log: EventLog) -> DataFrame:
    """(kind, object_type, attribute, distinct, value, count, rank): attributes with at least two values,
    and their most frequent values; event attributes count on linked events only."""
    objects = exploded_attributes(log.objects).groupBy("object_type", "attribute", "value").agg(
        F.count(F.lit(1)).alias("count")).select(F.lit("object").alias("kind"), "object_type", "attribute", "value", "count")
    linked = log.e2o.select("event_id").distinct()
    events = (log.events.join(linked, "event_id", "left_semi").select(F.explode("attrs").alias("attribute", "value"))
              .groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("count"))
              .select(F.lit("event").alias("kind"), F.lit(None).cast("string").alias("object_type"), "attribute", "value", "count"))
    counts = objects.unionByName(events)
    group = ["kind", "object_type", "attribute"]
    sizes = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("distinct"))
    ranked = top_values(counts, group, fixed.FILTER_VALUES)
    same = (ranked["kind"] == sizes["kind"]) & (ranked["attribute"] == sizes["attribute"]) & ranked["object_type"].eqNullSafe(
        sizes["object_type"])
    return (ranked.join(F.broadcast(sizes), same).where(F.col("distinct") >= 2)   # one row per attribute
            .select(*[ranked[c] for c in group], "distinct", "value", "count", "rank"))


def top_values(counts: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent values per group, in two rounds so that an attribute
    with very many values is first cut down inside ``salt`` parts."""
    part = F.pmod(F.xxhash64("value"), F.lit(64))
    first = Window.partitionBy(*group, "__part").orderBy(F.desc("count"), "value")
    local = (counts.withColumn("__part", part).withColumn("__r", F.row_number().over(first))
             .where(F.col("__r") <= n).drop("__part", "__r"))
    return local.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("count"), "value"))
                            ).where(F.col("rank") <= n)
