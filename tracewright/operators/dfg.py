"""Object-centric directly-follows graph."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions.spread import spread
from tracewright.operators import model
from tracewright.plans import skew
from tracewright.plans.log import ORDER, EventLog
from tracewright.session import settle


def activity_ranking(links: DataFrame) -> DataFrame:
    """Activities by number of distinct events (an event of several types counts once)."""
    counts = links.groupBy("activity").agg(F.countDistinct("event_id").alias("events"))
    # one row per activity: bounded by the mapping
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("events"), "activity")))


def visible_activities(links: DataFrame, activities: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    ranking = activity_ranking(links)
    if activities is not None:
        return ranking.withColumn("selected", F.col("activity").isin(list(activities)))
    if top is None:
        return ranking.withColumn("selected", F.lit(True))
    return ranking.withColumn("selected", F.col("rank") <= max(1, int(top)))


def graph_links(log: EventLog, types: Sequence[str], hub_mode: str = "own") -> DataFrame:
    """Links whose order makes the lines of the graph; of hub types only their own events, if so asked."""
    links = log.links_of(*types)
    hubs = [t for t in types if t in log.hubs]
    if hub_mode != "own" or not hubs:
        return links
    own = model.own_events(log).where(F.col("object_type").isin(hubs))
    plain = links.where(~F.col("object_type").isin(hubs))
    return plain.unionByName(links.where(F.col("object_type").isin(hubs))
                             .join(own, ["object_type", "event_id"], "left_semi"))


def passages(log: EventLog, links: DataFrame) -> DataFrame:
    """(object_type, object_id, source, target, seconds): every step of every object, with its start and its end."""
    pairs = skew.neighbours(links, "object_id", ORDER, previous={"p_activity": "activity"},
                            following={"n_activity": "activity", "n_ts": "ts"}, hot=log.hot_objects)
    step = F.struct(F.col("activity").alias("source"),
                    F.coalesce(F.col("n_activity"), F.concat(F.lit(f"{fixed.END}|"), F.col("object_type"))).alias("target"),
                    (F.unix_timestamp("n_ts") - F.unix_timestamp("ts")).alias("seconds"))
    start = F.struct(F.concat(F.lit(f"{fixed.START}|"), F.col("object_type")).alias("source"),
                     F.col("activity").alias("target"), F.lit(None).cast("long").alias("seconds"))
    both = F.when(F.col("p_activity").isNull(), F.array(start, step)).otherwise(F.array(step))
    return pairs.select("object_type", "object_id", F.explode(both).alias("e")).select(
        "object_type", "object_id", "e.*")


def edges(steps: DataFrame) -> DataFrame:
    """Edges with passages, objects and duration statistics (seconds)."""
    key = ["object_type", "source", "target"]
    # counts and times both read the steps: the ordered pass over all events runs once
    steps = settle(steps, "passages")
    # passages per object first: combined before the shuffle, and distinct objects come for free
    per_object = steps.groupBy(*key, "object_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_object.groupBy(*key).agg(F.sum("n").alias("passages"), F.count(F.lit(1)).alias("objects"))
    times = spread(steps, key, "seconds").select(
        *key, F.col("median"), F.col("mean"), F.col("min"), F.col("max"))
    return counts.join(times, key, "left")


def keep_paths(edge: DataFrame, percent: int = 100) -> DataFrame:
    """``kept``: the most frequent ``percent`` of the edges, plus the best way in and out of every activity."""
    p = max(0, min(int(percent), 100))
    # edges are bounded by (types x activities^2)
    order = [F.desc("passages"), "object_type", "source", "target"]
    everything = Window.orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    best_out = F.row_number().over(Window.partitionBy("object_type", "source").orderBy(*order)) == 1
    best_in = F.row_number().over(Window.partitionBy("object_type", "target").orderBy(*order)) == 1
    return (edge.withColumn("rank", F.row_number().over(everything))
            .withColumn("kept", (F.col("rank") <= F.ceil(n * p / 100)) | best_out | best_in))


@dataclass
class Graph:
    nodes: DataFrame       # node, kind, object_type, count, events, objects
    edges: DataFrame
    activities: DataFrame  # activity, events, rank, selected


def variant_restriction(log: EventLog, types: Sequence[str], variant_type: str, variant_ids: Sequence[int]
                        ) -> tuple[list[str], DataFrame]:
    """Types and links of the chosen variants: their lead objects and the objects of those cases."""
    others = [t for t in types if t != variant_type and t not in log.hubs]
    found = model.type_variants(log, variant_type, others)
    leads = found.cases.where(F.col("variant_id").isin(list(variant_ids))).select("lead_id")
    members = model.case_members(log, variant_type, others).join(leads, "lead_id", "left_semi")
    chosen = [variant_type, *others]
    return chosen, log.links_of(*chosen).join(members.select("object_id").distinct(), "object_id", "left_semi")


def build_graph(log: EventLog, types: Sequence[str], activities: Sequence[str] | None = None, top: int | None = None,
                paths: int = 100, hub_mode: str = "own", variant_type: str | None = None,
                variant_ids: Sequence[int] = ()) -> Graph:
    types = [t for t in types if t in log.types]
    if variant_type in log.types:
        types, links = variant_restriction(log, types, variant_type, variant_ids)
        lines, activities, top = links, None, None
    else:
        links = log.links_of(*types)
        lines = graph_links(log, types, hub_mode)
    shown = visible_activities(links, activities, top)
    if activities is not None or top is not None:
        names = shown.where("selected").select("activity")
        lines = lines.join(F.broadcast(names), "activity", "left_semi")   # one row per activity
    edge = keep_paths(edges(passages(log, lines)), paths)
    return Graph(nodes(links, shown, edge), edge, shown)


def nodes(links: DataFrame, shown: DataFrame, edge: DataFrame) -> DataFrame:
    """Activities per type with events and objects, and the start / end node of every type."""
    used = edge.select(F.explode(F.array("source", "target")).alias("activity")).distinct()
    per_type = links.groupBy("object_type", "activity").agg(
        F.countDistinct("event_id").alias("type_events"), F.countDistinct("object_id").alias("type_objects"))
    activity = (shown.where("selected").join(used, "activity", "left_semi").join(per_type, "activity")
                .select(F.col("activity").alias("node"), F.lit("activity").alias("kind"), "object_type",
                        F.col("events").alias("count"), "type_events", "type_objects"))
    ends = []
    for kind, side, prefix in (("start", "source", fixed.START), ("end", "target", fixed.END)):
        ends.append(edge.where(F.col(side).startswith(f"{prefix}|")).groupBy(F.col(side).alias("node"), "object_type")
                    .agg(F.sum("passages").alias("count"))
                    .select("node", F.lit(kind).alias("kind"), "object_type", "count",
                            F.lit(None).cast("long").alias("type_events"), F.lit(None).cast("long").alias("type_objects")))
    return activity.unionByName(ends[0]).unionByName(ends[1])
