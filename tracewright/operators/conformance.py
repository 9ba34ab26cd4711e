"""A process model against the log.

A model is two small tables: nodes(node_id, kind, name) with kind start, end,
activity or other (gateways, intermediate events), and flows(flow_id, source, target).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.operators import model
from tracewright.operators.build import union_all
from tracewright.plans import skew
from tracewright.plans.log import ORDER, EventLog
from tracewright.session import settle

BEGIN, FINISH = "▶start", "■end"
KINDS = {"startEvent": "start", "endEvent": "end", "task": "activity", "userTask": "activity", "serviceTask": "activity",
         "sendTask": "activity", "receiveTask": "activity", "manualTask": "activity", "businessRuleTask": "activity",
         "scriptTask": "activity", "callActivity": "activity", "subProcess": "activity", "exclusiveGateway": "other",
         "parallelGateway": "other", "inclusiveGateway": "other", "eventBasedGateway": "other", "complexGateway": "other",
         "intermediateCatchEvent": "other", "intermediateThrowEvent": "other", "boundaryEvent": "other"}     # fixed values
XML_MARKS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}      # the ampersand last
NODES, FLOWS = "node_id string, kind string, name string", "flow_id string, source string, target string"


@dataclass
class ProcessModel:
    nodes: DataFrame
    flows: DataFrame


def read_bpmn(spark: SparkSession, path: str) -> ProcessModel:
    """Nodes and sequence flows of BPMN files, at any depth, whatever prefix their tags carry.

    The files are read once, one record per tag, so that large ones are shared
    out between tasks. A '>' inside a value has to be written ``&gt;``, as
    editors do; what is commented out is left out.
    """
    tags = spark.read.option("lineSep", ">").text(path).select(F.regexp_extract("value", r"^[^<]*<(?:[\w.-]+:)?(\w+)\s", 1).alias("tag"), "value")

    def value(name: str):
        found = F.regexp_extract("value", rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 1)
        other = F.regexp_extract("value", rf"""\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')""", 2)
        text = F.concat(found, other)
        for mark, sign in XML_MARKS.items():
            text = F.replace(text, F.lit(mark), F.lit(sign))
        return text

    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    nodes = tags.withColumn("kind", F.try_element_at(kinds, F.col("tag"))).where("kind is not null").select(value("id").alias("node_id"), "kind", F.trim(value("name")).alias("name"))
    flows = tags.where("tag = 'sequenceFlow'").select(value("id").alias("flow_id"), value("sourceRef").alias("source"), value("targetRef").alias("target"))
    return ProcessModel(nodes.where("node_id <> ''"), flows.where("source <> '' AND target <> ''"))


def write_bpmn(m: ProcessModel, path: str) -> None:
    """The model as a BPMN file: one line per node and flow (a model is small: one file)."""
    def value(c: str):
        text = F.coalesce(F.col(c), F.lit(""))
        for mark, sign in reversed(XML_MARKS.items()):
            text = F.replace(text, F.lit(sign), F.lit(mark))
        return F.concat(F.lit('"'), text, F.lit('"'))

    tag = F.when(F.col("kind") == "start", "startEvent").when(F.col("kind") == "end", "endEvent").when(F.col("kind") == "activity", "task").otherwise("exclusiveGateway")
    line = lambda no, *parts: [F.lit(no).alias("no"), F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in parts]).alias("line")]
    nodes = m.nodes.select(*line(1, "<bpmn:", tag, " id=", value("node_id"), " name=", value("name"), "/>"))
    flows = m.flows.select(*line(2, "<bpmn:sequenceFlow id=", value("flow_id"), " sourceRef=", value("source"), " targetRef=", value("target"), "/>"))
    frame = m.nodes.sparkSession.createDataFrame([
        (0, '<?xml version="1.0" encoding="UTF-8"?>\n<bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL">\n<bpmn:process id="Process_1">'),
        (3, "</bpmn:process>\n</bpmn:definitions>")], "no int, line string")
    union_all([frame, nodes, flows]).coalesce(1).sortWithinPartitions("no", "line").select("line").write.text(path)


def variant_model(variants: model.Variants, variant_id: int) -> DataFrame:
    """Steps of a variant as rows (step, activity, repeated): the base of a model."""
    return variants.table.where(F.col("variant_id") == variant_id).select(F.posexplode("steps").alias("pos", "s")).select(
        (F.col("pos") + 1).alias("step"), "s.activity", "s.repeated")


def model_of_steps(steps: DataFrame) -> ProcessModel:
    """Start, one task per step, end, and the flows between them. Steps are few: one row per step of one variant."""
    spark = steps.sparkSession
    task = steps.select(F.concat(F.lit("Activity_"), F.col("step").cast("string")).alias("node_id"), F.lit("activity").alias("kind"),
                        F.col("activity").alias("name"))
    ends = spark.createDataFrame([("StartEvent_1", "start", ""), ("EndEvent_1", "end", "")], NODES)
    n = steps.agg(F.max("step").alias("n"))
    name = lambda c: F.when(c == 0, "StartEvent_1").otherwise(F.concat(F.lit("Activity_"), c.cast("string")))
    i = F.col("i")
    flows = n.select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select(
        F.concat(F.lit("Flow_"), (i + 1).cast("string")).alias("flow_id"), name(i).alias("source"),
        F.when(i == F.col("n"), "EndEvent_1").otherwise(name(i + 1)).alias("target"))
    return ProcessModel(task.unionByName(ends), flows)


# ---- cases -----------------------------------------------------------------
def case_sequence(log: EventLog, lead: str) -> DataFrame:
    """Events of each lead with those of directly linked non-hub objects."""
    return model.related_events(log, lead)


def case_durations(seq: DataFrame) -> DataFrame:
    """(lead_id, events, seconds): none for cases of a single event."""
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return seq.groupBy("lead_id").agg(F.count(F.lit(1)).alias("events"), F.when(F.count("ts") > 1, span).alias("seconds"))


@dataclass
class Observed:
    activities: DataFrame      # activity, cases
    pairs: DataFrame           # source, target, cases (with BEGIN and FINISH)


def observed(seq: DataFrame, chosen: DataFrame | None = None) -> Observed:
    """Cases per activity and per direct step, start and end; consecutive repeats count once."""
    seq = settle(seq if chosen is None else seq.join(chosen, "lead_id", "left_semi"), "observed-events")
    marked = skew.neighbours(seq, "lead_id", ORDER, previous={"before": "activity"}, following={"after": "activity"},
                             hot=skew.hot_keys(seq, "lead_id"))
    activities = marked.select("lead_id", "activity").distinct().groupBy("activity").agg(F.count(F.lit(1)).alias("cases"))
    # a step is a change of activity between neighbours; the first and the last event give start and end
    steps = F.array_compact(F.array(
        F.when(F.col("before").isNull(), F.struct(F.lit(BEGIN).alias("source"), F.col("activity").alias("target"))),
        F.when(F.col("after").isNull(), F.struct(F.col("activity").alias("source"), F.lit(FINISH).alias("target")))
        .when(F.col("after") != F.col("activity"), F.struct(F.col("activity").alias("source"), F.col("after").alias("target")))))
    pairs = (marked.select("lead_id", F.explode(steps).alias("s")).select("lead_id", "s.source", "s.target").distinct()
             .groupBy("source", "target").agg(F.count(F.lit(1)).alias("cases")))
    return Observed(activities, pairs)


# ---- model -----------------------------------------------------------------
def match_tasks(m: ProcessModel, activities: DataFrame, steps: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(node_id, activity): tasks named Activity_<n> are step n of the model's variant, others match by name.

    ``labels`` lists further names (activity, label) of an activity.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    tasks = m.nodes.where("kind = 'activity'")
    number = F.regexp_extract("node_id", r"^Activity_(\d+)$", 1).try_cast("int")
    names = activities.select("activity", norm("activity").alias("norm"), F.lit(0).alias("rank"))
    if labels is not None:
        names = names.unionByName(labels.join(activities.select("activity"), "activity", "left_semi").select("activity", norm("label").alias("norm"), F.lit(1).alias("rank")))
    names = names.groupBy("norm").agg(F.min(F.struct("rank", "activity")).alias("x")).select("norm", F.col("x.activity").alias("by_name"))
    out = tasks.withColumns({"step": number, "norm": norm("name")}).join(names, "norm", "left")
    if steps is not None:
        out = out.join(steps.select("step", F.col("activity").alias("by_step")), "step", "left")
    else:
        out = out.withColumn("by_step", F.lit(None).cast("string"))
    return out.select("node_id", F.coalesce("by_step", "by_name").alias("activity")).where("activity is not null")


def closure(ways: DataFrame) -> DataFrame:
    """All (via, node) that lie on a way of any length, from the single steps. Bounded by the pairs of nodes of a model."""
    known = settle(ways.distinct(), "ways")
    while True:
        further = known.withColumnRenamed("node", "between").join(known.select(F.col("via").alias("between"), "node"), "between").select("via", "node")
        new = settle(further.distinct().join(known, ["via", "node"], "left_anti"), "new-ways")
        if new.isEmpty():
            return known
        known = settle(known.unionByName(new), "ways")


def look_through(m: ProcessModel, tasks: DataFrame) -> DataFrame:
    """(flow_id, source, target): activity pairs each flow allows, looking through gateways and unmatched nodes.

    Ways through such nodes are grown from both ends at once: what is known is
    joined with itself until nothing new is found. Loops and nested splits add
    nothing twice, and a chain of n gateways takes about log2(n) rounds.
    """
    stops = tasks.select("node_id", F.col("activity").alias("label")).unionByName(
        m.nodes.where("kind IN ('start', 'end')").select("node_id", F.when(F.col("kind") == "start", BEGIN).otherwise(FINISH).alias("label")))
    stops = settle(stops, "stops")

    def reach(near: str, far: str) -> DataFrame:
        """(flow_id, label) of the stops met from the ``near`` end of every flow."""
        # from a node that is no stop, over each of its flows
        ways = m.flows.join(stops.select(F.col("node_id").alias(far)), far, "left_anti").select(F.col(far).alias("via"), F.col(near).alias("node"))
        ways = closure(ways)
        met = m.flows.select("flow_id", F.col(near).alias("node")).unionByName(
            m.flows.select("flow_id", F.col(near).alias("via")).join(ways, "via").select("flow_id", "node"))
        return met.join(stops.withColumnRenamed("node_id", "node"), "node").select("flow_id", "label").distinct()

    back, forth = reach("source", "target"), reach("target", "source")
    # what lies behind an end event, or before a start event, is no step of the model
    back = back.where(F.col("label") != FINISH)
    forth = forth.where(F.col("label") != BEGIN)
    return back.withColumnRenamed("label", "source").join(forth.withColumnRenamed("label", "target"), "flow_id")


@dataclass
class Overlay:
    flows: DataFrame           # flow_id, source, target, count, status
    elements: DataFrame        # node_id, kind, activity, count, status
    extra: DataFrame           # activity, count, position
    red_edges: DataFrame       # source, target, count
    cases_total: int
    cases_selected: int


def flow_status(m: ProcessModel, allowed: DataFrame, seen: Observed) -> DataFrame:
    counts = allowed.join(seen.pairs, ["source", "target"], "left").groupBy("flow_id").agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("count"))
    return m.flows.join(counts, "flow_id", "left").select(
        "flow_id", "source", "target", F.coalesce("count", F.lit(0)).alias("count")).withColumn(
        "status", F.when(F.col("count") > 0, "ok").otherwise("miss"))


def element_status(m: ProcessModel, tasks: DataFrame, allowed: DataFrame, flows: DataFrame, seen: Observed) -> DataFrame:
    """Tasks by cases of their activity; start and end by the steps they allow; other nodes by what flows in."""
    task = tasks.join(seen.activities, "activity", "left").select("node_id", "activity", F.coalesce("cases", F.lit(0)).alias("c"))
    ends = []
    for kind, near, word in (("start", "source", BEGIN), ("end", "target", FINISH)):
        at = m.nodes.where(F.col("kind") == kind).select("node_id")
        pairs = m.flows.join(at, F.col(near) == F.col("node_id")).select("node_id", "flow_id").join(
            allowed.where(F.col(near) == word), "flow_id").select("node_id", "source", "target").distinct()
        ends.append(pairs.join(seen.pairs, ["source", "target"]).groupBy("node_id").agg(F.sum("cases").alias("c")))
    through = flows.groupBy(F.col("target").alias("node_id")).agg(F.sum("count").alias("c"))
    other = m.nodes.where("kind = 'other'").select("node_id").join(through, "node_id")
    counts = union_all([task.select("node_id", "c"), *ends, other])
    return (m.nodes.join(counts, "node_id", "left").join(tasks, "node_id", "left")
            .select("node_id", "kind", "activity", F.coalesce("c", F.lit(0)).alias("count"))
            .withColumn("status", F.when(F.col("count") > 0, "ok").otherwise("miss")))


def extra_activities(tasks: DataFrame, seen: Observed, limit: int = fixed.EXTRA_ACTIVITIES) -> DataFrame:
    """Activities of the data that the model does not have, the most frequent first."""
    missing = seen.activities.join(tasks.select("activity").distinct(), "activity", "left_anti")
    ranked = missing.withColumn("position", F.row_number().over(Window.orderBy(F.desc("cases"), "activity")))      # activities
    return ranked.where(F.col("position") <= limit).select("activity", F.col("cases").alias("count"), "position")


def deviating_edges(tasks: DataFrame, allowed: DataFrame, extra: DataFrame, seen: Observed, limit: int = fixed.EXTRA_EDGES) -> DataFrame:
    """Steps of the data that the model does not allow, between nodes that are drawn."""
    drawn = tasks.groupBy("activity").agg(F.min(F.struct(F.length("node_id"), "node_id")).alias("x")).select("activity", F.col("x.node_id").alias("node")).unionByName(
        extra.select("activity", F.concat(F.lit("x:"), "activity").alias("node")))
    steps = seen.pairs.where((F.col("source") != BEGIN) & (F.col("target") != FINISH))
    strange = steps.join(allowed.select("source", "target").distinct(), ["source", "target"], "left_anti")
    a, b = drawn.select(F.col("activity").alias("source"), F.col("node").alias("from_node")), drawn.select(F.col("activity").alias("target"), F.col("node").alias("to_node"))
    return (strange.join(a, "source").join(b, "target").where("from_node <> to_node")
            .orderBy(F.desc("cases"), "source", "target").limit(limit)
            .select(F.col("from_node").alias("source"), F.col("to_node").alias("target"), F.col("cases").alias("count")))


def compare(log: EventLog, lead: str, m: ProcessModel, steps: DataFrame | None = None, labels: DataFrame | None = None,
            variant_ids: Sequence[int] | None = None) -> Overlay:
    seq = settle(case_sequence(log, lead).select("lead_id", "event_id", "activity", "ts", "ord"), "cases")
    total = seq.agg(F.countDistinct("lead_id").alias("n")).first()["n"]
    chosen, selected = None, total
    if variant_ids is not None:
        found = model.variants(seq, flags=True)
        chosen = settle(found.cases.where(F.col("variant_id").isin(list(variant_ids))).select("lead_id"), "chosen-cases")
        selected = chosen.count()
    tasks = settle(match_tasks(m, seq.select("activity").distinct(), steps, labels), "tasks")
    seen = observed(seq, chosen)
    seen = Observed(settle(seen.activities, "observed"), settle(seen.pairs, "observed"))
    allowed = settle(look_through(m, tasks), "allowed")
    flows = flow_status(m, allowed, seen)
    extra = extra_activities(tasks, seen)
    return Overlay(flows, element_status(m, tasks, allowed, flows, seen), extra, deviating_edges(tasks, allowed, extra, seen), total, selected)


# ---- roles -----------------------------------------------------------------
def activity_roles(log: EventLog, activities: Sequence[str]) -> DataFrame:
    """(activity, attribute, role): most frequent value of the most used role attribute that gives 1 to 8 roles
    to at least half of the activities."""
    told = log.events.where(F.col("activity").isin(list(activities))).select("activity", F.explode("attrs").alias("attribute", "value")).where(
        F.col("attribute").rlike(fixed.ROLE_ATTRIBUTE) & (F.col("value") != ""))
    counts = told.groupBy("attribute", "activity", "value").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("attribute", "activity").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("x"), F.sum("n").alias("n")).select(
        "attribute", "activity", F.col("x.value").alias("role"), "n")
    per = mode.groupBy("attribute").agg(F.sum("n").alias("used"), F.count_distinct("role").alias("roles"), F.count(F.lit(1)).alias("covered"))
    good = per.where(F.col("roles").between(1, fixed.MAX_ROLES) & (F.col("covered") >= max(1, len(set(activities)) // 2)))
    best = good.orderBy(F.desc("used"), "attribute").limit(1).select("attribute")
    return mode.join(F.broadcast(best), "attribute", "left_semi").select("activity", "attribute", "role")
