"""The process as seen from one lead object type."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions.spread import at_rank, mean, median, ranked_values, spread
from tracewright.operators import filters, model
from tracewright.plans import skew
from tracewright.plans.log import ORDER, EventLog
from tracewright.session import settle


@dataclass(frozen=True)
class Objective:
    """From the first ``start`` to the first later ``end`` of an object, maybe for some attribute values only."""

    object_type: str
    start: str
    end: str
    filter_attribute: str | None = None
    filter_values: tuple[str, ...] = ()


@dataclass
class Cases:
    log: EventLog
    lead: str
    scope: str
    seq: DataFrame                      # own events of the leads
    scope_seq: DataFrame                # events the variants are made of
    times: DataFrame                    # lead_id, first_ts, seconds (throughput)
    objective: Objective | None = None
    _memo: dict = field(default_factory=dict)

    @property
    def variants(self) -> model.Variants:
        if "variants" not in self._memo:
            self._memo["variants"] = model.variants(self.scope_seq, flags=True)
        return self._memo["variants"]


def objective_leads(log: EventLog, objective: Objective) -> DataFrame:
    """Objects the objective is about."""
    objects = log.objects_of(objective.object_type)
    if objective.filter_attribute:
        objects = objects.where(F.element_at("attrs", objective.filter_attribute).isin(list(objective.filter_values)))
    return objects.select(F.col("object_id").alias("lead_id"))


def start_to_end(seq: DataFrame, start: str, end: str) -> DataFrame:
    """(lead_id, start_ts, end_ts, has_end): first start, and first end not before it."""
    begun = seq.where(F.col("activity") == start).groupBy("lead_id").agg(F.min("ts").alias("start_ts"))
    ends = seq.where(F.col("activity") == end).select("lead_id", "ts")
    both = begun.join(ends, "lead_id", "full_outer")
    return both.groupBy("lead_id").agg(
        F.max("start_ts").alias("start_ts"), F.min(F.when(F.col("ts") >= F.col("start_ts"), F.col("ts"))).alias("end_ts"),
        F.max(F.col("ts").isNotNull()).alias("has_end"))


def cases(log: EventLog, lead: str, scope: str = "object", objective: Objective | None = None) -> Cases:
    """scope: object (own events), related (plus directly linked non-hub objects) or objective (start to end)."""
    own = model.own_sequence(log, lead)
    objective = objective if objective and objective.object_type == lead else None
    if objective and objective.filter_attribute:
        own = own.join(objective_leads(log, objective), "lead_id", "left_semi")
    if scope == "objective" and objective is None:
        scope = "object"
    first = own.groupBy("lead_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    span = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    scope_seq = own
    if scope == "related":
        scope_seq = model.related_events(log, lead)
        if objective and objective.filter_attribute:
            scope_seq = scope_seq.join(objective_leads(log, objective), "lead_id", "left_semi")
        days = filters.case_days(log, lead, "related").select(
            F.col("object_id").alias("lead_id"), F.round(F.col("days") * fixed.DAY).cast("long").alias("seconds"))
        times = first.join(days, "lead_id", "left").select("lead_id", "first_ts", "seconds")
    elif scope == "objective":
        pair = start_to_end(own, objective.start, objective.end)
        times = first.join(pair, "lead_id", "left").select(
            "lead_id", "first_ts", (F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")).alias("seconds"))
    else:
        times = first.select("lead_id", "first_ts", span.alias("seconds"))
    return Cases(log, lead, scope, own, scope_seq, times, objective)


# ---- all types -------------------------------------------------------------
def lifetimes(log: EventLog) -> DataFrame:
    """Median lifetime (seconds) per object type."""
    life = log.links.groupBy("object_type", "object_id").agg(
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return ranked_values(life, ["object_type"], "seconds").groupBy("object_type").agg(median("seconds").alias("median_lifetime"))


def relations(c: Cases) -> DataFrame:
    """Other types linked to the leads by an event: objects per lead (over all leads) and share of leads with any."""
    n = c.times.agg(F.count(F.lit(1)).alias("n")).first()["n"] or 1
    if c.log.wide and not (c.objective and c.objective.filter_attribute):
        pairs = c.log.pairs(c.lead, [t for t in c.log.types if t != c.lead]).withColumnRenamed("left_id", "lead_id").distinct()
    else:
        side = c.log.links.where(F.col("object_type") != c.lead).select("event_id", "object_id", "object_type")
        pairs = skew.incidence_join(c.seq.select("lead_id", "event_id"), side, "event_id", c.log.hot_events).select(
            "object_type", "lead_id", "object_id").distinct()
    per_lead = pairs.groupBy("object_type", "lead_id").agg(F.count(F.lit(1)).alias("k"))
    return per_lead.groupBy("object_type").agg((F.sum("k") / n).alias("average"), (F.count(F.lit(1)) / n).alias("share"))


def leads_that_gain(c: Cases) -> DataFrame:
    """How many leads get more events through their linked objects."""
    own = c.seq.groupBy("lead_id").agg(F.count(F.lit(1)).alias("own"))
    more = c.scope_seq.groupBy("lead_id").agg(F.count(F.lit(1)).alias("all"))
    return own.join(more, "lead_id").agg(F.count_if(F.col("all") > F.col("own")).alias("gaining"), F.count(F.lit(1)).alias("leads"))


def throughput(c: Cases) -> DataFrame:
    """One row: n, median, mean, min, max, p90 of the throughput (seconds)."""
    return spread(c.times, [], "seconds")


# ---- months ----------------------------------------------------------------
def month_spine(first_and_last: DataFrame) -> DataFrame:
    """All months between two times of a one-row table (a, b)."""
    return first_and_last.where(F.col("a").isNotNull()).select(F.explode(F.sequence(
        F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(
        F.date_format("m", "yyyy-MM").alias("month"))


def months(times: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Starts per month without gaps; ``chosen`` leads are counted on the months of all."""
    spine = month_spine(times.agg(F.min("first_ts").alias("a"), F.max("first_ts").alias("b")))
    counted = times if chosen is None else times.join(chosen, "lead_id", "left_semi")
    counts = counted.groupBy(F.date_format("first_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("count"))


# ---- variants --------------------------------------------------------------
def chosen_leads(c: Cases, variant_ids: Sequence[int] | None) -> DataFrame | None:
    if variant_ids is None:
        return None
    return c.variants.cases.where(F.col("variant_id").isin(list(variant_ids))).select("lead_id")


def variant_table(c: Cases) -> DataFrame:
    """Variants with repeat flags, share, running share, median and mean throughput."""
    timed = c.variants.cases.select("lead_id", "variant_id").join(c.times.select("lead_id", "seconds"), "lead_id")
    stats = ranked_values(timed, ["variant_id"], "seconds").groupBy("variant_id").agg(
        median("seconds").alias("median"), mean("seconds").alias("mean"))
    return c.variants.table.join(stats, "variant_id", "left")


def activity_volumes(c: Cases) -> DataFrame:
    """Leads and events per activity, over the events the variants are made of."""
    per_lead = c.scope_seq.groupBy("activity", "lead_id").agg(F.count(F.lit(1)).alias("k"))
    return per_lead.groupBy("activity").agg(F.count(F.lit(1)).alias("objects"), F.sum("k").alias("events"))


def happy_path(c: Cases) -> DataFrame:
    return c.variants.table.where(F.col("variant_id") == 1)


def other_activities(c: Cases, limit: int = 12) -> DataFrame:
    """Frequent activities that are not on the happy path."""
    on_path = happy_path(c).select(F.explode("steps").alias("s")).select("s.activity").distinct()
    n = c.variants.total or 1
    return (activity_volumes(c).join(F.broadcast(on_path), "activity", "left_anti")      # steps of one variant
            .withColumn("share", F.col("objects") / n).orderBy(F.desc("objects"), "activity").limit(limit))


# ---- histogram -------------------------------------------------------------
def histogram(c: Cases, chosen: DataFrame | None = None) -> DataFrame:
    """(bin, from_days, to_days, count, overflow): 12 bins up to the value at rank int(0.95 (n-1)), then one for the rest."""
    ranked = ranked_values(c.times, [], "seconds")
    row = ranked.agg(at_rank("seconds", F.floor(F.lit(0.95) * (F.col("n") - 1))).alias("top"),
                     F.max("seconds").alias("last")).first()
    spark, bins = c.log.spark, fixed.HISTOGRAM_BINS
    schema = "bin int, from_days double, to_days double, count long, overflow boolean"
    if row["last"] is None:
        return spark.createDataFrame([], schema)
    top, last = row["top"] / fixed.DAY, row["last"] / fixed.DAY
    counted = (c.times if chosen is None else c.times.join(chosen, "lead_id", "left_semi")).where(F.col("seconds").isNotNull())
    if top <= 0:
        edges = [(0, 0.0, 0.0, False)]
        slot = F.lit(0)
    else:
        width = top / bins
        edges = [(i, i * width, (i + 1) * width, False) for i in range(bins)] + [(bins, top, last, True)]
        days = F.col("seconds") / F.lit(fixed.DAY)
        slot = F.when(days > F.lit(top), bins).otherwise(F.least(F.lit(bins - 1), F.floor(days / F.lit(width)).cast("int")))
    counts = counted.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = spark.createDataFrame(edges, "bin int, from_days double, to_days double, overflow boolean")
    return frame.join(counts, "bin", "left").select(
        "bin", "from_days", "to_days", F.coalesce("count", F.lit(0)).alias("count"), "overflow").where(
        ~F.col("overflow") | (F.col("count") > 0))


# ---- activities ------------------------------------------------------------
def activity_times(c: Cases, chosen: DataFrame | None = None) -> DataFrame:
    """Per activity: leads, events, share, wait since the previous step and time since the start (seconds)."""
    seq = settle(c.scope_seq if chosen is None else c.scope_seq.join(chosen, "lead_id", "left_semi"), "activity-events")
    n = seq.agg(F.countDistinct("lead_id").alias("n")).first()["n"] or 1
    first = seq.groupBy("lead_id").agg(F.min("ts").alias("t0"))
    pairs = skew.neighbours(seq, "lead_id", ORDER, previous={"p_ts": "ts"}, hot=skew.hot_keys(seq, "lead_id"))
    timed = pairs.join(first, "lead_id").select(
        "activity", "lead_id", (F.unix_timestamp("ts") - F.unix_timestamp("p_ts")).alias("wait"),
        (F.unix_timestamp("ts") - F.unix_timestamp("t0")).alias("from_start"))
    volume = timed.groupBy("activity", "lead_id").agg(F.count(F.lit(1)).alias("k")).groupBy("activity").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("k").alias("events"))
    wait = ranked_values(timed, ["activity"], "wait").groupBy("activity").agg(
        median("wait").alias("wait_median"), mean("wait").alias("wait_mean"))
    start = ranked_values(timed, ["activity"], "from_start").groupBy("activity").agg(median("from_start").alias("start_median"))
    return (volume.join(wait, "activity", "left").join(start, "activity", "left")
            .withColumn("share", F.col("objects") / n)
            .withColumn("position", F.row_number().over(Window.orderBy(F.col("start_median").asc_nulls_last(), F.desc("objects"), "activity"))))


def open_cases(c: Cases) -> DataFrame:
    """Leads with a start but no later end: number, median and greatest age (seconds) at the last event of the log."""
    pair = start_to_end(c.seq, c.objective.start, c.objective.end).where(F.col("start_ts").isNotNull() & F.col("end_ts").isNull())
    end = c.log.last_time.first()["last_ts"]
    aged = pair.select((F.unix_timestamp(F.lit(end)) - F.unix_timestamp("start_ts")).alias("age"))
    return ranked_values(aged, [], "age").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("open"), median("age").alias("median_age"), F.max("age").alias("max_age"))


def volumes(c: Cases) -> DataFrame:
    """Leads, distinct events and events per lead."""
    per_event = c.seq.groupBy("event_id").agg(F.count(F.lit(1)).alias("k"))
    events = per_event.agg(F.count(F.lit(1)).alias("events"), F.sum("k").alias("links"))
    n = c.times.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return events.select(F.lit(n).cast("long").alias("objects"), "events", (F.col("links") / F.lit(n or 1)).alias("events_per_object"))
