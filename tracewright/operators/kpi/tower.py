"""All KPIs of a dashboard for a period, and the catalogue of what definitions can use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import scalars as S
from tracewright.operators import model
from tracewright.operators.build import union_all
from tracewright.operators.filters import exploded_attributes, top_values
from tracewright.operators.kpi import measures as M
from tracewright.operators.kpi.compile import Definition, kpi_frame, rows_of
from tracewright.operators.kpi.periods import in_months, period_months, start_range
from tracewright.plans.log import EventLog
from tracewright.session import settle


def compute(log: EventLog, kpis: list[Definition], period: str = "12") -> DataFrame:
    """(kpi, den, num, amount, amount_total, value, measured, previous, target, status, better) for the period.

    All KPIs of one object type share one pass over the log.
    """
    types = list(dict.fromkeys(k["object_type"] for k in kpis))
    first, last = start_range(log, types)
    current, before = period_months(period, first, last)
    frames = {t: settle(kpi_frame(log, t, [k for k in kpis if k["object_type"] == t]).drop("attrs"), "kpi-rows") for t in types}
    out = []
    for k in kpis:
        rows = rows_of(frames[k["object_type"]], k)
        now = M.measure(k, in_months(rows, current)).withColumn("__k", F.lit(1))
        if before:
            then = M.measure(k, in_months(rows, before)).select(F.col("value").alias("previous"), F.lit(1).alias("__k"))
            now = now.join(then, "__k", "left")
        else:
            now = now.withColumn("previous", F.lit(None).cast("double"))
        out.append(now.select(
            F.lit(k["id"]).alias("kpi"), "den", "num", "amount", "amount_total", "value", F.col("measured").cast("long").alias("measured"),
            "previous", F.lit(M.goal_of(k)).cast("double").alias("target"), M.status(k, F.col("value")).alias("status"),
            F.lit(M.better(k)).cast("string").alias("better")))
    return union_all(out)


def attribute_kinds(pairs: DataFrame, by: list[str], examples: int) -> DataFrame:
    """date, number or text per attribute: at least 80 % of its values read as such; with its most frequent values."""
    v = F.col("value")
    counts = pairs.where(~v.isin("", "None")).groupBy(*by, "attribute", "value").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy(*by, "attribute").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("filled"),
        F.sum(F.when(S.is_date_text(v), F.col("c")).otherwise(0)).alias("dates"),
        F.sum(F.when(S.number(v).isNotNull(), F.col("c")).otherwise(0)).alias("numbers"))
    kind = (F.when(F.col("dates") / F.col("filled") >= 0.8, "date")
            .when(F.col("numbers") / F.col("filled") >= 0.8, "number").otherwise("text"))
    shown = (top_values(counts.withColumnRenamed("c", "count"), [*by, "attribute"], examples).groupBy(*by, "attribute")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("x")))       # ``examples`` values
    return per.join(shown, [*by, "attribute"]).select(*by, "attribute", kind.alias("kind"), "distinct", "filled", F.transform("x", lambda x: x["value"]).alias("examples"))


def catalogue(log: EventLog, examples: int) -> DataFrame:
    """(scope, owner, attribute, kind, distinct, filled, examples): attributes of object types, and of activities' events."""
    objects = attribute_kinds(exploded_attributes(log.objects).select("object_type", "attribute", "value"), ["object_type"], examples)
    linked = log.links.select("event_id").distinct()
    events = log.events.join(linked, "event_id", "left_semi").select("activity", F.explode("attrs").alias("attribute", "value"))
    per_event = attribute_kinds(events, ["activity"], examples)
    return (objects.select(F.lit("object").alias("scope"), F.col("object_type").alias("owner"), "attribute", "kind", "distinct", "filled", "examples")
            .unionByName(per_event.select(F.lit("event").alias("scope"), F.col("activity").alias("owner"), "attribute", "kind", "distinct", "filled", "examples")))


def period(log: EventLog) -> DataFrame:
    return log.last_time.select(S.month("first_ts").alias("first_month"), S.month("last_ts").alias("last_month"))


def activities_of_types(log: EventLog) -> DataFrame:
    return model.activity_counts(log).select("object_type", "activity", "objects")
