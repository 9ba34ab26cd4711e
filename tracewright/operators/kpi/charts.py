"""Chart data of a KPI. Every chart is a small table; the heavy part is a grouped aggregation of its rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.spread import at_rank, median, p90_ceil, ranked_values
from tracewright.operators import model
from tracewright.operators.filters import top_values
from tracewright.operators.kpi import measures as M
from tracewright.operators.kpi.compile import Compiler, Definition
from tracewright.operators.kpi.dimensions import dimension_values, grouped
from tracewright.operators.kpi.periods import in_months, span
from tracewright.operators.overview import month_spine
from tracewright.plans.log import EventLog

SERIES, HEATMAP_SERIES, TOP, TOP_WIDE, MAP_GROUPS, SLICES, BINS, MAX_BINS = 5, 12, 10, 15, 250, 6, 10, 60   # fixed values
OTHER = "(other)"


def _months(log: EventLog, rows: DataFrame, months: Sequence[str] | None, widen: bool) -> DataFrame:
    """Month axis: all months with a start (and the chosen ones, when ``widen``), or just the chosen ones."""
    if months is not None and not widen:
        return log.spark.createDataFrame([(m,) for m in months], "month string")
    ends = rows.agg(F.min("start_ts").alias("a"), F.max("start_ts").alias("b"))
    if months:
        first, last = (F.to_timestamp(F.lit(f"{m}-01")) for m in (min(months), max(months)))
        ends = ends.select(F.least("a", first).alias("a"), F.greatest("b", last).alias("b"))
    return month_spine(ends)


def trend(log: EventLog, kpi: Definition, rows: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """trend, area, column_trend, combo: one point per month, without gaps."""
    points = M.measure(kpi, rows.withColumnRenamed("start_month", "month"), ["month"])
    return _fill(_months(log, rows, months, True).join(points, "month", "left"), kpi)


def _fill(points: DataFrame, kpi: Definition) -> DataFrame:
    """Months without objects: zero counts, and the value an empty group has."""
    out = points.na.fill(0, ["den", "num"])
    if kpi.get("amount"):
        out = out.na.fill(0.0, ["amount", "amount_total"])
    if kpi.get("measure") in ("count", "sum"):
        out = out.na.fill(0.0, ["value"])
    if kpi.get("measure") == "duration":
        out = out.na.fill(0, ["measured"])
    return out


def ordered_groups(kpi: Definition, groups: DataFrame, order: str = "impact") -> DataFrame:
    """Groups with their position: by impact, by value (value_desc, value_asc) or by label."""
    by = {"value_desc": [F.desc_nulls_last("value"), "label"], "value_asc": [F.asc_nulls_last("value"), "label"],
          "label": ["label"]}.get(order, [F.desc("impact"), F.desc("den"), "label"])
    with_impact = groups.withColumn("impact", M.impact(kpi))
    # one row per label: aggregated
    return with_impact.withColumn("position", F.row_number().over(Window.orderBy(*by)))


def group_chart(log: EventLog, kpi: Definition, rows: DataFrame, dimension: Definition, kind: str = "bars",
                order: str = "impact", top: int | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """bars, columns, table, bubble, treemap, map, pareto: the first groups, and how many there are beyond.

    A Pareto also carries the running share of the impact of all groups.
    """
    shown = MAP_GROUPS if kind == "map" else max(3, min(30, top or (
        TOP_WIDE if kind in ("bubble", "treemap", "pareto") else TOP)))
    groups = M.measure(kpi, grouped(log, kpi, in_months(rows, months), dimension), ["label"])
    out = ordered_groups(kpi, groups, order)
    everything = Window.partitionBy()
    out = out.withColumn("others", F.greatest(F.count(F.lit(1)).over(everything) - shown, F.lit(0)))
    if kind == "pareto":
        running = F.sum("impact").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("impact").over(everything)
        out = out.withColumn("cumulative", F.when(total != 0, running / total))
    return out.where(F.col("position") <= shown)


def matrix_chart(log: EventLog, kpi: Definition, rows: DataFrame, dimension: Definition, kind: str = "stacked_columns",
                 order: str = "impact", series: int | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """stacked_columns, multi_line, heatmap: the first groups by month; stacked columns also show the rest as one."""
    n = max(2, min(12, series or (HEATMAP_SERIES if kind == "heatmap" else SERIES)))
    chosen = grouped(log, kpi, in_months(rows, months), dimension)
    ranked = ordered_groups(kpi, M.measure(kpi, chosen, ["label"]), order).select("label", "position")
    axis = _months(log, rows, months, False)
    placed = chosen.join(F.broadcast(ranked.where(F.col("position") <= n)), "label", "left")     # at most 12 groups
    named = placed.withColumn("series", F.when(F.col("position").isNull(), OTHER).otherwise(F.col("label")))
    if kind != "stacked_columns":
        named = named.where(F.col("position").isNotNull())
    points = M.measure(kpi, named.withColumnRenamed("start_month", "month"), ["series", "month"])
    # every shown series on every month: both sides are labels of the chart, at most 13 x months
    names = named.select("series", F.coalesce("position", F.lit(n + 1)).alias("place")).distinct()
    months_of = F.array_sort(F.collect_list("month"))
    grid = names.withColumn("k", F.lit(1)).join(F.broadcast(axis.agg(months_of.alias("m")).withColumn("k", F.lit(1))), "k").select(
        "series", "place", F.explode("m").alias("month"))
    return _fill(grid.join(points, ["series", "month"], "left"), kpi)


def single_value(kpi: Definition, rows: DataFrame, tolerance: float = 10.0, months: Sequence[str] | None = None) -> DataFrame:
    """gauge, traffic_light: the value against its target."""
    one = M.measure(kpi, in_months(rows, months))
    return one.withColumns({"target": F.lit(M.goal_of(kpi)).cast("double"), "status": M.status(kpi, F.col("value")),
                            "light": M.light(kpi, F.col("value"), tolerance)})


def gauge_bands(log: EventLog, kpi: Definition, rows: DataFrame, tolerance: float = 10.0, low=None, high=None,
                months: Sequence[str] | None = None) -> DataFrame:
    value = M.measure(kpi, in_months(rows, months)).first()["value"]
    scale = M.gauge_scale(kpi, value, tolerance, low, high)
    return log.spark.createDataFrame([(scale["min"], scale["max"], b["from"], b["to"], b["light"]) for b in scale["bands"]],
                                     "low double, high double, from_value double, to_value double, light string")


def funnel(log: EventLog, kpi: Definition, rows: DataFrame, activities: Sequence[str], related: bool = False,
           months: Sequence[str] | None = None) -> DataFrame:
    """Objects of the population that reach each activity, in the given order."""
    c = Compiler(log, kpi["object_type"])
    reached = {f"a{i}": c.condition({"op": "activity", "activities": [a], "related": related}) for i, a in enumerate(activities)}
    frame = c.frame()
    flags = frame.select("object_id", *[v.alias(n) for n, v in reached.items()])
    counts = in_months(rows, months).select("object_id").join(flags, "object_id").agg(
        *[F.count_if(n).alias(n) for n in reached])
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(a).alias("activity"), F.col(f"a{i}").alias("objects"))
                                for i, a in enumerate(activities)])).alias("s")
    return counts.select(steps).select("s.*")


def histogram(log: EventLog, kpi: Definition, rows: DataFrame, bins: int | None = None,
              months: Sequence[str] | None = None) -> DataFrame:
    """(bin, from_value, to_value, count, open): round steps up to the 99th percentile, the rest in the last bin."""
    n = max(4, min(30, bins or BINS))
    rows = in_months(rows, months)
    if kpi.get("measure") == "duration":
        values = rows.where("hit").select(F.col("days").alias("v"))
    else:
        every = F.lit(kpi.get("measure") in ("count", "share"))
        values = rows.where(F.col("hit") | every).select(F.col("amount").alias("v"))
    values = values.where(F.col("v").isNotNull())
    ends = ranked_values(values, [], "v", width=1.0).agg(
        F.min("v").alias("lo"), F.max("v").alias("top"),
        at_rank("v", F.greatest(F.lit(0), F.ceil(F.lit(0.99) * F.col("n")) - 1)).alias("hi")).first()
    schema = "bin int, from_value double, to_value double, open boolean"
    if ends["lo"] is None:
        return log.spark.createDataFrame([], schema).withColumn("count", F.lit(0).cast("long"))
    lo, hi = ends["lo"], ends["hi"] if ends["hi"] > ends["lo"] else ends["lo"] + 1.0
    step = M.nice((hi - lo) / n, M.NICE_STEP)
    start = math.floor(lo / step) * step
    k = min(MAX_BINS + 1, max(1, math.floor((hi - start) / step) + 1))
    edges = [(i, start + step * i, start + step * (i + 1), i == k - 1 and ends["top"] > start + step * k) for i in range(k)]
    slot = F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.lit(start)) / F.lit(step)))).cast("int")
    counts = values.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return log.spark.createDataFrame(edges, schema).join(counts, "bin", "left").na.fill(0, ["count"])


def histogram_marks(kpi: Definition, rows: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """Number, median and 90th percentile of the values behind the histogram of a duration."""
    rows = in_months(rows, months)
    return ranked_values(rows.where("hit"), [], "days", width=1.0).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("count"), median("days").alias("median"), p90_ceil("days").alias("p90"))


def composition(log: EventLog, kpi: Definition, rows: DataFrame, categories: Sequence[Definition] = (),
                dimension: Definition | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """donut, pie: (position, label, value). By ordered categories (first match), by a dimension (an object with
    several values counts for each in equal parts; first slices plus the rest), or hit against the others."""
    by_amount = kpi.get("measure") in M.AMOUNTS
    weight = F.coalesce("amount", F.lit(0.0)) if by_amount else F.lit(1.0)
    rows = in_months(rows, months).withColumn("w", weight)
    hits = rows.where("hit")
    if categories:
        c = Compiler(log, kpi["object_type"])
        tests = [c.condition(x.get("condition")) for x in categories]
        first = F.lit(len(tests))
        for i in reversed(range(len(tests))):
            first = F.when(tests[i], i).otherwise(first)
        frame = c.frame()
        labels = F.array(*[F.lit(x["label"]) for x in categories], F.lit(OTHER))
        counted = hits.join(frame.select("object_id", first.alias("position")), "object_id").groupBy("position").agg(F.sum("w").alias("value"))
        return counted.where(F.col("value") != 0).select("position", F.get(labels, F.col("position")).alias("label"), "value")
    if dimension:
        values = dimension_values(log, kpi["object_type"], dimension)
        parts = values.groupBy("object_id").agg(F.count(F.lit(1)).alias("k"))
        slices = (hits.join(values, "object_id").join(parts, "object_id").groupBy("label")
                  .agg(F.sum(F.col("w") / F.col("k")).alias("value")))
        ranked = slices.withColumn("position", F.row_number().over(Window.orderBy(F.desc("value"), "label")))
        slot = F.least("position", F.lit(SLICES + 1)).alias("position")
        label = F.when(F.col("position") > SLICES, OTHER).otherwise(F.col("label")).alias("label")
        return ranked.groupBy(slot, label).agg(F.sum("value").alias("value")).where(F.col("value") != 0)
    side = F.when(F.col("hit"), 0).otherwise(1).alias("position")
    label = F.when(F.col("hit"), F.lit(str(kpi.get("name") or kpi["id"]))).otherwise(OTHER).alias("label")
    return rows.groupBy(side, label).agg(F.sum("w").alias("value")).where(F.col("value") != 0)


def currency(log: EventLog, kpi: Definition) -> DataFrame:
    """Most frequent value of the currency attribute (the smaller one on a tie)."""
    value = F.trim(F.element_at("attrs", kpi["currency"]))
    counts = (log.objects_of(kpi["object_type"]).select(value.alias("value")).where(F.col("value") != "")
              .groupBy("value").agg(F.count(F.lit(1)).alias("count")).withColumn("all", F.lit("")))
    return top_values(counts, ["all"], 1).select(F.col("value").alias("currency"), "count")
