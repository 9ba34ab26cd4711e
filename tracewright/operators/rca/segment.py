"""A segment of cases against the rest: the gap, and how much of it is only the mix."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions import scalars as S
from tracewright.functions.spread import median, ranked_values
from tracewright.operators.filters import top_values
from tracewright.operators.rca import features as FE
from tracewright.operators.rca import statistics as ST
from tracewright.plans import skew
from tracewright.plans.log import EventLog

CATEGORIES = 12
OTHER, EMPTY = "\x00other", "\x00empty"


def gap(segment: DataFrame, rest: DataFrame, binary: bool) -> dict[str, Any]:
    """Sizes, means (and medians), their difference and a two-sided p-value."""
    a, b = ST.totals(segment).first(), ST.totals(rest).first()
    out = {"n_seg": a["n_all"], "n_rest": b["n_all"], "m_seg": a["s_all"] / a["n_all"], "m_rest": b["s_all"] / b["n_all"]}
    out["gap"] = out["m_seg"] - out["m_rest"]
    if binary:
        bad, bad_rest = int(a["s_all"]), int(b["s_all"])
        out["p"] = ST.fisher(bad, a["n_all"] - bad, bad_rest, b["n_all"] - bad_rest, two_sided=True)
    else:
        both = segment.select("case_id", "y").unionByName(rest.select("case_id", "y"))
        ranks = segment.join(ST.mid_ranks(both), "y").agg(F.sum("rank").alias("r")).first()["r"]
        out["p"] = ST.mann_whitney(ranks, a["n_all"], b["n_all"], ST.tie_sum(both).first()["ties"], two_sided=True)
        for name, part in (("med_seg", segment), ("med_rest", rest)):
            out[name] = ranked_values(part, [], "y", ST.WIDTH).agg(median("y").alias("m")).first()["m"]
    out["worse"] = out["gap"] > 0 and out["p"] <= fixed.Q_MAX
    return out


def _top_or_other(values: DataFrame) -> DataFrame:
    counts = values.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("count"))
    top = top_values(counts, ["grp"], CATEGORIES).select("grp", F.col("value").alias("kept"))
    # at most 12 values per attribute
    marked = values.join(F.broadcast(top.withColumnRenamed("kept", "value").withColumn("kept", F.lit(True))), ["grp", "value"], "left")
    return marked.select("case_id", "grp", F.when(F.col("kept"), F.col("value")).otherwise(OTHER).alias("cat"))


def categories(log: EventLog, cases: DataFrame, lead: str, skip: set[tuple[str, str]], n_cases: int) -> DataFrame:
    """(case_id, grp, cat): quartiles of numbers, frequent values, and the first related object of each type."""
    values = FE.lead_values(log, lead, cases, skip)
    groups = FE.attribute_groups(values, n_cases).where("mode <> 'skip'")
    placed = values.join(F.broadcast(groups.select("grp", "mode", "cuts")), "grp")       # one row per attribute
    quartile = placed.where("mode = 'range'").select("case_id", "grp", F.concat(F.lit("Q"), (F.lit(1) + F.size(F.filter(
        "cuts", lambda c: F.coalesce(S.number("value"), F.lit(0.0)) > c))).cast("string")).alias("cat"))
    plain = _top_or_other(placed.where("mode = 'value'").select("case_id", "grp", "value"))
    no_ids = [t for t, a in skip if a == "__id__"]
    if log.wide:
        met = log.pairs(lead, [t for t in log.types if t != lead and t not in no_ids], events=True).withColumnRenamed("left_id", "case_id").join(
            cases.select("case_id"), "case_id", "left_semi")
    else:
        own = log.links_of(lead).select(F.col("object_id").alias("case_id"), "event_id").join(cases.select("case_id"), "case_id", "left_semi")
        side = log.links.where((F.col("object_type") != lead) & ~F.col("object_type").isin(no_ids)).select(
            "event_id", "object_id", "object_type", "ts", "ord")
        met = skew.incidence_join(own, side, "event_id", log.hot_events)
    first = met.groupBy("case_id", "object_type").agg(
        F.min(F.struct("ts", "ord", "event_id", "object_id")).alias("f"))
    names = log.objects.select("object_id", FE.display_name().alias("value"))
    related = first.select("case_id", F.concat(F.lit("rel:"), "object_type").alias("grp"), F.col("f.object_id").alias("object_id")).join(
        names, "object_id").select("case_id", "grp", "value")
    return quartile.unionByName(plain).unionByName(_top_or_other(related))


def mix_effects(segment: DataFrame, rest: DataFrame, cats: DataFrame) -> DataFrame:
    """(grp, cat, w_seg, w_rest, m_rest, part): share of each category on both sides and its part of the mix effect.

    part = (share in the segment - share in the rest) x (mean of the category in the rest - mean of the rest).
    """
    a, b = ST.totals(segment).first(), ST.totals(rest).first()
    overall = b["s_all"] / b["n_all"]
    sums = lambda part, side: cats.join(part.select("case_id", "y"), "case_id").groupBy("grp", "cat").agg(
        F.count(F.lit(1)).alias(f"n_{side}"), F.sum("y").alias(f"s_{side}"))
    both = sums(segment, "seg").join(sums(rest, "rest"), ["grp", "cat"], "full_outer").na.fill(0)
    # cases without a value are a category of their own
    filled = both.groupBy("grp").agg(*[F.sum(f"{x}_{s}").alias(f"{x}_{s}") for s in ("seg", "rest") for x in ("n", "s")])
    none = filled.select("grp", F.lit(EMPTY).alias("cat"), (F.lit(a["n_all"]) - F.col("n_seg")).alias("n_seg"), (F.lit(a["s_all"]) - F.col("s_seg")).alias("s_seg"),
                         (F.lit(b["n_all"]) - F.col("n_rest")).alias("n_rest"), (F.lit(b["s_all"]) - F.col("s_rest")).alias("s_rest"))
    both = both.unionByName(none.where("n_seg > 0 OR n_rest > 0"))
    m_rest = F.when(F.col("n_rest") >= 5, F.col("s_rest") / F.col("n_rest")).otherwise(F.lit(overall))
    w_seg, w_rest = F.col("n_seg") / F.lit(float(a["n_all"])), F.col("n_rest") / F.lit(float(b["n_all"]))
    out = both.select("grp", "cat", w_seg.alias("w_seg"), w_rest.alias("w_rest"), m_rest.alias("m_rest"))
    return out.withColumn("part", (F.col("w_seg") - F.col("w_rest")) * (F.col("m_rest") - F.lit(overall)))


def best_mix(parts: DataFrame) -> DataFrame:
    """The attribute with the biggest mix effect, and up to three categories that make it: one row each."""
    everything = parts.withColumn("mix", F.sum("part").over(Window.partitionBy("grp")))
    leading = everything.where((F.col("part") > 0) & (F.col("w_seg") > F.col("w_rest")))
    per = leading.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("part"), "cat")))
    best = per.groupBy("grp").agg(F.first("mix").alias("m")).orderBy(F.desc("m"), "grp").limit(1).select("grp")
    return per.join(F.broadcast(best), "grp", "left_semi").where("place <= 3").select(
        "grp", "mix", F.when(~F.col("cat").startswith("\x00"), F.col("cat")).alias("category"), "w_seg", "w_rest", "m_rest", "part", "place")


def segment_against_rest(log: EventLog, segment: DataFrame, rest: DataFrame, lead: str, skip: set[tuple[str, str]], binary: bool) -> dict:
    out = gap(segment, rest, binary)
    if not out["worse"]:
        return out
    cases = segment.select("case_id", "y").unionByName(rest.select("case_id", "y"))
    cats = categories(log, cases, lead, skip, out["n_seg"] + out["n_rest"])
    rows = best_mix(mix_effects(segment, rest, cats)).orderBy("place").collect()
    out["mix"] = None
    if rows and rows[0]["mix"] >= 0.25 * out["gap"]:
        mix = rows[0]["mix"]
        out["mix"] = {"group": rows[0]["grp"], "mix": mix, "perf": out["gap"] - mix, "mix_share": mix / out["gap"],
                      "top": [r.asDict() for r in rows]}
    return out
