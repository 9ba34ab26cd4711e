"""Features of cases, as one long table (case_id, feature, family, grp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions import scalars as S
from tracewright.functions.spread import at_rank, ranked_counts
from tracewright.operators import model
from tracewright.operators.build import union_all
from tracewright.operators.filters import exploded_attributes, top_values
from tracewright.operators.rca.manual import ManualProfile
from tracewright.plans import skew
from tracewright.plans.log import EventLog
from tracewright.session import settle

FEATURES = ["case_id", "feature", "family", "grp"]


def _feature(df: DataFrame, feature: Column, family: str, grp: Column) -> DataFrame:
    return df.select("case_id", feature.alias("feature"), F.lit(family).alias("family"), grp.alias("grp"))


# ---- attribute values ------------------------------------------------------
def held_groups(values: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, grps): which attributes each case has a value of; cases without any have an empty list."""
    have = values.select("case_id", "grp").unionByName(cases.select("case_id", F.lit(None).cast("string").alias("grp")))
    return have.groupBy("case_id").agg(F.collect_set("grp").alias("grps"))        # bounded by the attributes


def attribute_groups(values: DataFrame, n_cases: int, held: DataFrame | None = None) -> DataFrame:
    """(grp, kind, distinct, filled, cuts, mode) of (case_id, grp, value) rows; mode: value | range | skip.

    Texts are read as dates and numbers once per distinct value.
    """
    counts = settle(values.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("c")).withColumns({
        "x": S.number("value"), "dated": S.is_date_text("value")}), "attribute-values")
    per = counts.groupBy("grp").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("c").alias("total"),
        F.sum(F.when(F.col("dated"), F.col("c")).otherwise(0)).alias("dates"),
        F.sum(F.when(F.col("x").isNotNull(), F.col("c")).otherwise(0)).alias("numbers"))
    held = values.groupBy("case_id").agg(F.collect_set("grp").alias("grps")) if held is None else held
    filled = held.select(F.explode("grps").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("filled"))
    kind = (F.when(F.col("dates") / F.col("total") >= 0.8, "date").when(F.col("numbers") / F.col("total") >= 0.8, "number").otherwise("text"))
    per = per.withColumn("kind", kind).join(filled, "grp")
    many = F.broadcast(per.where((F.col("kind") == "number") & (F.col("distinct") > 8)).select("grp"))      # attributes
    numeric = counts.where("x is not null").join(many, "grp", "left_semi").groupBy("grp", "x").agg(F.sum("c").alias("c"))
    cuts = ranked_counts(numeric, ["grp"], "x", width=100.0).groupBy("grp").agg(F.array_sort(F.array_distinct(F.array(*[
        at_rank("x", F.floor(F.col("n") * q)) for q in (0.25, 0.5, 0.75)]))).alias("cuts"))
    identifier = (F.col("distinct") > 50) & (F.col("distinct") > 0.5 * F.greatest("filled", F.lit(1)))
    mode = (F.when(F.col("kind") == "date", "skip").when((F.col("kind") == "number") & (F.col("distinct") > 8), "range")
            .when(identifier, "skip").otherwise("value"))
    return per.join(cuts, "grp", "left").select("grp", "kind", "distinct", "filled", "cuts", mode.alias("mode"),
                                                (F.col("filled") / F.lit(float(max(n_cases, 1)))).alias("filled_share"))


def value_features(values: DataFrame, cases: DataFrame, n_cases: int, family: str = "context") -> DataFrame:
    """Frequent values, quartile ranges of numbers, and "no value"."""
    values = settle(values, "case-values")
    held = settle(held_groups(values, cases), "case-attributes")
    groups = F.broadcast(settle(attribute_groups(values, n_cases, held), "attributes"))       # one row per attribute
    placed = values.join(groups.select("grp", "mode", "cuts"), "grp")
    counts = placed.where("mode = 'value'").groupBy("grp", "value").agg(F.count(F.lit(1)).alias("count"))
    frequent = top_values(counts.where(F.col("count") >= fixed.MIN_CASES), ["grp"], fixed.MAX_VALUES).select("grp", "value")
    same = _feature(placed.join(F.broadcast(frequent), ["grp", "value"], "left_semi"),      # at most 30 per attribute
                    F.concat("grp", F.lit(":v:"), "value"), family, F.col("grp"))
    x = S.number("value")
    ranges = placed.where("mode = 'range'").withColumn("x", x).where("x is not null").withColumn(
        "i", F.size(F.filter("cuts", lambda c: F.col("x") > c)))
    ranged = _feature(ranges, F.concat("grp", F.lit(":range:"), F.col("i").cast("string")), family, F.col("grp")).distinct()
    open_groups = [r["grp"] for r in groups.where((F.col("kind") != "date") & (F.col("mode") != "skip") & F.col("filled_share").between(0.05, 0.95)).select("grp").collect()]
    missing = held.select("case_id", F.explode(F.array_except(F.array(*[F.lit(g) for g in open_groups]).cast("array<string>"), "grps")).alias("grp"))
    empty = _feature(missing, F.concat("grp", F.lit(":empty")), family, F.col("grp"))
    return union_all([same, ranged, empty])


def usable(attributes: DataFrame) -> DataFrame:
    return attributes.where(~F.col("value").isin("", "None"))


def lead_values(log: EventLog, lead: str, pop: DataFrame, skip: set[tuple[str, str]]) -> DataFrame:
    names = [a for t, a in skip if t == lead]
    attrs = usable(exploded_attributes(log.objects_of(lead))).where(~F.col("attribute").isin(names))
    return attrs.join(pop.select(F.col("case_id").alias("object_id")), "object_id", "left_semi").select(
        F.col("object_id").alias("case_id"), F.concat(F.lit(f"attr:{lead}:"), F.col("attribute")).alias("grp"), "value")


# ---- related objects -------------------------------------------------------
def display_name(attrs: str = "attrs", object_id: str = "object_id") -> Column:
    """Name attribute that is no number, with the id; else the id."""
    suffix = F.regexp_replace(object_id, r"^[^:]*:", "")
    names = F.filter(F.map_entries(attrs), lambda e: e["key"].rlike(fixed.DISPLAY_NAME) & (e["value"] != "") & S.number(e["value"]).isNull())
    first = F.get(names, F.lit(0))["value"]
    return F.coalesce(F.concat(first, F.lit(" ("), suffix, F.lit(")")), suffix)


def related(log: EventLog, lead: str, pop: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(case_id, object_type, object_id): objects of the case's own events (hubs too) and its case members."""
    if log.wide:
        direct = log.pairs(lead, [t for t in log.types if t != lead]).withColumnRenamed("left_id", "case_id")
        if len(model.allowed_types(log, lead)) < 2:
            # objects of one type are met only by an event of their own case: the members are among the direct ones
            return direct.distinct().join(pop.select("case_id"), "case_id", "left_semi").select("case_id", "object_type", "object_id")
        direct = direct.join(pop.select("case_id"), "case_id", "left_semi").select("case_id", "object_type", "object_id")
    else:
        own = log.links_of(lead).select(F.col("object_id").alias("case_id"), "event_id").join(pop.select("case_id"), "case_id", "left_semi")
        side = log.links.where(F.col("object_type") != lead).select("event_id", "object_id", "object_type")
        direct = skew.incidence_join(own, side, "event_id", log.hot_events).select("case_id", "object_type", "object_id")
    types = log.objects.select("object_id", "object_type")
    members = (model.case_members(log, lead) if members is None else members)
    members = (members.where(F.col("lead_id") != F.col("object_id"))
               .join(pop.select(F.col("case_id").alias("lead_id")), "lead_id", "left_semi")
               .join(types, "object_id").select(F.col("lead_id").alias("case_id"), "object_type", "object_id"))
    return direct.unionByName(members.where(F.col("object_type") != lead)).distinct()


def related_features(log: EventLog, lead: str, pop: DataFrame, n_cases: int, skip: set[tuple[str, str]], members: DataFrame | None = None) -> DataFrame:
    pairs = settle(related(log, lead, pop, members), "related-objects")
    no_ids = [t for t, a in skip if a == "__id__"]
    names = log.objects.select("object_id", display_name().alias("label"))
    ids = (pairs.where(~F.col("object_type").isin(no_ids)).join(names, "object_id")
           .select("case_id", F.concat(F.lit("rel:"), "object_type", F.lit(":__id__")).alias("grp"), F.col("label").alias("value")).distinct())
    counts = ids.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= fixed.MIN_CASES)
    frequent = top_values(counts, ["grp"], fixed.MAX_VALUES).select("grp", "value")
    by_id = _feature(ids.join(F.broadcast(frequent), ["grp", "value"], "left_semi"),       # at most 30 per type
                     F.concat(F.regexp_replace("grp", "__id__$", "id:"), F.col("value")), "context", F.col("grp"))
    attrs = usable(exploded_attributes(log.objects))
    for t, a in skip:
        attrs = attrs.where(~((F.col("object_type") == t) & (F.col("attribute") == a)))
    values = pairs.join(attrs.select("object_id", "attribute", "value"), "object_id").select(
        "case_id", F.concat_ws(":", F.lit("rel"), "object_type", "attribute").alias("grp"), "value").distinct()
    return by_id.unionByName(value_features(values, pop, n_cases))


# ---- behaviour and time ----------------------------------------------------
def behaviour_features(log: EventLog, lead: str, cutoff: DataFrame, skip: set[str], profile: ManualProfile, members: DataFrame | None = None) -> DataFrame:
    """Activity present, repeated, or done by hand, before the symptom shows."""
    events = model.case_events(log, lead, members=members).withColumnRenamed("lead_id", "case_id").join(cutoff, "case_id")
    early = events.where(~F.col("activity").isin(list(skip)) & (
        F.col("cutoff").isNull() | (F.unix_timestamp("ts") < F.col("cutoff"))))
    by_hand = F.lit(False)
    if profile.manual is not None:
        early = early.join(profile.manual.select("event_id", F.lit(True).alias("hand")), "event_id", "left")
        by_hand = F.coalesce(F.max("hand"), F.lit(False))
    per = early.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n"), by_hand.alias("by_hand"))
    kinds = F.array_compact(F.array(
        F.struct(F.lit("act:").alias("head"), F.lit("behavior").alias("family")),
        F.when(F.col("n") >= 2, F.struct(F.lit("rep:").alias("head"), F.lit("behavior").alias("family"))),
        F.when(F.col("by_hand"), F.struct(F.lit("man:").alias("head"), F.lit("manual").alias("family")))))
    key = F.concat("k.head", "activity")
    return per.select("case_id", "activity", F.explode(kinds).alias("k")).select(
        "case_id", key.alias("feature"), F.col("k.family").alias("family"), key.alias("grp"))


def time_features(pop: DataFrame) -> DataFrame:
    """Weekday and quarter end of the start, and starts in weeks with much work."""
    timed = pop.where("start_ts is not null")
    weekday = _feature(timed, F.concat(F.lit("time:wd:"), F.weekday("start_ts").cast("string")), "time", F.lit("time:wd"))
    quarter = _feature(timed.where(F.month("start_ts").isin(3, 6, 9, 12) & (F.dayofmonth("start_ts") >= 17)),
                       F.lit("time:qend"), "time", F.lit("time:qend"))
    week = F.expr("extract(YEAROFWEEK FROM start_ts) * 100 + weekofyear(start_ts)").alias("week")
    sizes = timed.groupBy(week).agg(F.count(F.lit(1)).alias("n"))          # weeks of the data
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy("n", "week"))
    ranked = sizes.withColumns({"weeks": n, "place": place})
    limit = F.max(F.when(F.col("place") == F.floor(F.col("weeks") * 2 / 3) + 1, F.col("n"))).over(Window.partitionBy())
    busy = ranked.withColumn("limit", limit).where("weeks >= 8 AND n > limit").select("week")
    load = _feature(timed.withColumn("week", week).join(F.broadcast(busy), "week", "left_semi"), F.lit("time:load"), "time", F.lit("time:load"))
    return union_all([weekday, quarter, load])


def build_features(log: EventLog, lead: str, pop: DataFrame, n_cases: int, cutoff: DataFrame, skip_activities: set[str],
                   skip_attributes: set[tuple[str, str]], profile: ManualProfile) -> DataFrame:
    members = settle(model.case_members(log, lead), "case-members")       # for related objects and for behaviour
    return union_all([
        value_features(lead_values(log, lead, pop, skip_attributes), pop, n_cases),
        related_features(log, lead, pop, n_cases, skip_attributes, members),
        behaviour_features(log, lead, cutoff, skip_activities, profile, members),
        time_features(pop)])
