"""Which events were done by hand although their activity usually runs by itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.plans.log import EventLog


@dataclass
class ManualProfile:
    """basis: user | time | None. ``automatic``: (activity, auto_share). ``manual``: (event_id, activity)."""

    basis: str | None
    users: DataFrame | None
    automatic: DataFrame | None
    manual: DataFrame | None


def user_attributes(log: EventLog) -> list[str]:
    """Event attributes that name a user, the most used first (bounded by the mapping)."""
    names = (log.events.select(F.explode(F.map_keys("attrs")).alias("name")).where(F.col("name").rlike(fixed.USER_ATTRIBUTE))
             .groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").collect())
    return [r["name"] for r in names]


def event_users(log: EventLog) -> DataFrame:
    """(event_id, activity, ts, user) of linked events with a user."""
    names = user_attributes(log)
    user = F.coalesce(*[F.nullif(F.element_at("attrs", n), F.lit("")) for n in names]) if names else F.lit(None).cast("string")
    linked = log.links.select("event_id").distinct()
    return log.events.join(linked, "event_id", "left_semi").select("event_id", "activity", "ts", user.alias("user")).where(
        F.col("user").isNotNull())


def technical_users(users: DataFrame) -> DataFrame:
    """(user, events, burst_share, off_share, technical): by name, or by bursts and working hours of many events.

    Events are first counted per user and second, so a busy user is summed up
    before its rows meet.
    """
    per_second = users.groupBy("user", "ts").agg(F.count(F.lit(1)).alias("n"))
    off = (F.weekday("ts") >= 5) | (F.hour("ts") < 6)
    timed = F.col("ts").isNotNull()
    per_user = per_second.groupBy("user").agg(
        F.sum("n").alias("events"), F.sum(F.when(timed, F.col("n")).otherwise(0)).alias("timed"),
        F.sum(F.when(timed & (F.col("n") >= 3), F.col("n")).otherwise(0)).alias("burst"),
        F.sum(F.when(timed & off, F.col("n")).otherwise(0)).alias("off"))
    share = lambda c: F.col(c) / F.greatest("timed", F.lit(1))
    many = (F.col("events") >= fixed.MIN_CASES) & ((share("burst") >= 0.6) | (share("off") >= 0.5))
    return per_user.select("user", "events", share("burst").alias("burst_share"), share("off").alias("off_share"),
                           (F.col("user").rlike(fixed.TECHNICAL_USER) | many).alias("technical"))


def usually_automatic(flagged: DataFrame) -> DataFrame:
    """Activities with at least 20 flagged events, 70 % of them automatic."""
    per = flagged.groupBy("activity").agg(F.count(F.lit(1)).alias("events"), F.count_if("auto").alias("auto"))
    return per.where((F.col("events") >= fixed.MIN_CASES) & (F.col("auto") >= 0.7 * F.col("events"))).select(
        "activity", F.round(F.col("auto") / F.col("events"), 3).alias("auto_share"))


def manual_profile(log: EventLog) -> ManualProfile:
    users = event_users(log)
    if users.limit(fixed.MIN_CASES).count() >= fixed.MIN_CASES:
        technical = technical_users(users)
        flagged = users.join(technical.select("user", F.col("technical").alias("auto")), "user")
        basis = "user"
    else:
        # without users: many events of one activity at one instant were made by a program
        technical = None
        events = log.events.join(log.links.select("event_id").distinct(), "event_id", "left_semi").where("ts is not null")
        blocks = events.groupBy("activity", "ts").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("activity", "ts", F.lit(True).alias("b"))
        flagged = events.select("event_id", "activity", "ts").join(blocks, ["activity", "ts"], "left").withColumn("auto", F.coalesce("b", F.lit(False)))
        basis = "time" if blocks.limit(1).count() else None
    if basis is None:
        return ManualProfile(None, None, None, None)
    automatic = usually_automatic(flagged)
    manual = flagged.where(~F.col("auto")).join(F.broadcast(automatic), "activity").select("event_id", "activity")   # one row per activity
    return ManualProfile(basis, technical, automatic, manual)
