"""KPI definitions -> columns.

A definition is a nested dict with a closed vocabulary. The compiler walks it
once, collects what it needs from the events as aggregates (own events and case
events, one pass each) and returns the rest as a column over one row per object.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions import scalars as S
from tracewright.operators import model
from tracewright.plans.log import EventLog

Definition = dict[str, Any]


def to_number(value) -> float | None:
    """Number inside a definition."""
    text = str("" if value is None else value).strip().replace(",", ".")
    try:
        return float(text)
    except ValueError:
        return None


class Compiler:
    """Collects the aggregates that conditions and time points of one object type need."""

    def __init__(self, log: EventLog, object_type: str):
        self.log, self.object_type = log, object_type
        self._aggregates: dict[str, dict[str, Column]] = {"own": {}, "case": {}}
        self._event_flags: dict[str, dict[str, Column]] = {"own": {}, "case": {}}
        self._aggregates["own"]["start_ts"] = F.min("ts")

    # ---- what events must tell -----------------------------------------
    def _need(self, related: bool, aggregate: Column) -> Column:
        scope = "case" if related else "own"
        name = f"{scope}_{len(self._aggregates[scope])}"
        self._aggregates[scope][name] = aggregate
        return F.col(name)

    # ---- points and durations ------------------------------------------
    def point(self, p: Definition | None) -> Column:
        """Time of an activity, or a date attribute plus days, in seconds."""
        p = p or {}
        if p.get("activity"):
            ts = F.when(F.col("activity") == p["activity"], F.unix_timestamp("ts"))
            return self._need(bool(p.get("related")), F.max(ts) if p.get("which") == "last" else F.min(ts)).cast("double")
        if p.get("attribute"):
            base = F.unix_timestamp(S.date_value(F.element_at("attrs", p["attribute"]))).cast("double")
            days = F.lit(to_number(p.get("plus_days")) or 0.0)
            if p.get("plus_days_attribute"):
                days = days + F.coalesce(S.number(F.element_at("attrs", p["plus_days_attribute"])), F.lit(0.0))
            return base + days * F.lit(fixed.DAY)
        return F.lit(None).cast("double")

    def days(self, start: Definition | None, end: Definition | None) -> Column:
        return (self.point(end) - self.point(start)) / F.lit(fixed.DAY)

    # ---- conditions ----------------------------------------------------
    def condition(self, c: Definition | None) -> Column:
        """True or false for every object, never unknown."""
        if not isinstance(c, dict) or not c:
            return F.lit(True)
        build = getattr(self, f"_{c.get('op')}", None)
        return F.coalesce(build(c), F.lit(False)) if build else F.lit(False)

    def _any(self, c):
        out = F.lit(False)
        for item in c.get("items") or []:
            out = out | self.condition(item)
        return out

    def _all(self, c):
        out = F.lit(True)
        for item in c.get("items") or []:
            out = out & self.condition(item)
        return out

    def _not(self, c):
        return ~self.condition(c.get("item"))

    def _activity(self, c):
        n = max(1, int(to_number(c.get("min_count")) or 1))
        hit = F.count_if(F.col("activity").isin(list(c.get("activities") or [])))
        return F.coalesce(self._need(bool(c.get("related")), hit), F.lit(0)) >= n

    def _user(self, c):
        """Some event attribute that is not excluded and, if asked, is included."""
        found = F.lit(False)
        for name in c.get("attributes") or []:
            v = F.element_at("attrs", name)
            ok = v.isNotNull() & (v != "") & ~S.matches_any(v, c.get("exclude") or [])
            if c.get("include"):
                ok = ok & S.matches_any(v, c["include"])
            found = found | F.coalesce(ok, F.lit(False))
        if c.get("activities"):
            found = found & F.col("activity").isin(list(c["activities"]))
        flags = self._event_flags["case" if c.get("related") else "own"]
        flag = f"flag_{len(flags)}"
        flags[flag] = found
        return F.coalesce(self._need(bool(c.get("related")), F.max(F.col(flag))), F.lit(False))

    def _attribute(self, c):
        v = F.coalesce(F.trim(F.element_at("attrs", str(c.get("attribute")))), F.lit(""))
        cmp, values = c.get("cmp") or "in", [str(x).strip() for x in c.get("values") or []]
        if cmp == "empty":
            return v == ""
        if cmp == "not_empty":
            return v != ""
        if cmp in ("in", "not_in"):
            numbers = [n for n in map(to_number, values) if n is not None]
            hit = v.isin(values)
            if numbers:
                hit = hit | F.coalesce(S.number(v).isin(numbers), F.lit(False))
            return hit if cmp == "in" else ~hit
        limit = to_number(values[0]) if values else None
        return self._compare(S.number(v), cmp, limit) if limit is not None else F.lit(False)

    def _duration(self, c):
        return self._compare(self.days(c.get("from"), c.get("to")), c.get("cmp") or "gt", to_number(c.get("days")) or 0.0)

    @staticmethod
    def _compare(a: Column, cmp: str, b: float) -> Column:
        b = F.lit(b)
        return {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}.get(cmp, F.lit(False))

    # ---- one row per object --------------------------------------------
    def _scope_events(self, related: bool) -> DataFrame:
        if related:
            return model.case_events(self.log, self.object_type)
        return model.own_sequence(self.log, self.object_type)

    def frame(self) -> DataFrame:
        """Objects of the type with every aggregate asked for so far."""
        out = self.log.objects_of(self.object_type).select("object_id", "attrs")
        for scope, aggregates in self._aggregates.items():
            if not aggregates:
                continue
            events = self._scope_events(scope == "case")
            flags = self._event_flags[scope]
            if flags:
                # flags are computed on the event and travel only where one is true
                some = reduce(Column.__or__, [F.col(f) for f in flags])
                flagged = self.log.events.select("event_id", *[c.alias(f) for f, c in flags.items()]).where(some)
                events = events.join(flagged, "event_id", "left")
            per = events.groupBy("lead_id").agg(*[a.alias(n) for n, a in aggregates.items()])
            out = out.join(per.withColumnRenamed("lead_id", "object_id"), "object_id", "left")
        return out


def kpi_frame(log: EventLog, object_type: str, kpis: list[Definition]) -> DataFrame:
    """One row per object with, per KPI, ``<id>_in``, ``<id>_hit``, ``<id>_amount`` and ``<id>_days``: one pass for all."""
    c = Compiler(log, object_type)
    columns: dict[str, Column] = {}
    for k in kpis:
        inside, hit = c.condition(k.get("population")), c.condition(k.get("condition"))
        amount = S.number(F.element_at("attrs", k["amount"])) if k.get("amount") else F.lit(None).cast("double")
        d = k.get("duration") or {}
        days = c.days(d.get("from"), d.get("to")) if k.get("measure") == "duration" else F.lit(None).cast("double")
        columns |= {f"{k['id']}_in": inside, f"{k['id']}_hit": hit, f"{k['id']}_amount": amount,
                    f"{k['id']}_days": F.when(hit, days)}
    columns["start_month"] = S.month("start_ts")
    return c.frame().withColumns(columns).select("object_id", "attrs", "start_ts", "start_month", *[
        n for n in columns if n != "start_month"])


def rows_of(frame: DataFrame, kpi: Definition) -> DataFrame:
    """(object_id, start_ts, start_month, hit, amount, days) of a KPI's population."""
    i = kpi["id"]
    return frame.where(F.col(f"{i}_in")).select(
        "object_id", "start_ts", "start_month", F.col(f"{i}_hit").alias("hit"), F.col(f"{i}_amount").alias("amount"),
        F.col(f"{i}_days").alias("days"))


def kpi_rows(log: EventLog, kpi: Definition) -> DataFrame:
    return rows_of(kpi_frame(log, kpi["object_type"], [kpi]), kpi)


def objects_where(log: EventLog, object_type: str, condition: Definition | None) -> DataFrame:
    """Ids of the objects for which a condition holds."""
    c = Compiler(log, object_type)
    holds = c.condition(condition)
    return c.frame().where(holds).select("object_id")
