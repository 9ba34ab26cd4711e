"""Chart selections as objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.kpi.compile import objects_where
from tracewright.operators.kpi.dimensions import dimension_values
from tracewright.plans.log import EventLog


def selected_objects(log: EventLog, selection: dict) -> DataFrame:
    """Ids of the objects a selected chart value or condition stands for."""
    if selection["kind"] == "condition":
        return objects_where(log, selection["type"], selection["condition"])
    values = dimension_values(log, selection["type"], selection["dimension"])
    return values.where(F.col("label").isin([str(v) for v in selection["values"]])).select("object_id").distinct()
