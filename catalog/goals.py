"""Queries on measurable objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import order_log, table
from catalog.overviews import GOAL, _GOAL
from catalog.sqlparts import sql
from tracewright.operators import build as B
from tracewright.operators import objective as G
from tracewright.operators import overview as O
from tracewright.plans.mapping import EventRule, Mapping, ObjectRule

Q, SQL = {}, {}
r4 = lambda c, name=None: F.round(c, 4).alias(name or c)

Q["b1_category_attributes"] = lambda spark, folder: G.category_attributes(order_log(spark, folder))
SQL["b1_category_attributes"] = sql("""SELECT object_type, attribute, value, objects FROM (
    SELECT *, count(*) OVER (PARTITION BY object_type, attribute) AS k, sum(objects) OVER (PARTITION BY object_type, attribute) AS filled FROM (
        SELECT object_type, name AS attribute, value, count(*) AS objects FROM attr WHERE object_type IN ('Order', 'Item')
        AND object_id IN (SELECT object_id FROM e2o) GROUP BY 1, 2, 3))
    JOIN (SELECT object_type, count(DISTINCT object_id) AS n FROM e2o GROUP BY 1) USING (object_type) WHERE k BETWEEN 2 AND 12 AND filled * 2 >= n""")


def b2(spark, folder):
    o = G.propose(order_log(spark, folder))
    return spark.createDataFrame([(o.object_type, o.start, o.end, o.filter_attribute)], "object_type string, start string, end string, filter_attribute string")


Q["b2_proposal"] = b2
SQL["b2_proposal"] = sql("""SELECT 'Order' AS object_type, (SELECT first_a FROM ends GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS start,
    (SELECT last_a FROM ends WHERE k >= 2 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS "end", NULL::VARCHAR AS filter_attribute""", {
    "ends": """SELECT object_id, arg_min(activity, (ts, event_id)) AS first_a, arg_max(activity, (ts, event_id)) AS last_a, count(DISTINCT activity) AS k
        FROM e2o WHERE object_type = 'Order' GROUP BY 1"""})

Q["b3_measurability"] = lambda spark, folder: G.measurability(order_log(spark, folder), GOAL).select(
    "objects", "measurable", "open", "end_only", "end_before_start", "neither", r4("median"), F.col("p90").cast("double").alias("p90"), r4("open_median_age"))
SQL["b3_measurability"] = sql("""SELECT count(*) AS objects, count(t1) AS measurable, count(*) FILTER (t1 IS NULL AND NOT has_end) AS open, 0 AS end_only,
    count(*) FILTER (t1 IS NULL AND has_end) AS end_before_start, 0 AS neither, round(median(epoch(t1) - epoch(t0)), 4) AS median,
    (list_sort(list(epoch(t1) - epoch(t0)) FILTER (t1 IS NOT NULL)))[round_even(0.9 * (count(t1) - 1), 0)::BIGINT + 1]::DOUBLE AS p90,
    round(median(epoch((SELECT max(ts) FROM ev)) - epoch(t0)) FILTER (t1 IS NULL AND NOT has_end), 4) AS open_median_age
    FROM (SELECT *, lead_id IN (SELECT object_id FROM e2o WHERE object_type = 'Order' AND activity = 'Return Item') AS has_end FROM goal)""", _GOAL)


def b4(spark, folder):
    """Line items that are returned: which attribute tells them from the others?"""
    line = table(spark, folder, "lineitem")
    rules = Mapping((ObjectRule("Line", "lines", ("row",), ("l_returnflag", "l_linestatus")),),
                    (EventRule("Line", "lines", "l_shipdate", activity_column="l_returnflag",
                               activity_values={"R": "Return", "N": "Other", "A": "Other"}, row_key=("row",)),))
    from tracewright.functions.scalars import object_key
    rows = line.select(object_key(list(data_row())).alias("row"), "l_returnflag", "l_linestatus", "l_shipdate")
    log = B.build(rules, {"lines": rows}).settled()
    return G.separating_attribute(log, O.Objective("Line", "Return", "Other"))


def data_row():
    from catalog.data import ITEM_ROW
    return ITEM_ROW


Q["b4_separating_attribute"] = b4
SQL["b4_separating_attribute"] = "SELECT 'l_returnflag' AS attribute, 'R' AS values, count(*) AS covered FROM lineitem WHERE l_returnflag = 'R'"
