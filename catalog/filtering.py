"""Queries of the case filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import order_log, session_log, table
from catalog.sqlparts import sql
from tracewright.operators import filters as X
from tracewright.operators import overview as O

Q, SQL = {}, {}

URGENT = {"kind": "object", "type": "Order", "attribute": "o_orderpriority", "values": ["1-URGENT"]}
SPRING = {"kind": "start_month", "type": "Order", "values": ["1997-03", "1997-04"]}

Q["f2_attribute_seeds"] = lambda spark, folder: X.seeds_of(order_log(spark, folder), URGENT)
SQL["f2_attribute_seeds"] = "SELECT 'Order:' || o_orderkey AS object_id FROM orders WHERE o_orderpriority = '1-URGENT'"

Q["f3_event_attribute_seeds"] = lambda spark, folder: X.event_attribute_seeds(order_log(spark, folder), "l_linestatus", ["F"])
SQL["f3_event_attribute_seeds"] = sql("""SELECT DISTINCT object_id FROM nonhub WHERE event_id IN (SELECT event_id FROM ev WHERE l_linestatus = 'F')""")

Q["f4_start_month_seeds"] = lambda spark, folder: X.seeds_of(order_log(spark, folder), SPRING)
SQL["f4_start_month_seeds"] = sql("""SELECT object_id FROM e2o WHERE object_type = 'Order' GROUP BY 1 HAVING strftime(min(ts), '%Y-%m') IN ('1997-03', '1997-04')""")

Q["f5_duration_seeds"] = lambda spark, folder: X.duration_seeds(order_log(spark, folder), "Order", [(10.0, 400.0), (2000.0, None)])
SQL["f5_duration_seeds"] = sql("""SELECT object_id FROM e2o WHERE object_type = 'Order' GROUP BY 1
    HAVING (epoch(max(ts)) - epoch(min(ts))) / 86400 BETWEEN 10 AND 400 OR (epoch(max(ts)) - epoch(min(ts))) / 86400 >= 2000""")
Q["f5_case_days_related"] = lambda spark, folder: X.case_days(order_log(spark, folder), "Item", "related").select("object_id", F.round("days", 4).alias("days"))
SQL["f5_case_days_related"] = sql("""SELECT object_id, round((epoch(max(b)) - epoch(min(a))) / 86400, 4) AS days FROM (
    SELECT object_id, ts AS a, ts AS b FROM e2o WHERE object_type = 'Item'
    UNION ALL SELECT l.object_id, s.a, s.b FROM e2o l JOIN nonhub m USING (event_id)
        JOIN (SELECT object_id, min(ts) AS a, max(ts) AS b FROM nonhub GROUP BY 1) s ON s.object_id = m.object_id WHERE l.object_type = 'Item') GROUP BY 1""")


def f6(spark, folder):
    ids = table(spark, folder, "orders").where(F.col("o_totalprice") > 400000).select(F.concat(F.lit("Order:"), F.col("o_orderkey").cast("string")).alias("object_id"))
    return X.id_seeds(order_log(spark, folder), "Order", ids)


Q["f6_id_list"] = f6
SQL["f6_id_list"] = "SELECT 'Order:' || o_orderkey AS object_id FROM orders WHERE o_totalprice > 400000"

_DIM = {"kind": "dimension", "type": "Order", "dimension": {"source": "related", "object_type": "Customer", "attribute": "c_mktsegment"},
        "values": ["BUILDING"]}
_COND = {"kind": "condition", "type": "Order", "condition": {"op": "activity", "activities": ["Return Item"], "min_count": 2}}
Q["f7_dimension_seeds"] = lambda spark, folder: X.seeds_of(order_log(spark, folder), _DIM)
SQL["f7_dimension_seeds"] = "SELECT 'Order:' || o_orderkey AS object_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"
Q["f7_condition_seeds"] = lambda spark, folder: X.seeds_of(order_log(spark, folder), _COND)
SQL["f7_condition_seeds"] = "SELECT 'Order:' || l_orderkey AS object_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 2"

_EXPAND = {
    "seeds": "SELECT 'Order:' || o_orderkey AS object_id FROM orders WHERE o_orderpriority = '1-URGENT'",
    "core": """SELECT object_id FROM seeds UNION SELECT object_id FROM nonhub WHERE object_type <> 'Order'
        AND event_id IN (SELECT event_id FROM e2o WHERE object_id IN (SELECT object_id FROM seeds))""",
    "kept": "SELECT DISTINCT event_id FROM e2o WHERE object_id IN (SELECT object_id FROM core)",
    "fe2o": """SELECT * FROM e2o WHERE event_id IN (SELECT event_id FROM kept) AND (object_id IN (SELECT object_id FROM core)
        OR object_type IN (SELECT object_type FROM tstat WHERE hub))""",
}
Q["f8_filtered_links"] = lambda spark, folder: X.apply(order_log(spark, folder), [URGENT]).e2o.select("event_id", "object_id", "qualifier")
SQL["f8_filtered_links"] = sql("SELECT event_id, object_id, qualifier FROM fe2o", _EXPAND)
Q["f8_filtered_objects"] = lambda spark, folder: X.apply(order_log(spark, folder), [URGENT]).objects.select("object_id", "object_type")
SQL["f8_filtered_objects"] = sql("""SELECT object_id, object_type FROM obj WHERE object_id IN (SELECT object_id FROM fe2o UNION SELECT object_id FROM seeds)""", _EXPAND)

Q["f9_filter_sequence"] = lambda spark, folder: X.apply(order_log(spark, folder), [URGENT, SPRING]).e2o.select("event_id", "object_id", "qualifier")
SQL["f9_filter_sequence"] = sql("""SELECT event_id, object_id, qualifier FROM fe2o
    WHERE event_id IN (SELECT event_id FROM fe2o WHERE object_id IN (SELECT object_id FROM core2))
    AND (object_id IN (SELECT object_id FROM core2) OR object_type IN (SELECT object_type FROM tstat WHERE hub))""", {
    **_EXPAND,
    "seeds2": "SELECT object_id FROM fe2o WHERE object_type = 'Order' GROUP BY 1 HAVING strftime(min(ts), '%Y-%m') IN ('1997-03', '1997-04')",
    "core2": """SELECT object_id FROM seeds2 UNION SELECT object_id FROM fe2o WHERE object_type NOT IN (SELECT object_type FROM tstat WHERE hub) AND object_type <> 'Order'
        AND event_id IN (SELECT event_id FROM fe2o WHERE object_id IN (SELECT object_id FROM seeds2))"""})

Q["f10_filterable_attributes"] = lambda spark, folder: X.filterable_attributes(order_log(spark, folder)).select(
    "kind", "object_type", "attribute", "distinct", "value", "count", F.col("rank").cast("long").alias("rank"))
SQL["f10_filterable_attributes"] = sql("""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, object_type, attribute ORDER BY count DESC, value) AS rank,
        count(*) OVER (PARTITION BY kind, object_type, attribute) AS "distinct" FROM (
        SELECT 'object' AS kind, object_type, name AS attribute, value, count(*) AS count FROM attr GROUP BY ALL
        UNION ALL SELECT 'event', NULL, 'l_linestatus', l_linestatus, count(*) FROM ev WHERE l_linestatus IS NOT NULL GROUP BY ALL))
    WHERE rank <= 2000 AND "distinct" >= 2""")


def f11(spark, folder):
    history = table(spark, folder, "orders").select(
        F.concat(F.lit("Customer:"), F.col("o_custkey").cast("string")).alias("object_id"), F.lit("last_status").alias("name"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("time"),
        F.col("o_orderstatus").alias("value"))
    return X.latest_attributes(history).select("object_id", F.element_at("attrs", "last_status").alias("last_status"))


Q["f11_latest_attributes"] = f11
SQL["f11_latest_attributes"] = "SELECT 'Customer:' || o_custkey AS object_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1"


def f12(spark, folder):
    """The months chart started SPRING itself: it is drawn without it, but with the other filter."""
    log = order_log(spark, folder)
    rest = X.apply(log, X.without([URGENT, SPRING], "start_month", "Order"))
    return O.months(O.cases(rest, "Order").times)


Q["f12_cross_filter"] = f12
SQL["f12_cross_filter"] = sql("""SELECT strftime(m, '%Y-%m') AS month, count(object_id) AS count FROM
    (SELECT unnest(generate_series((SELECT date_trunc('month', min(a)) FROM starts), (SELECT date_trunc('month', max(a)) FROM starts), INTERVAL 1 MONTH)) AS m)
    LEFT JOIN starts ON date_trunc('month', a) = m GROUP BY 1""", {
    **_EXPAND, "starts": "SELECT object_id, min(ts) AS a FROM fe2o WHERE object_type = 'Order' GROUP BY 1"})
