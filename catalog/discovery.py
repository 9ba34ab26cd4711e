"""Links found in the data, and the process order."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import ORDER_LOG, order_log, star, table
from catalog.sqlparts import sql
from tracewright.operators import links as L
from tracewright.plans.mapping import EventRule

Q, SQL = {}, {}


def _tables(spark, folder):
    """Open items: orders, closed by the customer's next order when they are finished."""
    from pyspark.sql import Window
    o = table(spark, folder, "orders")
    nxt = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    items = o.select("o_orderkey", "o_custkey", "o_orderdate", F.lead("o_orderkey").over(nxt).alias("n"), F.lead("o_orderdate").over(nxt).alias("d"), "o_orderstatus")
    done = F.col("n").isNotNull() & (F.col("o_orderstatus") != "P")
    items = items.select(F.col("o_orderkey").alias("doc_no"), F.col("o_orderdate").alias("created"), F.when(done, F.col("d")).alias("closed_on"),
                         F.when(done, F.col("n")).alias("closed_by_doc"), F.col("o_custkey").alias("c_custkey"))
    docs = o.select(F.col("o_orderkey").alias("doc_no"), F.col("o_orderdate").alias("posted"), F.col("o_orderpriority").alias("kind"))
    return {"open_items": items, "docs": docs, "customer": table(spark, folder, "customer")}


EVENTS = [EventRule("Open Item", "open_items", "created"), EventRule("Close Item", "open_items", "closed_on"), EventRule("Post", "docs", "posted")]
OBJECTS = [L.BusinessObject("Document", "docs", ("doc_no",)), L.BusinessObject("Customer", "customer", ("c_custkey",)),
           L.BusinessObject("Urgent", "docs", ("doc_no",), "kind", ("1-URGENT",))]

Q["m11_reference_links"] = lambda spark, folder: L.reference_links(_tables(spark, folder), EVENTS, OBJECTS).select(
    "event", "column", "object", F.round("share", 4).alias("share"))
SQL["m11_reference_links"] = """WITH x AS (SELECT lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderstatus FROM orders)
    SELECT 'Close Item' AS event, 'closed_by_doc' AS "column", 'Document' AS object,
        round(count(DISTINCT n) FILTER (n IN (SELECT o_orderkey FROM orders)) / count(DISTINCT n), 4) AS share FROM x WHERE o_orderstatus <> 'P' AND n IS NOT NULL
    UNION ALL SELECT 'Open Item', 'c_custkey', 'Document', round(count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT o_orderkey FROM orders)) / count(DISTINCT o_custkey), 4) FROM orders"""

Q["m12_shared_key_links"] = lambda spark, folder: L.shared_key_links(_tables(spark, folder), EVENTS, OBJECTS).select(
    "event", "object", F.round("share", 4).alias("share"))
SQL["m12_shared_key_links"] = """
    SELECT e.event, o.object, round(o.share, 4) AS share FROM (SELECT unnest(['Open Item', 'Close Item']) AS event) e, (
        SELECT 'Document' AS object, 1.0::DOUBLE AS share UNION ALL SELECT 'Customer', count(DISTINCT o_custkey) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 'Urgent', count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) FROM orders) o WHERE o.share >= 0.2"""

Q["m13_process_order"] = lambda spark, folder: L.process_order(order_log(spark, folder), ORDER_LOG).select("kind", "name", F.round("position", 6).alias("position"))
SQL["m13_process_order"] = sql("""
    SELECT 'event' AS kind, event_group AS name, p AS position FROM g
    UNION ALL SELECT 'object', object_type, round(p, 6) FROM ob
    UNION ALL SELECT 'table', t, round(min(p), 6) FROM (
        SELECT CASE object_type WHEN 'Order' THEN 'orders' WHEN 'Item' THEN 'lineitem' ELSE lower(object_type) END AS t, p FROM ob
        UNION ALL SELECT CASE event_group WHEN 'Item' THEN 'lineitem' ELSE 'orders' END, p FROM g) GROUP BY t""", {
    "g": """SELECT event_group, (row_number() OVER (ORDER BY m, event_group) - 1)::DOUBLE AS p FROM (
        SELECT event_group, (list_sort(list(ts)))[count(*) // 2 + 1] AS m FROM ev GROUP BY 1)""",
    "ob": """SELECT object_type, min(p) + 0.5 - count(DISTINCT event_group) / 5.0 AS p FROM e2o JOIN (SELECT event_id AS id, event_group FROM ev) x ON x.id = e2o.event_id JOIN g USING (event_group) GROUP BY 1"""})
