"""Queries on building and merging logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import data
from catalog.data import ORDER_LOG, SPLIT_LOG, order_log, split_log, split_tables, star, table
from catalog.sqlparts import sql
from tracewright.functions import scalars as S
from tracewright.operators import build as B
from tracewright.plans.mapping import ComputedColumn, EventRule, Mapping, ObjectRule

Q, SQL = {}, {}

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
stamp = lambda c="ts": F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)

Q["t1_clean_scalar"] = lambda spark, folder: (
    table(spark, folder, "documents").select("doc_id", S.clean("source").alias("source"), S.clean("lang").alias("lang"),
                                             F.length(S.clean("text")).cast("long").alias("chars")))
SQL["t1_clean_scalar"] = """SELECT doc_id, CASE WHEN trim(source) = 'nan' THEN '' ELSE coalesce(trim(source), '') END AS source,
    CASE WHEN trim(lang) = 'nan' THEN '' ELSE coalesce(trim(lang), '') END AS lang,
    length(CASE WHEN trim(text) = 'nan' THEN '' ELSE coalesce(trim(text), '') END) AS chars FROM documents"""

Q["t3_object_split"] = lambda spark, folder: B.split_outcomes(SPLIT_LOG, split_tables(spark, folder))
SQL["t3_object_split"] = """SELECT 'Order' AS base_type, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'excluded' ELSE 'unmapped' END AS outcome,
    o_orderstatus AS split_value, count(*) AS rows FROM orders GROUP BY 1, 2, 3"""


def t4(spark, folder):
    rule = SPLIT_LOG.events[1]
    activity, outcome = B.event_activity(rule)
    return table(spark, folder, "lineitem").groupBy(activity.alias("activity"), outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows"))


Q["t4_activity_from_column"] = t4
SQL["t4_activity_from_column"] = """SELECT CASE l_returnflag WHEN 'N' THEN 'Ship Item' WHEN 'A' THEN 'Item [l_returnflag=A]' END AS activity,
    CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'A' THEN 'unmapped' ELSE 'excluded' END AS outcome, count(*) AS rows FROM lineitem GROUP BY 1, 2"""

Q["t5_object_keys"] = lambda spark, folder: table(spark, folder, "lineitem").select(
    S.object_key(["l_linenumber", "l_orderkey"]).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
SQL["t5_object_keys"] = "SELECT l_linenumber || '|' || l_orderkey AS key, count(*) AS rows FROM lineitem GROUP BY 1"


def t6(spark, folder):
    o = table(spark, folder, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    clock = F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":15"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, text).when(F.col("o_orderkey") % 3 == 1, compact)
                    .otherwise(F.concat(text, F.lit(" 08:30:00"))).alias("d"), clock.alias("t"))
    return rows.select("o_orderkey", stamp_of(S.event_time("d", None, "t")))


def stamp_of(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("ts")


Q["t6_event_time"] = t6
SQL["t6_event_time"] = """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 2 THEN o_orderdate + INTERVAL 510 MINUTE
    ELSE o_orderdate + to_minutes((o_orderkey % 24) * 60 + 15) END, '%Y-%m-%d %H:%M:%S') AS ts FROM orders"""


def t7(spark, folder):
    line = table(spark, folder, "lineitem")
    main = B.main_key_column(ORDER_LOG.objects[1], line)
    return line.agg(F.countDistinct(main).alias("distinct_values")).select(F.lit(main).alias("main_column"), "distinct_values")


Q["t7_main_key_column"] = t7
SQL["t7_main_key_column"] = """SELECT CASE WHEN count(DISTINCT l_orderkey) > count(DISTINCT l_linenumber) THEN 'l_orderkey' ELSE 'l_linenumber' END AS main_column,
    greatest(count(DISTINCT l_orderkey), count(DISTINCT l_linenumber)) AS distinct_values FROM lineitem"""

_LINKS = "SELECT event_id, object_id, qualifier FROM {}"
Q["t8_links_by_reference"] = lambda spark, folder: order_log(spark, folder).e2o.where(
    F.col("qualifier") != "involves").select("event_id", "object_id", "qualifier")
SQL["t8_links_by_reference"] = sql(_LINKS.format("e2o WHERE qualifier <> 'involves'"))
Q["t8_links_by_bridge_and_split"] = lambda spark, folder: split_log(spark, folder).e2o.select("event_id", "object_id", "qualifier")
SQL["t8_links_by_bridge_and_split"] = sql(_LINKS.format("pe2o"))


def changes(spark, folder):
    """Status changes: every order against the previous order of its customer."""
    from pyspark.sql import Window
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    old = F.lag("o_orderstatus").over(w)
    return table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.lit("cust-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("-x")).alias("ref"),
        F.lit("status").alias("field"), F.when(old != "O", old).otherwise("").alias("old_value"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("new_value"))


CHANGES_SQL = """SELECT o_orderkey, 'cust-' || lpad(o_custkey::VARCHAR, 8, '0') || '-x' AS ref, 'status' AS field,
    CASE WHEN old <> 'O' THEN old ELSE '' END AS old_value, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE '' END AS new_value
    FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders)"""

COMPUTED = (ComputedColumn("changes", "change", "change", field="field", old="old_value", new="new_value"),
            ComputedColumn("changes", "customer", "slice", column="ref", start=5, length=8))

Q["t9_computed_change"] = lambda spark, folder: changes(spark, folder).groupBy(
    S.change_value("old_value", "new_value", "field").alias("change")).agg(F.count(F.lit(1)).alias("rows"))
_CHANGE = """CASE WHEN old_value = '' AND new_value <> '' THEN 'SET status' WHEN old_value <> '' AND new_value = '' THEN 'REMOVE status'
    WHEN old_value <> '' AND new_value <> '' THEN 'CHANGE status' ELSE '' END"""
SQL["t9_computed_change"] = f"SELECT {_CHANGE} AS change, count(*) AS rows FROM ({CHANGES_SQL}) GROUP BY 1"

Q["t10_computed_slice"] = lambda spark, folder: changes(spark, folder).select("o_orderkey", S.slice_value("ref", 5, 8).alias("customer"))
SQL["t10_computed_slice"] = f"SELECT o_orderkey, substring(ref, 6, 8) AS customer FROM ({CHANGES_SQL})"

Q["t11_computed_columns"] = lambda spark, folder: B.with_computed({"changes": changes(spark, folder)}, COMPUTED)["changes"].select(
    "o_orderkey", "change", "customer")
SQL["t11_computed_columns"] = f"SELECT o_orderkey, {_CHANGE} AS change, substring(ref, 6, 8) AS customer FROM ({CHANGES_SQL})"

Q["t12_objects"] = lambda spark, folder: order_log(spark, folder).objects.select(
    "object_id", "object_type", "key", F.explode_outer("attrs").alias("name", "value"))
SQL["t12_objects"] = sql("SELECT object_id, obj.object_type, key, name, value FROM obj LEFT JOIN attr USING (object_id)")

Q["t13_events"] = lambda spark, folder: order_log(spark, folder).events.select(
    "event_id", "activity", stamp(), "event_group", F.element_at("attrs", "l_linestatus").alias("l_linestatus"))
SQL["t13_events"] = sql(f"SELECT event_id, activity, {TS.format('ts')} AS ts, event_group, l_linestatus FROM ev")
Q["t13_links"] = lambda spark, folder: order_log(spark, folder).e2o.select(
    "event_id", "object_id", "object_type", "qualifier", "activity", stamp())
SQL["t13_links"] = sql(f"SELECT event_id, object_id, object_type, qualifier, activity, {TS.format('ts')} AS ts FROM e2o")

Q["t14_existing_objects_only"] = lambda spark, folder: (
    order_log(spark, folder).e2o.join(order_log(spark, folder).objects.select("object_id"), "object_id", "left_semi")
    .groupBy("object_type", "qualifier").agg(F.count(F.lit(1)).alias("links")))
SQL["t14_existing_objects_only"] = sql("SELECT object_type, qualifier, count(*) AS links FROM e2o GROUP BY 1, 2")

Q["t15_excluded_events"] = lambda spark, folder: split_log(spark, folder).events.select("event_id", "activity", "event_group")
SQL["t15_excluded_events"] = sql("SELECT event_id, activity, event_group FROM pev")

Q["t16_skips"] = lambda spark, folder: split_log(spark, folder).skips.groupBy("event_group", "source_table", "kind", "reason").agg(
    F.count(F.lit(1)).alias("rows"))
SQL["t16_skips"] = sql("""
    SELECT 'Item' AS event_group, 'lineitem' AS source_table, 'excluded' AS kind, 'value ''R'' of ''l_returnflag'' is left out' AS reason, count(*) AS rows
        FROM lineitem WHERE l_returnflag = 'R'
    UNION ALL SELECT 'Place Order', 'orders', 'excluded_object', 'value ''P'' of ''o_orderstatus'' is left out (Order)', count(*) FROM orders WHERE o_orderstatus = 'P'""")

Q["t17_type_catalogue"] = lambda spark, folder: (
    B.object_type_catalogue(SPLIT_LOG, split_log(spark, folder)).select(F.lit("object").alias("kind"), F.col("object_type").alias("name"))
    .unionByName(B.event_type_catalogue(SPLIT_LOG, split_log(spark, folder)).select(F.lit("event").alias("kind"), F.col("event_type").alias("name"))))
SQL["t17_type_catalogue"] = sql("""SELECT DISTINCT 'object' AS kind, object_type AS name FROM pobj
    UNION SELECT 'object', 'Customer' UNION SELECT DISTINCT 'event', activity FROM pev UNION SELECT 'event', 'Place Order'""")

Q["t18_build_statistics"] = lambda spark, folder: B.build_statistics(SPLIT_LOG, split_log(spark, folder)).unionByName(
    B.activity_counts(split_log(spark, folder)).select(F.concat_ws("/", F.lit("activity"), "event_group", "activity").alias("measure"),
                                                       F.col("events").alias("value"))).unionByName(
    B.unmapped_activity_values(SPLIT_LOG, split_log(spark, folder)).select(
        F.concat_ws("/", F.lit("unmapped"), "event_group", "value").alias("measure"), F.col("events").alias("value")))
SQL["t18_build_statistics"] = sql("""
    SELECT 'objects' AS measure, count(*) AS value FROM pobj
    UNION ALL SELECT 'events', count(*) FROM pev
    UNION ALL SELECT 'object_types', count(DISTINCT object_type) FROM pobj
    UNION ALL SELECT 'event_types', count(DISTINCT activity) FROM pev
    UNION ALL SELECT 'skipped', 0
    UNION ALL SELECT 'activity/' || event_group || '/' || activity, count(*) FROM pev GROUP BY 1
    UNION ALL SELECT 'unmapped/Item/A', count(*) FROM pev WHERE activity LIKE 'Item [%'""")

_MERGE_LOG = Mapping(
    objects=(ObjectRule("Order", "orders", ("o_orderkey",), ("o_orderstatus",)), ObjectRule("Customer", "customer", ("c_custkey",))),
    events=(EventRule("Place Order", "orders", "o_orderdate", attributes=("o_orderpriority",), row_key=("o_orderkey",)),),
    links=tuple(r for r in ORDER_LOG.links if r.event == "Place Order"))


def merged(spark, folder):
    """The orders up to 1998 merged with all orders since 1997, where open orders are now finished."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    year = F.year("o_orderdate")
    old = B.build(_MERGE_LOG, {"orders": orders.where(year <= 1998), "customer": customer})
    closed = orders.where(year >= 1997).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "O", "F").otherwise(F.col("o_orderstatus")))
    return B.merge_logs(old, B.build(_MERGE_LOG, {"orders": closed, "customer": customer}))


Q["t19_merge_counts"] = lambda spark, folder: merged(spark, folder)[1]
SQL["t19_merge_counts"] = """SELECT 'added_objects' AS measure, count(*) AS value FROM orders WHERE year(o_orderdate) > 1998
    UNION ALL SELECT 'updated_objects', count(*) FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998 AND o_orderstatus = 'O'
    UNION ALL SELECT 'added_events', count(*) FROM orders WHERE year(o_orderdate) > 1998"""


def t19_log(spark, folder):
    log, _ = merged(spark, folder)
    return (log.e2o.groupBy("object_id").agg(F.count(F.lit(1)).alias("events"), stamp_of(F.max("ts")))
            .join(log.objects, "object_id").select("object_id", "events", "ts", F.element_at("attrs", "o_orderstatus").alias("status")))


Q["t19_merged_log"] = t19_log
SQL["t19_merged_log"] = """
    SELECT 'Order:' || o_orderkey AS object_id, 1 AS events, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts,
        CASE WHEN year(o_orderdate) >= 1997 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS status FROM orders
    UNION ALL SELECT 'Customer:' || o_custkey, count(*), strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S'), NULL FROM orders GROUP BY 1"""

Q["t19_renumbered_events"] = lambda spark, folder: B.renumbered(order_log(spark, folder))
SQL["t19_renumbered_events"] = sql("SELECT event_id, 'e' || row_number() OVER (ORDER BY ts, event_id) AS number FROM ev")


def t21(spark, folder):
    log = B.build(ORDER_LOG, star(spark, folder))
    return (log.e2o.groupBy("object_type", "activity", "qualifier").agg(
        F.count(F.lit(1)).alias("links"), F.countDistinct("object_id").alias("objects"), F.countDistinct("event_id").alias("events")))


Q["t21_whole_build"] = t21
SQL["t21_whole_build"] = sql("""SELECT object_type, activity, qualifier, count(*) AS links, count(DISTINCT object_id) AS objects,
    count(DISTINCT event_id) AS events FROM e2o GROUP BY 1, 2, 3""")


def t21_copies(spark, folder):
    """Rows without a declared key: identical rows stay separate events."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag")
    rules = Mapping(objects=(ObjectRule("Supplier", "supplier", ("s_suppkey",)),),
                    events=(EventRule("Ship", "lines", "l_shipdate", activity_column="l_returnflag"),),
                    links=(data.LinkRule("Ship", "lines", "l_suppkey", "Supplier"),))
    log = B.build(rules, {"lines": lines, "supplier": table(spark, folder, "supplier")})
    return log.e2o.groupBy("object_id", "activity").agg(F.countDistinct("event_id").alias("events"))


Q["t21_build_identical_rows"] = t21_copies
SQL["t21_build_identical_rows"] = """SELECT 'Supplier:' || l_suppkey AS object_id, l_returnflag AS activity, count(*) AS events
    FROM lineitem GROUP BY 1, 2"""
