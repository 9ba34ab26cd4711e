"""Queries of the readers, the writers and the schema discovery."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.data import order_log, session_log, table
from catalog.sqlparts import sql
from tracewright.functions import scalars as S
from tracewright.operators import profile as P
from tracewright.session import settle, shared_folder
from tracewright.sources import files, ocel

Q, SQL = {}, {}


def scratch(spark):
    return f"{shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"


def s1(spark, folder):
    """Customers written as CSV and read back as text; 'NULL' and 'n/a' mean no value."""
    path = scratch(spark)
    c = table(spark, folder, "customer")
    segment = F.when(F.col("c_custkey") % 7 == 0, "NULL").when(F.col("c_custkey") % 7 == 1, "n/a").otherwise(F.col("c_mktsegment"))
    c.withColumn("c_mktsegment", segment).write.option("header", True).csv(path)
    return files.read_csv(spark, path)


Q["s1_csv_scan"] = s1
SQL["s1_csv_scan"] = """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal,
    CASE WHEN c_custkey % 7 > 1 THEN c_mktsegment END AS c_mktsegment FROM customer"""


def s1_line_breaks(spark, folder):
    """Names with line breaks, quotes and separators, written as CSV and read back."""
    path = scratch(spark)
    c = table(spark, folder, "customer")
    name = F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('", '), F.repeat(F.lit("line\n"), F.pmod("c_custkey", F.lit(4)).cast("int")), F.lit("end"))
    c.select("c_custkey", name.alias("note"), "c_mktsegment").write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(spark, path)


Q["s1_csv_line_breaks"] = s1_line_breaks
SQL["s1_csv_line_breaks"] = """SELECT c_custkey::VARCHAR AS c_custkey, c_mktsegment,
    c_name || chr(10) || '"' || c_mktsegment || '", ' || repeat('line' || chr(10), (c_custkey % 4)::INTEGER) || 'end' AS note FROM customer"""


def typed(spark, folder):
    """One column per kind of content, from the orders."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("erdat"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30")).alias("clock"),
        F.concat(((k % 14) + 10).cast("string"), F.lit("1500")).alias("event_time"), k.cast("string").alias("number"),
        F.col("o_totalprice").cast("string").alias("price"), F.when(k % 2 == 0, "yes").otherwise("no").alias("flag"),
        F.col("o_orderpriority").alias("priority"), F.lit(None).cast("string").alias("nothing"))


def values(spark, folder):
    return settle(P.value_counts({"typed": typed(spark, folder)}), "values")


Q["s3_column_statistics"] = lambda spark, folder: P.schema_discovery(values(spark, folder)).select(
    "column", "rows", "null_ratio", "distinct_ratio", F.array_join("samples", ", ").alias("samples"))
_TYPED = {"ty": """SELECT strftime(o_orderdate, '%Y%m%d') AS erdat, strftime(o_orderdate, '%d.%m.%Y') AS day, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' AS clock,
    (o_orderkey % 14 + 10) || '1500' AS event_time, o_orderkey::VARCHAR AS number, o_totalprice::VARCHAR AS price, CASE o_orderkey % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS flag, o_orderpriority AS priority FROM orders""",
          "vals": "SELECT * FROM (UNPIVOT ty ON COLUMNS(*) INTO NAME col VALUE value)"}
SQL["s3_column_statistics"] = sql("""SELECT col AS "column", count(*) AS rows, 0.0 AS null_ratio, round(count(DISTINCT value) / count(*), 3) AS distinct_ratio,
    array_to_string(list_sort(list_distinct(list(value)))[1:5], ', ') AS samples FROM vals GROUP BY 1
    UNION ALL SELECT 'nothing', count(*), 1.0, 0.0, NULL FROM orders""", _TYPED)

Q["s4_type_inference"] = lambda spark, folder: P.column_statistics(values(spark, folder)).select("column", P.inferred_type().alias("inferred_type"))
SQL["s4_type_inference"] = """SELECT * FROM (VALUES ('erdat', 'date'), ('day', 'date'), ('clock', 'time'), ('event_time', 'time'), ('number', 'integer'), ('price', 'float'),
    ('flag', 'boolean'), ('priority', 'string'), ('nothing', 'string')) t("column", inferred_type) WHERE (SELECT count(*) FROM orders) > 0"""


def s5(spark, folder):
    e = table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 6
    text = (F.when(kind == 0, F.date_format(ts, "HH:mm:ss")).when(kind == 1, F.date_format(ts, "HH:mm")).when(kind == 2, F.date_format(ts, "HHmmss"))
            .when(kind == 3, F.concat(F.date_format(ts, "HHmmss").cast("int").cast("string"), F.lit(".0"))).when(kind == 4, F.date_format(ts, "HH:mm:ss.SSS"))
            .otherwise("99:99"))
    return e.select("event_id", S.seconds_of_day(text).cast("long").alias("seconds"))


Q["s5_time_of_day"] = s5
SQL["s5_time_of_day"] = """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 1 THEN hour(ts) * 3600 + minute(ts) * 60
    WHEN 3 THEN CASE WHEN hour(ts) > 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END ELSE hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS seconds FROM events
    WHERE NOT (event_id % 6 = 3 AND hour(ts) = 0) UNION ALL
    SELECT event_id, CASE WHEN minute(ts) >= 10 AND false THEN 0 END FROM events WHERE event_id % 6 = 3 AND hour(ts) = 0"""

Q["s6_time_columns"] = lambda spark, folder: P.column_statistics(values(spark, folder)).where(F.col("filled") > 0).select(
    "column", ((F.col("time_text") > 0.95 * F.col("filled")) | (F.col("column").rlike(P.fixed.TIME_NAME) & (F.col("time_any") > 0.95 * F.col("filled")))).alias("is_time"))
SQL["s6_time_columns"] = sql("""SELECT col AS "column", col IN ('clock', 'event_time') AS is_time FROM vals GROUP BY 1""", _TYPED)


def dated(spark, folder):
    o = table(spark, folder, "orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey", d.alias("issued"), F.date_add(d, F.when(F.col("o_orderkey") % 2 == 0, 30).otherwise(60)).alias("pay_by"),
                    F.date_add(d, (F.col("o_orderkey") % 97).cast("int")).alias("shipped"), F.date_add(d, 1).alias("due_base"),
                    F.date_add(d, F.lit(1500)).alias("EINDT"), F.date_add(d, F.lit(1300) + (F.col("o_orderkey") % 211).cast("int")).alias("review"))


Q["s8_planned_dates"] = lambda spark, folder: P.planned_dates(
    dated(spark, folder), "invoices", ["issued", "pay_by", "shipped", "due_base", "EINDT", "review"], "2001-01-01")
SQL["s8_planned_dates"] = """SELECT * FROM (VALUES ('invoices', 'EINDT', 'code'), ('invoices', 'due_base', 'name'), ('invoices', 'review', 'future'), ('invoices', 'pay_by', 'offset from issued')) t("table", "column", reason)
    WHERE (SELECT avg((o_orderdate + to_days(1300 + (o_orderkey % 211)::INTEGER) > TIMESTAMP '2001-01-01')::INTEGER) FROM orders) >= 0.2"""

Q["s9_without_empty_columns"] = lambda spark, folder: files.without_empty_columns(typed(spark, folder)).unpivot([], [
    "erdat", "day", "clock", "event_time", "number", "price", "flag", "priority"], "column", "value").groupBy("column").agg(F.count("value").alias("values"))
SQL["s9_without_empty_columns"] = sql("""SELECT col AS "column", count(*) AS values FROM vals GROUP BY 1""", _TYPED)


def exported(spark, folder):
    path = scratch(spark)
    ocel.write_json(session_log(spark, folder), path)
    return path


def s12(spark, folder):
    path = exported(spark, folder)
    events = spark.read.schema(ocel.EVENT_SCHEMA).json(f"{path}/events")
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("relationships")).alias("links"), F.max("time").alias("last"))


Q["s12_json_export"] = s12
SQL["s12_json_export"] = sql("""SELECT activity AS type, count(DISTINCT event_id) AS events, count(*) AS links, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last FROM se2o GROUP BY 1""")


def s13(spark, folder):
    log = ocel.read_json_lines(spark, exported(spark, folder))
    return log.e2o.groupBy("object_type", "qualifier", "activity").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("object_id").alias("objects"),
                                                                     F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"))


Q["s13_json_import"] = s13
SQL["s13_json_import"] = sql("""SELECT object_type, qualifier, activity, count(*) AS links, count(DISTINCT object_id) AS objects, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM se2o GROUP BY 1, 2, 3""")

def s13_document(spark, folder):
    """The session log written as one document, and the links of what is read back."""
    path = scratch(spark)
    ocel.write_document(session_log(spark, folder), path)
    log = ocel.read_document(spark, path)
    return log.e2o.groupBy("object_type", "qualifier", "activity").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("object_id").alias("objects"),
                                                                     F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"))


Q["s13_document"] = s13_document
SQL["s13_document"] = SQL["s13_json_import"]

Q["s14_flat_objects"] = lambda spark, folder: ocel.flat_objects(order_log(spark, folder), "Order").select(
    "object_id", F.element_at("attrs", "o_orderstatus").alias("status"), "events", F.date_format("first", "yyyy-MM-dd").alias("first"),
    F.date_format("last", "yyyy-MM-dd").alias("last"), "duration_days", "activities")
SQL["s14_flat_objects"] = sql("""SELECT object_id, o_orderstatus AS status, count(*) AS events, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last,
    round((epoch(max(ts)) - epoch(min(ts))) / 86400, 1) AS duration_days, substring(string_agg(activity, ' > ' ORDER BY ts, activity), 1, 400) AS activities
    FROM e2o JOIN orders ON 'Order:' || o_orderkey = object_id WHERE object_type = 'Order' GROUP BY 1, 2""")
Q["s14_flat_events"] = lambda spark, folder: ocel.flat_events(session_log(spark, folder)).select("event_id", "activity", "objects", F.element_at("attrs", "k").alias("k"))
SQL["s14_flat_events"] = sql("""SELECT '1|' || event_id AS event_id, e.activity, string_agg(object_id, ' ' ORDER BY object_id) AS objects, any_value(k) AS k FROM se2o e JOIN act ON act.eid = e.event_id GROUP BY 1, 2""")
