"""Ad-hoc queries on the given tables."""

from __future__ import annotations

from catalog.data import table
from tracewright.operators import adhoc as A

Q, SQL = {}, {}

TESTS = {
    "eq": ("o_orderstatus", "F", "o_orderstatus = 'F'"), "ne": ("o_orderstatus", "F", "o_orderstatus <> 'F'"),
    "in": ("o_orderpriority", ["1-URGENT", "5-LOW"], "o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "not_in": ("o_orderpriority", ["1-URGENT", "5-LOW"], "o_orderpriority NOT IN ('1-URGENT', '5-LOW')"),
    "contains": ("o_orderpriority", "igh", "contains(lower(o_orderpriority), 'igh')"), "startswith": ("o_orderpriority", "4-n", "starts_with(lower(o_orderpriority), '4-n')"),
    "empty": ("o_orderpriority", None, "o_orderpriority IS NULL OR trim(o_orderpriority) = ''"), "not_empty": ("o_orderpriority", None, "trim(o_orderpriority) <> ''"),
    "gt": ("o_totalprice", "400000", "o_totalprice > 400000"), "lt": ("o_orderdate", "1995-06", "o_orderdate::VARCHAR < '1995-06'"),
}


def q1(spark, folder):
    from pyspark.sql import functions as F
    o = table(spark, folder, "orders")
    return o.agg(*[F.count_if(A.predicate(c, op, v)).alias(op + "_rows") for op, (c, v, _) in TESTS.items()])


Q["q1_row_filters"] = q1
SQL["q1_row_filters"] = "SELECT " + ", ".join(f"count(*) FILTER ({t}) AS {op}_rows" for op, (_, _, t) in TESTS.items()) + " FROM orders"

WHERE = [{"column": "o_totalprice", "op": "gt", "value": "100000"}, {"column": "o_orderstatus", "op": "ne", "value": "P"}]
Q["q2_group_counts"] = lambda spark, folder: A.group_counts(table(spark, folder, "orders"), ["o_orderstatus", "o_custkey"], WHERE)
SQL["q2_group_counts"] = """SELECT o_orderstatus, o_custkey::VARCHAR AS o_custkey, count(*) AS rows, count(*) OVER () AS distinct_groups FROM orders
    WHERE o_totalprice > 100000 AND o_orderstatus <> 'P' GROUP BY 1, 2 ORDER BY rows DESC, 1, 2 LIMIT 40"""

Q["q3_sample_rows"] = lambda spark, folder: A.sample_rows(table(spark, folder, "orders"), WHERE, ["o_orderkey", "o_orderstatus"], 20)


def q4(spark, folder):
    return A.containment(table(spark, folder, "orders"), "o_custkey", table(spark, folder, "supplier"), "s_suppkey")


def q4_part(spark, folder):
    return A.containment(table(spark, folder, "customer"), "c_name", table(spark, folder, "supplier"), "s_name", start=8, length=10)


def _q4(a, x, b, y):
    return f"""WITH v AS (SELECT {x} AS v FROM {a}), t AS (SELECT DISTINCT {y} AS v FROM {b}),
        d AS (SELECT DISTINCT v, v IN (SELECT v FROM t) AS hit FROM v WHERE v <> '')
    SELECT count(*) AS distinct_values, count(*) FILTER (hit) AS found, (SELECT count(*) FROM v) AS rows_in_table, (SELECT count(*) FROM v WHERE v <> '') AS rows_with_value,
        coalesce((SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM d WHERE hit ORDER BY v LIMIT 5)), '') AS examples_found,
        coalesce((SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM d WHERE NOT hit ORDER BY v LIMIT 5)), '') AS examples_not_found,
        round(100 * count(*) FILTER (hit) / count(*), 1) AS found_pct FROM d"""


Q["q4_containment"] = q4
SQL["q4_containment"] = _q4("orders", "o_custkey::VARCHAR", "supplier", "s_suppkey::VARCHAR")
Q["q4_containment_of_part"] = q4_part
SQL["q4_containment_of_part"] = _q4("customer", "substring(c_name, 9, 10)", "supplier", "s_name")
