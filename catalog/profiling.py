"""Queries of the table profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.building import changes
from catalog.data import STAR, star, table
from tracewright.operators import profile as P

Q, SQL = {}, {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
_MEMO: dict = {}


def memo(spark, folder, name, make):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def star_profile(spark, folder):
    return memo(spark, folder, "star", lambda: P.Profile(star(spark, folder), {"orders": ["o_orderdate"], "lineitem": ["l_shipdate"]}))


def log_tables(spark, folder):
    """A ticket log made of the events, its users, finished orders, and a change log with composite references."""
    e = table(spark, folder, "events")
    name = F.col("event_type")
    log = e.select(F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("log_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticket_id"),
                   F.concat(F.lit("SET_"), F.upper(name)).alias("event_name"), F.upper(name).alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"),
                   F.when(name.isin("error", "click"), F.concat(F.lit("because of "), name)).alias("hold_reason"), F.col("value").alias("amount"),
                   F.when(F.col("event_id") % 3 == 0, "30").otherwise("60").alias("payment_days"))
    users = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticket_id"), (F.col("user_id") % 3).cast("string").alias("priority_type")).distinct()
    o = table(spark, folder, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
                      F.col("o_orderstatus").alias("status"))
    closed = orders.where("status = 'F'")
    history = changes(spark, folder).select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("change_id"), "ref", F.lit("2001-05-01").alias("changed_on"), "field", "old_value", "new_value")
    people = table(spark, folder, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("person_no"), F.col("c_mktsegment").alias("field_of_work"))
    return {"ticket_log": log, "tickets": users, "orders": orders, "closed_orders": closed, "history": history, "people": people}


def log_profile(spark, folder):
    return memo(spark, folder, "log", lambda: P.Profile(log_tables(spark, folder), {
        "ticket_log": ["event_date"], "orders": ["created"], "closed_orders": ["created"], "history": ["changed_on"]}))


LOG = """WITH tl AS (SELECT 'L' || event_id AS log_id, 'U' || user_id AS ticket_id, 'SET_' || upper(event_type) AS event_name, upper(event_type) AS status, strftime(ts, '%Y-%m-%d') AS event_date,
    CASE WHEN event_type IN ('error', 'click') THEN 'because of ' || event_type END AS hold_reason, value AS amount, CASE event_id % 3 WHEN 0 THEN '30' ELSE '60' END AS payment_days FROM events),
    ch AS (SELECT o_orderkey, o_custkey, CASE WHEN old <> 'O' THEN old ELSE '' END AS o, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus ELSE '' END AS n
        FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders)),
    kinds AS (SELECT *, CASE WHEN coalesce(o, '') = '' AND n <> '' THEN 'SET' WHEN o <> '' AND n = '' THEN 'REMOVE' WHEN o <> '' AND n <> '' THEN 'CHANGE' ELSE '' END AS kind FROM ch)
    """


def p1(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey") % 6
    d = F.col("o_orderdate").cast("timestamp")
    text = (F.when(k == 0, "00000000").when(k == 1, "9999-12-31").when(k == 2, F.date_format(d, "yyyyMMdd")).when(k == 3, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
            .when(k == 4, F.date_format(d, "dd.MM.yyyy")).otherwise("soon"))
    return o.select("o_orderkey", F.date_format(P.parsed_date(text), "yyyy-MM-dd").alias("day"))


Q["p1_date_parsing"] = p1
SQL["p1_date_parsing"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 3, 4) THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"

Q["p2_empty_tables"] = lambda spark, folder: P.duplicate_rows({**star(spark, folder), "old_orders": table(spark, folder, "orders").where("o_orderdate < '1900-01-01'")}).where("rows = 0").select("table", "rows")
SQL["p2_empty_tables"] = "SELECT 'old_orders' AS \"table\", count(*) AS rows FROM orders WHERE o_orderdate < '1900-01-01'"


def p3(spark, folder):
    line = table(spark, folder, "lineitem")
    return P.duplicate_rows({"lineitem": line, "flags": line.select("l_returnflag", "l_linestatus", "l_suppkey"), "orders": table(spark, folder, "orders")})


Q["p3_duplicate_rows"] = p3
SQL["p3_duplicate_rows"] = """SELECT 'lineitem' AS "table", count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates FROM lineitem
    UNION ALL SELECT 'flags', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem)) FROM lineitem
    UNION ALL SELECT 'orders', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) FROM orders"""


def p4(spark, folder):
    t = table(spark, folder, "nation").withColumns({"nothing": F.lit(None).cast("string"), "planet": F.lit("Earth"), "blank": F.lit("  ")})
    return P.Profile({"nation": t}).empty_and_constant()


Q["p4_empty_and_constant"] = p4
SQL["p4_empty_and_constant"] = """SELECT * FROM (VALUES ('nation', 'nothing', 'empty'), ('nation', 'blank', 'empty'), ('nation', 'planet', 'constant')) t("table", "column", finding) WHERE (SELECT count(*) FROM nation) > 0"""


def p5(spark, folder):
    p = star_profile(spark, folder)
    return spark.createDataFrame([(t, i, c) for t in p.tables for i, c in enumerate(p.key_columns(t))], "table string, position long, column string")


_COLS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_regionkey", "n_name"], "customer": ["c_custkey", "c_nationkey", "c_name", "c_mktsegment"],
         "supplier": ["s_suppkey", "s_nationkey", "s_name"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
         "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
         "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]}
Q["p5_key_columns"] = p5
SQL["p5_key_columns"] = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i}, '{c}')" for t, cs in _COLS.items() for i, c in enumerate(cs)) + """) t("table", position, "column")
    WHERE (SELECT count(*) FROM orders) > 0"""


def p6(spark, folder):
    p = star_profile(spark, folder)
    return spark.createDataFrame([(t, "+".join(k) if k else None) for t, k in p.keys.items()], "table string, key string")


_PAIRS = [("l_orderkey", "l_partkey"), ("l_orderkey", "l_suppkey"), ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey"), ("l_partkey", "l_linenumber"), ("l_suppkey", "l_linenumber")]
Q["p6_candidate_keys"] = p6
SQL["p6_candidate_keys"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", CASE WHEN count(DISTINCT {k}) = count(*) THEN '{k}' END AS key FROM {t}" for t, k in KEYS.items()) + (
    " UNION ALL SELECT 'lineitem', CASE " + " ".join(f"WHEN count(DISTINCT ({a}, {b})) = count(*) THEN '{a}+{b}'" for a, b in _PAIRS) + " END FROM lineitem")


def dates(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 11 == 0, "9999-12-31").when(k % 11 == 1, "unknown").when(k % 11 == 2, None).otherwise(F.date_format(d, "yyyy-MM-dd"))
    clock = F.when(k % 2 == 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00"))).otherwise("00:00:00")
    return o.select(text.alias("created"), clock.alias("created_at"), F.date_format(d, "yyyyMMdd").alias("plain"))


PERIOD = ("1996-01-01", "2003-12-31")
Q["p7_date_columns"] = lambda spark, folder: P.date_profile(dates(spark, folder), "orders", {"created": "created_at", "plain": None}, "2000-06-30", PERIOD)
SQL["p7_date_columns"] = """WITH d AS (SELECT o_orderkey % 11 AS k, CASE WHEN o_orderkey % 11 > 2 THEN o_orderdate + to_hours(CASE o_orderkey % 2 WHEN 0 THEN o_orderkey % 24 ELSE 0 END) END AS ts FROM orders)
    SELECT 'orders' AS "table", 'created' AS "column", 'created_at' AS time_column, round_even(100 * count(*) FILTER (k <> 2) / count(*), 0)::BIGINT AS filled_pct, strftime(min(ts), '%Y-%m-%d') AS min, strftime(max(ts), '%Y-%m-%d') AS max,
        true AS has_time, count(*) FILTER (k = 0) AS placeholders, count(*) FILTER (ts > '2000-06-30') AS future, count(*) FILTER (k = 1) AS unparsable,
        count(*) FILTER (ts < '1996-01-01' AND ts <= '2000-06-30') AS outside_period, round_even(100 * (1 - count(*) FILTER (date_trunc('day', ts) <> ts) / count(ts)), 0)::BIGINT AS midnight_pct FROM d
    UNION ALL SELECT 'orders', 'plain', NULL, 100, strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'), false, 0, count(*) FILTER (o_orderdate > '2000-06-30'), 0,
        count(*) FILTER (o_orderdate < '1996-01-01'), NULL FROM orders"""

Q["p8_no_time_of_day"] = lambda spark, folder: P.date_profile(dates(spark, folder), "orders", {"plain": None}, "2000-06-30").agg((~F.max("has_time")).alias("no_time"))
SQL["p8_no_time_of_day"] = "SELECT bool_and(date_trunc('day', o_orderdate) = o_orderdate) AS no_time FROM orders"


def p9(spark, folder):
    a = P.date_profile(table(spark, folder, "orders"), "orders", {"o_orderdate": None}, "2005-01-01")
    b = P.date_profile(table(spark, folder, "events"), "events", {"ts": None}, "2025-01-01")
    return P.period_gaps(a.unionByName(b), ("1994-01-01", "2010-12-31"))


Q["p9_period_gaps"] = p9
SQL["p9_period_gaps"] = """SELECT t AS "table", a > DATE '1994-01-01' + 31 AS starts_late, b < DATE '2010-12-31' - 31 AS ends_early, missing AS missing_days,
    CASE WHEN missing > 6208 / 4.0 THEN 'attention' ELSE 'info' END AS severity FROM (
    SELECT *, CASE WHEN a - DATE '1994-01-01' > 31 THEN a - DATE '1994-01-01' ELSE 0 END + CASE WHEN DATE '2010-12-31' - b > 31 THEN DATE '2010-12-31' - b ELSE 0 END AS missing FROM (
        SELECT 'orders' AS t, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders UNION ALL SELECT 'events', min(ts)::DATE, max(ts)::DATE FROM events)) WHERE missing > 0"""

_CHILD = {c: t for t, cs in {**_COLS, "customer": [*_COLS["customer"], "c_acctbal"], "supplier": [*_COLS["supplier"], "s_acctbal"], "part": [*_COLS["part"], "p_retailprice"],
                             "orders": [*_COLS["orders"], "o_totalprice", "o_orderdate"],
                             "lineitem": [*_COLS["lineitem"], "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]}.items() for c in cs}
Q["p10_relationships"] = lambda spark, folder: star_profile(spark, folder).relationships
SQL["p10_relationships"] = "WITH vals AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 3" for c, t in _CHILD.items()) + """),
    sz AS (SELECT t, c, count(*) AS d, sum(n)::BIGINT AS n FROM vals GROUP BY 1, 2),
    tn AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS rows, '{KEYS.get(t, '')}' AS key, {i} AS place FROM {t}" for i, t in enumerate(STAR)) + """),
    met AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, count(*) AS k, sum(a.n)::BIGINT AS kn FROM vals a JOIN vals b ON a.v = b.v AND a.t <> b.t JOIN tn p ON p.t = b.t AND p.key = b.c GROUP BY 1, 2, 3, 4),
    ok AS (SELECT m.*, s.n, round(100 * kn / s.n, 1) AS cov, p.place FROM met m JOIN sz s ON s.t = m.t AND s.c = m.c JOIN tn p ON p.t = m.pt JOIN tn ch ON ch.t = m.t
        WHERE s.d >= 2 AND k >= 0.5 * s.d AND NOT (ch.key = m.c AND (ch.rows, m.pt) > (p.rows, m.t)))
    SELECT t AS child_table, c AS child_column, pt AS parent_table, pc AS parent_column, cov AS coverage_pct, n - kn AS orphan_rows, 'values' AS matched_by FROM (
        SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY cov DESC, place) AS r FROM ok) WHERE r = 1"""

Q["p11_embedded_keys"] = lambda spark, folder: log_profile(spark, folder).embedded_keys()
SQL["p11_embedded_keys"] = """SELECT 'history' AS child_table, 'ref' AS child_column, 'people' AS parent_table, 'person_no' AS parent_column, 5 AS start, 8 AS length,
    round(100 * count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer)) / count(*), 1) AS coverage_pct FROM orders"""

Q["p12_copies"] = lambda spark, folder: log_profile(spark, folder).copies()
SQL["p12_copies"] = "SELECT 'closed_orders' AS \"table\", 'orders' AS of, 1.0 AS share, count(*) AS rows, '' AS extra, '' AS new, true AS exclude FROM orders WHERE o_orderstatus = 'F'"

Q["p13_activity_columns"] = lambda spark, folder: log_profile(spark, folder).activity_values().where("table = 'ticket_log'").select("table", "column", "value", "rows")
SQL["p13_activity_columns"] = LOG + "SELECT 'ticket_log' AS \"table\", 'event_name' AS \"column\", event_name AS value, count(*) AS rows FROM tl GROUP BY 3"


def p14(spark, folder):
    p = log_profile(spark, folder)
    rows = [(a, b, p.same_partition("ticket_log", a, b)) for a, b in (("event_name", "status"), ("event_name", "payment_days"), ("ticket_id", "event_name"))]
    return spark.createDataFrame(rows, "a string, b string, same boolean")


Q["p14_same_partition"] = p14
SQL["p14_same_partition"] = LOG + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, (SELECT max(k) FROM (SELECT count(DISTINCT {b}) AS k FROM tl GROUP BY {a})) = 1 AND (SELECT max(k) FROM (SELECT count(DISTINCT {a}) AS k FROM tl GROUP BY {b})) = 1 AS same"
    for a, b in (("event_name", "status"), ("event_name", "payment_days"), ("ticket_id", "event_name")))

Q["p15_type_columns"] = lambda spark, folder: log_profile(spark, folder).type_columns()
SQL["p15_type_columns"] = "SELECT 'tickets' AS \"table\", 'priority_type' AS \"column\", (user_id % 3)::VARCHAR AS value, count(DISTINCT user_id) AS rows FROM events GROUP BY 3"

Q["p16_reason_columns"] = lambda spark, folder: log_profile(spark, folder).reason_columns()
SQL["p16_reason_columns"] = LOG + "SELECT 'ticket_log' AS \"table\", 'hold_reason' AS \"column\", hold_reason AS value, count(*) AS rows FROM tl WHERE hold_reason IS NOT NULL GROUP BY 3"

Q["p17_days_columns"] = lambda spark, folder: log_profile(spark, folder).days_columns()
SQL["p17_days_columns"] = LOG + "SELECT 'ticket_log' AS \"table\", 'payment_days' AS \"column\" FROM tl HAVING max(payment_days::INTEGER) <= 400"

Q["p18_value_domains"] = lambda spark, folder: log_profile(spark, folder).domains("history").where("name IN ('STATUS', 'PRIORITY', 'EVENT_NAME')")
SQL["p18_value_domains"] = LOG + """SELECT DISTINCT 'STATUS' AS name, o_orderstatus AS value FROM orders UNION SELECT 'STATUS', status FROM tl UNION SELECT 'PRIORITY', o_orderpriority FROM orders
    UNION SELECT 'EVENT_NAME', event_name FROM tl"""

Q["p19_change_log"] = lambda spark, folder: log_profile(spark, folder).change_counts("history")
SQL["p19_change_log"] = LOG + "SELECT 'status' AS field, kind, count(*) AS rows FROM kinds WHERE kind <> '' GROUP BY 2"


def foreign(spark, folder):
    """A log whose 'priority' field holds values of the status."""
    t = log_tables(spark, folder)
    bad = t["history"].where(F.col("old_value") != "").withColumn("field", F.lit("priority"))
    return P.Profile({"history": t["history"].unionByName(bad), "orders": t["orders"]}, {"history": ["changed_on"]})


Q["p19_foreign_values"] = lambda spark, folder: foreign(spark, folder).foreign_values("history")
SQL["p19_foreign_values"] = LOG + """SELECT 'priority' AS field, side, 'STATUS' AS other FROM (
    SELECT 'old' AS side, bool_and(o NOT IN (SELECT o_orderpriority FROM orders)) AS strange FROM kinds WHERE o <> '' UNION ALL
    SELECT 'new', bool_and(n NOT IN (SELECT o_orderpriority FROM orders)) FROM kinds WHERE o <> '' AND n <> '') WHERE strange"""


def p20(spark, folder):
    t = log_tables(spark, folder)["history"]
    only = t.where("old_value = ''").withColumn("field", F.lit("hold"))
    return P.Profile({"history": t.unionByName(only)}).never_removed("history")


Q["p20_never_removed"] = p20
SQL["p20_never_removed"] = LOG + "SELECT 'hold' AS field, count(*) AS sets FROM kinds WHERE coalesce(o, 'x') = '' AND n <> '' HAVING count(*) >= 3"


def p21(spark, folder):
    """Operations SET_<type> of the log; purchases are also reset, errors removed."""
    log = log_tables(spark, folder)["ticket_log"]
    more = log.where("status IN ('PURCHASE', 'ERROR')").withColumn("event_name", F.when(F.col("status") == "ERROR", "REMOVE_ERROR").otherwise("reset purchase"))
    return P.Profile({"ticket_log": log.unionByName(more)}).missing_opposites()


Q["p21_missing_opposites"] = p21
SQL["p21_missing_opposites"] = "SELECT DISTINCT 'ticket_log' AS \"table\", 'event_name' AS \"column\", 'SET_' || upper(event_type) AS value, 'REMOVE' AS opposite FROM events WHERE event_type NOT IN ('purchase', 'error')"

Q["p22_isolated_tables"] = lambda spark, folder: P.Profile({**{n: table(spark, folder, n) for n in ("region", "nation")}, "benchmark": table(spark, folder, "benchmark").select("text")}).isolated_tables()
SQL["p22_isolated_tables"] = "SELECT 'benchmark' AS \"table\" FROM benchmark LIMIT 1"


def p23(spark, folder):
    some = table(spark, folder, "customer").where(F.col("c_custkey") % 5 > 0)
    return P.Profile({"customer": some.select("c_custkey", "c_name"), "orders": table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")}).low_coverage()


Q["p23_low_coverage"] = p23
SQL["p23_low_coverage"] = """SELECT 'orders' AS child_table, 'c_custkey' AS child_column, 'customer' AS parent_table, 'c_custkey' AS parent_column, round(100 * count(*) FILTER (o_custkey % 5 > 0) / count(*), 1) AS coverage_pct,
    count(*) FILTER (o_custkey % 5 = 0) AS orphan_rows, 'name and values' AS matched_by FROM orders"""

Q["p24_ranked_issues"] = lambda spark, folder: P.ranked_issues(P.issues(log_profile(spark, folder), "2010-01-01", (None, None))).select(
    F.col("position").cast("long").alias("position"), "severity", "table", "issue", "subject", "rows", "verdict")

Q["p26_value_summary"] = lambda spark, folder: star_profile(spark, folder).value_summary().select("table", "column", "value", "rows", F.col("rank").cast("long").alias("rank"))
SQL["p26_value_summary"] = "WITH vals AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::VARCHAR AS v, count(*) AS n FROM {t} GROUP BY 3" for c, t in _CHILD.items()) + """)
    SELECT t AS "table", c AS "column", v AS value, n AS rows, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY n DESC, v) AS r, count(*) OVER (PARTITION BY t, c) AS k FROM vals) WHERE k <= 25 AND r <= 12"""
