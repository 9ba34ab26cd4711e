"""Queries of the KPI engine on the order log."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import order_log, table
from catalog.sqlparts import sql
from tracewright.functions import scalars as S
from tracewright.operators import filters as X
from tracewright.operators import model
from tracewright.operators.kpi import charts as C
from tracewright.operators.kpi import measures as M
from tracewright.operators.kpi import periods as P
from tracewright.operators.kpi import tower
from tracewright.operators.kpi.compile import Compiler, kpi_rows
from tracewright.operators.kpi.dimensions import dimension_values, grouped

Q, SQL = {}, {}
r4 = lambda c, name=None: F.round(c, 4).alias(name or c)
r6 = lambda c, name=None: F.round(c, 6).alias(name or c)

RETURNED = {"op": "activity", "activities": ["Return Item"]}
LATE = {"op": "duration", "from": {"activity": "Place Order"}, "to": {"activity": "Ship Item", "which": "last"}, "cmp": "gt", "days": 700}
URGENT = {"op": "attribute", "attribute": "o_orderpriority", "cmp": "in", "values": ["1-URGENT", "2-HIGH"]}
FINISHED = {"op": "user", "activities": ["Return Item", "Accept Item"], "attributes": ["l_linestatus"], "exclude": ["O*"]}

K_SHARE = {"id": "k1", "name": "Returned", "object_type": "Order", "measure": "share", "condition": RETURNED, "amount": "o_totalprice",
           "target": {"op": "<=", "value": 40}}
K_COUNT = {"id": "k2", "object_type": "Order", "measure": "count", "population": URGENT, "condition": LATE}
K_SUM = {"id": "k3", "object_type": "Order", "measure": "sum", "amount": "o_totalprice", "condition": FINISHED,
         "target": {"op": ">=", "value": 1000000}}
K_SHARE_AMOUNT = {"id": "k4", "object_type": "Order", "measure": "share_amount", "amount": "o_totalprice",
                  "condition": {"op": "all", "items": [RETURNED, {"op": "not", "item": URGENT}]}, "target": {"op": ">=", "value": 60}}
K_DAYS = {"id": "k5", "name": "Days", "object_type": "Order", "measure": "duration", "better": "lower",
          "duration": {"from": {"activity": "Place Order"}, "to": {"activity": "Ship Item"}, "stat": "median"}}
K_MEAN = {**K_DAYS, "id": "k6", "duration": {**K_DAYS["duration"], "stat": "mean"}}
K_P90 = {**K_DAYS, "id": "k7", "duration": {**K_DAYS["duration"], "stat": "p90"}}
ALL = [K_SHARE, K_COUNT, K_SUM, K_SHARE_AMOUNT, K_DAYS, K_MEAN, K_P90]

# per order: what the definitions need
_O = {"o": """
    SELECT 'Order:' || o_orderkey AS object_id, any_value(o_orderpriority) AS pr, any_value(o_totalprice) AS amt, any_value(o_orderstatus) AS status, any_value(o_custkey) AS ck,
        least(any_value(o_orderdate), min(l_shipdate)) AS start_ts, strftime(least(any_value(o_orderdate), min(l_shipdate)), '%Y-%m') AS sm,
        count(*) FILTER (l_returnflag = 'R') AS nr, count(*) FILTER (l_returnflag IN ('R', 'A') AND l_linestatus NOT LIKE 'O%') AS nf,
        (epoch(min(l_shipdate) FILTER (l_returnflag = 'N')) - epoch(any_value(o_orderdate))) / 86400 AS ship1,
        (epoch(max(l_shipdate) FILTER (l_returnflag = 'N')) - epoch(any_value(o_orderdate))) / 86400 AS shipn
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""}
_URG = "pr IN ('1-URGENT', '2-HIGH')"

# ---- scalars ---------------------------------------------------------------


def k1(spark, folder):
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    kind = F.col("o_orderkey") % 5
    text = (F.when(kind == 0, us).when(kind == 1, eu).when(kind == 2, F.concat(F.lit(" "), F.translate(us, ",", "'")))
            .when(kind == 3, F.col("o_totalprice").cast("string")).otherwise(F.concat(F.lit("n/a "), us)))
    return table(spark, folder, "orders").select("o_orderkey", S.number(text).alias("value"))


Q["k1_number_parser"] = k1
SQL["k1_number_parser"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_totalprice END AS value FROM orders"


def k2(spark, folder):
    d = F.col("o_orderdate").cast("timestamp")
    kind = F.col("o_orderkey") % 6
    text = F.lit("no date")
    for i, f in enumerate(["yyyyMMdd", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'"]):
        text = F.when(kind == i, F.date_format(d, f)).otherwise(text)
    return table(spark, folder, "orders").select("o_orderkey", F.date_format(S.date_value(text), "yyyy-MM-dd").alias("day"))


Q["k2_date_parser"] = k2
SQL["k2_date_parser"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"


def k3(spark, folder):
    from tracewright.operators.overview import month_spine
    return month_spine(table(spark, folder, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")))


Q["k3_month_range"] = k3
SQL["k3_month_range"] = """SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders),
    (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH)) AS m)"""

Q["k4_catalogue"] = lambda spark, folder: tower.catalogue(order_log(spark, folder), 8).withColumn("examples", F.array_join("examples", ", "))
SQL["k4_catalogue"] = sql("""
    SELECT scope, owner, attribute, CASE WHEN attribute = 'l_shipdate' THEN 'date'
        WHEN attribute IN ('o_totalprice', 'o_custkey', 'l_quantity', 'l_extendedprice', 'l_discount', 'c_nationkey', 's_nationkey') THEN 'number' ELSE 'text' END AS kind,
        count(*) AS distinct, sum(n)::BIGINT AS filled, string_agg(value, ', ' ORDER BY r) FILTER (r <= 8) AS examples FROM (
        SELECT *, row_number() OVER (PARTITION BY scope, owner, attribute ORDER BY n DESC, value) AS r FROM (
            SELECT 'object' AS scope, object_type AS owner, name AS attribute, value, count(*) AS n FROM attr GROUP BY 1, 2, 3, 4
            UNION ALL SELECT 'event', activity, 'l_linestatus', l_linestatus, count(*) FROM ev WHERE event_group = 'Item' GROUP BY 2, 4)) GROUP BY 1, 2, 3""")

# ---- conditions and points -------------------------------------------------


def holds(log, object_type, condition):
    c = Compiler(log, object_type)
    flag = c.condition(condition)
    return c.frame().select("object_id", flag.alias("holds"))


def condition(name, object_type, spec, query):
    Q[name] = lambda spark, folder: holds(order_log(spark, folder), object_type, spec)
    SQL[name] = query


Q["k6_case_events"] = lambda spark, folder: model.case_events(
    order_log(spark, folder), "Item").groupBy("lead_id").agg(F.count(F.lit(1)).alias("events"))
SQL["k6_case_events"] = sql("""SELECT lead_id, count(*) AS events FROM (
    SELECT object_id AS lead_id, event_id FROM e2o WHERE object_type = 'Item'
    UNION SELECT i.object_id, x.event_id FROM e2o i JOIN e2o o ON o.event_id = i.event_id AND o.object_type = 'Order' JOIN e2o x ON x.object_id = o.object_id WHERE i.object_type = 'Item') GROUP BY 1""")


def k7(spark, folder):
    c = Compiler(order_log(spark, folder), "Item")
    shipped = c.point({"activity": "Ship Item", "which": "last"})
    due = c.point({"attribute": "l_shipdate", "plus_days_attribute": "l_quantity", "plus_days": 3})
    placed = c.point({"activity": "Place Order", "related": True})
    return c.frame().select("object_id", shipped.alias("shipped"), due.alias("due"), placed.alias("placed"))


Q["k7_time_points"] = k7
SQL["k7_time_points"] = sql("""SELECT 'Item:' || f.l_linenumber || '|' || f.l_orderkey AS object_id, epoch(s.t)::DOUBLE AS shipped,
    epoch(f.l_shipdate) + (f.l_quantity + 3) * 86400 AS due, epoch(o_orderdate)::DOUBLE AS placed
    FROM item_first f JOIN orders ON o_orderkey = f.l_orderkey
    LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS t FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) s USING (l_orderkey, l_linenumber)""")


def k8(spark, folder):
    c = Compiler(order_log(spark, folder), "Order")
    d = c.days({"activity": "Place Order"}, {"activity": "Ship Item"})
    return c.frame().select("object_id", r4(d, "days"))


Q["k8_duration_days"] = k8
SQL["k8_duration_days"] = sql("SELECT object_id, round(ship1, 4) AS days FROM o", _O)

condition("k9_any_all_not", "Order", {"op": "any", "items": [{"op": "all", "items": [RETURNED, URGENT]}, {"op": "not", "item": LATE}]},
          sql(f"SELECT object_id, (nr > 0 AND {_URG}) OR NOT coalesce(shipn > 700, false) AS holds FROM o", _O))
condition("k10_activity", "Order", {"op": "activity", "activities": ["Return Item"], "min_count": 2}, sql("SELECT object_id, nr >= 2 AS holds FROM o", _O))
condition("k10_activity_related", "Item", {"op": "activity", "activities": ["Return Item"], "min_count": 3, "related": True},
          sql("""SELECT 'Item:' || f.l_linenumber || '|' || f.l_orderkey AS object_id, n >= 3 AS holds FROM item_first f
              JOIN (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1) USING (l_orderkey)"""))
condition("k11_user", "Order", FINISHED, sql("SELECT object_id, nf > 0 AS holds FROM o", _O))
condition("k12_attribute_in", "Order", URGENT, sql(f"SELECT object_id, {_URG} AS holds FROM o", _O))
condition("k12_attribute_number", "Order", {"op": "attribute", "attribute": "o_totalprice", "cmp": "ge", "values": ["250000"]},
          sql("SELECT object_id, amt >= 250000 AS holds FROM o", _O))
condition("k12_attribute_equal_number", "Item", {"op": "attribute", "attribute": "l_quantity", "cmp": "not_in", "values": ["5", "7"]},
          sql("SELECT 'Item:' || l_linenumber || '|' || l_orderkey AS object_id, l_quantity NOT IN (5, 7) AS holds FROM item_first"))
condition("k13_duration", "Order", LATE, sql("SELECT object_id, coalesce(shipn > 700, false) AS holds FROM o", _O))
condition("k14_evaluator", "Order", {"op": "all", "items": [{"op": "any", "items": [FINISHED, RETURNED]}, {"op": "not", "item": {"op": "all", "items": [URGENT, LATE]}},
                                                             {"op": "attribute", "attribute": "o_orderstatus", "cmp": "not_empty"}]},
          sql(f"SELECT object_id, (nf > 0 OR nr > 0) AND NOT ({_URG} AND coalesce(shipn > 700, false)) AS holds FROM o", _O))

# ---- rows and measures -----------------------------------------------------
Q["k15_kpi_rows"] = lambda spark, folder: kpi_rows(order_log(spark, folder), K_DAYS | {"condition": RETURNED, "amount": "o_totalprice", "population": URGENT}).select(
    "object_id", "start_month", "hit", "amount", r4("days"))
SQL["k15_kpi_rows"] = sql(f"SELECT object_id, sm AS start_month, nr > 0 AS hit, amt AS amount, CASE WHEN nr > 0 THEN round(ship1, 4) END AS days FROM o WHERE {_URG}", _O)


def measures(*kpis):
    def run(spark, folder):
        out = None
        for k in kpis:
            row = M.measure(k, kpi_rows(order_log(spark, folder), k)).select(
                F.lit(k["id"]).alias("kpi"), "den", "num", F.round("amount", 2).alias("amount"), F.round("amount_total", 2).alias("amount_total"), r4("value"))
            out = row if out is None else out.unionByName(row)
        return out
    return run


_M = {"k1": "SELECT 'k1' AS kpi, count(*) AS den, count(*) FILTER (nr > 0) AS num, round(sum(amt) FILTER (nr > 0), 2) AS amount, round(sum(amt), 2) AS amount_total, round(count(*) FILTER (nr > 0) / count(*), 4) AS value FROM o",
      "k2": f"SELECT 'k2' AS kpi, count(*) AS den, count(*) FILTER (shipn > 700) AS num, NULL::DOUBLE AS amount, NULL::DOUBLE AS amount_total, count(*) FILTER (shipn > 700)::DOUBLE AS value FROM o WHERE {_URG}",
      "k3": "SELECT 'k3' AS kpi, count(*) AS den, count(*) FILTER (nf > 0) AS num, round(sum(amt) FILTER (nf > 0), 2) AS amount, round(sum(amt), 2) AS amount_total, round(sum(amt) FILTER (nf > 0), 4) AS value FROM o",
      "k4": f"SELECT 'k4' AS kpi, count(*) AS den, count(*) FILTER (nr > 0 AND NOT {_URG}) AS num, round(sum(amt) FILTER (nr > 0 AND NOT {_URG}), 2) AS amount, round(sum(amt), 2) AS amount_total, round(sum(amt) FILTER (nr > 0 AND NOT {_URG}) / sum(amt), 4) AS value FROM o",
      "k5": "SELECT 'k5' AS kpi, count(*) AS den, count(*) AS num, NULL::DOUBLE AS amount, NULL::DOUBLE AS amount_total, round(median(ship1), 4) AS value FROM o",
      "k6": "SELECT 'k6' AS kpi, count(*) AS den, count(*) AS num, NULL::DOUBLE AS amount, NULL::DOUBLE AS amount_total, round(avg(ship1), 4) AS value FROM o",
      "k7": "SELECT 'k7' AS kpi, count(*) AS den, count(*) AS num, NULL::DOUBLE AS amount, NULL::DOUBLE AS amount_total, round((list_sort(list(ship1) FILTER (ship1 IS NOT NULL)))[ceil(0.9 * count(ship1))::BIGINT], 4) AS value FROM o"}
Q["k16_measures"] = measures(K_SHARE, K_COUNT, K_SUM, K_SHARE_AMOUNT, K_DAYS)
SQL["k16_measures"] = sql(" UNION ALL ".join(_M[k] for k in ("k1", "k2", "k3", "k4", "k5")), _O)
Q["k17_duration_statistics"] = measures(K_DAYS, K_MEAN, K_P90)
SQL["k17_duration_statistics"] = sql(" UNION ALL ".join(_M[k] for k in ("k5", "k6", "k7")), _O)


def k18(spark, folder):
    first, last = P.start_range(order_log(spark, folder), ["Order"])
    rows = []
    for period in ("3", "12", "1997-02..1997-05", "list:1997-01,1997-03", "1990-01..1995-02", "all"):
        cur, prev = P.period_months(period, first, last)
        rows += [(period, "current", m) for m in cur or []] + [(period, "previous", m) for m in prev or []]
    return spark.createDataFrame(rows, "period string, role string, month string")


Q["k18_periods"] = k18
SQL["k18_periods"] = (
    "WITH o AS (" + _O["o"] + "), ends AS (SELECT date_trunc('month', min(start_ts)) AS a, date_trunc('month', max(start_ts)) AS b FROM o)" + """
    SELECT '3' AS period, CASE WHEN i < 3 THEN 'current' ELSE 'previous' END AS role, strftime(b - to_months(i::INTEGER), '%Y-%m') AS month FROM ends, (SELECT unnest(range(6)) AS i)
    UNION ALL SELECT '12', CASE WHEN i < 12 THEN 'current' ELSE 'previous' END, strftime(b - to_months(i::INTEGER), '%Y-%m') FROM ends, (SELECT unnest(range(24)) AS i)
    UNION ALL SELECT '1997-02..1997-05', CASE WHEN i < 4 THEN 'current' ELSE 'previous' END, strftime(DATE '1997-05-01' - to_months(i::INTEGER), '%Y-%m') FROM (SELECT unnest(range(8)) AS i)
    UNION ALL SELECT 'list:1997-01,1997-03', 'current', unnest(['1997-01', '1997-03'])
    UNION ALL SELECT '1990-01..1995-02', 'current', strftime(m, '%Y-%m') FROM (SELECT unnest(generate_series(a, TIMESTAMP '1995-02-01', INTERVAL 1 MONTH)) AS m FROM ends)""")


def k19(spark, folder):
    out = None
    for k in (K_SHARE, K_SUM, K_SHARE_AMOUNT):
        row = C.single_value(k, kpi_rows(order_log(spark, folder), k), 10.0).select(
            F.lit(k["id"]).alias("kpi"), r6("target"), "status", F.lit(M.better(k)).alias("better"))
        out = row if out is None else out.unionByName(row)
    return out


Q["k19_target_status"] = k19
SQL["k19_target_status"] = sql(f"""SELECT 'k1' AS kpi, 0.4 AS target, CASE WHEN count(*) FILTER (nr > 0) / count(*) <= 0.4 THEN 'ok' ELSE 'ko' END AS status, 'lower' AS better FROM o
    UNION ALL SELECT 'k3', 1000000, CASE WHEN sum(amt) FILTER (nf > 0) >= 1000000 THEN 'ok' ELSE 'ko' END, 'higher' FROM o
    UNION ALL SELECT 'k4', 0.6, CASE WHEN sum(amt) FILTER (nr > 0 AND NOT {_URG}) / sum(amt) >= 0.6 THEN 'ok' ELSE 'ko' END, 'higher' FROM o""", _O)


def k20(spark, folder):
    log = order_log(spark, folder)
    out = C.gauge_bands(log, K_SHARE, kpi_rows(log, K_SHARE), 20.0).select(F.lit("k1").alias("kpi"), "*")
    more = C.gauge_bands(log, K_SHARE_AMOUNT, kpi_rows(log, K_SHARE_AMOUNT), 15.0, high=90).select(F.lit("k4").alias("kpi"), "*")
    return out.unionByName(more).select("kpi", r6("low"), r6("high"), r6("from_value"), r6("to_value"), "light")


Q["k20_gauge_bands"] = k20
SQL["k20_gauge_bands"] = """SELECT * FROM (VALUES ('k1', 0.0, 1.0, 0.0, 0.4, 'green'), ('k1', 0.0, 1.0, 0.4, 0.6, 'amber'), ('k1', 0.0, 1.0, 0.6, 1.0, 'red'),
    ('k4', 0.0, 0.9, 0.0, 0.45, 'red'), ('k4', 0.0, 0.9, 0.45, 0.6, 'amber'), ('k4', 0.0, 0.9, 0.6, 0.9, 'green')) t(kpi, low, high, from_value, to_value, light)
    WHERE (SELECT count(*) FROM orders) > 0"""


def k20_light(spark, folder):
    log = order_log(spark, folder)
    rows = kpi_rows(log, K_SHARE)
    out = None
    for tol in (10.0, 50.0):
        row = C.single_value(K_SHARE, rows, tol).select(F.lit(tol).alias("tolerance"), r4("value"), "light")
        out = row if out is None else out.unionByName(row)
    return out


Q["k20_traffic_light"] = k20_light
SQL["k20_traffic_light"] = sql("""SELECT tol AS tolerance, round(v, 4) AS value, CASE WHEN v <= 0.4 THEN 'green' WHEN v - 0.4 <= tol / 100 THEN 'amber' ELSE 'red' END AS light
    FROM (SELECT count(*) FILTER (nr > 0) / count(*) AS v FROM o), (SELECT unnest([10.0::DOUBLE, 50.0::DOUBLE]) AS tol)""", _O)

# ---- dimensions ------------------------------------------------------------
D_ATTR = {"source": "attribute", "attribute": "o_orderpriority"}
D_REL = {"source": "related", "object_type": "Customer", "attribute": "c_mktsegment"}
D_NATION = {"source": "related", "object_type": "Customer", "attribute": "c_nationkey"}
D_EVENT = {"source": "event_attribute", "attributes": ["l_linestatus"], "activities": ["Return Item", "Ship Item"]}
D_ACT = {"source": "activity", "activities": ["Ship Item", "Return Item"]}
_ITEMS = "SELECT DISTINCT 'Order:' || o_orderkey AS object_id, {v} AS label FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag IN ('R', 'N')"


def dimension(name, d, query, object_type="Order"):
    Q[name] = lambda spark, folder: dimension_values(order_log(spark, folder), object_type, d)
    SQL[name] = query


dimension("k21_dimension_attribute", D_ATTR, "SELECT 'Order:' || o_orderkey AS object_id, o_orderpriority AS label FROM orders")
dimension("k22_dimension_related", D_REL, "SELECT 'Order:' || o_orderkey AS object_id, c_mktsegment AS label FROM orders JOIN customer ON c_custkey = o_custkey")
dimension("k22_dimension_related_id", {"source": "related", "object_type": "Supplier"},
          "SELECT DISTINCT 'Order:' || o_orderkey AS object_id, coalesce(l_suppkey::VARCHAR, '') AS label FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
dimension("k23_dimension_event_attribute", D_EVENT, _ITEMS.format(v="coalesce(l_linestatus, '')"))
dimension("k24_dimension_activity", D_ACT, _ITEMS.format(v="coalesce(CASE l_returnflag WHEN 'R' THEN 'Return Item' WHEN 'N' THEN 'Ship Item' END, '')"))

# ---- charts ----------------------------------------------------------------


def groups(kpi, d, **kw):
    def run(spark, folder):
        log = order_log(spark, folder)
        out = C.group_chart(log, kpi, kpi_rows(log, kpi), d, **kw)
        extra = [r6("cumulative")] if kw.get("kind") == "pareto" else []
        return out.select("label", "den", "num", r4("value"), F.col("position").cast("long").alias("position"), F.col("others").cast("long").alias("others"), *extra)
    return run


_G = """SELECT label, den, num, value, position, greatest(total - {top}, 0) AS others{extra} FROM (
    SELECT *, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS total FROM (
        SELECT label, count(*) AS den, count(*) FILTER ({hit}) AS num, round({value}, 4) AS value, {impact} AS impact FROM ({src}) GROUP BY 1)) WHERE position <= {top}"""
_SEG = "SELECT o.*, c_mktsegment AS label FROM o JOIN customer ON c_custkey = ck"
_NAT = "SELECT o.*, c_nationkey::VARCHAR AS label FROM o JOIN customer ON c_custkey = ck"
_DEF = dict(hit="nr > 0", value="count(*) FILTER (nr > 0) / count(*)", impact="count(*) FILTER (nr > 0)", order="impact DESC, den DESC, label", top=10, extra="", src=_SEG)

Q["k25_grouping_by_value"] = groups(K_SHARE, D_NATION, order="value_desc")
SQL["k25_grouping_by_value"] = sql(_G.format(**{**_DEF, "src": _NAT, "order": "impact / den DESC, label"}), _O)
Q["k25_grouping_drops_empty"] = groups(K_SHARE, D_EVENT)
SQL["k25_grouping_drops_empty"] = sql(_G.format(**{**_DEF, "src": f"SELECT o.*, label FROM o JOIN ({_ITEMS.format(v='l_linestatus')}) USING (object_id) WHERE label IS NOT NULL"}), _O)
Q["k28_group_chart"] = groups(K_SHARE, D_NATION, top=5)
SQL["k28_group_chart"] = sql(_G.format(**{**_DEF, "src": _NAT, "top": 5}), _O)
Q["k28_group_chart_duration"] = groups(K_DAYS, D_REL, kind="table", order="label")
SQL["k28_group_chart_duration"] = sql(_G.format(**{**_DEF, "hit": "true", "value": "median(ship1)", "impact": "count(*)", "order": "label"}), _O)
Q["k29_pareto"] = groups(K_SUM, D_NATION, kind="pareto")
SQL["k29_pareto"] = sql("""SELECT label, den, num, round(impact, 4) AS value, position, greatest(total - 15, 0) AS others, round(run / tot, 6) AS cumulative FROM (
    SELECT *, row_number() OVER (ORDER BY impact DESC, den DESC, label) AS position, count(*) OVER () AS total, sum(impact) OVER (ORDER BY impact DESC, den DESC, label) AS run,
    sum(impact) OVER () AS tot FROM (SELECT label, count(*) AS den, count(*) FILTER (nf > 0) AS num, sum(amt) FILTER (nf > 0) AS impact FROM (""" + _NAT + ") GROUP BY 1)) WHERE position <= 15", _O)


def k26(spark, folder):
    log = order_log(spark, folder)
    return C.trend(log, K_SHARE, kpi_rows(log, K_SHARE), ["1994-11", "1997-01"]).select("month", "den", "num", r4("value"))


Q["k26_trend"] = k26
SQL["k26_trend"] = sql("""SELECT strftime(m, '%Y-%m') AS month, count(object_id) AS den, count(object_id) FILTER (nr > 0) AS num, round(count(object_id) FILTER (nr > 0) / nullif(count(object_id), 0), 4) AS value
    FROM (SELECT unnest(generate_series(TIMESTAMP '1994-11-01', (SELECT date_trunc('month', max(start_ts)) FROM o), INTERVAL 1 MONTH)) AS m) LEFT JOIN o ON sm = strftime(m, '%Y-%m') GROUP BY 1""", _O)


def k26_duration(spark, folder):
    log = order_log(spark, folder)
    return C.trend(log, K_DAYS, kpi_rows(log, K_DAYS)).select("month", "den", "measured", r4("value"))


Q["k26_trend_duration"] = k26_duration
SQL["k26_trend_duration"] = sql("""SELECT strftime(m, '%Y-%m') AS month, count(object_id) AS den, count(ship1) AS measured, round(median(ship1), 4) AS value
    FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(start_ts)) FROM o), (SELECT date_trunc('month', max(start_ts)) FROM o), INTERVAL 1 MONTH)) AS m)
    LEFT JOIN o ON sm = strftime(m, '%Y-%m') GROUP BY 1""", _O)

MONTHS = ["1996-01", "1996-02", "1996-03"]


def k27(spark, folder):
    log = order_log(spark, folder)
    return C.matrix_chart(log, K_SHARE, kpi_rows(log, K_SHARE), D_NATION, months=MONTHS, series=4).select(
        "series", F.col("place").cast("long").alias("place"), "month", "den", "num", r4("value"))


Q["k27_stacked_columns"] = k27
SQL["k27_stacked_columns"] = sql("""
    SELECT s.series, s.place, m.month, count(c.object_id) AS den, count(c.object_id) FILTER (c.nr > 0) AS num, round(count(c.object_id) FILTER (c.nr > 0) / nullif(count(c.object_id), 0), 4) AS value
    FROM (SELECT label AS series, place FROM top UNION ALL SELECT '(other)', 5) s JOIN (SELECT unnest(['1996-01', '1996-02', '1996-03']) AS month) m ON true
    LEFT JOIN named c ON c.series = s.series AND c.sm = m.month GROUP BY 1, 2, 3""", {
    **_O, "src": f"SELECT * FROM ({_NAT}) WHERE sm IN ('1996-01', '1996-02', '1996-03')",
    "top": """SELECT label, row_number() OVER (ORDER BY count(*) FILTER (nr > 0) DESC, count(*) DESC, label) AS place FROM src GROUP BY 1 QUALIFY place <= 4""",
    "named": "SELECT src.*, coalesce(top.label, '(other)') AS series FROM src LEFT JOIN top ON top.label = src.label"})

Q["k30_single_value"] = lambda spark, folder: C.single_value(K_SHARE, kpi_rows(order_log(spark, folder), K_SHARE), months=MONTHS).select(
    "den", "num", r4("value"), r6("target"), "status", "light")
SQL["k30_single_value"] = sql("""SELECT den, num, round(v, 4) AS value, 0.4 AS target, CASE WHEN v <= 0.4 THEN 'ok' ELSE 'ko' END AS status,
    CASE WHEN v <= 0.4 THEN 'green' WHEN v - 0.4 <= 0.1 THEN 'amber' ELSE 'red' END AS light
    FROM (SELECT count(*) AS den, count(*) FILTER (nr > 0) AS num, count(*) FILTER (nr > 0) / count(*) AS v FROM o WHERE sm IN ('1996-01', '1996-02', '1996-03'))""", _O)


def k31(spark, folder):
    log = order_log(spark, folder)
    return C.funnel(log, K_COUNT, kpi_rows(log, K_COUNT), ["Place Order", "Ship Item", "Return Item"])


Q["k31_funnel"] = k31
SQL["k31_funnel"] = f"""SELECT 0 AS step, 'Place Order' AS activity, count(*) AS objects FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT CASE l_returnflag WHEN 'N' THEN 1 ELSE 2 END, CASE l_returnflag WHEN 'N' THEN 'Ship Item' ELSE 'Return Item' END, count(DISTINCT o_orderkey)
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND l_returnflag IN ('N', 'R') GROUP BY 1, 2"""


def k32(spark, folder):
    log = order_log(spark, folder)
    return C.histogram(log, K_DAYS, kpi_rows(log, K_DAYS)).select("bin", r4("from_value"), r4("to_value"), "count", "open")


Q["k32_histogram"] = k32
SQL["k32_histogram"] = sql("""SELECT b.i::INTEGER AS bin, round(st + b.i * step, 4) AS from_value, round(st + (b.i + 1) * step, 4) AS to_value, count(v.v) AS count, b.i = k - 1 AND mx > st + k * step AS open
    FROM par, (SELECT unnest(range(100)) AS i) b LEFT JOIN v ON least((SELECT k FROM par) - 1, greatest(0, floor((v.v - (SELECT st FROM par)) / (SELECT step FROM par)))) = b.i
    WHERE b.i < k GROUP BY b.i, st, step, k, mx""", {
    **_O, "v": "SELECT ship1 AS v FROM o WHERE ship1 IS NOT NULL",
    "e": "SELECT min(v) AS lo, max(v) AS mx, (list_sort(list(v)))[ceil(0.99 * count(*))::BIGINT] AS hi FROM v",
    "s": "SELECT lo, hi, mx, (SELECT min(c * pow(10, floor(log10((hi - lo) / 10)))) FROM (SELECT unnest([1, 2, 2.5, 5, 10]) AS c) WHERE c * pow(10, floor(log10((hi - lo) / 10))) >= (hi - lo) / 10) AS step FROM e",
    "par": "SELECT lo, hi, mx, step, floor(lo / step) * step AS st, floor((hi - floor(lo / step) * step) / step) + 1 AS k FROM s"})

Q["k32_histogram_marks"] = lambda spark, folder: C.histogram_marks(K_DAYS, kpi_rows(order_log(spark, folder), K_DAYS)).select("count", r4("median"), r4("p90"))
SQL["k32_histogram_marks"] = sql("SELECT count(ship1) AS count, round(median(ship1), 4) AS median, round((list_sort(list(ship1) FILTER (ship1 IS NOT NULL)))[ceil(0.9 * count(ship1))::BIGINT], 4) AS p90 FROM o", _O)

CATS = [{"label": "Urgent", "condition": URGENT}, {"label": "Finished", "condition": FINISHED}]


def k33_cat(spark, folder):
    log = order_log(spark, folder)
    return C.composition(log, K_SHARE, kpi_rows(log, K_SHARE), categories=CATS).select("label", "value")


def k33_dim(spark, folder):
    log = order_log(spark, folder)
    d = {"source": "related", "object_type": "Supplier"}
    return C.composition(log, K_SHARE, kpi_rows(log, K_SHARE), dimension=d).select("label", r4("value"), F.col("position").cast("long").alias("position"))


def k33_rest(spark, folder):
    log = order_log(spark, folder)
    return C.composition(log, K_SUM, kpi_rows(log, K_SUM)).select("label", F.round("value", 2).alias("value"))


Q["k33_composition_categories"] = k33_cat
SQL["k33_composition_categories"] = sql(f"""SELECT CASE WHEN {_URG} THEN 'Urgent' WHEN nf > 0 THEN 'Finished' ELSE '(other)' END AS label, count(*)::DOUBLE AS value FROM o WHERE nr > 0 GROUP BY 1""", _O)
Q["k33_composition_dimension"] = k33_dim
SQL["k33_composition_dimension"] = sql("""SELECT CASE WHEN p > 6 THEN '(other)' ELSE label END AS label, round(sum(v), 4) AS value, least(p, 7) AS position FROM (
    SELECT label, sum(1.0 / k) AS v, row_number() OVER (ORDER BY round(sum(1.0 / k), 9) DESC, label) AS p FROM (
        SELECT DISTINCT o.object_id, l_suppkey::VARCHAR AS label, count(DISTINCT l_suppkey) OVER (PARTITION BY o.object_id) AS k
        FROM o JOIN lineitem ON 'Order:' || l_orderkey = o.object_id WHERE nr > 0) GROUP BY 1) GROUP BY 1, 3""", _O)
Q["k33_composition_rest"] = k33_rest
SQL["k33_composition_rest"] = sql("SELECT CASE WHEN nf > 0 THEN 'k3' ELSE '(other)' END AS label, round(sum(amt), 2) AS value FROM o GROUP BY 1", _O)

Q["k34_currency"] = lambda spark, folder: C.currency(order_log(spark, folder), {"object_type": "Order", "currency": "o_orderstatus"})
SQL["k34_currency"] = "SELECT o_orderstatus AS currency, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"

Q["k35_whole_dashboard"] = lambda spark, folder: tower.compute(order_log(spark, folder), ALL, "1996-01..1996-12").select(
    "kpi", "den", "num", r4("value"), r4("previous"), r6("target"), "status", "better")
_K35 = """SELECT '{k}' AS kpi, count(*) FILTER (cur{pop}) AS den, count(*) FILTER (cur{pop}{hit}) AS num, round({cur}, 4) AS value, round({prev}, 4) AS previous,
    {target} AS target, {status} AS status, {better} AS better FROM (SELECT *, sm LIKE '1996-%' AS cur, sm LIKE '1995-%' AS prev FROM o)"""


def _k35(k, value, pop="", hit="", target="NULL::DOUBLE", status="NULL::VARCHAR", better="NULL::VARCHAR"):
    cur, prev = value.replace("@", "cur"), value.replace("@", "prev")
    return _K35.format(k=k, pop=pop, hit=hit, cur=cur, prev=prev, target=target, status=status.replace("#", cur), better=better)


_P90 = "(list_sort(list(ship1) FILTER (@ AND ship1 IS NOT NULL)))[ceil(0.9 * count(ship1) FILTER (@))::BIGINT]"
SQL["k35_whole_dashboard"] = sql(" UNION ALL ".join([
    _k35("k1", "count(*) FILTER (@ AND nr > 0) / nullif(count(*) FILTER (@), 0)", hit=" AND nr > 0", target="0.4", status="CASE WHEN # <= 0.4 THEN 'ok' ELSE 'ko' END", better="'lower'"),
    _k35("k2", f"count(*) FILTER (@ AND {_URG} AND shipn > 700)::DOUBLE", pop=f" AND {_URG}", hit=" AND shipn > 700"),
    _k35("k3", "sum(amt) FILTER (@ AND nf > 0)", hit=" AND nf > 0", target="1000000", status="CASE WHEN # >= 1000000 THEN 'ok' ELSE 'ko' END", better="'higher'"),
    _k35("k4", f"sum(amt) FILTER (@ AND nr > 0 AND NOT {_URG}) / sum(amt) FILTER (@)", hit=f" AND nr > 0 AND NOT {_URG}", target="0.6", status="CASE WHEN # >= 0.6 THEN 'ok' ELSE 'ko' END", better="'higher'"),
    _k35("k5", "median(ship1) FILTER (@)", better="'lower'"), _k35("k6", "avg(ship1) FILTER (@)", better="'lower'"), _k35("k7", _P90, better="'lower'")]), _O)


def k37(spark, folder):
    log = order_log(spark, folder)
    period, rest = P.split_period([{"kind": "start_month", "type": "Order", "values": ["1996-02", "1996-01", "1996-03"]},
                                   {"kind": "object", "type": "Order", "attribute": "o_orderpriority", "values": ["1-URGENT"]}], ["Order"])
    return tower.compute(X.apply(log, rest), [K_SHARE], period).select(F.lit(period).alias("period"), "den", "num", r4("value"))


Q["k37_filters_as_period"] = k37
SQL["k37_filters_as_period"] = sql("""SELECT '1996-01..1996-03' AS period, count(*) AS den, count(*) FILTER (nr > 0) AS num, round(count(*) FILTER (nr > 0) / count(*), 4) AS value
    FROM o WHERE pr = '1-URGENT' AND sm IN ('1996-01', '1996-02', '1996-03')""", _O)
