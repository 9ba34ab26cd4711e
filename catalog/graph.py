"""Queries on sequences, hubs, cases, variants and the directly-follows graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import order_log, session_log, split_log
from catalog.sqlparts import sql
from tracewright.operators import dfg, model

Q, SQL = {}, {}


def r4(c, name=None):
    return F.round(c, 4).alias(name or c)


def x1_sequences(spark, folder):
    s = model.sequences(order_log(spark, folder), "Order")
    return s.select("object_id", "seq", "activity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


Q["x1_sequences"] = x1_sequences
SQL["x1_sequences"] = sql("""SELECT object_id, seq, activity, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM seq WHERE object_type = 'Order'""")

Q["x2_activity_counts"] = lambda spark, folder: model.activity_counts(order_log(spark, folder))
SQL["x2_activity_counts"] = sql("""SELECT object_type, activity, count(DISTINCT event_id) AS events, count(DISTINCT object_id) AS objects FROM e2o GROUP BY 1, 2""")

Q["x3_type_stats"] = lambda spark, folder: order_log(spark, folder).type_stats.select(
    "object_type", "objects", "with_events", "events", r4("average"))
SQL["x3_type_stats"] = sql("SELECT object_type, objects, with_events, events, round(average, 4) AS average FROM tstat")

Q["x4_hub_types"] = lambda spark, folder: order_log(spark, folder).type_stats.select("object_type", "hub")
SQL["x4_hub_types"] = sql("SELECT object_type, hub FROM tstat")

Q["x5_hub_own_events"] = lambda spark, folder: model.own_events(split_log(spark, folder)).select("object_type", "event_id")
_OWN = {
    "hist": """SELECT DISTINCT n.event_id FROM nonhub n JOIN tstat t USING (object_type)
        JOIN (SELECT object_id, count(*) AS c FROM e2o GROUP BY 1) k USING (object_id) WHERE t.average >= 1.5 OR k.c >= 2""",
    "own": """SELECT DISTINCT object_type, event_id, activity FROM e2o WHERE object_type IN (SELECT object_type FROM tstat WHERE hub)
        AND (qualifier = 'involves' OR event_id NOT IN (SELECT event_id FROM hist))""",
    "sstat": """SELECT object_type, count(DISTINCT event_id) / count(DISTINCT object_id) AS average, count(DISTINCT object_id) AS n,
        count(DISTINCT event_id) AS e FROM pe2o GROUP BY 1""",
    "shub": "SELECT object_type FROM sstat WHERE average >= 8 AND n * 4 <= e",
    "shist": """SELECT DISTINCT n.event_id FROM pe2o n JOIN sstat t USING (object_type)
        JOIN (SELECT object_id, count(*) AS c FROM pe2o GROUP BY 1) k USING (object_id)
        WHERE n.object_type NOT IN (SELECT object_type FROM shub) AND (t.average >= 1.5 OR k.c >= 2)""",
    "sown": """SELECT DISTINCT object_type, event_id, activity FROM pe2o WHERE object_type IN (SELECT object_type FROM shub)
        AND (qualifier = 'involves' OR event_id NOT IN (SELECT event_id FROM shist))""",
}
SQL["x5_hub_own_events"] = sql("SELECT object_type, event_id FROM sown", _OWN)

Q["x6_hub_own_activities"] = lambda spark, folder: model.own_activities(split_log(spark, folder))
SQL["x6_hub_own_activities"] = sql("SELECT DISTINCT object_type, activity FROM sown", _OWN)

Q["x8_case_members"] = lambda spark, folder: model.case_members(order_log(spark, folder), "Order")
SQL["x8_case_members"] = sql("""
    SELECT object_id AS lead_id, object_id FROM e2o WHERE object_type = 'Order'
    UNION SELECT l.object_id, m.object_id FROM e2o l JOIN e2o m ON m.event_id = l.event_id AND m.object_type = 'Item' WHERE l.object_type = 'Order'""")

_VAR = """SELECT row_number() OVER (ORDER BY n DESC, len(s), s) AS variant_id, array_to_string(s, ' > ') AS steps, n AS cases,
        round(n / sum(n) OVER (), 6) AS share, round(med, 4) AS median FROM (
        SELECT s, count(*) AS n, median(d) AS med FROM (
            SELECT lead_id, list(activity ORDER BY ts, event_id) FILTER (prev IS NULL OR prev <> activity) AS s, epoch(max(ts)) - epoch(min(ts)) AS d
            FROM (SELECT *, lag(activity) OVER (PARTITION BY lead_id ORDER BY ts, event_id) AS prev FROM {src}) GROUP BY lead_id) GROUP BY s)"""


def _variant_rows(v):
    return v.with_median().select("variant_id", model.step_text().alias("steps"), "cases",
                                  F.round("share", 6).alias("share"), r4("median"))


Q["x9_variants_own"] = lambda spark, folder: _variant_rows(model.type_variants(order_log(spark, folder), "Order"))
SQL["x9_variants_own"] = sql(_VAR.format(src="(SELECT object_id AS lead_id, * FROM e2o WHERE object_type = 'Order')"))
Q["x9_variants_case"] = lambda spark, folder: _variant_rows(model.type_variants(order_log(spark, folder), "Order", ["Item"]))
SQL["x9_variants_case"] = sql(_VAR.format(src="cas"))
Q["x9_variants_sessions"] = lambda spark, folder: _variant_rows(model.type_variants(session_log(spark, folder), "Session"))
SQL["x9_variants_sessions"] = sql(_VAR.format(src="(SELECT object_id AS lead_id, * FROM se2o WHERE object_type = 'Session')"))

Q["x10_activity_ranking"] = lambda spark, folder: dfg.visible_activities(
    order_log(spark, folder).links_of("Order", "Item"), top=3).select("activity", "events", F.col("rank").cast("long").alias("rank"), "selected")
SQL["x10_activity_ranking"] = sql("""SELECT activity, n AS events, rank, rank <= 3 AS selected FROM (
    SELECT activity, count(DISTINCT event_id) AS n, row_number() OVER (ORDER BY count(DISTINCT event_id) DESC, activity) AS rank
    FROM e2o WHERE object_type IN ('Order', 'Item') GROUP BY 1)""")

_EDGE = {
    "vis": "SELECT * FROM e2o WHERE object_type IN ('Order', 'Item')",
    "step": """SELECT object_type, object_id, activity, ts, lag(activity) OVER w AS p, lead(activity) OVER w AS n, lead(ts) OVER w AS nts
        FROM vis WINDOW w AS (PARTITION BY object_id ORDER BY ts, event_id)""",
    "pass": """SELECT object_type, object_id, activity AS source, coalesce(n, '__end__|' || object_type) AS target, epoch(nts) - epoch(ts) AS d FROM step
        UNION ALL SELECT object_type, object_id, '__start__|' || object_type, activity, NULL FROM step WHERE p IS NULL""",
    "edge": """SELECT object_type, source, target, count(*) AS passages, count(DISTINCT object_id) AS objects, median(d) AS median,
        avg(d) AS mean, min(d) AS min, max(d) AS max FROM pass GROUP BY 1, 2, 3""",
}


def _edges(spark, folder):
    log = order_log(spark, folder)
    return dfg.edges(dfg.passages(log, log.links_of("Order", "Item")))


Q["x11_edges"] = lambda spark, folder: _edges(spark, folder).select("object_type", "source", "target", "passages", "objects")
SQL["x11_edges"] = sql("SELECT object_type, source, target, passages, objects FROM edge", _EDGE)
Q["x12_edge_durations"] = lambda spark, folder: _edges(spark, folder).select(
    "object_type", "source", "target", r4("median"), r4("mean"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))
SQL["x12_edge_durations"] = sql("""SELECT object_type, source, target, round(median, 4) AS median, round(mean, 4) AS mean, min::DOUBLE AS min, max::DOUBLE AS max FROM edge""", _EDGE)


def x11_edges_hidden(spark, folder):
    g = dfg.build_graph(order_log(spark, folder), ["Order", "Item"], activities=["Place Order", "Return Item"])
    return g.edges.select("object_type", "source", "target", "passages", "objects")


Q["x11_edges_hidden_activities"] = x11_edges_hidden
SQL["x11_edges_hidden_activities"] = sql("SELECT object_type, source, target, passages, objects FROM edge", {
    **_EDGE, "vis": "SELECT * FROM e2o WHERE object_type IN ('Order', 'Item') AND activity IN ('Place Order', 'Return Item')"})

_KEEP = """SELECT object_type, source, target, passages,
    row_number() OVER w <= ceil(count(*) OVER () * 40 / 100.0)
    OR row_number() OVER (PARTITION BY object_type, source ORDER BY passages DESC, object_type, source, target) = 1
    OR row_number() OVER (PARTITION BY object_type, target ORDER BY passages DESC, object_type, source, target) = 1 AS kept
    FROM edge WINDOW w AS (ORDER BY passages DESC, object_type, source, target)"""
Q["x13_kept_paths"] = lambda spark, folder: dfg.keep_paths(_edges(spark, folder), 40).select(
    "object_type", "source", "target", "passages", "kept")
SQL["x13_kept_paths"] = sql(_KEEP, _EDGE)

_NODES = """
    SELECT e.activity AS node, 'activity' AS kind, e.object_type, a.n AS count, count(DISTINCT e.event_id) AS type_events, count(DISTINCT e.object_id) AS type_objects
    FROM vis e JOIN (SELECT activity, count(DISTINCT event_id) AS n FROM vis GROUP BY 1) a USING (activity) GROUP BY 1, 2, 3, 4
    UNION ALL SELECT source, 'start', object_type, sum(passages)::BIGINT, NULL, NULL FROM edge WHERE source LIKE '\\_\\_start%' ESCAPE '\\' GROUP BY 1, 2, 3
    UNION ALL SELECT target, 'end', object_type, sum(passages)::BIGINT, NULL, NULL FROM edge WHERE target LIKE '\\_\\_end%' ESCAPE '\\' GROUP BY 1, 2, 3"""
Q["x14_nodes"] = lambda spark, folder: dfg.build_graph(order_log(spark, folder), ["Order", "Item"]).nodes
SQL["x14_nodes"] = sql(_NODES, _EDGE)


def x15(spark, folder):
    g = dfg.build_graph(order_log(spark, folder), ["Order", "Item"], variant_type="Order", variant_ids=[1, 2, 3])
    return g.edges.select("object_type", "source", "target", "passages", "objects")


Q["x15_variant_graph"] = x15
SQL["x15_variant_graph"] = sql("SELECT object_type, source, target, passages, objects FROM edge", {
    "vc": """SELECT lead_id, list(activity ORDER BY ts, event_id) FILTER (prev IS NULL OR prev <> activity) AS s
        FROM (SELECT *, lag(activity) OVER (PARTITION BY lead_id ORDER BY ts, event_id) AS prev FROM cas) GROUP BY lead_id""",
    "vr": "SELECT s, row_number() OVER (ORDER BY count(*) DESC, len(s), s) AS id FROM vc GROUP BY s",
    "leads": "SELECT lead_id FROM vc JOIN vr USING (s) WHERE id <= 3",
    "mem": """SELECT lead_id AS object_id FROM leads UNION
        SELECT m.object_id FROM leads JOIN e2o l ON l.object_id = lead_id JOIN e2o m ON m.event_id = l.event_id AND m.object_type = 'Item'""",
    **_EDGE, "vis": "SELECT * FROM e2o WHERE object_type IN ('Order', 'Item') AND object_id IN (SELECT object_id FROM mem)"})

Q["x16_graph"] = lambda spark, folder: dfg.build_graph(
    order_log(spark, folder), ["Order", "Item", "Customer"], top=3, paths=50).edges.select(
    "object_type", "source", "target", "passages", "objects", r4("median"), "kept")
SQL["x16_graph"] = sql("""SELECT object_type, source, target, passages, objects, round(median, 4) AS median,
    row_number() OVER w <= ceil(count(*) OVER () * 50 / 100.0)
    OR row_number() OVER (PARTITION BY object_type, source ORDER BY passages DESC, object_type, source, target) = 1
    OR row_number() OVER (PARTITION BY object_type, target ORDER BY passages DESC, object_type, source, target) = 1 AS kept
    FROM edge WINDOW w AS (ORDER BY passages DESC, object_type, source, target)""", {
    **_OWN,
    "top3": """SELECT activity FROM e2o WHERE object_type IN ('Order', 'Item', 'Customer') GROUP BY 1 ORDER BY count(DISTINCT event_id) DESC, activity LIMIT 3""",
    **_EDGE, "vis": """SELECT * FROM e2o WHERE activity IN (SELECT activity FROM top3) AND (object_type IN ('Order', 'Item')
        OR (object_type = 'Customer' AND event_id IN (SELECT event_id FROM own WHERE object_type = 'Customer')))"""})
