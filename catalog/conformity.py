"""Conformance of the orders with a model made from their most frequent variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.data import order_log, session_log
from catalog.overviews import _REL, _VTEXT, _v
from catalog.sqlparts import sql
from tracewright.operators import conformance as N
from tracewright.operators import model
from tracewright.operators import overview as O
from tracewright.session import shared_folder

Q, SQL = {}, {}
r4 = lambda c, name=None: F.round(c, 4).alias(name or c)

Q["n1_case_durations"] = lambda spark, folder: N.case_durations(N.case_sequence(order_log(spark, folder), "Order")).select(
    "lead_id", "events", F.col("seconds").cast("double").alias("seconds"))
SQL["n1_case_durations"] = sql("SELECT lead_id, count(*) AS events, CASE WHEN count(*) > 1 THEN epoch(max(ts)) - epoch(min(ts)) END::DOUBLE AS seconds FROM rel GROUP BY 1")

Q["n2_case_variants"] = lambda spark, folder: model.variants(N.case_sequence(order_log(spark, folder), "Order"), flags=True).table.select(
    "variant_id", model.step_text().alias("steps"), "cases", F.round("share", 6).alias("share"))
SQL["n2_case_variants"] = sql(f"SELECT variant_id, {_VTEXT} AS steps, cases, round(cases / sum(cases) OVER (), 6) AS share FROM vt", _v("rel"))


def the_model(spark, folder):
    """Place, then ship or accept (a gateway), maybe again (a loop), then an unknown task before the end."""
    nodes = [("s", "start", ""), ("e", "end", ""), ("g1", "other", ""), ("g2", "other", ""), ("t1", "activity", "place  order"), ("t2", "activity", "Ship Item"),
             ("t3", "activity", "ACCEPT ITEM"), ("t4", "activity", "Archive")]
    flows = [("f1", "s", "t1"), ("f2", "t1", "g1"), ("f3", "g1", "t2"), ("f4", "g1", "t3"), ("f5", "t2", "g2"), ("f6", "t3", "g2"), ("f7", "g2", "g1"), ("f8", "g2", "t4"), ("f9", "t4", "e")]
    return N.ProcessModel(spark.createDataFrame(nodes, N.NODES), spark.createDataFrame(flows, N.FLOWS))


def compared(spark, folder):
    return N.compare(order_log(spark, folder), "Order", the_model(spark, folder))


def n4(spark, folder):
    log = order_log(spark, folder)
    acts = log.events.groupBy("activity").agg(F.count(F.lit(1)).alias("events"))
    return N.match_tasks(the_model(spark, folder), acts.select("activity")).join(acts, "activity")


Q["n4_task_matching"] = n4
SQL["n4_task_matching"] = sql("""SELECT CASE activity WHEN 'Place Order' THEN 't1' WHEN 'Ship Item' THEN 't2' ELSE 't3' END AS node_id, activity, count(*) AS events
    FROM ev WHERE activity <> 'Return Item' GROUP BY 1, 2""")

_SEEN = {"st": "SELECT lead_id, activity, lag(activity) OVER w AS p, lead(activity) OVER w AS n FROM rel WINDOW w AS (PARTITION BY lead_id ORDER BY ts, event_id)",
         "pairs": """SELECT source, target, count(*) AS cases FROM (
    SELECT lead_id, activity AS source, n AS target FROM st WHERE n <> activity UNION SELECT lead_id, '▶start', activity FROM st WHERE p IS NULL
    UNION SELECT lead_id, activity, '■end' FROM st WHERE n IS NULL) GROUP BY 1, 2""",
         "acts": "SELECT activity, count(DISTINCT lead_id) AS cases FROM st GROUP BY 1"}
Q["n5_observed_steps"] = lambda spark, folder: N.observed(N.case_sequence(order_log(spark, folder), "Order")).pairs
SQL["n5_observed_steps"] = sql("SELECT * FROM pairs", _SEEN)
Q["n5_observed_activities"] = lambda spark, folder: N.observed(N.case_sequence(order_log(spark, folder), "Order")).activities
SQL["n5_observed_activities"] = sql("SELECT * FROM acts", _SEEN)

# which flow allows which step of the model, by hand
_ALLOWED = {"allowed": """SELECT * FROM (VALUES ('f1', '▶start', 'Place Order'), ('f2', 'Place Order', 'Ship Item'), ('f2', 'Place Order', 'Accept Item'),
    ('f3', 'Place Order', 'Ship Item'), ('f3', 'Ship Item', 'Ship Item'), ('f3', 'Accept Item', 'Ship Item'), ('f4', 'Place Order', 'Accept Item'), ('f4', 'Ship Item', 'Accept Item'), ('f4', 'Accept Item', 'Accept Item'),
    ('f5', 'Ship Item', 'Ship Item'), ('f5', 'Ship Item', 'Accept Item'), ('f5', 'Ship Item', '■end'), ('f6', 'Accept Item', 'Ship Item'), ('f6', 'Accept Item', 'Accept Item'), ('f6', 'Accept Item', '■end'),
    ('f7', 'Ship Item', 'Ship Item'), ('f7', 'Ship Item', 'Accept Item'), ('f7', 'Accept Item', 'Ship Item'), ('f7', 'Accept Item', 'Accept Item'),
    ('f8', 'Ship Item', '■end'), ('f8', 'Accept Item', '■end'), ('f9', 'Ship Item', '■end'), ('f9', 'Accept Item', '■end')) t(flow_id, source, target)"""}


def n6(spark, folder):
    m = the_model(spark, folder)
    log = order_log(spark, folder)
    allowed = N.look_through(m, N.match_tasks(m, log.events.select("activity").distinct()))
    return allowed.join(N.observed(N.case_sequence(log, "Order")).pairs, ["source", "target"], "left").select(
        "flow_id", "source", "target", F.coalesce("cases", F.lit(0)).alias("cases"))


Q["n6_allowed_steps"] = n6
SQL["n6_allowed_steps"] = sql("SELECT flow_id, source, target, coalesce(cases, 0) AS cases FROM allowed LEFT JOIN pairs USING (source, target)", {**_SEEN, **_ALLOWED})

Q["n7_flow_status"] = lambda spark, folder: compared(spark, folder).flows.select("flow_id", "count", "status")
SQL["n7_flow_status"] = sql("""SELECT flow_id, coalesce(sum(cases), 0)::BIGINT AS count, CASE WHEN coalesce(sum(cases), 0) > 0 THEN 'ok' ELSE 'miss' END AS status
    FROM allowed LEFT JOIN pairs USING (source, target) GROUP BY 1""", {**_SEEN, **_ALLOWED})
Q["n7_element_status"] = lambda spark, folder: compared(spark, folder).elements.select("node_id", "activity", "count", "status")
SQL["n7_element_status"] = sql("""SELECT node_id, activity, count, CASE WHEN count > 0 THEN 'ok' ELSE 'miss' END AS status FROM (
    SELECT CASE activity WHEN 'Place Order' THEN 't1' WHEN 'Ship Item' THEN 't2' ELSE 't3' END AS node_id, activity, cases AS count FROM acts WHERE activity <> 'Return Item'
    UNION ALL SELECT 't4', NULL, 0
    UNION ALL SELECT 's', NULL, (SELECT coalesce(sum(cases), 0)::BIGINT FROM pairs WHERE source = '▶start' AND target = 'Place Order')
    UNION ALL SELECT 'e', NULL, (SELECT coalesce(sum(cases), 0)::BIGINT FROM pairs WHERE target = '■end' AND source IN ('Ship Item', 'Accept Item'))
    UNION ALL SELECT g, NULL, (SELECT coalesce(sum(cases), 0)::BIGINT FROM allowed JOIN pairs USING (source, target) WHERE list_contains(fs, flow_id)) FROM (VALUES ('g1', ['f2', 'f7']), ('g2', ['f5', 'f6'])) t(g, fs))""", {**_SEEN, **_ALLOWED})

Q["n8_extra_activities"] = lambda spark, folder: compared(spark, folder).extra.select("activity", "count")
SQL["n8_extra_activities"] = sql("SELECT activity, cases AS count FROM acts WHERE activity = 'Return Item'", _SEEN)
Q["n8_deviating_edges"] = lambda spark, folder: compared(spark, folder).red_edges
_NODE = "CASE {} WHEN 'Place Order' THEN 't1' WHEN 'Ship Item' THEN 't2' WHEN 'Accept Item' THEN 't3' ELSE 'x:Return Item' END"
SQL["n8_deviating_edges"] = sql(f"""SELECT {_NODE.format('source')} AS source, {_NODE.format('target')} AS target, cases AS count FROM pairs
    WHERE source <> '▶start' AND target <> '■end' AND (source, target) NOT IN (SELECT (source, target) FROM allowed)""", {**_SEEN, **_ALLOWED})


def n9(spark, folder):
    """The most frequent variant as a model, and only the cases of the first two variants."""
    log = order_log(spark, folder)
    seq = N.case_sequence(log, "Order")
    steps = N.variant_model(model.variants(seq, flags=True), 2)
    o = N.compare(log, "Order", N.model_of_steps(steps), steps, variant_ids=[1, 2])
    return o.elements.where("kind = 'activity'").select("node_id", "activity", "count", "status", F.lit(o.cases_total).alias("cases_total"), F.lit(o.cases_selected).alias("cases_selected"))


Q["n9_comparison"] = n9
SQL["n9_comparison"] = sql("""SELECT 'Activity_' || i AS node_id, s[i].a AS activity, (SELECT count(DISTINCT lead_id) FROM runs WHERE activity = s[i].a AND lead_id IN (SELECT lead_id FROM sel)) AS count,
    'ok' AS status, (SELECT count(*) FROM vc) AS cases_total, (SELECT count(*) FROM sel) AS cases_selected
    FROM (SELECT s, unnest(generate_series(1, len(s))) AS i FROM vt WHERE variant_id = 2)""", {**_v("rel"), "sel": "SELECT lead_id FROM vc JOIN vt USING (s) WHERE variant_id <= 2"})


def n10(spark, folder):
    v = O.cases(order_log(spark, folder), "Order").variants
    m = N.model_of_steps(N.variant_model(v, 7))
    return m.flows.select(F.col("flow_id").alias("id"), F.col("source").alias("a"), F.col("target").alias("b")).unionByName(
        m.nodes.select(F.col("node_id").alias("id"), F.col("kind").alias("a"), F.col("name").alias("b")))


Q["n10_variant_model"] = n10
SQL["n10_variant_model"] = sql("""
    SELECT 'Flow_' || (i + 1) AS id, CASE i WHEN 0 THEN 'StartEvent_1' ELSE 'Activity_' || i END AS a, CASE i WHEN len(s) THEN 'EndEvent_1' ELSE 'Activity_' || (i + 1) END AS b
        FROM (SELECT s, unnest(generate_series(0, len(s))) AS i FROM vt WHERE variant_id = 7)
    UNION ALL SELECT 'Activity_' || i, 'activity', s[i].a FROM (SELECT s, unnest(generate_series(1, len(s))) AS i FROM vt WHERE variant_id = 7)
    UNION ALL SELECT 'StartEvent_1', 'start', '' UNION ALL SELECT 'EndEvent_1', 'end', ''""", _v("(SELECT object_id AS lead_id, * FROM e2o WHERE object_type = 'Order')"))


def n3(spark, folder):
    """The model of a variant, written as a file and read back."""
    m = N.model_of_steps(N.variant_model(O.cases(order_log(spark, folder), "Order").variants, 7))
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    N.write_bpmn(m, path)
    m = N.read_bpmn(spark, path)
    return m.flows.select(F.col("flow_id").alias("id"), F.col("source").alias("a"), F.col("target").alias("b")).unionByName(
        m.nodes.select(F.col("node_id").alias("id"), F.col("kind").alias("a"), F.col("name").alias("b")))


Q["n3_model_graph"] = n3
SQL["n3_model_graph"] = SQL["n10_variant_model"]


def n11(spark, folder):
    """Sessions with the parity of the user's number as a team."""
    log = session_log(spark, folder)
    from tracewright.plans.log import EventLog
    team = F.concat(F.lit("team "), (F.element_at("attrs", "k").cast("int") % 3).cast("string"))
    events = log.events.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("team"), team)))
    return N.activity_roles(EventLog(log.objects, events, log.e2o), ["click", "error", "purchase", "signup", "view"])


Q["n11_activity_roles"] = n11
SQL["n11_activity_roles"] = sql("""SELECT activity, 'team' AS attribute, 'team ' || t AS role FROM (
    SELECT activity, k::INTEGER % 3 AS t, row_number() OVER (PARTITION BY activity ORDER BY count(*) DESC, k::INTEGER % 3) AS r FROM act WHERE k IS NOT NULL GROUP BY 1, 2) WHERE r = 1""")
