"""Common table expressions of the comparison SQL: the same logs straight from the given tables."""

from __future__ import annotations

import re

PARTS: dict[str, str] = {
    # ---- order log -------------------------------------------------------
    "item_first": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS rn FROM lineitem)
        WHERE rn = 1""",
    "obj": """
        SELECT 'Order:' || o_orderkey AS object_id, 'Order' AS object_type, o_orderkey::VARCHAR AS key FROM orders
        UNION ALL SELECT 'Item:' || l_linenumber || '|' || l_orderkey, 'Item', l_linenumber || '|' || l_orderkey FROM item_first
        UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_custkey::VARCHAR FROM customer
        UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_suppkey::VARCHAR FROM supplier
        UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_partkey::VARCHAR FROM part""",
    "attr": """
        SELECT 'Order:' || o_orderkey AS object_id, 'Order' AS object_type, unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice', 'o_custkey']) AS name,
            unnest([o_orderstatus, o_orderpriority, o_totalprice::VARCHAR, o_custkey::VARCHAR]) AS value FROM orders
        UNION ALL SELECT 'Item:' || l_linenumber || '|' || l_orderkey, 'Item', unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_returnflag', 'l_shipdate']),
            unnest([l_quantity::VARCHAR, l_extendedprice::VARCHAR, l_discount::VARCHAR, l_returnflag, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')]) FROM item_first
        UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', unnest(['c_mktsegment', 'c_nationkey', 'c_name']),
            unnest([c_mktsegment, c_nationkey::VARCHAR, c_name]) FROM customer
        UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', unnest(['s_name', 's_nationkey']), unnest([s_name, s_nationkey::VARCHAR]) FROM supplier
        UNION ALL SELECT 'Part:' || p_partkey, 'Part', unnest(['p_brand', 'p_type']), unnest([p_brand, p_type]) FROM part""",
    "ev": """
        SELECT '1|' || chr(96 + length(o_orderkey::VARCHAR)::INTEGER) || o_orderkey AS event_id, 'Place Order' AS activity, o_orderdate AS ts,
            'Place Order' AS event_group, o_orderkey AS ok, NULL AS ln, o_custkey AS ck, NULL AS pk, NULL AS sk, NULL AS l_linestatus FROM orders
        UNION ALL
        SELECT '2|' || chr(96 + length(l_orderkey::VARCHAR)::INTEGER) || l_orderkey || '|' || chr(96 + length(l_linenumber::VARCHAR)::INTEGER) || l_linenumber || '|' || chr(96 + length(l_partkey::VARCHAR)::INTEGER) || l_partkey
            || '|' || chr(96 + length(l_suppkey::VARCHAR)::INTEGER) || l_suppkey || '|' || chr(95 + strpos(l_quantity::VARCHAR, '.')::INTEGER) || l_quantity::VARCHAR || '|' || chr(95 + strpos(l_extendedprice::VARCHAR, '.')::INTEGER) || l_extendedprice::VARCHAR,
            CASE l_returnflag WHEN 'N' THEN 'Ship Item' WHEN 'R' THEN 'Return Item' ELSE 'Accept Item' END, l_shipdate, 'Item',
            l_orderkey, l_linenumber, NULL, l_partkey, l_suppkey, l_linestatus FROM lineitem""",
    "e2o": """
        SELECT * FROM (
            SELECT event_id, 'Order:' || ok AS object_id, 'Order' AS object_type, 'involves' AS qualifier, activity, ts FROM ev WHERE event_group = 'Place Order'
            UNION ALL SELECT event_id, 'Customer:' || ck, 'Customer', 'for customer', activity, ts FROM ev WHERE event_group = 'Place Order'
            UNION ALL SELECT event_id, 'Item:' || ln || '|' || ok, 'Item', 'involves', activity, ts FROM ev WHERE event_group = 'Item'
            UNION ALL SELECT event_id, 'Order:' || ok, 'Order', 'for order', activity, ts FROM ev WHERE event_group = 'Item'
            UNION ALL SELECT event_id, 'Supplier:' || sk, 'Supplier', 'for supplier', activity, ts FROM ev WHERE event_group = 'Item'
            UNION ALL SELECT event_id, 'Part:' || pk, 'Part', 'for part', activity, ts FROM ev WHERE event_group = 'Item')
        WHERE object_id IN (SELECT object_id FROM obj)""",
    "tstat": """
        SELECT o.object_type, o.objects, coalesce(l.with_events, 0) AS with_events, coalesce(l.events, 0) AS events,
            coalesce(l.events / nullif(l.with_events, 0), 0.0) AS average,
            coalesce(l.events / l.with_events >= 8 AND l.with_events * 4 <= l.events, false) AS hub
        FROM (SELECT object_type, count(*) AS objects FROM obj GROUP BY 1) o
        LEFT JOIN (SELECT object_type, count(DISTINCT object_id) AS with_events, count(DISTINCT event_id) AS events FROM e2o GROUP BY 1) l USING (object_type)""",
    "nonhub": "SELECT * FROM e2o WHERE object_type NOT IN (SELECT object_type FROM tstat WHERE hub)",
    "seq": """
        SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY ts, event_id) AS seq,
            lag(activity) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS prev_act,
            lead(activity) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS next_act,
            lag(ts) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS prev_ts,
            lead(ts) OVER (PARTITION BY object_id ORDER BY ts, event_id) AS next_ts FROM e2o""",
    # events of an order with its directly linked, non-hub objects
    "rel": """
        SELECT DISTINCT l.object_id AS lead_id, x.event_id, x.activity, x.ts FROM e2o l
        JOIN nonhub m ON m.event_id = l.event_id JOIN nonhub x ON x.object_id = m.object_id WHERE l.object_type = 'Order'
        UNION SELECT object_id, event_id, activity, ts FROM e2o WHERE object_type = 'Order'""",
    # the same, walking to items only and never through another order
    "cas": """
        SELECT DISTINCT l.object_id AS lead_id, x.event_id, x.activity, x.ts FROM e2o l
        JOIN e2o m ON m.event_id = l.event_id AND m.object_type = 'Item' JOIN e2o x ON x.object_id = m.object_id WHERE l.object_type = 'Order'
        UNION SELECT object_id, event_id, activity, ts FROM e2o WHERE object_type = 'Order'""",
    # ---- split log: closed and open orders; pending ones are left out ----
    "pobj": """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'Closed Order:' ELSE 'Order:' END || o_orderkey AS object_id,
            CASE o_orderstatus WHEN 'F' THEN 'Closed Order' ELSE 'Order' END AS object_type, o_orderkey AS ok FROM orders WHERE o_orderstatus <> 'P'
        UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', NULL FROM customer""",
    "prow": """
        SELECT event_id, CASE WHEN event_group = 'Place Order' THEN activity WHEN activity = 'Ship Item' THEN 'Ship Item'
            WHEN activity = 'Accept Item' THEN 'Item [l_returnflag=A]' END AS activity, ts, event_group, ok FROM ev""",
    "pe2o": """
        SELECT r.event_id, o.object_id, o.object_type, CASE r.event_group WHEN 'Item' THEN 'for order' ELSE 'involves' END AS qualifier, r.activity, r.ts
            FROM prow r JOIN pobj o ON o.ok = r.ok AND o.object_type <> 'Customer' WHERE r.activity IS NOT NULL
        UNION ALL SELECT r.event_id, 'Customer:' || h.o_custkey, 'Customer', 'for customer', r.activity, r.ts
            FROM prow r JOIN orders h ON h.o_orderkey = r.ok WHERE r.activity IS NOT NULL AND r.event_group = 'Item'
            AND h.o_custkey IN (SELECT c_custkey FROM customer)""",
    "pev": """
        SELECT * FROM prow WHERE activity IS NOT NULL AND (event_group = 'Item' OR ok IN (SELECT ok FROM pobj WHERE ok IS NOT NULL))""",
    # ---- session log -----------------------------------------------------
    "act": """
        SELECT event_id AS id, chr(96 + length(event_id::VARCHAR)::INTEGER) || event_id AS eid, date_trunc('second', ts) AS ts, user_id, event_type AS activity, value,
            strftime(ts, '%Y-%m-%d') AS day, props->>'$.k' AS k FROM events""",
    "sobj": """
        SELECT DISTINCT 'Session:' || day || '|' || user_id AS object_id, 'Session' AS object_type FROM act
        UNION ALL SELECT DISTINCT 'User:' || user_id, 'User' FROM act
        UNION ALL SELECT DISTINCT 'Key:' || k, 'Key' FROM act WHERE k IS NOT NULL""",
    "se2o": """
        SELECT eid AS event_id, 'Session:' || day || '|' || user_id AS object_id, 'Session' AS object_type, 'involves' AS qualifier, activity, ts FROM act
        UNION ALL SELECT eid, 'User:' || user_id, 'User', 'for user', activity, ts FROM act
        UNION ALL SELECT eid, 'Key:' || k, 'Key', 'for key', activity, ts FROM act WHERE k IS NOT NULL""",
}

NEEDS = {"obj": ["item_first"], "attr": ["item_first"], "e2o": ["ev", "obj"], "tstat": ["obj", "e2o"], "nonhub": ["e2o", "tstat"],
         "seq": ["e2o"], "rel": ["e2o", "nonhub"], "cas": ["e2o"], "pobj": [], "prow": ["ev"], "pe2o": ["prow", "pobj"], "pev": ["prow", "pobj"], "sobj": ["act"], "se2o": ["act"]}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the shared expressions that ``body`` and ``extra`` mention, in order of need."""
    extra = extra or {}
    text = " ".join([body, *extra.values()])
    wanted: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in wanted:
            wanted.append(name)

    for name in PARTS:
        if name not in extra and re.search(rf"\b{name}\b(?!\.)", text):
            need(name)
    parts = [f"{n} AS ({PARTS[n].strip()})" for n in wanted] + [f"{n} AS ({q.strip()})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
