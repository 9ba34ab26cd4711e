"""Queries of the root-cause analysis: why do orders have returned items?"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import order_log, session_log, table
from catalog.kpis import _O
from catalog.sqlparts import sql
from tracewright.functions import fixed
from tracewright.functions.spread import at_rank, median, ranked_values
from tracewright.operators import filters as X
from tracewright.operators.kpi.compile import kpi_rows
from tracewright.operators.rca import analysis as A
from tracewright.operators.rca import cohort as C
from tracewright.operators.rca import features as FE
from tracewright.operators.rca import manual as MP
from tracewright.operators.rca import population as P
from tracewright.operators.rca import segment as SG
from tracewright.operators.rca import statistics as ST
from tracewright.session import settle

Q, SQL = {}, {}
r4 = lambda c, name=None: F.round(c, 4).alias(name or c)

K_RETURN = {"id": "ret", "object_type": "Order", "measure": "share", "condition": {"op": "activity", "activities": ["Return Item"]},
            "target": {"op": "<=", "value": 20}}
K_SHIP = {"id": "ship", "object_type": "Order", "measure": "duration", "target": {"op": "<=", "value": 300},
          "duration": {"from": {"activity": "Place Order"}, "to": {"activity": "Ship Item"}, "stat": "median"}}
K_LATE = {"id": "late", "object_type": "Order", "measure": "share", "target": {"op": "<=", "value": 20},
          "condition": {"op": "duration", "from": {"activity": "Place Order"}, "to": {"activity": "Ship Item"}, "cmp": "gt", "days": 500}}


def pop_of(spark, folder, kpi):
    return settle(P.population(kpi, kpi_rows(order_log(spark, folder), kpi)), "population")


_POP = {**_O, "pop": "SELECT object_id AS case_id, (nr > 0)::INTEGER::DOUBLE AS y, start_ts FROM o"}
_DPOP = {**_O, "pop": "SELECT object_id AS case_id, ship1 AS y, start_ts FROM o WHERE ship1 IS NOT NULL"}


def r1(spark, folder):
    a = pop_of(spark, folder, K_RETURN).select(F.lit("ret").alias("kpi"), "case_id", "y")
    return a.unionByName(pop_of(spark, folder, K_SHIP).select(F.lit("ship").alias("kpi"), "case_id", r4("y")))


Q["r1_symptom"] = r1
SQL["r1_symptom"] = sql("SELECT 'ret' AS kpi, object_id AS case_id, (nr > 0)::INTEGER::DOUBLE AS y FROM o UNION ALL SELECT 'ship', object_id, round(ship1, 4) FROM o WHERE ship1 IS NOT NULL", _O)


def r2(spark, folder):
    log = order_log(spark, folder)
    acts, attrs = P.not_causes(K_LATE | {"amount": "o_totalprice"}, [
        {"kind": "dimension", "type": "Order", "dimension": {"source": "related", "object_type": "Customer", "attribute": "c_mktsegment"}, "values": ["BUILDING"]},
        {"kind": "object", "type": "Order", "attribute": "o_orderstatus", "values": ["F"]}], "Order")
    left = X.exploded_attributes(log.objects.where(F.col("object_type").isin("Order", "Customer"))).groupBy("object_type", "attribute").agg(F.count(F.lit(1)).alias("objects"))
    for t, a in attrs:
        left = left.where(~((F.col("object_type") == t) & (F.col("attribute") == a)))
    more = log.events.where(~F.col("activity").isin(list(acts))).groupBy("activity").agg(F.count(F.lit(1)).alias("objects"))
    return left.unionByName(more.select(F.lit("__event__").alias("object_type"), F.col("activity").alias("attribute"), "objects"))


Q["r2_tautology_guards"] = r2
SQL["r2_tautology_guards"] = sql("""SELECT object_type, name AS attribute, count(*) AS objects FROM attr WHERE object_type IN ('Order', 'Customer')
    AND name NOT IN ('o_totalprice', 'o_orderstatus', 'c_mktsegment') GROUP BY 1, 2
    UNION ALL SELECT '__event__', activity, count(*) FROM ev WHERE activity NOT IN ('Place Order', 'Ship Item') GROUP BY 2""")

Q["r3_cutoffs"] = lambda spark, folder: P.cutoffs(order_log(spark, folder), K_SHIP, pop_of(spark, folder, K_SHIP))
SQL["r3_cutoffs"] = sql("""SELECT case_id, epoch(o_orderdate) + 300 * 86400.0 AS cutoff FROM pop JOIN orders ON 'Order:' || o_orderkey = case_id""", _DPOP)

Q["r4_technical_users"] = lambda spark, folder: MP.technical_users(MP.event_users(session_log(spark, folder))).select(
    "user", "events", r4("burst_share"), r4("off_share"), "technical")
_TECH = {"u": """SELECT user_id::VARCHAR AS user, sum(n)::BIGINT AS events, sum(n) FILTER (n >= 3) AS b, sum(n) FILTER (isodow(ts) >= 6 OR hour(ts) < 6) AS f
    FROM (SELECT user_id, ts, count(*) AS n FROM act GROUP BY 1, 2) GROUP BY 1""",
         "tech": """SELECT user, events, coalesce(b, 0) / events AS burst_share, coalesce(f, 0) / events AS off_share,
    events >= 20 AND (coalesce(b, 0) / events >= 0.6 OR coalesce(f, 0) / events >= 0.5) AS technical FROM u"""}
SQL["r4_technical_users"] = sql("SELECT user, events, round(burst_share, 4) AS burst_share, round(off_share, 4) AS off_share, technical FROM tech", _TECH)


def r5(spark, folder):
    """Item events of one day, counted as blocks: without users, many at one instant mean a program."""
    p = MP.manual_profile(order_log(spark, folder))
    hand = p.manual.groupBy("activity").agg(F.count(F.lit(1)).alias("manual_events"))
    return p.automatic.join(hand, "activity", "left").select("activity", r4("auto_share"), F.coalesce("manual_events", F.lit(0)).alias("manual_events"))


Q["r5_manual_exceptions"] = r5
SQL["r5_manual_exceptions"] = sql("""SELECT activity, round(round(a / n, 3), 4) AS auto_share, n - a AS manual_events FROM (
    SELECT activity, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (c >= 5), 0)::BIGINT AS a FROM (SELECT activity, ts, count(*) AS c FROM ev GROUP BY 1, 2) GROUP BY 1)
    WHERE n >= 20 AND a >= 0.7 * n""")


def lead_values(spark, folder):
    log, pop = order_log(spark, folder), pop_of(spark, folder, K_RETURN)
    return log, pop, FE.lead_values(log, "Order", pop, set())


def r6(spark, folder):
    _, pop, values = lead_values(spark, folder)
    return FE.attribute_groups(values, pop.count()).select("grp", "kind", "distinct", "filled", "mode", F.array_join(F.transform("cuts", lambda c: F.round(c, 2).cast("string")), ", ").alias("cuts"))


_CUT = """SELECT 'attr:Order:' || name AS grp, list_distinct([(l)[(n * 0.25)::BIGINT + 1]]) AS x FROM v"""
Q["r6_value_kinds"] = r6
SQL["r6_value_kinds"] = sql("""SELECT 'attr:Order:' || name AS grp, CASE WHEN num THEN 'number' ELSE 'text' END AS kind, d AS "distinct", n AS filled,
    CASE WHEN num AND d > 8 THEN 'range' WHEN d > 50 AND d > 0.5 * n THEN 'skip' ELSE 'value' END AS mode,
    CASE WHEN num AND d > 8 THEN array_to_string(list_sort(list_distinct([round(l[floor(n * 0.25)::BIGINT + 1], 2), round(l[floor(n * 0.5)::BIGINT + 1], 2), round(l[floor(n * 0.75)::BIGINT + 1], 2)])), ', ') END AS cuts
    FROM (SELECT name, count(*) AS n, count(DISTINCT value) AS d, name IN ('o_totalprice', 'o_custkey') AS num, list_sort(list(try_cast(value AS DOUBLE))) AS l FROM attr WHERE object_type = 'Order' GROUP BY 1)""")


def r7(spark, folder):
    _, pop, values = lead_values(spark, folder)
    f = FE.value_features(values, pop.select("case_id"), pop.count())
    return f.groupBy("feature", "family", "grp").agg(F.count(F.lit(1)).alias("cases"))


_FEAT = {
    "ov": "SELECT object_id AS case_id, name, value FROM attr WHERE object_type = 'Order'",
    "cut": """SELECT name, list_sort(list_distinct([l[floor(n * 0.25)::BIGINT + 1], l[floor(n * 0.5)::BIGINT + 1], l[floor(n * 0.75)::BIGINT + 1]])) AS cuts FROM (
        SELECT name, count(*) AS n, list_sort(list(value::DOUBLE)) AS l FROM ov WHERE name IN ('o_totalprice', 'o_custkey') GROUP BY 1 HAVING count(DISTINCT value) > 8)""",
    "feat": """SELECT case_id, 'attr:Order:' || name || ':v:' || value AS feature, 'context' AS family, 'attr:Order:' || name AS grp FROM ov WHERE name IN ('o_orderstatus', 'o_orderpriority')
        UNION ALL SELECT case_id, 'attr:Order:' || name || ':range:' || len(list_filter(cuts, lambda c: value::DOUBLE > c)), 'context', 'attr:Order:' || name FROM ov JOIN cut USING (name)""",
}
Q["r7_value_features"] = r7
SQL["r7_value_features"] = sql("SELECT feature, family, grp, count(*) AS cases FROM feat GROUP BY 1, 2, 3 HAVING count(*) >= 20 OR feature LIKE '%:range:%'", _FEAT)


def r8(spark, folder):
    log, pop = order_log(spark, folder), pop_of(spark, folder, K_RETURN)
    f = FE.related_features(log, "Order", pop, pop.count(), set())
    return f.where(~F.col("feature").rlike(":(range:.*|empty)$")).groupBy("feature", "grp").agg(F.count(F.lit(1)).alias("cases"))


Q["r8_related_features"] = r8
SQL["r8_related_features"] = sql("""
    SELECT grp || CASE WHEN grp LIKE '%:__id__' THEN '' ELSE '' END AS grp, feature, cases FROM (
    SELECT grp, CASE WHEN grp LIKE '%\\_\\_id\\_\\_' ESCAPE '\\' THEN replace(grp, '__id__', 'id:') || value ELSE grp || ':v:' || value END AS feature, cases,
        row_number() OVER (PARTITION BY grp ORDER BY cases DESC, value) AS r FROM (
        SELECT grp, value, count(DISTINCT case_id) AS cases FROM (
            SELECT case_id, 'rel:' || t || ':__id__' AS grp, coalesce(n.value || ' (' || split_part(oid, ':', 2) || ')', substring(oid, position(':' IN oid) + 1)) AS value
                FROM pairs LEFT JOIN (SELECT object_id, value FROM attr WHERE name IN ('c_name', 's_name')) n ON n.object_id = oid
            UNION ALL SELECT case_id, 'rel:' || t || ':' || name, value FROM pairs JOIN attr ON attr.object_id = oid JOIN keepattr USING (name)) GROUP BY 1, 2) WHERE cases >= 20) WHERE r <= 30""", {
    "pairs": "SELECT DISTINCT l.object_id AS case_id, m.object_type AS t, m.object_id AS oid FROM e2o l JOIN e2o m USING (event_id) WHERE l.object_type = 'Order' AND m.object_type <> 'Order'",
    "flat": "SELECT DISTINCT case_id, t, name, value FROM pairs JOIN attr ON attr.object_id = oid",
    "keepattr": """SELECT name FROM (SELECT name, count(DISTINCT value) AS d, count(DISTINCT case_id) AS f,
        count(*) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) / count(*) >= 0.8 AS num FROM flat WHERE name <> 'l_shipdate' GROUP BY 1)
        WHERE NOT (num AND d > 8) AND NOT (d > 50 AND d > 0.5 * f)"""})


def r9(spark, folder):
    log, pop = order_log(spark, folder), pop_of(spark, folder, K_SHIP)
    cut = P.cutoffs(log, K_SHIP, pop)
    f = FE.behaviour_features(log, "Order", cut, {"Place Order", "Ship Item"}, MP.ManualProfile(None, None, None, None))
    return f.groupBy("feature", "family").agg(F.count(F.lit(1)).alias("cases"))


Q["r9_behaviour_features"] = r9
SQL["r9_behaviour_features"] = sql("""SELECT CASE k WHEN 1 THEN 'act:' ELSE 'rep:' END || activity AS feature, 'behavior' AS family, count(*) AS cases FROM (
    SELECT case_id, activity, count(*) AS n FROM pop JOIN orders ON 'Order:' || o_orderkey = case_id JOIN cas ON cas.lead_id = case_id
    WHERE activity NOT IN ('Place Order', 'Ship Item') AND epoch(ts) < epoch(o_orderdate) + 300 * 86400 GROUP BY 1, 2), (SELECT unnest([1, 2]) AS k) WHERE n >= k GROUP BY 1, 2""", _DPOP)

Q["r10_time_features"] = lambda spark, folder: FE.time_features(pop_of(spark, folder, K_RETURN)).groupBy("feature", "grp").agg(F.count(F.lit(1)).alias("cases"))
SQL["r10_time_features"] = sql("""
    SELECT 'time:wd:' || (isodow(start_ts) - 1) AS feature, 'time:wd' AS grp, count(*) AS cases FROM pop GROUP BY 1
    UNION ALL SELECT 'time:qend', 'time:qend', count(*) FROM pop WHERE month(start_ts) IN (3, 6, 9, 12) AND day(start_ts) >= 17
    UNION ALL SELECT 'time:load', 'time:load', sum(n)::BIGINT FROM wk WHERE n > (SELECT (list_sort(list(n)))[count(*) * 2 // 3 + 1] FROM wk) HAVING (SELECT count(*) FROM wk) >= 8""", {
    **_POP, "wk": "SELECT isoyear(start_ts) AS y, week(start_ts) AS w, count(*) AS n FROM pop GROUP BY 1, 2"})


def features(spark, folder, kpi):
    log, pop = order_log(spark, folder), pop_of(spark, folder, kpi)
    values = FE.lead_values(log, "Order", pop, set())
    return pop, settle(FE.value_features(values, pop.select("case_id"), pop.count()), "features")


_EFF = """SELECT feature, count(*) AS n, sum(y) AS s, avg(y) AS m_g, ((SELECT sum(y) FROM pop) - sum(y)) / ((SELECT count(*) FROM pop) - count(*)) AS m_r FROM feat JOIN pop USING (case_id) GROUP BY 1"""


def r11_rates(spark, folder):
    pop, f = features(spark, folder, K_RETURN)
    return ST.binary_effects(pop, f).select("feature", "n", *[F.round(c, 6).alias(c) for c in ("m_g", "m_r", "diff", "lift")], r4("excess"))


def r11_days(spark, folder):
    pop, f = features(spark, folder, K_SHIP)
    return ST.duration_effects(pop, f).select("feature", "n", *[r4(c) for c in ("m_g", "m_r", "med_g", "med_r", "diff")], F.round("excess", 2).alias("excess"))


Q["r11_effects_rates"] = r11_rates
SQL["r11_effects_rates"] = sql("SELECT feature, n, round(m_g, 6) AS m_g, round(m_r, 6) AS m_r, round(m_g - m_r, 6) AS diff, round(m_g / m_r, 6) AS lift, round((m_g - m_r) * n, 4) AS excess FROM eff", {**_POP, **_FEAT, "eff": _EFF})
Q["r11_effects_days"] = r11_days
SQL["r11_effects_days"] = sql("""SELECT feature, n, round(m_g, 4) AS m_g, round(m_r, 4) AS m_r, round(med_g, 4) AS med_g, round(med_r, 4) AS med_r, round(med_g - med_r, 4) AS diff, round((m_g - m_r) * n, 2) AS excess
    FROM eff JOIN (SELECT g.feature, median(p.y) FILTER (f.case_id IS NOT NULL) AS med_g, median(p.y) FILTER (f.case_id IS NULL) AS med_r
        FROM (SELECT DISTINCT feature FROM feat) g CROSS JOIN pop p LEFT JOIN feat f ON f.case_id = p.case_id AND f.feature = g.feature GROUP BY 1) USING (feature)""",
                              {**_DPOP, **_FEAT, "ov": "SELECT object_id AS case_id, name, value FROM attr WHERE object_type = 'Order' AND object_id IN (SELECT case_id FROM pop)", "cut": _FEAT["cut"], "feat": _FEAT["feat"], "eff": _EFF})


def r12(spark, folder):
    pop, f = features(spark, folder, K_RETURN)
    return ST.p_values(pop, f, True).select("feature", F.round("p", 6).alias("p"))


Q["r12_fisher"] = r12
# the tail of the hypergeometric distribution, term by term
SQL["r12_fisher"] = sql("""SELECT feature, round(least(1.0, sum(exp(lgamma(n + 1) + lgamma(t - n + 1) + lgamma(b + 1) + lgamma(t - b + 1) - lgamma(t + 1)
        - lgamma(k + 1) - lgamma(n - k + 1) - lgamma(b - k + 1) - lgamma(t - n - b + k + 1)))), 6) AS p
    FROM (SELECT feature, n, t, b, unnest(generate_series(s::BIGINT, least(n, b::BIGINT))) AS k FROM eff, (SELECT count(*) AS t, sum(y) AS b FROM pop))
    GROUP BY 1""", {**_POP, **_FEAT, "eff": _EFF})


def r13(spark, folder):
    pop, f = features(spark, folder, K_SHIP)
    ranked = f.join(pop.select("case_id", "y"), "case_id").join(ST.mid_ranks(pop), "y")
    p = ST.p_values(pop, f, False)
    return ranked.groupBy("feature").agg(F.sum("rank").alias("rank_sum"), F.count(F.lit(1)).alias("n")).join(p, "feature").select(
        "feature", "n", F.round("rank_sum", 1).alias("rank_sum"), (F.col("p") <= 0.05).alias("significant"))


Q["r13_rank_test"] = r13
SQL["r13_rank_test"] = sql("""SELECT feature, n, round(rs, 1) AS rank_sum, (rs - n * (n + 1) / 2 - n * (t - n) / 2 - 0.5) / sqrt(n * (t - n) / 12 * (t + 1 - ties / (t * (t - 1)))) >= 1.6448536269514722 AS significant
    FROM (SELECT feature, count(*) AS n, sum(rk) AS rs FROM feat JOIN ranks USING (case_id) GROUP BY 1), (SELECT count(*)::DOUBLE AS t FROM pop), (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM pop GROUP BY y))""",
                           {**_DPOP, **_FEAT, "ov": "SELECT object_id AS case_id, name, value FROM attr WHERE object_type = 'Order' AND object_id IN (SELECT case_id FROM pop)", "cut": _FEAT["cut"], "feat": _FEAT["feat"],
                            "ranks": "SELECT case_id, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rk FROM pop"})


def candidates(spark, folder, kpi, more=None):
    """Cohort, marks and measured sums of the features of orders."""
    pop, f = features(spark, folder, kpi)
    if more is not None:
        f = f.unionByName(more(pop))
    cases = C.cohort(pop, A.P.symptom(kpi)["kind"] == "binary")
    marks = settle(C.marks(cases, f), "marks")
    return pop, f, cases, marks, C.sums(cases, marks)


def r14(spark, folder):
    """The gates themselves, as the analysis applies them."""
    _, f, cases, _, sums = candidates(spark, folder, K_RETURN)
    rows = [(name, A.large_enough(x.n, cases.n), A.Candidate(name, "context", frozenset(), x).matters(None)) for name, x in sums.items()]
    return spark.createDataFrame(rows, "feature string, large boolean, matters boolean")


Q["r14_gates"] = r14
SQL["r14_gates"] = sql("""SELECT feature, n >= 20 AND n >= 0.03 * (SELECT count(*) FROM pop) AND n < (SELECT count(*) FROM pop) AS large,
    m_g / m_r >= 1.5 AND m_g - m_r >= 0.05 AS matters FROM eff""", {**_POP, **_FEAT, "eff": _EFF})


def r15(spark, folder):
    _, f, cases, marks, _ = candidates(spark, folder, K_RETURN)
    group = {r["feature"]: r["grp"] for r in f.select("feature", "grp").distinct().collect()}
    wanted = [(r["a"], r["b"]) for r in ST.overlaps(cases.table, f).where("a < b").collect() if group[r["a"]] != group[r["b"]] and A.large_enough(r["n"], cases.n)]
    pairs = C.sums(cases, C.pair_marks(marks, wanted))
    return spark.createDataFrame([(name, x.n, x.inside, x.outside) for name, x in pairs.items()], "feature string, n long, m_g double, m_r double").select(
        "feature", "n", F.round("m_g", 6).alias("m_g"), F.round("m_r", 6).alias("m_r"))


Q["r15_feature_pairs"] = r15
SQL["r15_feature_pairs"] = sql("""SELECT feature, n, round(s / n, 6) AS m_g, round(((SELECT sum(y) FROM pop) - s) / ((SELECT count(*) FROM pop) - n), 6) AS m_r FROM (
    SELECT a.feature || ' & ' || b.feature AS feature, count(*) AS n, sum(y) AS s FROM feat a JOIN feat b ON a.case_id = b.case_id AND a.feature < b.feature AND a.grp <> b.grp
    JOIN pop ON pop.case_id = a.case_id GROUP BY 1) WHERE n >= 20 AND n >= 0.03 * (SELECT count(*) FROM pop)""", {**_POP, **_FEAT})


def r16(spark, folder):
    pop, f = features(spark, folder, K_RETURN)
    tested = ST.group_sums(pop, f).select("feature", (F.col("n") / F.lit(float(pop.count())) / 10).alias("p"))
    return ST.adjusted_p(tested, 25).select("feature", F.round("q", 6).alias("q"))


Q["r16_adjusted_p"] = r16
SQL["r16_adjusted_p"] = sql("""SELECT feature, round(least(1.0, min(p * 25 / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM (
    SELECT feature, n / (SELECT count(*) FROM pop) / 10 AS p, row_number() OVER (ORDER BY n, feature) AS r FROM eff)""", {**_POP, **_FEAT, "eff": _EFF})


def r17(spark, folder):
    sums = candidates(spark, folder, K_RETURN)[-1]
    rows = [(i, name, h.n, h.inside, h.outside) for name, x in sums.items() for i, h in enumerate(x.halves) if h.n]
    return spark.createDataFrame(rows, "half int, feature string, n long, m_g double, m_r double").select(
        "half", "feature", "n", F.round("m_g", 6).alias("m_g"), F.round("m_r", 6).alias("m_r"))


Q["r17_halves"] = r17
SQL["r17_halves"] = sql("""SELECT half, feature, count(*) AS n, round(avg(y), 6) AS m_g, round((any_value(s) - sum(y)) / (any_value(t) - count(*)), 6) AS m_r
    FROM feat JOIN hp USING (case_id) JOIN (SELECT half, count(*) AS t, sum(y) AS s FROM hp GROUP BY 1) USING (half) GROUP BY 1, 2""", {
    **_POP, **_FEAT, "hp": "SELECT *, (row_number() OVER (ORDER BY start_ts, case_id) > (SELECT count(*) FROM pop) // 2)::INTEGER AS half FROM pop"})


def r18(spark, folder):
    _, f, cases, _, sums = candidates(spark, folder, K_RETURN)
    group = {r["feature"]: r["grp"] for r in f.select("feature", "grp").distinct().collect()}
    rows = [(r["a"], r["b"], A.adjusted_effect(sums[r["a"]], sums[r["b"]], (r["n"], r["s"])))
            for r in ST.overlaps(cases.table, f).collect() if group[r["a"]] != group[r["b"]]]
    return spark.createDataFrame(rows, "feature string, given string, effect double").select("feature", "given", F.round("effect", 6).alias("effect"))


Q["r18_confounding"] = r18
SQL["r18_confounding"] = sql("""SELECT feature, given, round(sum((m_g - m_r) * n) / sum(n), 6) AS effect FROM (
    SELECT feature, given, inside, count(*) FILTER (hit) AS n, count(*) FILTER (NOT hit) AS r, avg(y) FILTER (hit) AS m_g, avg(y) FILTER (NOT hit) AS m_r FROM (
        SELECT a.feature, b.feature AS given, p.y, fa.case_id IS NOT NULL AS hit, fb.case_id IS NOT NULL AS inside
        FROM (SELECT DISTINCT feature, grp FROM feat) a JOIN (SELECT DISTINCT feature, grp FROM feat) b ON a.feature < b.feature AND a.grp <> b.grp CROSS JOIN pop p
        LEFT JOIN feat fa ON fa.case_id = p.case_id AND fa.feature = a.feature LEFT JOIN feat fb ON fb.case_id = p.case_id AND fb.feature = b.feature) GROUP BY 1, 2, 3)
    WHERE n >= 3 AND r >= 3 GROUP BY 1, 2""", {**_POP, **_FEAT})


def r19(spark, folder):
    pop, f = features(spark, folder, K_RETURN)
    n = ST.group_sums(pop, f).select("feature", "n")
    o = ST.overlaps(pop, f).where("a < b")
    a, b = n.select(F.col("feature").alias("a"), F.col("n").alias("na")), n.select(F.col("feature").alias("b"), F.col("n").alias("nb"))
    return o.join(a, "a").join(b, "b").select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


Q["r19_similar_features"] = r19
SQL["r19_similar_features"] = sql("""SELECT a.feature AS a, b.feature AS b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard
    FROM feat a JOIN feat b ON a.case_id = b.case_id AND a.feature < b.feature JOIN (SELECT feature, count(*) AS n FROM feat GROUP BY 1) na ON na.feature = a.feature
    JOIN (SELECT feature, count(*) AS n FROM feat GROUP BY 1) nb ON nb.feature = b.feature GROUP BY 1, 2""", _FEAT)


K_TROUBLE = {"id": "trouble", "object_type": "Order", "measure": "share", "target": {"op": "<=", "value": 10}, "condition": {"op": "any", "items": [
    {"op": "activity", "activities": ["Return Item"], "min_count": 3},
    {"op": "all", "items": [{"op": "attribute", "attribute": "o_orderstatus", "cmp": "in", "values": ["F"]},
                            {"op": "attribute", "attribute": "o_orderpriority", "cmp": "in", "values": ["1-URGENT"]}]}]}}


def r20(spark, folder):
    """What marks orders with many returns or a bad mix of status and priority? Attributes and start times, alone and in pairs.

    The two attributes are left among the features, so that there is something to find.
    """
    pop, f = features(spark, folder, K_TROUBLE)
    found, _ = A.analyse_features(pop, f.unionByName(FE.time_features(pop)), True, top=100)
    return found.select("position", "feature", "family", "n", *[F.round(c, 6).alias(c) for c in ("m_g", "m_r", "diff", "lift", "p", "q", "share_pop", "excess_share")],
                        F.round("excess", 3).alias("excess"), "confidence", "same_cases")


Q["r20_findings"] = r20
_TIME = {
    "wk": "SELECT isoyear(start_ts) AS y, week(start_ts) AS w, count(*) AS n FROM pop GROUP BY 1, 2",
    "timef": """SELECT case_id, 'time:wd:' || (isodow(start_ts) - 1) AS feature, 'time' AS family, 'time:wd' AS grp FROM pop
        UNION ALL SELECT case_id, 'time:qend', 'time', 'time:qend' FROM pop WHERE month(start_ts) IN (3, 6, 9, 12) AND day(start_ts) >= 17
        UNION ALL SELECT case_id, 'time:load', 'time', 'time:load' FROM pop JOIN wk ON wk.y = isoyear(start_ts) AND w = week(start_ts)
            WHERE n > (SELECT (list_sort(list(n)))[count(*) * 2 // 3 + 1] FROM wk) AND (SELECT count(*) FROM wk) >= 8""",
}
_RANKED = {
    "frequent": "SELECT feature FROM feat GROUP BY 1 HAVING count(*) >= 20 OR feature LIKE '%:range:%'",
    "hp": "SELECT case_id, y, (row_number() OVER (ORDER BY start_ts, case_id) > (SELECT count(*) FROM pop) // 2)::INTEGER AS half FROM pop",
    "marks": "SELECT * FROM (SELECT * FROM feat WHERE feature IN (SELECT feature FROM frequent) UNION ALL SELECT * FROM timef) JOIN hp USING (case_id)",
    "tot": "SELECT count(*) AS t, sum(y) AS b, sum(half) AS t1, sum(y * half) AS b1 FROM hp",
    "sums": "SELECT feature, any_value(family) AS family, [any_value(grp)] AS grps, count(*) AS n, sum(y) AS s, sum(half) AS n1, sum(y * half) AS s1 FROM marks GROUP BY 1",
    "single": "SELECT * FROM sums, tot WHERE n >= greatest(20, 0.03 * t) AND n < t",
    "pool": "SELECT * FROM single WHERE family = 'context' AND n >= 40 ORDER BY n DESC, feature LIMIT 20",
    "pairm": """SELECT a.feature || ' & ' || b.feature AS feature, [a.grp, b.grp] AS grps, a.case_id, a.y, a.half, greatest(pa.s / pa.n / ((pa.b - pa.s) / (pa.t - pa.n)), pb.s / pb.n / ((pb.b - pb.s) / (pb.t - pb.n))) AS best
        FROM marks a JOIN marks b ON a.case_id = b.case_id AND a.feature < b.feature AND a.grp <> b.grp JOIN pool pa ON pa.feature = a.feature JOIN pool pb ON pb.feature = b.feature""",
    "pairs": "SELECT feature, 'combination' AS family, any_value(grps) AS grps, count(*) AS n, sum(y) AS s, sum(half) AS n1, sum(y * half) AS s1, any_value(best) AS best FROM pairm GROUP BY 1",
    "tested": """SELECT *, s / n AS m_g, (b - s) / (t - n) AS m_r FROM (
            SELECT feature, family, grps, n, s, n1, s1, 0.0 AS best, t, b, t1, b1 FROM single
            UNION ALL SELECT feature, family, grps, n, s, n1, s1, 1.3 * best, t, b, t1, b1 FROM pairs, tot WHERE n >= greatest(20, 0.03 * t) AND n < t)
        WHERE s / n / ((b - s) / (t - n)) >= greatest(1.5, best) AND s / n - (b - s) / (t - n) >= 0.05""",
    "pv": """SELECT feature, least(1.0, sum(exp(lgamma(n + 1) + lgamma(t - n + 1) + lgamma(b + 1) + lgamma(t - b + 1) - lgamma(t + 1)
            - lgamma(k + 1) - lgamma(n - k + 1) - lgamma(b - k + 1) - lgamma(t - n - b + k + 1)))) AS p
        FROM (SELECT feature, n, t, b, unnest(generate_series(s::BIGINT, least(n, b::BIGINT))) AS k FROM tested) GROUP BY 1""",
    "qv": """SELECT feature, p, least(1.0, min(p * greatest(m, (SELECT count(*) FROM single)) / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q
        FROM (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS m FROM pv)""",
    "found": """SELECT *, (m_g - m_r) * n AS excess FROM tested JOIN qv USING (feature) WHERE q <= 0.05
        AND n1 >= 5 AND n1 < t1 AND s1 / n1 >= 1.15 * (b1 - s1) / (t1 - n1) AND s1 / n1 > (b1 - s1) / (t1 - n1)
        AND n - n1 >= 5 AND n - n1 < t - t1 AND (s - s1) / (n - n1) >= 1.15 * (b - b1 - s + s1) / (t - t1 - n + n1) AND (s - s1) / (n - n1) > (b - b1 - s + s1) / (t - t1 - n + n1)""",
    "held": "SELECT feature, case_id, y FROM marks WHERE feature IN (SELECT feature FROM found) UNION ALL SELECT feature, case_id, y FROM pairm WHERE feature IN (SELECT feature FROM found)",
    "ovl": "SELECT a.feature AS f, o.feature AS o, count(*) AS n, sum(a.y) AS s FROM held a JOIN held o ON a.case_id = o.case_id AND a.feature <> o.feature GROUP BY 1, 2",
    "layers": """SELECT f, o, diff, unnest([ni, f_n - ni]) AS n, unnest([si, f_s - si]) AS s, unnest([o_n, t - o_n]) AS tn, unnest([o_s, b - o_s]) AS ts FROM (
            SELECT f.feature AS f, o.feature AS o, f.m_g - f.m_r AS diff, coalesce(v.n, 0) AS ni, coalesce(v.s, 0) AS si, f.n AS f_n, f.s AS f_s, o.n AS o_n, o.s AS o_s, f.t, f.b
            FROM found f JOIN found o ON f.feature <> o.feature AND NOT list_has_any(f.grps, o.grps) AND 2 * o.excess >= f.excess LEFT JOIN ovl v ON v.f = f.feature AND v.o = o.feature)""",
    "hidden": """SELECT DISTINCT f FROM (SELECT f, o, any_value(diff) AS diff, sum((s / n - (ts - s) / (tn - n)) * n) / sum(n) AS effect FROM layers WHERE n >= 3 AND tn - n >= 3 GROUP BY 1, 2) WHERE 2 * effect < diff""",
    "free": "SELECT *, row_number() OVER (ORDER BY excess DESC, feature) AS i FROM found WHERE feature NOT IN (SELECT f FROM hidden)",
    "near": """SELECT v.f AS feature, list(v.o) AS alike FROM ovl v JOIN free f ON f.feature = v.f JOIN free k ON k.feature = v.o WHERE v.n >= 0.8 * (f.n + k.n - v.n) GROUP BY 1""",
    # the first of each group of nearly equal case sets, from the biggest on
    "walk": """SELECT 0::BIGINT AS i, []::VARCHAR[] AS firsts, ''::VARCHAR AS feature, NULL::VARCHAR AS twin_of
        UNION ALL SELECT i, CASE WHEN hit IS NULL THEN list_append(firsts, feature) ELSE firsts END, feature, hit FROM (
            SELECT w.i + 1 AS i, w.firsts, f.feature, list_filter(w.firsts, lambda x: list_contains(coalesce(alike, []), x))[1] AS hit
            FROM walk w JOIN free f ON f.i = w.i + 1 LEFT JOIN near ON near.feature = f.feature)""",
    "twins": "SELECT twin_of, string_agg(feature, ', ' ORDER BY i) AS same_cases FROM walk WHERE twin_of IS NOT NULL GROUP BY 1",
}
SQL["r20_findings"] = sql("""SELECT (row_number() OVER (ORDER BY i))::INTEGER AS position, f.feature, family, n, round(m_g, 6) AS m_g, round(m_r, 6) AS m_r, round(m_g - m_r, 6) AS diff,
    round(m_g / m_r, 6) AS lift, round(p, 6) AS p, round(q, 6) AS q, round(n / t, 6) AS share_pop, round(excess / b, 6) AS excess_share, round(excess, 3) AS excess,
    CASE WHEN q <= 0.01 AND n >= 50 THEN 'high' ELSE 'medium' END AS confidence, coalesce(same_cases, '') AS same_cases
    FROM free f JOIN (SELECT feature FROM walk WHERE twin_of IS NULL) USING (feature) LEFT JOIN twins ON twins.twin_of = f.feature""",
                          {**_O, "pop": "SELECT object_id AS case_id, (nr >= 3 OR (status = 'F' AND pr = '1-URGENT'))::INTEGER::DOUBLE AS y, start_ts FROM o",
                           **_FEAT, **_TIME, **_RANKED}).replace("WITH ", "WITH RECURSIVE ", 1)


def parts(spark, folder, kpi):
    """Orders of the BUILDING segment against the others."""
    log, pop = order_log(spark, folder), pop_of(spark, folder, kpi)
    ids = X.seeds_of(log, {"kind": "dimension", "type": "Order", "dimension": {"source": "related", "object_type": "Customer", "attribute": "c_mktsegment"}, "values": ["BUILDING"]})
    ids = settle(ids.select(F.col("object_id").alias("case_id")), "segment")
    return log, pop.join(ids, "case_id", "left_semi"), pop.join(ids, "case_id", "left_anti")


def r21(spark, folder):
    _, seg, rest = parts(spark, folder, K_SHIP)
    g = SG.gap(seg, rest, False)
    return spark.createDataFrame([(g["n_seg"], g["n_rest"], g["m_seg"], g["m_rest"], g["med_seg"], g["med_rest"], g["worse"])],
                                 "n_seg long, n_rest long, m_seg double, m_rest double, med_seg double, med_rest double, worse boolean").select(
        "n_seg", "n_rest", r4("m_seg"), r4("m_rest"), r4("med_seg"), r4("med_rest"), "worse")


_SEGP = "SELECT p.*, c_mktsegment = 'BUILDING' AS seg FROM pop p JOIN orders ON 'Order:' || o_orderkey = case_id JOIN customer ON c_custkey = o_custkey"
Q["r21_segment_gap"] = r21
SQL["r21_segment_gap"] = sql("""SELECT count(*) FILTER (seg) AS n_seg, count(*) FILTER (NOT seg) AS n_rest, round(avg(y) FILTER (seg), 4) AS m_seg, round(avg(y) FILTER (NOT seg), 4) AS m_rest,
    round(median(y) FILTER (seg), 4) AS med_seg, round(median(y) FILTER (NOT seg), 4) AS med_rest,
    avg(y) FILTER (seg) > avg(y) FILTER (NOT seg) AND abs(any_value(z)) >= 1.959963984540054 AS worse FROM sp, (
        SELECT (abs(rs - n * (n + 1) / 2 - n * (t - n) / 2) - 0.5) / sqrt(n * (t - n) / 12 * (t + 1 - (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE AS c FROM pop GROUP BY y)) / (t * (t - 1)))) AS z
        FROM (SELECT sum(rk) FILTER (seg) AS rs, count(*) FILTER (seg)::DOUBLE AS n, count(*)::DOUBLE AS t FROM (
            SELECT seg, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rk FROM sp)))""", {**_DPOP, "sp": _SEGP})


def r22(spark, folder):
    log, seg, rest = parts(spark, folder, K_RETURN)
    both = seg.select("case_id", "y").unionByName(rest.select("case_id", "y"))
    cats = SG.categories(log, both, "Order", {("Supplier", "__id__"), ("Part", "__id__"), ("Item", "__id__"), ("Customer", "__id__")}, both.count())
    return SG.mix_effects(seg, rest, cats).select("grp", "cat", F.round("w_seg", 6).alias("w_seg"), F.round("w_rest", 6).alias("w_rest"), F.round("m_rest", 6).alias("m_rest"), F.round("part", 6).alias("part"))


Q["r22_mix_effect"] = r22
SQL["r22_mix_effect"] = sql("""SELECT grp, cat, round(ws, 6) AS w_seg, round(wr, 6) AS w_rest, round(m, 6) AS m_rest, round((ws - wr) * (m - m0), 6) AS part FROM (
    SELECT grp, cat, count(*) FILTER (seg) / any_value(ns) AS ws, count(*) FILTER (NOT seg) / any_value(nr) AS wr, any_value(m0) AS m0,
        CASE WHEN count(*) FILTER (NOT seg) >= 5 THEN avg(y) FILTER (NOT seg) ELSE any_value(m0) END AS m
    FROM (SELECT case_id, grp, replace(replace(feature, grp || ':v:', ''), grp || ':range:', '') AS c, CASE WHEN feature LIKE '%:range:%' THEN 'Q' || (1 + replace(feature, grp || ':range:', '')::INTEGER) ELSE replace(feature, grp || ':v:', '') END AS cat FROM feat)
    JOIN sp USING (case_id), (SELECT count(*) FILTER (seg) AS ns, count(*) FILTER (NOT seg) AS nr, avg(y) FILTER (NOT seg) AS m0 FROM sp) GROUP BY 1, 2)""", {**_POP, **_FEAT, "sp": _SEGP})


def r23(spark, folder):
    a = A.analyse(order_log(spark, folder), {**K_RETURN, "condition": {"op": "activity", "activities": ["Return Item"], "min_count": 99}})
    return spark.createDataFrame([(a.status, a.population, a.bad)], "status string, cases long, bad long")


Q["r23_sufficiency"] = r23
SQL["r23_sufficiency"] = "SELECT 'insufficient' AS status, count(*) AS cases, 0 AS bad FROM orders"
