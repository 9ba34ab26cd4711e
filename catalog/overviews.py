"""Queries of the process overview (lead: orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.data import order_log, session_log
from catalog.sqlparts import sql
from tracewright.operators import model
from tracewright.operators import overview as O

Q, SQL = {}, {}

GOAL = O.Objective("Order", "Place Order", "Return Item")
GOAL_URGENT = O.Objective("Order", "Place Order", "Return Item", "o_orderpriority", ("1-URGENT", "2-HIGH"))
r4 = lambda c, name=None: F.round(c, 4).alias(name or c)

_T = {"tp": "SELECT object_id AS lead_id, min(ts) AS first_ts, epoch(max(ts)) - epoch(min(ts)) AS d FROM e2o WHERE object_type = 'Order' GROUP BY 1"}
_REL = {"tp": "SELECT lead_id, min(ts) AS first_ts, epoch(max(ts)) - epoch(min(ts)) AS d FROM rel GROUP BY 1"}
_GOAL = {"st": "SELECT object_id AS lead_id, min(ts) AS t0 FROM e2o WHERE object_type = 'Order' AND activity = 'Place Order' GROUP BY 1",
         "goal": """SELECT s.lead_id, s.t0, min(e.ts) FILTER (e.ts >= s.t0) AS t1 FROM st s LEFT JOIN
            (SELECT object_id, ts FROM e2o WHERE object_type = 'Order' AND activity = 'Return Item') e ON e.object_id = s.lead_id GROUP BY 1, 2""",
         "tp": "SELECT lead_id, epoch(t1) - epoch(t0) AS d FROM goal"}
_STATS = """SELECT count(d) AS n, round(median(d), 4) AS median, round(avg(d), 4) AS mean, min(d)::DOUBLE AS min, max(d)::DOUBLE AS max,
    (list_sort(list(d) FILTER (d IS NOT NULL)))[round_even(0.9 * (count(d) - 1), 0)::BIGINT + 1]::DOUBLE AS p90 FROM tp"""


def _stats(df):
    return df.select("n", r4("median"), r4("mean"), *[F.col(c).cast("double").alias(c) for c in ("min", "max", "p90")])


Q["o2_statistics"] = lambda spark, folder: _stats(O.throughput(O.cases(order_log(spark, folder), "Order")))
SQL["o2_statistics"] = sql(_STATS, _T)

Q["o3_lifetimes"] = lambda spark, folder: O.lifetimes(order_log(spark, folder)).select("object_type", r4("median_lifetime"))
SQL["o3_lifetimes"] = sql("""SELECT object_type, round(median(d), 4) AS median_lifetime FROM (SELECT object_type, object_id, epoch(max(ts)) - epoch(min(ts)) AS d
    FROM e2o GROUP BY 1, 2) GROUP BY 1""")

Q["o4_relations"] = lambda spark, folder: O.relations(O.cases(order_log(spark, folder), "Order")).select("object_type", F.round("average", 6).alias("average"), F.round("share", 6).alias("share"))
SQL["o4_relations"] = sql("""SELECT object_type, round(count(*) / (SELECT count(DISTINCT object_id) FROM e2o WHERE object_type = 'Order'), 6) AS average,
    round(count(DISTINCT lead_id) / (SELECT count(DISTINCT object_id) FROM e2o WHERE object_type = 'Order'), 6) AS share FROM (
    SELECT DISTINCT m.object_type, l.object_id AS lead_id, m.object_id FROM e2o l JOIN e2o m USING (event_id) WHERE l.object_type = 'Order' AND m.object_type <> 'Order') GROUP BY 1""")

Q["o5_throughput_object"] = lambda spark, folder: O.cases(order_log(spark, folder), "Order").times.select(
    "lead_id", F.col("seconds").cast("double").alias("seconds"))
SQL["o5_throughput_object"] = sql("SELECT lead_id, d::DOUBLE AS seconds FROM tp", _T)
Q["o6_throughput_related"] = lambda spark, folder: O.cases(order_log(spark, folder), "Order", "related").times.select(
    "lead_id", F.col("seconds").cast("double").alias("seconds"))
SQL["o6_throughput_related"] = sql("SELECT lead_id, d::DOUBLE AS seconds FROM tp", _REL)
Q["o6_leads_that_gain"] = lambda spark, folder: O.leads_that_gain(O.cases(session_log(spark, folder), "Session", "related")).unionByName(
    O.leads_that_gain(O.cases(order_log(spark, folder), "Item", "related")))
SQL["o6_leads_that_gain"] = sql("""SELECT 0 AS gaining, count(DISTINCT object_id) AS leads FROM se2o WHERE object_type = 'Session'
    UNION ALL SELECT count(*) FILTER (a > o), count(*) FROM (SELECT object_id, count(*) AS o FROM e2o WHERE object_type = 'Item' GROUP BY 1)
    JOIN (SELECT l.object_id, count(DISTINCT x.event_id) AS a FROM e2o l JOIN nonhub m ON m.event_id = l.event_id JOIN nonhub x ON x.object_id = m.object_id
        WHERE l.object_type = 'Item' GROUP BY 1) USING (object_id)""")
Q["o7_throughput_objective"] = lambda spark, folder: O.cases(order_log(spark, folder), "Order", "objective", GOAL).times.where(
    "seconds is not null").select("lead_id", F.col("seconds").cast("double").alias("seconds"))
SQL["o7_throughput_objective"] = sql("SELECT lead_id, d::DOUBLE AS seconds FROM tp WHERE d IS NOT NULL", _GOAL)

_MONTHS = """SELECT strftime(m, '%Y-%m') AS month, count(lead_id) AS count FROM
    (SELECT unnest(generate_series((SELECT date_trunc('month', min(first_ts)) FROM tp), (SELECT date_trunc('month', max(first_ts)) FROM tp), INTERVAL 1 MONTH)) AS m)
    LEFT JOIN {} ON date_trunc('month', first_ts) = m GROUP BY 1"""
Q["o8_months"] = lambda spark, folder: O.months(O.cases(order_log(spark, folder), "Order").times)
SQL["o8_months"] = sql(_MONTHS.format("tp"), _T)

_VAR = {"runs": """SELECT *, lag(activity) OVER w AS p, lead(activity) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY lead_id ORDER BY ts, event_id)""",
        "vc": """SELECT lead_id, list({{'a': activity, 'r': coalesce(n = activity, false)}} ORDER BY ts, event_id) FILTER (p IS NULL OR p <> activity) AS s FROM runs GROUP BY 1""",
        "vt": """SELECT s, count(*) AS cases, row_number() OVER (ORDER BY count(*) DESC, len(s), s) AS variant_id FROM vc GROUP BY s"""}
_OWN = "(SELECT object_id AS lead_id, * FROM e2o WHERE object_type = 'Order')"


def _v(src):
    return {k: q.format(src=src) for k, q in _VAR.items()}


_VTEXT = "array_to_string(list_transform(s, lambda x: x.a || CASE WHEN x.r THEN '+' ELSE '' END), ' > ')"
_VROWS = f"""SELECT variant_id, {_VTEXT} AS steps, cases, round(cases / sum(cases) OVER (), 6) AS share,
    round(sum(cases) OVER (ORDER BY variant_id) / sum(cases) OVER (), 6) AS cum_share, round(med, 4) AS median, round(mean, 4) AS mean
    FROM vt JOIN (SELECT s, median(d) AS med, avg(d) AS mean FROM vc JOIN tp USING (lead_id) GROUP BY s) USING (s)"""


def _variant_rows(c):
    return O.variant_table(c).select("variant_id", model.step_text().alias("steps"), "cases", F.round("share", 6).alias("share"),
                                     F.round("cum_share", 6).alias("cum_share"), r4("median"), r4("mean"))


Q["o9_variants"] = lambda spark, folder: _variant_rows(O.cases(order_log(spark, folder), "Order"))
SQL["o9_variants"] = sql(_VROWS, {**_T, **_v(_OWN)})
Q["o9_variants_related"] = lambda spark, folder: _variant_rows(O.cases(order_log(spark, folder), "Order", "related"))
SQL["o9_variants_related"] = sql(_VROWS, {**_REL, **_v("rel")})

Q["o10_other_activities"] = lambda spark, folder: O.other_activities(O.cases(order_log(spark, folder), "Order")).select(
    "activity", "objects", "events", F.round("share", 6).alias("share"))
SQL["o10_other_activities"] = sql("""SELECT activity, count(DISTINCT lead_id) AS objects, count(*) AS events, round(count(DISTINCT lead_id) / (SELECT count(*) FROM vc), 6) AS share
    FROM runs WHERE activity NOT IN (SELECT unnest(list_transform(s, lambda x: x.a)) FROM vt WHERE variant_id = 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""", _v(_OWN))
Q["o10_happy_path"] = lambda spark, folder: O.happy_path(O.cases(order_log(spark, folder), "Order")).select(model.step_text().alias("steps"), "cases")
SQL["o10_happy_path"] = sql(f"SELECT {_VTEXT} AS steps, cases FROM vt WHERE variant_id = 1", _v(_OWN))

_HIST = {"h": "SELECT d / 86400 AS v FROM tp WHERE d IS NOT NULL",
         "top": "SELECT (list_sort(list(v)))[floor(0.95 * (count(*) - 1))::BIGINT + 1] AS t, max(v) AS last FROM h",
         "slots": "SELECT unnest(range(13)) AS bin"}
_HROWS = """SELECT s.bin::INTEGER AS bin, round(CASE WHEN s.bin = 12 THEN t ELSE s.bin * (t / 12) END, 4) AS from_days,
    round(CASE WHEN s.bin = 12 THEN last ELSE (s.bin + 1) * (t / 12) END, 4) AS to_days, count(c.v) AS count, s.bin = 12 AS overflow
    FROM slots s, top LEFT JOIN {src} c ON CASE WHEN c.v > t THEN 12 ELSE least(11, floor(c.v / (t / 12))) END = s.bin
    GROUP BY s.bin, t, last HAVING s.bin < 12 OR count(c.v) > 0"""


def _hist(df):
    return df.select("bin", r4("from_days"), r4("to_days"), "count", "overflow")


Q["o11_histogram"] = lambda spark, folder: _hist(O.histogram(O.cases(order_log(spark, folder), "Order")))
SQL["o11_histogram"] = sql(_HROWS.format(src="h"), {**_T, **_HIST})

_PICK = {**_v(_OWN), "chosen": "SELECT lead_id FROM vc JOIN vt USING (s) WHERE variant_id IN (1, 2, 5)"}


def _picked(spark, folder):
    c = O.cases(order_log(spark, folder), "Order")
    return c, O.chosen_leads(c, [1, 2, 5])


_ACT = {"w": """SELECT lead_id, activity, epoch(ts) - epoch(lag(ts) OVER win) AS wait, epoch(ts) - epoch(min(ts) OVER (PARTITION BY lead_id)) AS fs FROM {src}
    WINDOW win AS (PARTITION BY lead_id ORDER BY ts, event_id)"""}
_AROWS = """SELECT activity, count(DISTINCT lead_id) AS objects, count(*) AS events, round(count(DISTINCT lead_id) / (SELECT count(DISTINCT lead_id) FROM w), 6) AS share,
    round(median(wait), 4) AS wait_median, round(avg(wait), 4) AS wait_mean, round(median(fs), 4) AS start_median,
    row_number() OVER (ORDER BY median(fs), count(DISTINCT lead_id) DESC, activity) AS position FROM w GROUP BY 1"""


def _acts(df):
    return df.select("activity", "objects", "events", F.round("share", 6).alias("share"), r4("wait_median"), r4("wait_mean"), r4("start_median"),
                     F.col("position").cast("long").alias("position"))


Q["o12_activity_times"] = lambda spark, folder: _acts(O.activity_times(O.cases(order_log(spark, folder), "Order")))
SQL["o12_activity_times"] = sql(_AROWS, {"w": _ACT["w"].format(src=_OWN)})


def o13_months(spark, folder):
    c, chosen = _picked(spark, folder)
    return O.months(c.times, chosen)


def o13_hist(spark, folder):
    c, chosen = _picked(spark, folder)
    return _hist(O.histogram(c, chosen))


def o13_acts(spark, folder):
    c, chosen = _picked(spark, folder)
    return _acts(O.activity_times(c, chosen))


Q["o13_chosen_months"] = o13_months
SQL["o13_chosen_months"] = sql(_MONTHS.format("(SELECT * FROM tp WHERE lead_id IN (SELECT lead_id FROM chosen)) tp2"), {**_T, **_PICK})
Q["o13_chosen_histogram"] = o13_hist
SQL["o13_chosen_histogram"] = sql(_HROWS.format(src="(SELECT d / 86400 AS v FROM tp WHERE lead_id IN (SELECT lead_id FROM chosen))"), {**_T, **_PICK, **_HIST})
Q["o13_chosen_activities"] = o13_acts
SQL["o13_chosen_activities"] = sql(_AROWS, {**_PICK, "w": _ACT["w"].format(src="(SELECT object_id AS lead_id, * FROM e2o WHERE object_id IN (SELECT lead_id FROM chosen))")})

Q["o14_open_cases"] = lambda spark, folder: O.open_cases(O.cases(order_log(spark, folder), "Order", "objective", GOAL)).select(
    "open", r4("median_age"), F.col("max_age").cast("double").alias("max_age"))
SQL["o14_open_cases"] = sql("""SELECT count(*) AS open, round(median(a), 4) AS median_age, max(a)::DOUBLE AS max_age FROM (
    SELECT epoch((SELECT max(ts) FROM ev)) - epoch(t0) AS a FROM goal WHERE t1 IS NULL)""", _GOAL)

Q["o15_volumes"] = lambda spark, folder: O.volumes(O.cases(order_log(spark, folder), "Order")).select("objects", "events", F.round("events_per_object", 6).alias("events_per_object"))
SQL["o15_volumes"] = sql("""SELECT count(DISTINCT object_id) AS objects, count(DISTINCT event_id) AS events, round(count(*) / count(DISTINCT object_id), 6) AS events_per_object
    FROM e2o WHERE object_type = 'Order'""")

Q["o16_objective_filter"] = lambda spark, folder: _stats(O.throughput(O.cases(order_log(spark, folder), "Order", "objective", GOAL_URGENT)))
SQL["o16_objective_filter"] = sql(_STATS.replace("FROM tp", "FROM tp WHERE lead_id IN (SELECT 'Order:' || o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))"), _GOAL)
