"""Logs whose rows name their objects: the same results as with tables of links, and code the JVM compiles."""

from pyspark.sql import functions as F

from tracewright import EventRule, LinkRule, Mapping, ObjectRule
from tracewright.operators import build as B
from tracewright.operators import filters, model
from tracewright.plans.log import EventLog

MAPPING = Mapping(
    (ObjectRule("Order", "orders", ("ok",), ("prio", "day"), unique_key=True), ObjectRule("Item", "lines", ("item",), ("price",)),
     ObjectRule("Shop", "shops", ("shop",), unique_key=True)),
    (EventRule("Place", "orders", "day", row_key=("ok",)),
     EventRule("Line", "lines", "day", activity_column="kind", activity_values={"S": "Ship", "R": "Return"}, attributes=("kind",),
               row_key=("ok_ref", "item", "price"))),
    (LinkRule("Line", "lines", "ok_ref", "Order"), LinkRule("Line", "lines", "shop_ref", "Shop")))


def tables(spark):
    orders = [(n, f"2024-01-{n + 1:02d}", "high" if n % 3 == 0 else "low") for n in range(14)]
    # items 1 to 9 belong to one order each, item 10 to a high and a low one, item 11 to an order that does not exist
    lines = [(n % 9 + 1, n % 9, n % 4, 1.5 + n, f"2024-02-{n + 1:02d}", "S" if n % 2 else "R") for n in range(20)]
    lines += [(10, 0, 0, 0.25, "2024-03-01", "S"), (10, 1, 1, 12.5, "2024-03-02", "S"), (11, 99, 2, 7.0, "2024-03-03", "R")]
    return {"orders": spark.createDataFrame(orders, "ok long, day string, prio string"),
            "lines": spark.createDataFrame(lines, "item int, ok_ref long, shop_ref int, price double, day string, kind string"),
            "shops": spark.createDataFrame([(n,) for n in range(3)], "shop int")}


def both(spark):
    log = B.build(MAPPING, tables(spark)).settled()
    plain = EventLog(log.objects, log.events, log.e2o, log.skips, unique_links=True)
    assert log.wide and not plain.wide
    return log, plain


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_rows_and_tables_give_the_same(spark):
    log, plain = both(spark)
    assert not rows(log.e2o.where("object_id IN ('Order:99', 'Shop:3')")) and log.e2o.where("object_id = 'Item:11'").count() == 1
    assert log.types == plain.types and log.hubs == plain.hubs
    assert rows(log.type_stats) == rows(plain.type_stats)
    high = {"kind": "object", "type": "Order", "attribute": "prio", "values": ["high"]}
    for wanted in ([high], [high, {"kind": "duration", "type": "Order", "ranges": [(0.0, 40.0)]}]):
        a, b = filters.apply(log, wanted), filters.apply(plain, wanted)
        assert rows(a.e2o) == rows(b.e2o) and rows(a.events) == rows(b.events)
        assert rows(a.objects.select("object_id", "key")) == rows(b.objects.select("object_id", "key"))
    for lead in ("Order", "Item", "Shop"):
        assert rows(model.case_members(log, lead)) == rows(model.case_members(plain, lead))
        assert rows(model.case_events(log, lead)) == rows(model.case_events(plain, lead))
        assert rows(model.related_events(log, lead)) == rows(model.related_events(plain, lead))
        assert rows(filters.case_days(log, lead, "related")) == rows(filters.case_days(plain, lead, "related"))


def test_ids_are_made_by_compiled_code(spark):
    log = B.build(MAPPING, tables(spark))
    table = spark.range(10).selectExpr("id a", "id b", "id c", "id d", "id * 1.5D e", "id * 2.5D f")
    for df in (table.select(B.row_order(table, 1)), log.events):
        parts = df._jdf.queryExecution().debug().codegenToSeq().iterator()
        while parts.hasNext():
            assert parts.next()._3().maxMethodCodeSize() < 8000        # larger methods stay interpreted


def test_related_objects_and_categories(spark):
    from tracewright.operators import objective, overview
    from tracewright.operators.kpi.dimensions import related_objects
    from tracewright.operators.rca.features import related
    log, plain = both(spark)
    pop = spark.createDataFrame([(f"Order:{n}",) for n in range(5)], "case_id string")
    assert rows(related(log, "Order", pop)) == rows(related(plain, "Order", pop))
    assert rows(related_objects(log, "Order", "Shop")) == rows(related_objects(plain, "Order", "Shop"))
    assert rows(overview.relations(overview.cases(log, "Item"))) == rows(overview.relations(overview.cases(plain, "Item")))
    found = rows(objective.category_attributes(log))
    assert found == rows(objective.category_attributes(plain)) and {r[0] for r in found} == {"price", "prio"}     # 14 days are too many
