"""How the given tables are bound to event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.build import build
from tracewright.plans.log import EventLog
from tracewright.plans.mapping import EventRule, LinkRule, Mapping, ObjectRule
from tracewright.session import prepare

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

ITEM_ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

ORDER_LOG = Mapping(
    objects=(
        ObjectRule("Order", "orders", ("o_orderkey",),
                   ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey"), unique_key=True),
        ObjectRule("Item", "lineitem", ("l_orderkey", "l_linenumber"),
                   ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")),
        ObjectRule("Customer", "customer", ("c_custkey",), ("c_mktsegment", "c_nationkey", "c_name"), unique_key=True),
        ObjectRule("Supplier", "supplier", ("s_suppkey",), ("s_name", "s_nationkey"), unique_key=True),
        ObjectRule("Part", "part", ("p_partkey",), ("p_brand", "p_type"), unique_key=True),
    ),
    events=(
        EventRule("Place Order", "orders", "o_orderdate", row_key=("o_orderkey",)),
        EventRule("Item", "lineitem", "l_shipdate", activity_column="l_returnflag",
                  activity_values={"N": "Ship Item", "R": "Return Item", "A": "Accept Item"},
                  attributes=("l_linestatus",), row_key=ITEM_ROW),
    ),
    links=(
        LinkRule("Place Order", "orders", "o_custkey", "Customer"),
        LinkRule("Item", "lineitem", "l_orderkey", "Order"),
        LinkRule("Item", "lineitem", "l_suppkey", "Supplier"),
        LinkRule("Item", "lineitem", "l_partkey", "Part"),
    ),
)

# orders divided by their status; pending orders are left out
SPLIT_LOG = Mapping(
    objects=(
        ObjectRule("Order", "orders", ("o_orderkey",), ("o_orderpriority",), split_column="o_orderstatus",
                   split_values={"F": "Closed Order", "P": ""}),
        ObjectRule("Customer", "customer", ("c_custkey",), ("c_mktsegment",)),
    ),
    events=(
        EventRule("Place Order", "orders", "o_orderdate", row_key=("o_orderkey",)),
        EventRule("Item", "lineitem", "l_shipdate", activity_column="l_returnflag",
                  activity_values={"N": "Ship Item", "R": ""}, row_key=ITEM_ROW),
    ),
    links=(
        LinkRule("Item", "lineitem", "l_orderkey", "Order"),
        LinkRule("Item", "order_heads", "l_orderkey", "Customer"),
    ),
)

SESSION_LOG = Mapping(
    objects=(
        ObjectRule("Session", "activity", ("day", "user_id"), ("day",)),
        ObjectRule("User", "activity", ("user_id",)),
        ObjectRule("Key", "activity", ("k",)),
    ),
    events=(
        EventRule("Use", "activity", "ts", activity_column="event_type", attributes=("value", "k", "user_id"),
                  row_key=("event_id",)),
    ),
    links=(
        LinkRule("Use", "activity", "user_id", "User"),
        LinkRule("Use", "activity", "k", "Key"),
    ),
)

_LOGS: dict[tuple, EventLog] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in STAR}


def split_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The star tables plus the bridge from a line's order number to its customer."""
    heads = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    return {**star(spark, folder), "order_heads": heads}


def activity_table(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table with the day and the key inside ``props``."""
    e = table(spark, folder, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value",
                    F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"),
                    F.get_json_object("props", "$.k").alias("k"))


def _log(spark: SparkSession, folder: str, name: str, make) -> EventLog:
    """A log is written once per session and folder, then read by every query."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _LOGS:
        _LOGS[key] = make().settled()
    return _LOGS[key]


def order_log(spark: SparkSession, folder: str) -> EventLog:
    return _log(spark, folder, "orders", lambda: build(ORDER_LOG, star(spark, folder)))


def split_log(spark: SparkSession, folder: str) -> EventLog:
    return _log(spark, folder, "split", lambda: build(SPLIT_LOG, split_tables(spark, folder)))


def session_log(spark: SparkSession, folder: str) -> EventLog:
    return _log(spark, folder, "sessions", lambda: build(SESSION_LOG, {"activity": activity_table(spark, folder)}))
