"""Ids of events tell every two rows apart, and excerpts keep whole lines."""

from pyspark.sql import functions as F

from tracewright import EventRule, Mapping, ObjectRule
from tracewright.operators import build as B
from tracewright.operators import excerpts as E


def ids(spark, rows, schema, key=()):
    table = spark.createDataFrame([("t", "2024-02-01", *r) for r in rows], f"id string, day string, {schema}")
    m = Mapping((ObjectRule("Thing", "rows", ("id",)),), (EventRule("Seen", "rows", "day", row_key=tuple(key)),))
    return [r["event_id"] for r in B.build(m, {"rows": table}).events.collect()]


def test_wide_and_negative_keys(spark):
    numbers = [10 ** 12 + 1, 10 ** 12 + 2, 9223372036854775806, 9223372036854775807, -9223372036854775808, -1, 0, None]
    got = ids(spark, [(n,) for n in numbers], "k long", ["k"])
    assert len(set(got)) == len(numbers)
    by_value = spark.createDataFrame([(n,) for n in numbers[:-1]], "k long")
    ordered = by_value.orderBy(B.row_order(by_value, 1)).collect()
    assert [r["k"] for r in ordered] == sorted(numbers[:-1])


def test_fractions_and_separators(spark):
    fractions = [(1.00001,), (1.00002,), (0.001,), (0.002,), (-5.5,), (1e300,), (float("nan"),), (None,)]
    for key in ((), ("k",)):
        assert len(set(ids(spark, fractions, "k double", key))) == len(fractions)
        texts = [("a|b", "c"), ("a", "b|c"), ("a~pb", "c"), ("", None), (None, ""), ("~n", ""), ("", "")]
        assert len(set(ids(spark, texts, "a string, b string", key and ("a", "b")))) == len(texts)


def test_long_lines_stay_whole(spark):
    long = "".join(chr(97 + i % 26) for i in range(5000))
    text = f"short line\n{long}\nlast line"
    docs = spark.createDataFrame([("doc-a", text), ("doc-b", None), ("doc-c", "")], "doc_id string, text string")
    parts = E.passages(docs).orderBy("place").collect()
    assert {p["doc"] for p in parts} == {"doc-a"} and "".join(p["passage"] for p in parts).replace("\n", "") == text.replace("\n", "")
    scored = E.scored_passages(E.passages(docs), {"t": (["last"], [])})
    assert [(r["doc"], r["topic"]) for r in E.pick_excerpts(scored).collect()] == [("doc-a", "t")]      # ids may be texts


def test_very_long_variant(spark):
    from tracewright.operators.model import variants
    n = 120_000
    seq = spark.range(n).select(F.lit("case").alias("lead_id"), F.col("id").cast("string").alias("event_id"), F.when(F.col("id") % 2 == 0, "on").otherwise("off").alias("activity"),
                                F.timestamp_seconds("id").alias("ts"), F.lit("").alias("ord"))
    row = variants(seq).table.select("length", F.size("steps").alias("steps")).first()
    assert (row["length"], row["steps"]) == (n, n)
