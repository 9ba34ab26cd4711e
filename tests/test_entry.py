import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["object_type", "source", "target", "passages", "objects", "median", "mean", "min", "max"]
    rows = df.collect()
    starts = sum(r["passages"] for r in rows if r["source"] == "__start__|Order")
    ends = sum(r["passages"] for r in rows if r["target"] == "__end__|Order")
    assert starts == ends == 1500
