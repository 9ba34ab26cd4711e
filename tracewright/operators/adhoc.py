"""Ad-hoc questions to a table: rows, groups, and how two columns match."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.functions import scalars as S

OPERATORS = ("eq", "ne", "in", "not_in", "contains", "startswith", "empty", "not_empty", "gt", "lt")


def cell(column: str) -> Column:
    text = S.clean(F.col(f"`{column}`"))
    return F.when(text.isin("None", "NaT"), "").otherwise(text)


def _as_text(value) -> str:
    text = str("" if value is None else value).strip()
    return "" if text in ("nan", "None", "NaT") else text


def _number(text: Column) -> Column:
    plain = F.replace(text, F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain).try_cast("double")


def predicate(column: str, op: str, value=None) -> Column:
    """One test; gt and lt compare numbers when both sides are numbers, else texts."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op}; one of {OPERATORS}")
    c = cell(column)
    if op == "empty":
        return c == ""
    if op == "not_empty":
        return c != ""
    if op in ("in", "not_in"):
        hit = c.isin([_as_text(v) for v in (value if isinstance(value, (list, tuple)) else [value])])
        return hit if op == "in" else ~hit
    text = _as_text(value[0] if isinstance(value, (list, tuple)) and value else value)
    if op in ("eq", "ne"):
        return c == text if op == "eq" else c != text
    if op == "contains":
        return F.contains(F.lower(c), F.lit(text.lower()))
    if op == "startswith":
        return F.startswith(F.lower(c), F.lit(text.lower()))
    a, b = _number(c), _number(F.lit(text))
    less = op == "lt"
    return F.coalesce(a < b if less else a > b, c < text if less else c > text)


def matching(table: DataFrame, where: Sequence[dict] = ()) -> DataFrame:
    """Rows that pass all tests [{column, op, value}]."""
    tests = [predicate(w["column"], w["op"], w.get("value")) for w in where]
    return table.where(reduce(Column.__and__, tests)) if tests else table


def group_counts(table: DataFrame, by: Sequence[str], where: Sequence[dict] = (), limit: int = fixed.GROUPS_SHOWN) -> DataFrame:
    """The most frequent combinations of values, with the number of all combinations."""
    labels = [F.coalesce(F.nullif(cell(c), F.lit("")), F.lit(fixed.EMPTY_LABEL)).alias(c) for c in by]
    counts = matching(table, where).select(*labels).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    one = F.lit(1).alias("k")
    top = counts.orderBy(F.desc("rows"), *by).limit(limit).select("*", one)
    number = counts.agg(F.count(F.lit(1)).alias("distinct_groups")).select("distinct_groups", one)
    return top.join(F.broadcast(number), "k").drop("k")          # one row


def sample_rows(table: DataFrame, where: Sequence[dict] = (), columns: Sequence[str] | None = None, limit: int = 10) -> DataFrame:
    """Some matching rows (a sample is the feature: at most 20 rows and 15 columns)."""
    shown = [c for c in (columns or []) if c in table.columns] or table.columns[:fixed.SAMPLE_COLUMNS]
    few = matching(table, where).limit(max(1, min(int(limit), fixed.SAMPLE_ROWS)))
    return few.select(*[F.substring(cell(c), 1, fixed.CELL_CHARS).alias(c) for c in shown[:fixed.SAMPLE_COLUMNS]])


def containment(table: DataFrame, column: str, other: DataFrame, other_column: str, start: int | None = None,
                length: int | None = None, examples: int = 5) -> DataFrame:
    """One row: distinct values of a column (or of a part of it), how many are in the other column, examples, rows."""
    value = cell(column)
    if start is not None:
        value = F.substring(value, start + 1, length if length is not None else 2_000_000_000)
    rows = table.select(value.alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("rows"))
    target = other.select(cell(other_column).alias("v")).distinct().withColumn("hit", F.lit(True))
    met = counts.join(target, "v", "left").withColumns({"hit": F.coalesce("hit", F.lit(False)), "real": F.col("v") != ""})
    totals = met.agg(F.count_if("real").alias("distinct_values"), F.count_if(F.col("real") & F.col("hit")).alias("found"),
                     F.sum("rows").alias("rows_in_table"), F.sum(F.when(F.col("real"), F.col("rows")).otherwise(0)).alias("rows_with_value"))
    def few(hit: bool, name: str) -> DataFrame:
        chosen = met.where(F.col("real") & (F.col("hit") == hit)).select("v").orderBy("v").limit(examples)
        return chosen.agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias(name))
    one = F.lit(1).alias("k")
    out = totals.select("*", one).join(few(True, "examples_found").select("*", one), "k").join(few(False, "examples_not_found").select("*", one), "k")
    return out.drop("k").withColumn("found_pct", F.when(F.col("distinct_values") > 0, F.round(100 * F.col("found") / F.col("distinct_values"), 1)).otherwise(0.0))
