"""Passages of a text table that talk about given tables and columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed

WEIGHTS = {"data_dictionary": 2.0, "manual": 1.3, "procedure": 1.2, "bpmn": 1.0, "other": 1.0}      # fixed values


def chunks(text: str = "text") -> Column:
    """Passages of about 700 characters. Array of texts.

    One fold over the lines of a text: a line that would make the current
    passage too long starts the next one. A line of more than two passages is
    cut into pieces of that length; nothing but white space around a passage is
    left out.
    """
    size = fixed.CHUNK_CHARS
    longest = 2 * size

    def cut(line: Column) -> Column:
        last = F.greatest(F.floor((F.length(line) - 1) / longest), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(line, i * longest + 1, F.lit(longest)))

    lines = F.flatten(F.transform(F.split(text, r"\r\n|\r|\n"), cut))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, line: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(line) + 1 > size) & (acc["now"] != "")
        add = F.concat(line, F.lit("\n"))
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
                        F.when(full, add).otherwise(F.concat(acc["now"], add)).alias("now"))

    def finish(acc: Column) -> Column:
        return F.array_append(acc["done"], acc["now"])

    trimmed = F.transform(F.aggregate(lines, start, step, finish), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda c: c != "")


def passages(documents: DataFrame, doc: str = "doc_id", text: str = "text", kind: str | None = None) -> DataFrame:
    """(doc, place, passage, weight) of every document."""
    weight = F.lit(1.0)
    for name, w in (WEIGHTS.items() if kind else ()):
        weight = F.when(F.col(kind) == name, w).otherwise(weight)
    return documents.where(F.col(text).isNotNull()).select(
        F.col(doc).alias("doc"), weight.alias("weight"), F.posexplode(chunks(text)).alias("place", "passage"))


def term_hit(term: str) -> Column:
    """Does the passage name the term as a word of its own?"""
    return F.col("passage").rlike(r"(?i)(?<![A-Za-z0-9_])" + re.escape(term) + r"(?![A-Za-z0-9_])").cast("int")


def scored_passages(parts: DataFrame, topics: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """(topic, doc, place, passage, score): passages with a strong term or at least two weak ones.

    ``topics`` maps a table name to its strong and weak terms. score = (3 strong + weak) x weight of the document.
    """
    rows = []
    for topic, (strong, weak) in topics.items():
        count = lambda terms: sum((term_hit(t) for t in terms), F.lit(0))
        rows.append(F.struct(F.lit(topic).alias("topic"), count(strong).alias("strong"), count(weak).alias("weak")))
    told = parts.select("*", F.explode(F.array(*rows)).alias("t")).where("t.strong > 0 OR t.weak >= 2")
    return told.select("t.topic", "doc", "place", "passage", ((3 * F.col("t.strong") + F.col("t.weak")) * F.col("weight")).alias("score"))


def pick_excerpts(scored: DataFrame, budget: int = fixed.EXCERPT_CHARS) -> DataFrame:
    """(topic, doc, place, passage): the best passages that fit the budget, taken greedily by score.

    A passage that no longer fits is passed over, later ones may still fit. Of
    the passages of one length a greedy run can take at most budget / length, the
    best ones; all others are dropped before a topic's candidates meet.
    """
    size = F.length("passage")
    rank_in = lambda *by: Window.partitionBy("topic", *by).orderBy(F.desc("score"), "doc", "place")
    fitting = scored.withColumn("size", size).where(F.col("size") <= budget)
    # of passages of one length at most budget / length can be taken: more of them are never reached
    most = F.floor(F.lit(budget) / F.greatest("size", F.lit(1)))
    part = F.pmod(F.xxhash64("doc", "place"), F.lit(32))
    local = fitting.withColumn("part", part).withColumn("r", F.row_number().over(rank_in("size", "part"))).where(F.col("r") <= most)
    reach = local.withColumn("r", F.row_number().over(rank_in("size"))).where(F.col("r") <= most)
    # at most budget x (1 + 1/2 + 1/3 + ...) candidates per topic remain
    entry = F.struct((-F.col("score")).alias("s"), "doc", "place", "size")
    listed = reach.groupBy("topic").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    id_type = scored.schema["doc"].dataType.simpleString()
    empty = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<doc:{id_type},place:int>>").alias("taken"))

    def step(acc: Column, c: Column) -> Column:
        fits = acc["used"] + c["size"] <= budget
        key = F.struct(c["doc"].alias("doc"), c["place"].alias("place"))
        return F.struct(F.when(fits, acc["used"] + c["size"]).otherwise(acc["used"]).alias("used"),
                        F.when(fits, F.array_append(acc["taken"], key)).otherwise(acc["taken"]).alias("taken"))

    taken = listed.select("topic", F.explode(F.aggregate("c", empty, step)["taken"]).alias("k")).select("topic", "k.doc", "k.place")
    return reach.join(F.broadcast(taken), ["topic", "doc", "place"], "left_semi").select("topic", "doc", "place", "passage", "score")
