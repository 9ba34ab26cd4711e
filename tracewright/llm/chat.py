"""Chat logs as training texts.

Systems often log a conversation anew after every turn, so short logs repeat
the beginning of longer ones. A rolling hash of the turns names every prefix of
every log; a log whose whole hash is an inner prefix of another one is dropped
by an anti join, and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.skew import hot_keys, neighbours
from tracewright.session import settle

# Marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"


def maximal(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns (conv_id, place, role, text, n_turns, copies) of the logs that no other log continues.

    A log continues another if it is longer and starts with the same roles and
    texts. Of equal logs the one with the smallest id stays, and ``copies``
    says how many there were. Turns are ordered by ``turn``, then role and
    text; ``place`` counts from 1, so gaps and repeated turn numbers do no
    harm. A null text is an empty one, a null role is written unknown; rows
    with a null conversation id are one log. An empty table gives no rows.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"),
                        F.coalesce(text, F.lit("")).alias("text"), F.xxhash64(F.col(conv_id), F.col(conv_id).isNull()).alias("log"), F.lit(1).cast("long").alias("one"))
    hot = hot_keys(rows, "log")
    order = ["turn", "role", "text"]
    placed = neighbours(rows, "log", order, running={"place": "one"}, hot=hot)
    hashes = {f"h{i}": F.shiftright(F.xxhash64("role", "text", "place", F.lit(i)), 24) for i in (1, 2, 3)}      # 40 bits: sums of millions stay exact
    rolling = neighbours(placed.withColumns(hashes), "log", ["place"], running={"p1": "h1", "p2": "h2", "p3": "h3"}, hot=hot)
    rolling = settle(rolling.select("log", "conv_id", "place", "role", "text", "p1", "p2", "p3"), "chat-prefixes")

    lengths = rolling.groupBy("log").agg(F.max("place").alias("n_turns"))
    ends = (rolling.select("log", "conv_id", "place", "p1", "p2", "p3").join(lengths, "log").where("place = n_turns"))
    logs = settle(ends.groupBy("place", "p1", "p2", "p3").agg(F.min(F.struct("conv_id", "log")).alias("kept"), F.count(F.lit(1)).alias("copies")), "chat-logs")
    inner = rolling.select("log", "place", "p1", "p2", "p3").join(lengths, "log").where("place < n_turns").select("place", "p1", "p2", "p3").distinct()
    kept = logs.join(settle(inner, "chat-inner"), ["place", "p1", "p2", "p3"], "left_anti").select(F.col("kept.log").alias("log"), F.col("place").alias("n_turns"), "copies")
    return rolling.join(settle(kept, "chat-kept"), "log").select("conv_id", "place", "role", "text", "n_turns", "copies", "log")


def render(turns: DataFrame) -> DataFrame:
    """One text per log (conv_id, n_turns, copies, text) from the rows of ``maximal``."""
    line = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END))
    rows = turns.groupBy("log").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
                                    F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    return rows.select("conv_id", "n_turns", "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
