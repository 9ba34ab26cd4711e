"""The cases of a question with all that is looked up per case, and sums over groups of them."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed
from tracewright.operators.rca import statistics as ST
from tracewright.plans import skew
from tracewright.session import settle

PIECES = 4096        # equal parts of the ranked cases; a median is looked for inside one of them

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Sums:
    """Cases and symptom of a group and of everything; per half of the time and with ranks where they are known."""

    n: int
    s: float
    total_n: int
    total_s: float
    ranks: float = 0.0
    halves: tuple[Sums, ...] = ()

    @property
    def inside(self) -> float:
        return self.s / self.n

    @property
    def outside(self) -> float:
        return (self.total_s - self.s) / (self.total_n - self.n)

    @property
    def difference(self) -> float:
        return self.inside - self.outside

    @property
    def lift(self) -> float:
        return self.inside / self.outside if self.outside > 0 else math.inf if self.inside > 0 else 1.0

    @property
    def excess(self) -> float:
        return self.difference * self.n

    def holds(self, binary: bool) -> bool:
        """Is the group worse, by five cases and more?"""
        return 5 <= self.n < self.total_n and self.difference > 0 and (not binary or self.lift >= fixed.STABLE_LIFT)

    def stable(self, binary: bool) -> bool:
        return bool(self.halves) and all(h.holds(binary) for h in self.halves)


@dataclass
class Cohort:
    """``table``: case_id, y, k (number), half and, for durations, rank (mid-rank), place (from 1) and piece."""

    table: DataFrame
    binary: bool
    n: int
    s: float
    weight: float                        # what shares of the excess are taken of
    halves: list[tuple[int, float]]
    ties: float = 0.0
    median: float | None = None

    def test_inputs(self, sums: Sums) -> tuple:
        """Arguments of the test of one feature."""
        if self.binary:
            return int(sums.s), int(sums.n - sums.s), int(self.s - sums.s), int(self.n - sums.n - self.s + sums.s)
        return sums.ranks, sums.n, self.n - sums.n, self.ties


def halves(pop: DataFrame) -> DataFrame | None:
    """(case_id, half) by start time; None when there are too few timed cases."""
    timed = pop.where("start_ts is not null").select("case_id", "start_ts")
    n = timed.count()
    if n < 2 * fixed.MIN_CASES:
        return None
    return skew.ranked(timed, ["start_ts", "case_id"], "r").select("case_id", (F.col("r") > n // 2).cast("int").alias("half"))


def cohort(pop: DataFrame, binary: bool) -> Cohort:
    half, table = halves(pop), pop.select("case_id", "y")
    table = table.withColumn("half", F.lit(None).cast("int")) if half is None else table.join(half, "case_id", "left")
    n = pop.count()
    if not binary:
        table = skew.ranked(table, ["y", "case_id"], "place")
        table = table.withColumn("piece", F.floor((F.col("place") - 1) * PIECES / F.lit(float(max(n, 1)))).cast("int"))
    table = settle(table.withColumn("k", F.monotonically_increasing_id() + 1), "cohort")
    ties, median = 0.0, None
    if not binary:
        tied = table.groupBy("y").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
        c = (F.col("hi") - F.col("lo") + 1).cast("double")
        ties = tied.agg(F.sum(c * c * c - c)).first()[0] or 0.0
        middle = table.where(F.col("place").isin((n + 1) // 2, n // 2 + 1)).agg(F.avg("y")).first()[0]
        median = middle or 0.0
        if ties:
            table = settle(table.join(tied.select("y", ((F.col("lo") + F.col("hi")) / 2.0).alias("rank")), "y"), "cohort-ranks")
        else:
            table = table.withColumn("rank", F.col("place").cast("double"))
    per = table.groupBy("half").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.abs("y")).alias("w")).collect()
    of_half = {r["half"]: (r["n"], r["s"]) for r in per}
    return Cohort(table, binary, n, math.fsum(r["s"] for r in per), math.fsum(r["w"] for r in per),
                  [] if half is None else [of_half.get(i, (0, 0.0)) for i in (0, 1)], ties, median)


def marks(cases: Cohort, features: DataFrame) -> DataFrame:
    """The features of the cases, with what is looked up per case."""
    return features.join(cases.table, "case_id")


def sums(cases: Cohort, marks: DataFrame) -> dict[str, Sums]:
    """All sums of every feature in one pass; a row per feature reaches the driver."""
    of = lambda i, c: F.sum(F.when(F.col("half") == i, c).otherwise(0))
    per = marks.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum("rank" if not cases.binary else F.lit(0.0)).alias("ranks"),
        *[of(i, F.lit(1)).alias(f"n{i}") for i in (0, 1)], *[of(i, F.col("y")).alias(f"s{i}") for i in (0, 1)])
    return {r["feature"]: Sums(r["n"], r["s"], cases.n, cases.s, r["ranks"], tuple(Sums(r[f"n{i}"], r[f"s{i}"], *cases.halves[i]) for i in (0, 1)) if cases.halves else ())
            for r in per.collect()}


def pair_marks(mine: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Marks of the cases that have both features of a wanted pair."""
    rest = [c for c in mine.columns if c not in ("feature", "family", "grp")]
    held = mine.groupBy(*rest).agg(F.collect_set("feature").alias("names"))      # at most as many as the pool
    has = lambda x: F.array_contains("names", F.lit(x))
    tests = F.array_compact(F.array(*[F.when(has(a) & has(b), F.lit(f"{a} & {b}")) for a, b in wanted]))
    return held.select(*rest, F.explode(tests).alias("feature"))


def medians(cases: Cohort, marks: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, med_g, med_r): medians in and outside each group.

    Cases are counted per feature and piece; what is missing to the count of the
    whole piece is the rest. The counts lead to the pieces of the middle ranks,
    and only the cases of those pieces are ranked one by one.
    """
    mine = marks.where(F.col("feature").isin(list(names))).select("feature", "k", "piece")
    counts = mine.groupBy("feature", "piece").agg(F.count(F.lit(1)).alias("c"))
    whole = np.zeros(PIECES, np.int64)
    for r in cases.table.groupBy("piece").agg(F.count(F.lit(1)).alias("c")).collect():      # a row per piece
        whole[r["piece"]] = r["c"]

    def middles(group: pa.Table) -> pa.Table:
        own = np.zeros(PIECES, np.int64)
        own[group.column("piece").to_numpy()] = group.column("c").to_numpy()
        rows = []
        for inside, c in ((True, own), (False, whole - own)):
            ends = np.cumsum(c)
            for rank in {int(ends[-1] - 1) // 2, int(ends[-1]) // 2}:
                piece = int(np.searchsorted(ends, rank, side="right"))
                rows.append((piece, inside, rank - int(ends[piece] - c[piece]) + 1))
        piece, inside, at = zip(*rows)
        return pa.table({"feature": [group.column("feature")[0].as_py()] * len(rows), "piece": pa.array(piece, pa.int32()), "inside": list(inside), "at": pa.array(at, pa.int64())})

    targets = counts.groupBy("feature").applyInArrow(middles, "feature string, piece int, inside boolean, at long")
    asked = targets.groupBy("feature", "piece", "inside").agg(F.collect_list("at").alias("at"))       # one or two ranks
    near = cases.table.select("k", "y", "place", "piece").join(asked, "piece")
    near = near.join(mine.select("feature", "k", F.lit(True).alias("has")), ["feature", "k"], "left").where(F.coalesce("has", F.lit(False)) == F.col("inside"))
    w = Window.partitionBy("feature", "piece", "inside").orderBy("place")
    hit = near.withColumn("r", F.row_number().over(w)).where(F.array_contains("at", F.col("r").cast("long")))
    of = lambda side: F.avg(F.when(F.col("inside") == side, F.col("y")))
    return hit.groupBy("feature").agg(of(True).alias("med_g"), of(False).alias("med_r"))
