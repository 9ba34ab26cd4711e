"""Effects of features and their significance.

Cases are only touched by grouped aggregations. What is tested is one row per
feature: group counts, sums and rank sums. The rest of the population is always
"everything minus the group".
"""

from __future__ import annotations

import functools
import math
import sys
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.spread import median, ranked_values
from tracewright.session import settle

WIDTH = 1.0      # days per bin of the exact medians

# the two small functions below travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- tail probabilities of one feature -------------------------------------
def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1.0) - math.lgamma(k + 1.0) - math.lgamma(n - k + 1.0)


class Hypergeometric:
    """How many of ``row`` cases drawn from n have the symptom that ``col`` of the n have."""

    def __init__(self, row: int, col: int, n: int):
        self.row, self.col, self.n = row, col, n
        self.low, self.high = max(0, row + col - n), min(row, col)
        self.mode = min(max((row + 1) * (col + 1) // (n + 2), self.low), self.high)

    def log_p(self, k: int) -> float:
        return _log_choose(self.col, k) + _log_choose(self.n - self.col, self.row - k) - _log_choose(self.n, self.row)

    def outward(self, k: int, step: int, chunk: int = 1024) -> float:
        """Sum from k on, away from the mode: each term is the one before times a ratio, until they no longer count."""
        if not self.low <= k <= self.high:
            return 0.0
        last = math.exp(self.log_p(k))
        total, at = last, k
        while last > total * 1e-18 and (at < self.high if step > 0 else at > self.low):
            ks = np.arange(at, min(at + chunk, self.high)) if step > 0 else np.arange(at, max(at - chunk, self.low), -1)
            x = ks.astype(float)
            up = (self.row - x) * (self.col - x)
            down = x * (self.n - self.row - self.col + x)
            ratio = up / ((x + 1) * (self.n - self.row - self.col + x + 1)) if step > 0 else down / ((self.row - x + 1) * (self.col - x + 1))
            terms = last * np.cumprod(ratio)
            total, last, at = total + float(terms.sum()), float(terms[-1]), at + step * len(ks)
        return total

    def at_least(self, k: int) -> float:
        if k > self.mode:
            return self.outward(k, 1)
        return 1.0 - self.outward(k - 1, -1)

    def as_rare(self, k: int) -> float:
        """All outcomes that are no more likely than k, on both sides of the mode."""
        limit = self.log_p(k) + 1e-7
        side = 1 if k > self.mode else -1
        near, far = (self.low, self.mode) if side > 0 else (self.mode, self.high)
        # the other side falls off steadily: bisect for the first outcome that is rare enough
        inside, outside = (far, near - 1) if side > 0 else (near, far + 1)
        while abs(inside - outside) > 1:
            middle = (inside + outside) // 2
            inside, outside = (inside, middle) if self.log_p(middle) <= limit else (middle, outside)
        if k == self.mode or self.log_p(inside) <= limit:
            return 1.0
        return self.outward(k, side) + self.outward(outside, -side)


def fisher(a: int, b: int, c: int, d: int, two_sided: bool = False) -> float:
    """Exact test of a 2x2 table ((a, b), (c, d)); one-sided: the first row has more."""
    h = Hypergeometric(a + b, a + c, a + b + c + d)
    return min(1.0, max(0.0, h.as_rare(a) if two_sided else h.at_least(a)))


EXACT = 8        # of an untied sample of at most so many values the rank sum is judged exactly


@functools.lru_cache(maxsize=None)
def _small_parts(m: int) -> tuple[int, list[int]]:
    """1 / ((1-x)(1-x)(1-x^2)...(1-x^m)) as a polynomial over (1-x^step)^(m+1): step and coefficients, by convolution of counts."""
    step = math.lcm(*range(1, m + 1))
    top = [1]
    for part in [1, *range(1, m + 1)]:
        grown = [0] * (len(top) + step - part)
        for i, ways in enumerate(top):
            for j in range(0, step, part):
                grown[i + j] += ways
        top = grown
    return step, top


def _ways_up_to(u: int, m: int) -> int:
    """Number of ways to write whole numbers up to u as sums of the parts 1..m."""
    step, top = _small_parts(m)
    return sum(top[j] * math.comb((u - j) // step + m, m) for j in range(u % step, min(len(top), u + 1), step)) if u >= 0 else 0


def exact_rank_sum(u: int, n1: int, n2: int) -> float:
    """P(U >= u) without ties, for a smaller sample of m values against any number N of others.

    The numbers of ways are the coefficients of prod (1-x^(N+i)) / (1-x^i) for
    i = 1..m. The product above the line has 2^m terms; what is below it is
    summed in closed form, so nothing grows with N.
    """
    m, others = min(n1, n2), max(n1, n2)
    terms = {0: 1}
    for i in range(1, m + 1):
        for shift, sign in list(terms.items()):
            terms[shift + others + i] = terms.get(shift + others + i, 0) - sign
    below = sum(sign * _ways_up_to(u - 1 - shift, m) for shift, sign in terms.items())
    return float(1 - Fraction(below, math.comb(others + m, m)))


def mann_whitney(rank_sum: float, n1: int, n2: int, ties: float, two_sided: bool = False) -> float:
    """P-value of the rank sum of the first group; ``ties`` is the sum of t^3 - t over tied values.

    One rule: exact if no value is tied and the smaller group has at most EXACT
    values, whatever the size of the other; else the normal form with correction
    for ties and continuity.
    """
    n = n1 + n2
    u = rank_sum - n1 * (n1 + 1) / 2
    if two_sided:
        u = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= EXACT:
        p = exact_rank_sum(math.ceil(u), n1, n2)
    else:
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0.0
        p = 0.5 * math.erfc((u - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2)) if sd > 0 else 1.0
    return min(1.0, 2 * p) if two_sided else p


@F.pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)])


@F.pandas_udf(T.DoubleType())
def ranks_greater(rank_sum: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney(r, int(x), int(y), t) for r, x, y, t in zip(rank_sum, n1, n2, ties)])


# ---- effects ---------------------------------------------------------------
def totals(pop: DataFrame) -> DataFrame:
    return pop.agg(F.count(F.lit(1)).alias("n_all"), F.sum("y").alias("s_all"))


def group_sums(pop: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, family, grp, n, s): size and sum of the symptom of every feature's group."""
    return features.join(pop.select("case_id", "y"), "case_id").groupBy("feature", "family", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))


def _with_total(df: DataFrame, pop: DataFrame) -> DataFrame:
    one = F.lit(1).alias("k")
    return df.select("*", one).join(F.broadcast(totals(pop).select("*", one)), "k").drop("k")


def binary_effects(pop: DataFrame, features: DataFrame) -> DataFrame:
    """Rates in and outside the group, their difference, lift and excess cases."""
    g = _with_total(group_sums(pop, features), pop).where(F.col("n") < F.col("n_all"))
    m_g, m_r = F.col("s") / F.col("n"), (F.col("s_all") - F.col("s")) / (F.col("n_all") - F.col("n"))
    out = g.withColumns({"m_g": m_g, "m_r": m_r})
    lift = F.when(F.col("m_r") > 0, F.col("m_g") / F.col("m_r")).when(F.col("m_g") > 0, F.lit(float("inf"))).otherwise(1.0)
    return out.withColumns({"diff": F.col("m_g") - F.col("m_r"), "lift": lift,
                            "excess": (F.col("m_g") - F.col("m_r")) * F.col("n")})


def rest_medians(pop: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, med_r): median of the cases outside each group, without writing out those cases.

    Counts per bin of everything minus those of the group lead to the bin of the
    middle; only there single values are compared.
    """
    bin_of = F.floor(F.col("y") / F.lit(WIDTH))
    everything = pop.groupBy("y").agg(F.count(F.lit(1)).alias("c")).withColumn("bin", bin_of)
    inside = features.select("case_id", "feature").join(pop.select("case_id", "y"), "case_id").groupBy("feature", "y").agg(
        F.count(F.lit(1)).alias("c")).withColumn("bin", bin_of)
    bins = everything.groupBy("bin").agg(F.sum("c").alias("c"))
    in_bins = inside.groupBy("feature", "bin").agg(F.sum("c").alias("g"))
    names = in_bins.select("feature").distinct()
    one = F.lit(1).alias("k")
    grid = names.select("feature", one).join(F.broadcast(bins.agg(F.collect_list(F.struct("bin", "c")).alias("b")).select("b", one)), "k").select(
        "feature", F.explode("b").alias("b")).select("feature", "b.bin", "b.c")        # features x days of the range
    rest = grid.join(in_bins, ["feature", "bin"], "left").select("feature", "bin", (F.col("c") - F.coalesce("g", F.lit(0))).alias("r"))
    w = Window.partitionBy("feature").orderBy("bin")
    rest = rest.withColumns({"hi": F.sum("r").over(w), "n": F.sum("r").over(Window.partitionBy("feature"))}).withColumn("lo", F.col("hi") - F.col("r"))
    mid = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]
    holds = lambda k: (F.col("lo") <= k) & (k < F.col("hi"))
    target = rest.where(holds(mid[0]) | holds(mid[1])).select("feature", "bin", F.col("lo").alias("before"), "n")
    values = target.join(everything, "bin").join(inside.select("feature", "y", F.col("c").alias("g")), ["feature", "y"], "left").withColumn(
        "r", F.col("c") - F.coalesce("g", F.lit(0)))
    w = Window.partitionBy("feature", "bin").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("hi", F.col("before") + F.sum("r").over(w)).withColumn("lo", F.col("hi") - F.col("r"))
    at = lambda k: F.max(F.when(holds(k), F.col("y")))
    return values.groupBy("feature").agg(((at(mid[0]) + at(mid[1])) / 2.0).alias("med_r"))


def duration_effects(pop: DataFrame, features: DataFrame) -> DataFrame:
    """Means and medians in and outside the group; the difference is that of the medians."""
    g = _with_total(group_sums(pop, features), pop).where(F.col("n") < F.col("n_all"))
    inside = features.select("case_id", "feature").join(pop.select("case_id", "y"), "case_id")
    med = ranked_values(inside, ["feature"], "y", WIDTH).groupBy("feature").agg(median("y").alias("med_g"))
    out = g.withColumns({"m_g": F.col("s") / F.col("n"), "m_r": (F.col("s_all") - F.col("s")) / (F.col("n_all") - F.col("n"))})
    return out.join(med, "feature").join(rest_medians(pop, features), "feature").withColumns({
        "diff": F.col("med_g") - F.col("med_r"), "excess": (F.col("m_g") - F.col("m_r")) * F.col("n")})


def effects(pop: DataFrame, features: DataFrame, binary: bool) -> DataFrame:
    return binary_effects(pop, features) if binary else duration_effects(pop, features)


# ---- significance ----------------------------------------------------------
def mid_ranks(pop: DataFrame) -> DataFrame:
    """(y, rank): mid-rank of every value in the whole population."""
    return ranked_values(pop, [], "y", WIDTH).select("y", (F.col("lo") + (F.col("c") + 1) / 2.0).alias("rank"))


def tie_sum(pop: DataFrame) -> DataFrame:
    c = F.col("c").cast("double")
    return pop.groupBy("y").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(c * c * c - c).alias("ties"))


def p_values(pop: DataFrame, features: DataFrame, binary: bool) -> DataFrame:
    """(feature, p): chance of an effect at least this big, one-sided."""
    if binary:
        g = _with_total(group_sums(pop, features), pop)
        return g.select("feature", fisher_greater("s", F.col("n") - F.col("s"), F.col("s_all") - F.col("s"),
                                                  F.col("n_all") - F.col("n") - F.col("s_all") + F.col("s")).alias("p"))
    ranked = features.join(pop.select("case_id", "y"), "case_id").join(mid_ranks(pop), "y")
    sums = _with_total(ranked.groupBy("feature").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n")), pop)
    one = F.lit(1).alias("k")
    sums = sums.select("*", one).join(F.broadcast(tie_sum(pop).select("ties", one)), "k")
    return sums.select("feature", ranks_greater("r", "n", F.col("n_all") - F.col("n"), "ties").alias("p"))


def adjusted_p(tested: DataFrame, candidates: int) -> DataFrame:
    """Benjamini-Hochberg over the tested features and the candidates dropped before (as p = 1)."""
    # one row per tested feature
    order = Window.orderBy("p", "feature")
    ranked = tested.withColumn("rank", F.row_number().over(order))
    n = F.greatest(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(candidates))
    onward = Window.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * n / F.col("rank")).over(onward))).drop("rank")


def adjusted(spark, rows: list[tuple], binary: bool, candidates: int) -> dict[str, tuple[float, float]]:
    """p and q of each tested feature from the arguments of its test (a row per feature)."""
    kind = "a long, b long, c long, d long" if binary else "a double, b long, c long, d double"
    test = fisher_greater if binary else ranks_greater
    p = spark.createDataFrame(rows, f"feature string, {kind}").select("feature", test("a", "b", "c", "d").alias("p"))
    return {r["feature"]: (r["p"], r["q"]) for r in adjusted_p(p, candidates).collect()}


# ---- overlaps --------------------------------------------------------------
def numbered(pop: DataFrame) -> DataFrame:
    """``pop`` with a number per case, from 1 in each written part, so that blocks of bitmaps fill up."""
    return pop if "k" in pop.columns else settle(pop.withColumn("k", F.monotonically_increasing_id() + 1), "numbered-cases")


def overlaps(pop: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, n, s): cases and symptom sum shared by each two features (a <= b) that share any.

    Each feature is a bitmap over the numbered cases, built before the shuffle:
    32,768 cases are 4 KB. Bitmaps of one block of cases meet in one task, where
    every two are combined bit by bit; cases are never paired with features or
    features with features in rows.
    """
    pop = numbered(pop)
    names = features.select("feature").distinct()
    ids = F.broadcast(names.withColumn("id", F.row_number().over(Window.orderBy("feature")) - 1))       # a row per feature
    block, place = F.bitmap_bucket_number("k").alias("block"), F.bitmap_bit_position("k")
    bits = (features.select("case_id", "feature").join(ids, "feature").join(pop.select("case_id", "k"), "case_id")
            .groupBy("id", block).agg(F.bitmap_construct_agg(place).alias("bits")))
    cases = pop.select(F.bitmap_bucket_number("k").alias("of_block"), place.alias("place"), "y")

    def combine(maps: pa.Table, cases: pa.Table) -> pa.Table:
        id_, planes = maps.column("id").to_numpy(), np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in maps.column("bits")]) if len(maps) else np.zeros((0, 0), np.uint8)
        order = np.argsort(id_)
        id_, planes = id_[order], planes[order]
        y = np.zeros(planes.shape[1] * 8)
        place = cases.column("place").to_numpy()
        y[place] = cases.column("y").to_numpy()
        n, s = np.zeros((len(id_), len(id_)), np.int64), np.zeros((len(id_), len(id_)))
        for i in range(len(id_)):
            n[i, i:] = np.bitwise_count(planes[i] & planes[i:]).sum(axis=1)
        for lo in range(0, planes.shape[1], 256):
            part = np.unpackbits(planes[:, lo:lo + 256], axis=1, bitorder="little").astype(float)
            s += (part * y[lo * 8:(lo + 256) * 8]) @ part.T
        a, b = np.nonzero(n)
        return pa.table({"a": pa.array(id_[a], pa.int32()), "b": pa.array(id_[b], pa.int32()), "n": pa.array(n[a, b]), "s": pa.array(s[a, b])})

    shared = (bits.groupBy("block").cogroup(cases.groupBy("of_block")).applyInArrow(combine, "a int, b int, n long, s double")
              .groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    name = lambda c: ids.select(F.col("id").alias(c), F.col("feature").alias(f"{c}_name"))
    return shared.join(name("a"), "a").join(name("b"), "b").select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), "n", "s")
