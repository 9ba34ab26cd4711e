"""Keeping one hot key from becoming one slow task.

Two situations need care in this engine:

* an *ordered* pass over all events of one object (previous / next event);
* a *join on the event id*, where one event may link very many objects.

Both first look at the group sizes (a map-side combined count). Ordinary groups
take the plain window or join. Groups above ``limit`` rows are cut into pieces
that run in parallel and are put together again, so that no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle

HOT_ROWS = 2_000_000       # rows of one key that one task may take
LIMIT_SETTING = "tracewright.hotRows"


def hot_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(LIMIT_SETTING, str(HOT_ROWS)))


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys with more rows than one task should take.

    At most (rows / limit) values can qualify, so the list stays small however
    large the table is.
    """
    rows = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_limit(df)).select(key).collect()
    return [r[0] for r in rows]


def neighbours(df: DataFrame, key: str, order: Sequence[str], previous: dict[str, str] | None = None,
               following: dict[str, str] | None = None, running: dict[str, str] | None = None,
               hot: Sequence | None = None) -> DataFrame:
    """Values of the previous / next row of the same key, and running sums in order.

    ``previous`` and ``following`` map a new column to the column it is taken
    from, ``running`` to a number that is added up. ``hot`` lists the keys known
    to be too big for one task.
    """
    previous, following, running = previous or {}, following or {}, running or {}
    if not hot:
        return _window_pass(df, [key], order, previous, following, running)
    is_hot = F.col(key).isin(list(hot))
    cold = _window_pass(df.where(~is_hot), [key], order, previous, following, running)
    return cold.unionByName(_chunked_pass(df.where(is_hot), key, order, previous, following, running))


def ranked(df: DataFrame, order: Sequence[str], rank: str, running: dict[str, str] | None = None) -> DataFrame:
    """Overall position (from 1) and running sums of a table, in pieces when it is big."""
    one = df.withColumns({"__all": F.lit(1), "__one": F.lit(1).cast("long")})
    big = df.count() > hot_limit(df)
    return neighbours(one, "__all", order, running={rank: "__one", **(running or {})},
                      hot=[1] if big else None).drop("__all", "__one")


def _by(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _window_pass(df, keys, order, previous, following, running) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_by(order))
    cols = {new: F.lag(c).over(w) for new, c in previous.items()}
    cols |= {new: F.lead(c).over(w) for new, c in following.items()}
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    cols |= {new: F.sum(F.col(c).cast("long")).over(so_far) for new, c in running.items()}
    return df.withColumns(cols) if cols else df


def _chunked_pass(df, key, order, previous, following, running) -> DataFrame:
    """The same pass over pieces: each piece is a range of (key, order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = settle(df.repartitionByRange(parts, F.col(key), *_by(order))
                    .withColumns({"__piece": F.spark_partition_id(), "__step": F.lit(1)}), "pieces")
    inside = _window_pass(pieces, [key, "__piece"], order, previous, following, {**running, "__pos": "__step"})
    # one row per (key, piece): what the neighbouring pieces need to know
    when = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in order])
    edge = pieces.groupBy(key, "__piece").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(F.col(c).cast("long")).alias(f"__sum_{new}") for new, c in running.items()],
        *[F.max_by(F.struct(c), when).alias(f"__last_{new}") for new, c in previous.items()],
        *[F.min_by(F.struct(c), when).alias(f"__first_{new}") for new, c in following.items()])
    w = Window.partitionBy(key).orderBy("__piece")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.select(
        key, "__piece", "__n",
        *[F.coalesce(F.sum(f"__sum_{new}").over(earlier), F.lit(0)).alias(f"__before_{new}") for new in running],
        *[F.lag(f"__last_{new}").over(w).alias(f"__last_{new}") for new in previous],
        *[F.lead(f"__first_{new}").over(w).alias(f"__first_{new}") for new in following])
    # bounded by hot keys + range partitions
    out = inside.join(F.broadcast(edge), [key, "__piece"])
    cols = {}
    for new, c in previous.items():
        cols[new] = F.when(F.col("__pos") == 1, F.col(f"__last_{new}")[c]).otherwise(F.col(new))
    for new, c in following.items():
        cols[new] = F.when(F.col("__pos") == F.col("__n"), F.col(f"__first_{new}")[c]).otherwise(F.col(new))
    for new in running:
        cols[new] = F.col(new) + F.col(f"__before_{new}")
    return out.withColumns(cols).select(*df.columns, *previous, *following, *running)


def incidence_join(left: DataFrame, right: DataFrame, key: str, hot: Sequence | None = None,
                   salts: int = 32, how: str = "inner") -> DataFrame:
    """Join two link tables on the event id; rows of hot events are spread over ``salts`` tasks.

    Left rows of a hot key get one salt each, right rows are repeated per salt:
    every matching pair still meets exactly once.
    """
    if not hot:
        return left.join(right, key, how)
    hot = list(hot)
    plain = left.where(~F.col(key).isin(hot)).join(right.where(~F.col(key).isin(hot)), key, how)
    others = [c for c in left.columns if c != key]
    salt = F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int") if others else F.lit(0)
    hot_left = left.where(F.col(key).isin(hot)).withColumn("__salt", salt)
    hot_right = right.where(F.col(key).isin(hot)).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return plain.unionByName(hot_left.join(hot_right, [key, "__salt"], how).drop("__salt"))


def numbered_copies(df: DataFrame, column: str, block: int = 100_000) -> DataFrame:
    """Rows with an occurrence number among identical rows.

    Identical rows are first counted (combined before the shuffle) and written
    out again in blocks, so a row repeated very often is never held by one task.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counted.withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {block}"))))
    # blocks of one row go to different tasks before they are written out
    return (blocks.repartition("__block", *df.columns).withColumn(column, F.explode(F.sequence(
        F.col("__block") * block + 1, F.least(F.col("__n"), (F.col("__block") + 1) * block))))
        .drop("__n", "__block"))
