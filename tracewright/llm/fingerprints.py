"""Order MinHash fingerprints of texts, sensitive to edits and to order.

The symbols of a text are its words, cut into pieces of at most ``PIECE``
characters, and its other visible characters, one by one; letters of scripts
that are written without spaces also stand alone. Runs of ``k`` symbols
(k-mers) are numbered by occurrence, so that repeats count, and every pair
(k-mer, number) gets a hash. All hashes of a text lie on a circle; order j of
the ``orders`` starts at the j-th of as many evenly spaced points and runs
around it. Hashes are uniform, so each order by itself ranks the pairs at
random. Of each order the ``depth`` smallest pairs are selected, put back in
the order in which they stand in the text, and the tuple of their k-mers is
hashed to 16 bits. The likeness of two fingerprints is the share of equal
entries.

Everything is a column expression over one row, without a row per k-mer:
hashes and positions are packed into whole numbers and sorted as plain arrays;
the point where an order starts is found by halving steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3              # symbols of a k-mer
DEPTH = 2          # pairs selected per order
ORDERS = 64        # entries of a fingerprint
PIECE = 8          # characters of a symbol, at most
PLACE_BITS = 31    # of a packed number; the other 33 bits hold a hash

SYMBOL = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]{1,%d}|\S" % PIECE


def _pack(hashed: Column, place: Column) -> Column:
    """The 33 high bits of a hash, followed by a position."""
    return F.shiftleft(F.shiftright(hashed, PLACE_BITS), PLACE_BITS).bitwiseOR(place)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND((1 << PLACE_BITS) - 1)


def with_fingerprint(rows: DataFrame, text: str, name: str, k: int = K, depth: int = DEPTH, orders: int = ORDERS) -> DataFrame:
    """``rows`` with the fingerprint of a column of texts: an array of ``orders`` whole numbers from 0 to 65535.

    Equal texts have equal fingerprints. A text of fewer than k symbols is one
    k-mer, a text of white space one symbol; with fewer than ``depth`` pairs
    the tuple holds all of them. A null text is an empty one and has no k-mers:
    its array is empty. Two k-mers of one text that agree in 33 hash bits are
    numbered as if they were one.
    """
    n, symbols, kmers, runs, pairs, steps = (f"__{name}_{part}" for part in ("n", "symbols", "kmers", "runs", "pairs", "steps"))
    whole = F.coalesce(F.col(text), F.lit(""))
    code = lambda packed: F.shiftright(packed, PLACE_BITS)
    kmer = lambda at: F.xxhash64(*[F.get(F.col(symbols), at + (d - 1)) for d in range(k)])  # noqa: E731  (what lies behind the end is null and not hashed)
    kmer_at = lambda r: F.element_at(F.col(kmers), r)

    rows = rows.withColumn(symbols, F.regexp_extract_all(whole, F.lit(SYMBOL), F.lit(0)))
    rows = rows.withColumn(symbols, F.transform(F.when(F.size(symbols) > 0, F.col(symbols)).otherwise(F.array(whole)), lambda s: F.xxhash64(s)))

    # Arrays without nulls are sorted as plain numbers. Equal k-mers come to stand side by side, in the order of the text.
    rows = rows.withColumn(n, F.coalesce(F.greatest(F.size(symbols) - k + 1, F.lit(1)), F.lit(1)))
    rows = rows.withColumn(kmers, F.sort_array(F.transform(F.sequence(F.lit(1), F.col(n)), lambda i: _pack(kmer(i), i.cast("long")))))

    # The first of each run of equal k-mers has number 0, the rest of the run counts on.
    rows = rows.withColumn(runs, F.filter(F.sequence(F.lit(1), F.col(n)), lambda r: F.when(r == 1, True).otherwise(code(kmer_at(r - 1)) != code(kmer_at(r)))))
    pair = lambda p, number: _pack(F.xxhash64(code(p), number), _place(p))
    firsts = F.transform(F.col(runs), lambda first: pair(kmer_at(first), F.lit(0)))
    length = lambda run: F.coalesce(F.get(F.col(runs), run), F.col(n) + 1) - F.element_at(F.col(runs), run)
    longer = F.filter(F.sequence(F.lit(1), F.size(runs)), lambda run: length(run) > 1)
    rest = F.flatten(F.transform(longer, lambda run: F.transform(
        F.slice(F.col(kmers), F.element_at(F.col(runs), run) + 1, length(run) - 1), lambda p, number: pair(p, number + 1))))
    rows = rows.withColumn(pairs, F.sort_array(F.concat(firsts, rest)))
    rows = rows.withColumn(steps, F.filter(F.array(*[F.lit(1 << b) for b in reversed(range(PLACE_BITS))]), lambda step: step <= F.col(n)))

    def entry(start: Column) -> Column:
        below = F.aggregate(F.col(steps), F.lit(0), lambda at, step: F.when(
            (at + step <= F.col(n)) & (F.element_at(F.col(pairs), F.least(at + step, F.col(n))) < start), at + step).otherwise(at))
        chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(depth), F.col(n)) - 1),
                             lambda d: _place(F.element_at(F.col(pairs), F.pmod(below + d, F.col(n)) + 1)).cast("int"))
        return F.xxhash64(F.transform(F.sort_array(chosen), kmer)).bitwiseAND(65535).cast("int")

    starts = F.array(*[F.lit(j * ((1 << 64) // orders) - (1 << 63)).cast("long") for j in range(orders)])
    rows = rows.withColumn(name, F.when(whole != "", F.transform(starts, entry)).otherwise(F.expr("cast(array() as array<int>)")))
    return rows.drop(n, symbols, kmers, runs, pairs, steps)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries, 0 to 1. Two empty texts are alike, an empty text is unlike all others."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda equal: equal))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(same / F.size(a))


def written(fingerprint: Column) -> Column:
    """Four hexadecimal digits per entry."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row with ``next``: the ``columns`` of the row that follows it in ascending order of ``key``; after the last row comes the first.

    Nulls come last; rows of one key follow each other as they are read, so a
    stored table gives the same result every time. The order is cut into as many
    blocks as a shuffle has partitions. The cuts (one key per block) are found
    from the keys alone; then each row travels once, to its block, and the first
    row of each block also to the block before.
    """
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("__order", F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("read")))
    firsts = (docs.select("__order").repartitionByRange(blocks, "__order").groupBy(F.spark_partition_id().alias("part"))
              .agg(F.min("__order").alias("first")).orderBy("first").collect())
    if not firsts:
        return docs.drop("__order").withColumn("next", F.struct(*columns))
    kind = docs.schema["__order"].dataType
    cuts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["first"], kind, strict=True)]) for r in firsts])
    n, steps = len(firsts), [1 << b for b in reversed(range(len(firsts).bit_length()))]
    block = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(
        (at + step <= n) & (F.element_at(cuts, F.least(at + step, F.lit(n))) <= F.col("__order")), at + step).otherwise(at))
    placed = docs.withColumn("__block", block)
    leads = F.element_at(cuts, F.col("__block")) == F.col("__order")
    before = F.when(F.col("__block") > 1, F.col("__block") - 1).otherwise(n)
    guest = F.when(leads, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    placed = placed.withColumn("__guest", F.explode(guest)).withColumn("__block", F.when(F.col("__guest"), before).otherwise(F.col("__block")))
    w = Window.partitionBy("__block").orderBy("__guest", "__order")
    rows = placed.withColumn("next", F.lead(F.struct(*columns)).over(w)).where(~F.col("__guest"))
    return (rows.withColumn("next", F.coalesce("next", F.raise_error(F.lit("rows changed while they were read; store the table first"))))
            .drop("__order", "__block", "__guest"))


def replace_tail(text: Column, by: Column) -> Column:
    """The last quarter of the code points (rounded down) gives way to as many, or all, from the start of another text."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(text, n - quarter), F.left(by, quarter))


def with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, its ``fingerprint``, the text with a quarter replaced, ``edited``, its ``edited_fingerprint``, and ``next`` (text and fingerprint of the next document).

    A null text is an empty one, an empty table gives no rows, repeated rows
    are each compared with their own follower. Other columns of ``docs`` are
    not looked at. Texts of any length are worked on whole, in one row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fingerprint"), "doc_id", ["text", "fingerprint"])
    return with_fingerprint(rows.withColumn("edited", replace_tail(F.col("text"), F.col("next.text"))), "edited", "edited_fingerprint")
