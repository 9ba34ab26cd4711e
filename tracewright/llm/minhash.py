"""Near copies by minhash with tensored tables, confirmed on whole shingle sets.

``sides`` small keys are made from each of two collections of minhashes, and
each pair of a key of the first and a key of the second is the key of one
table: ``sides`` squared tables from ``2 * sides * rows`` minhashes. Two sets
of similarity s meet in some table with probability
(1 - (1 - s ** rows) ** sides) squared.

Documents with equal sets are one node. In each bucket every node is compared
with one representative, the smallest node. Only buckets that still hold several
components go on: their nodes meet block against block, and a task that compares
two blocks gives back one link for each two components at most. So a bucket of a
thousand copies gives about a thousand comparisons, no group meets in one task,
no pairs are written out, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import text as tx
from tracewright.llm.graphs import components
from tracewright.session import settle

SIDES, ROWS = 7, 2         # 49 tables from 28 minhashes; a pair at 0.85 is met with probability 0.9997
BLOCK = 256                # nodes of a group that are compared at once with as many others
COLUMNS = 8192             # shingles taken at a time there


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and how many each has."""
    starts, ends, counts = tx.words(data, offsets, tx.SOLID)
    hashes = tx.word_hashes(data, starts, ends)
    found = []
    for k in range(1, width + 1):
        grams, _, n = tx.gram_hashes(hashes, counts, k)
        of = np.repeat(np.arange(len(counts)), n)
        if k < width:      # a shorter text is one shingle
            mine = counts[of] == k
            grams, of = tx.mix(grams[mine] + np.uint64(k)), of[mine]
        found.append((of, grams))
    of, grams = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((grams, of))
    of, grams = of[order], grams[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.bincount(of[new], minlength=len(counts))


def _per_text(op, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """reduceat over texts with something in them; zero for the others."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        out[some] = op.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _signature(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit name of each set."""
    total = _per_text(np.add, tx.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), counts)
    return tx.mix(total ^ tx.mix(_per_text(np.bitwise_xor, grams, counts) + counts.astype(np.uint64))).view(np.int64)


def _scan_keys(carry: list[str], text: str, width: int, sides: int, rows: int):
    draw = np.random.default_rng(11)
    flips, factors = (draw.integers(1, 1 << 63, 2 * sides * rows, dtype=np.uint64) for _ in range(2))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.pieces(batches, text):
            grams, counts = shingle_sets(tx.lower_ascii(data), offsets, width)
            keys = []
            for side in range(2 * sides):
                key = np.full(len(counts), side, np.uint64)
                for r in range(side * rows, (side + 1) * rows):
                    key = tx.mix(key * np.uint64(31) + _per_text(np.minimum, (grams ^ flips[r]) * (factors[r] | np.uint64(1)), counts))
                keys.append(key.view(np.int64))
            each = np.full(len(counts), 2 * sides)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(counts.astype(np.int64)), pa.array(_signature(grams, counts)),
                                              tx.lists(each, np.stack(keys, 1).ravel(), pa.int64())], [*[f"c{i}" for i in range(len(carry))], "n_shingles", "node", "keys"])
    return scan


def _scan_sets(text: str, width: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()     # copies within the task
        for _, data, offsets in tx.pieces(batches, text):
            grams, counts = shingle_sets(tx.lower_ascii(data), offsets, width)
            nodes = _signature(grams, counts)
            for i in range(len(counts)):
                if counts[i] and (node := int(nodes[i])) not in seen:
                    seen.add(node)
                else:
                    counts[i] = -counts[i]
            keep = counts > 0
            flat = grams[np.repeat(keep, np.abs(counts))]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), tx.lists(counts[keep], flat.view(np.int64), pa.int64())], ["node", "grams"])
    return scan


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb")).cast("long")
    return (pairs.join(one, "a").join(two, "b")
            .where(100 * F.least(F.size("ga"), F.size("gb")) >= percent * F.greatest(F.size("ga"), F.size("gb")))
            .where(100 * both >= percent * (F.size("ga") + F.size("gb") - both)).select("a", "b"))


def _linked_block(percent: int):
    def compare(group: pa.Table) -> pa.Table:
        """One link for each two components that have one between the two blocks of the group."""
        sides = group["side"].to_numpy()
        nodes, roots = group["node"].to_numpy(), group["root"].to_numpy()
        grams = group["grams"].combine_chunks()
        sizes = np.diff(grams.offsets.to_numpy())
        _, at, often = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = often > 1                 # others are in no intersection
        column = np.cumsum(shared) - 1
        keep = shared[at]
        row, col = np.repeat(np.arange(len(sizes)), sizes)[keep], column[at][keep]
        one, two = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        both = np.zeros((len(one), len(two)), np.float32)
        for lo in range(0, int(shared.sum()), COLUMNS):
            table = np.zeros((len(sizes), COLUMNS), np.float32)
            mine = (col >= lo) & (col < lo + COLUMNS)
            table[row[mine], col[mine] - lo] = 1
            both += table[one] @ table[two].T
        union = sizes[one][:, None] + sizes[two][None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & (roots[one][:, None] != roots[two][None, :]))
        first = {}
        for a, b in zip(one[i], two[j], strict=True):
            first.setdefault((min(roots[a], roots[b]), max(roots[a], roots[b])), (nodes[a], nodes[b]))
        return pa.table({"a": pa.array([x for x, _ in first.values()], pa.int64()), "b": pa.array([y for _, y in first.values()], pa.int64())})
    return compare


def _between(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components (root) among the nodes of one representative.

    Each group is dealt into blocks of about BLOCK nodes; each two blocks meet
    in a task of their own and are compared there as two tables of ones and
    zeros. Side 0 and 1 are the blocks; 2 is a block against itself.
    """
    groups = rest.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = (rest.join(settle(groups, "minhash-blocks"), "rep").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("rep", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")))
    return dealt.join(sets, "node").groupBy("rep", "i", "j").applyInArrow(_linked_block(percent), "a long, b long").distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, sides: int = SIDES, rows: int = ROWS,
                row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Words are runs of anything but white space, lower-cased in A-Z; a text of
    fewer than ``width`` words is one shingle. Texts are linked when 100 *
    intersection >= percent * union of their sets. ``component_id`` is the
    smallest id reachable by links. Null, empty and blank texts have empty sets
    and stay alone; equal sets are always linked. A null id counts in no
    minimum: rows all of whose links have null ids get a null component. Rows of
    equal id are judged by their own text. An empty table gives no rows.

    ``kept`` marks the rows whose id is that of their component. ``row`` names a
    column that differs in every row; it is returned too, and ``kept`` then marks
    one row of each component, that of the smallest id and row (null ids last).

    Sets are sets of 64-bit hashes; the name of a set is one as well.
    """
    carry = [doc_id] if row is None else [doc_id, row]
    held = [f"c{i}" for i in range(len(carry))]
    schema = T.StructType([*[T.StructField(h, docs.schema[c].dataType) for h, c in zip(held, carry, strict=True)], T.StructField("n_shingles", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    texts = docs.select(*dict.fromkeys([doc_id, text]))
    scanned = settle(docs.select(*dict.fromkeys([*carry, text])).mapInArrow(_scan_keys(carry, text, width, sides, rows), schema), "minhash")
    some = scanned.where("n_shingles > 0")
    rank = F.struct(F.col("c0").isNull().alias("none"), *held)
    nodes = settle(some.groupBy("node").agg(F.min("c0").alias("low"), F.min(rank).alias("first"), F.first("keys").alias("keys")), "minhash-nodes")

    tables = F.array(*[F.xxhash64(F.lit(i * sides + j), F.col("keys")[i], F.col("keys")[sides + j]) for i in range(sides) for j in range(sides)])
    slots = nodes.select("node", F.explode(tables).alias("slot"))
    buckets = settle(slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("rep")).where("n > 1"), "minhash-buckets")
    members = settle(slots.join(buckets, "slot").select("slot", "node", "rep"), "minhash-members")
    sets = settle(texts.mapInArrow(_scan_sets(text, width), "node long, grams array<long>")
                  .join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams")), "minhash-sets")

    pairs = members.where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    links = settle(_confirmed(pairs, sets, percent), "minhash-links")
    roots = settle(components(links), "minhash-roots")
    placed = members.join(roots, "node", "left").select("slot", "rep", "node", F.coalesce("root", "node").alias("root"))
    open_slots = placed.groupBy("slot").agg(F.min("root").alias("lowest"), F.max("root").alias("highest")).where("lowest < highest").select("slot")
    rest = settle(placed.join(settle(open_slots, "minhash-open"), "slot").select("rep", "node", "root").distinct(), "minhash-rest")
    more = settle(_between(rest, sets, percent), "minhash-links")
    if not more.isEmpty():
        roots = settle(components(links.unionByName(more)), "minhash-roots")

    low = nodes.select("node", "low", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = low.groupBy("root").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    named = settle(low.drop("first").join(settle(groups, "minhash-groups"), "root").select("node", "component_id", "first"), "minhash-named")
    kept = F.col("c0").eqNullSafe(F.col("component_id")) if row is None else F.col("c1") == F.col("first")["c1"]
    joined = some.join(named, "node").select(*held, "n_shingles", "component_id", kept.alias("kept"))
    alone = scanned.where("n_shingles = 0").select(*held, "n_shingles", F.col("c0").alias("component_id"), F.lit(True).alias("kept"))
    names = [F.col(h).alias(c) for h, c in zip(held, ["doc_id"] if row is None else ["doc_id", row], strict=True)]
    return joined.unionByName(alone).select(*names, "n_shingles", "component_id", "kept")
