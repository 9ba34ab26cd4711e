"""Near copies among embedding vectors by refining a neighbour graph.

Every distinct vector keeps a short list of its nearest vectors. Lists start
from buckets of random half-space codes. In each round all vectors around a
common neighbour are compared with each other, and lists take what is nearer,
until no list gains an entry at the threshold. A list whose every entry passes the
threshold is saturated: it may be too short for its links. The saturated lists
are enlarged by the nearest vectors outside their component of links, refined
until no list changes, and again with the components this joins, until
nothing outside is left at the threshold. The components are compared whole,
block against block, in double precision, which decides each link inside them
exactly. A bounded sample of vectors is then compared with all vectors; if
too few of its links were found, another turn with new codes follows, and the
run fails if they still are too few after the last one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.graphs import components
from tracewright.session import settle

LIST = 8               # entries of a neighbour list
CODES = 8              # half-space codes per turn
CODE_BITS = 24
BLOCK = 64             # vectors compared with each other at once while lists are refined
WIDE_BLOCK = 256       # and when components are compared
CENTRES = 200          # neighbourhoods per task group
ROUNDS, TURNS = 5, 6      # rounds before lists are enlarged; turns before a failed audit fails the run
AUDITED = 2000         # vectors compared with all others to measure recall, at most
RECALL = 0.995
SLACK = 1e-5           # lists are in single precision


def _matrix(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def _prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; null for vectors that link with nothing."""
    for batch in batches:
        out = []
        for v in batch.column("vec").to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, float)
            if x is not None and np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()        # no overflow of squares
                out.append(x / np.sqrt((x * x).sum()))
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "label", "unit"])


def _coder(turn: int):
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            units = batch.column("unit").to_pylist()
            out = []
            for u in units:
                if len(u) not in planes:
                    planes[len(u)] = np.random.default_rng([turn, len(u)]).normal(size=(len(u), CODES * CODE_BITS))
                signs = (np.array(u) @ planes[len(u)] > 0).reshape(CODES, CODE_BITS)
                out.append((signs @ (1 << np.arange(CODE_BITS))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("area"), pa.array(out, pa.list_(pa.int64()))], ["node", "area", "codes"])
    return code


def _joined(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of each member to the first member of its component in a square truth table."""
    name = np.arange(len(mask))
    while True:
        low = np.where(mask, name[None, :], len(name)).min(1)
        new = np.minimum(name, low)
        new = new[new]
        if (new == name).all():
            break
        name = new
    at = np.flatnonzero(name != np.arange(len(name)))
    return at, name[at]


def _refine(threshold: float):
    def around(group: pa.Table) -> list[tuple]:
        order = np.argsort(group["centre"].to_numpy(), kind="stable")
        centre, node, home, worst = (group[c].to_numpy()[order] for c in ("centre", "node", "home", "worst"))
        x = _matrix(group["vec"], np.float32)[order]
        cuts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1], True])
        rows = []
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            ids, first = np.unique(node[a:e], return_index=True)
            mine, at_home, floor_of = x[a:e][first], home[a:e][first], worst[a:e][first]
            near = mine @ mine.T
            near[at_home[:, None] == at_home[None, :]] = -2
            if len(ids) > LIST + 1:
                floor = np.partition(near, -LIST, axis=1)[:, -LIST]
            else:
                floor = np.full(len(ids), -1.5, np.float32)
            i, j = np.nonzero((near >= floor[:, None]) & (near > floor_of[:, None]) & (near > -1.5))
            rows.append((ids[i], ids[j], near[i, j].astype(float), np.zeros(len(i), bool)))
            linked = near >= threshold - SLACK
            if linked.any():
                i, j = _joined(linked)
                rows.append((ids[i], ids[j], np.ones(len(i)), np.ones(len(i), bool)))
        return rows

    def refine(group: pa.Table) -> pa.Table:
        """Compares all vectors around each centre: entries better than what their lists hold, and ties at the threshold."""
        rows = []
        lengths = group["vec"].combine_chunks().value_lengths().to_numpy()
        for n in np.unique(lengths):       # vectors around one centre are of one length
            rows += around(group.take(pa.array(np.flatnonzero(lengths == n))))
        a, b, cos, tie = (np.concatenate(c) for c in zip(*rows, strict=True))
        return pa.table({"a": a, "b": b, "cos": cos, "tie": tie})
    return refine


def _decide(threshold: float):
    def decide(group: pa.Table) -> pa.Table:
        """Links between two blocks: how many each node has (copies counted), and ties that hold them together."""
        side, node, home, copies = (group[c].to_numpy() for c in ("side", "node", "home", "copies"))
        lengths = group["unit"].combine_chunks().value_lengths().to_numpy()
        counts, ties = [], []
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            x = _matrix(group["unit"].take(pa.array(mine)), float)
            s, ids, h, k = side[mine], node[mine], home[mine], copies[mine]
            linked = (x @ x.T >= threshold) & (h[:, None] == h[None, :]) & (ids[:, None] != ids[None, :])
            linked &= (s[:, None] + s[None, :] == 1) | (s[:, None] == 2)      # across the two blocks, or within one
            counts.append((ids, linked @ k))
            i, j = _joined(linked)
            ties.append((ids[i], ids[j]))
        a, n = (np.concatenate(c) for c in zip(*counts, strict=True))
        i, j = (np.concatenate(c) for c in zip(*ties, strict=True))
        return pa.table({"a": np.r_[a, i], "b": np.r_[np.full(len(a), -1), j], "n": np.r_[n, np.zeros(len(i), n.dtype)].astype(np.int64)})
    return decide


def _lists(found: DataFrame) -> DataFrame:
    """The LIST nearest of each node; ``old`` marks what stood in the list before."""
    best = found.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.max("old").alias("old"))
    return best.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("cos", "b", "old")), asc=False), 1, LIST).alias("near"))


def _around(lists: DataFrame, salt: int, kin: DataFrame | None = None) -> DataFrame:
    """(centre, node): each node with its list and the nodes that list it, where any of these entries is new, and with its entries (a, b) in ``kin``.

    Nodes on very many lists meet these in parts of about BLOCK, each with the whole list.
    """
    flat = lists.select("a", F.explode("near").alias("x")).select("a", "x.b", (~F.col("x.old")).alias("new"))
    own = flat.select(F.col("a").alias("centre"), F.col("b").alias("node"), "new", F.lit(0).alias("back"))
    itself = lists.select(F.col("a").alias("centre"), F.col("a").alias("node"), F.lit(False).alias("new"), F.lit(0).alias("back"))
    back = flat.select(F.col("b").alias("centre"), F.col("a").alias("node"), "new", F.lit(1).alias("back"))
    both = own.unionByName(itself).unionByName(back)
    if kin is not None:
        both = both.unionByName(kin.select(F.col("a").alias("centre"), F.col("b").alias("node"), F.lit(False).alias("new"), F.lit(0).alias("back")))
    sizes = both.groupBy("centre").agg(F.greatest(F.ceil(F.sum("back") / BLOCK), F.lit(1)).cast("int").alias("parts"), F.max("new").alias("moved")).where("moved").select("centre", "parts")
    part = F.when(F.col("back") == 1, F.array(F.pmod(F.xxhash64("node", F.lit(salt)), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return both.join(settle(sizes, "nn-parts"), "centre").select("centre", "node", F.explode(part).alias("part")).select(F.xxhash64("centre", "part").alias("centre"), "node")


def _dealt(rows: DataFrame, area: list[str], block: int, salt: int) -> DataFrame:
    """Adds ``part``: rows of one area in parts of about ``block``."""
    sizes = settle(rows.groupBy(*area).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")), "nn-parts")
    return rows.join(sizes, area).withColumn("part", F.pmod(F.xxhash64("node", F.lit(salt)), "parts").cast("int"))


def _descent(nodes: DataFrame, threshold: float, turn: int, kin: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ties at the threshold, and the lists, from one descent among vectors of different ``home``.

    With ``kin``, the entries that nodes have at home, it goes on until no list changes.
    """
    slim = settle(nodes.select("node", "home", F.col("unit").cast("array<float>").alias("vec")), "nn-vectors")
    codes = settle(nodes.select("node", "area", "unit").mapInArrow(_coder(turn), "node long, area long, codes array<long>"), "nn-codes")
    sizes = settle(codes.groupBy("area").agg(F.greatest(F.ceil(F.log2(F.count(F.lit(1)) / BLOCK)), F.lit(0)).alias("bits")), "nn-bits")
    coded = codes.join(sizes, "area").select("node", "area", "bits", F.posexplode("codes").alias("no", "code"))
    coded = coded.withColumn("bucket", F.xxhash64("area", "no", F.expr("code & cast(pow(2, least(bits, 24)) - 1 as long)")))
    placed = _dealt(coded.select("node", "bucket"), ["bucket"], 2 * BLOCK, turn).select("node", F.xxhash64("bucket", "part").alias("centre"))
    members = placed.withColumn("worst", F.lit(-1.0))
    ties, lists, linked = None, None, -1
    batches = max(1, nodes.count() // CENTRES)
    for step in itertools.count():
        work = members.join(slim, "node").withColumn("batch", F.pmod(F.xxhash64("centre"), F.lit(batches)))
        found = settle(work.groupBy("batch").applyInArrow(_refine(threshold), "a long, b long, cos double, tie boolean"), "nn-found")
        new = found.where("tie").select("a", "b")
        ties = new if ties is None else ties.unionByName(new)
        entries = found.where("not tie").select("a", "b", "cos", F.lit(False).alias("old"))
        if lists is not None:
            entries = entries.unionByName(lists.select("a", F.explode("near").alias("x")).select("a", "x.b", "x.cos", F.lit(True).alias("old")))
        lists = settle(_lists(entries), "nn-lists")
        n, moved = lists.agg(F.sum(F.size(F.filter("near", lambda x: x["cos"] >= threshold - SLACK))), F.sum(F.size(F.filter("near", lambda x: ~x["old"])))).first()
        if not moved or (kin is None and (n == linked or step + 1 == ROUNDS)):
            break
        linked = n
        worst = lists.select(F.col("a").alias("node"), F.when(F.size("near") < LIST, F.lit(-1.0)).otherwise(F.element_at("near", -1)["cos"]).alias("worst"))
        members = _around(lists, step, kin).join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.0)))
    return ties, lists


def _turn(nodes: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Ties at the threshold from one descent, with saturated lists enlarged until nothing at the threshold is left outside their components."""
    ties, lists = _descent(nodes.withColumn("home", F.col("node")), threshold, turn)
    full = F.filter("near", lambda x: x["cos"] >= threshold - SLACK)
    full = settle(lists.where(F.size(full) == LIST).select("a", "near"), "nn-full")
    kin = settle(full.select("a", F.explode("near.b").alias("b")).join(full.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"), "nn-kin")
    for step in itertools.count(1):
        roots = settle(components(ties), "nn-roots")
        homes = full.select(F.col("a").alias("node")).join(roots, "node").withColumnRenamed("root", "home")
        wide = settle(nodes.join(homes, "node"), "nn-wide")
        several = wide.groupBy("area").agg((F.min("home") < F.max("home")).alias("several")).where("several")
        wide = wide.join(several, "area", "left_semi")
        if wide.isEmpty():
            return ties
        more, _ = _descent(wide, threshold, 1000 * step + turn, kin.join(wide.select(F.col("node").alias("a")), "a", "left_semi"))
        if more.isEmpty():
            return ties
        ties = ties.unionByName(more)


def _whole(nodes: DataFrame, ties: DataFrame, threshold: float) -> DataFrame:
    """Every two members of a component of ties compared: (a, -1, links) and ties (a, b, 0)."""
    homes = settle(components(ties), "nn-homes").select("node", F.col("root").alias("home"))
    sizes = settle(homes.groupBy("home").agg(F.count(F.lit(1)).alias("size")), "nn-sizes")
    batches = max(1, homes.count() // WIDE_BLOCK)
    blocks = F.ceil(F.col("size") / WIDE_BLOCK).cast("int")
    placed = homes.join(sizes, "home").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = F.least("own", "other"), F.greatest("own", "other")
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("home"), F.lit(batches))).otherwise(F.xxhash64("home", one, two))      # small components share a task
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    work = placed.select("node", "home", F.col("blocks").alias("many"), key.alias("key"), side.alias("side")).join(nodes.select("node", "copies", "unit"), "node")
    return settle(work.groupBy("key", F.col("many") > 1).applyInArrow(_decide(threshold), "a long, b long, n long"), "nn-decided")


def _auditor(queries: pa.Table, threshold: float):
    def audit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, area = queries["node"].to_numpy(), queries["area"].to_numpy()
        lengths = queries["unit"].combine_chunks().value_lengths().to_numpy()
        total = np.zeros(len(node), np.int64)
        for batch in batches:
            sizes = batch.column("unit").value_lengths().to_numpy()
            for n in np.unique(sizes):
                q, m = np.flatnonzero(lengths == n), pa.array(np.flatnonzero(sizes == n))
                if len(q):
                    part = batch.take(m)
                    near = _matrix(queries["unit"].take(pa.array(q)), float) @ _matrix(part.column("unit"), float).T >= threshold
                    near &= (area[q][:, None] == part.column("area").to_numpy()[None, :]) & (node[q][:, None] != part.column("node").to_numpy()[None, :])
                    total[q] += near @ part.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total)], ["node", "truth"])
    return audit


def audit(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Mean share of their true links that was found, over the nodes with links among at most AUDITED chosen by a hash.

    Those are compared with all nodes. Each node counts the same, so one large group cannot hide what others miss.
    """
    queries = nodes.select("node", "area", "unit").orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDITED).toArrow()
    truth = nodes.select("node", "area", "unit", "copies").mapInArrow(_auditor(queries, threshold), "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    share = truth.where("truth > 0").join(links, "node", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("truth"))).first()[0]
    return 1.0 if share is None else share


def near_vectors(vectors: DataFrame, threshold: float, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row, and the recall measured.

    Two vectors link if their labels are equal and not null, they have as many
    components, and their cosine is at least ``threshold``. Vectors that are
    null, empty, zero or hold a null or a non-finite component link with
    nothing and stay alone. Equal vectors of a label are one node; each counts
    the others as links. ``component_id`` is the smallest id reachable; null
    ids count in no minimum. An empty table gives no rows. Recall below RECALL
    after TURNS turns is an error.
    """
    rows = settle(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
                  .mapInArrow(_prepare, vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label")).schema.add("unit", T.ArrayType(T.DoubleType())))
                  .withColumn("row", F.monotonically_increasing_id()), "nn-rows")
    able = rows.where(F.col("unit").isNotNull() & F.col("label").isNotNull())
    area = F.xxhash64(F.col("label").cast("string"), F.size("unit"))
    nodes = settle(able.groupBy(area.alias("area"), "unit").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")), "nn-nodes")
    ties, recall = None, 1.0
    for turn in range(TURNS):
        new = _turn(nodes, threshold, turn)
        ties = new if ties is None else ties.unionByName(new)
        decided = _whole(nodes, ties, threshold)
        links = settle(decided.where("b = -1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "nn-links")
        recall = audit(nodes, links, threshold)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"near_vectors: after {TURNS} turns only {recall:.4f} of the links of the audited vectors are found ({RECALL} are needed)")
    roots = settle(components(decided.where("b <> -1").select("a", "b")), "nn-roots")
    known = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = settle(known.groupBy("root").agg(F.min("low").alias("component_id")), "nn-lows")
    known = settle(known.join(lows, "root").join(links, "node", "left").select("area", "unit", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "nn-known")
    joined = able.withColumn("area", area).join(known, ["area", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("unit").isNull() | F.col("label").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall
