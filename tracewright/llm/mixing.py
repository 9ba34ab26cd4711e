"""Mixing documents to target weights of domains, with soft membership.

A classifier learned from a labelled table gives each document a probability
for every domain. Rates (how often a document enters the mix) are found by
projected-gradient least squares under bounds, so that the expected tokens of
each domain meet their targets. A gradient step lowers the rate of a document
by the product of its probabilities with a vector that is the same for all
documents, so the vectors of the steps (with their momentum) are all that is
kept: a pass over the documents replays them and adds up what each domain gets.
The fit ends where the targets are met, or where a lower bound of the miss,
added up in the same pass, shows that it is the least possible. Where neither is
so after a stated number of passes (rates without a ceiling that would have to
grow without end), Newton's method on the dual problem takes over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import text as tx
from tracewright.session import settle

BITS = 14              # words are hashed to 2 ** BITS features
PER_DOMAIN = 1000      # labelled documents of a domain to learn from, about
CLOSE = 1e-3           # enough: no domain misses its target by more than this share of all tokens
STILL = 1e-4           # or the miss is the least possible: its equation holds to this share of all tokens
PULL = 1e-9            # weight of staying at rate 1 against meeting the targets
PASSES = 60            # gradient steps, at most
PROVED = 1e-3          # the weighted miss exceeds the least possible by no more than this share
LENGTHS = tuple(2.0 ** -i for i in range(12))      # parts of a step that are tried in one pass
DENSE = 4              # features besides words


@dataclass(frozen=True)
class Classifier:
    domains: tuple[str, ...]
    weights: np.ndarray        # (2 ** BITS + DENSE) x domains
    bias: np.ndarray


@dataclass(frozen=True)
class Mix:
    classifier: Classifier
    steps: tuple[tuple[tuple[float, ...], float], ...]      # vector and momentum of each
    ceiling: float | None
    targets: dict[str, float]      # tokens
    reached: dict[str, float]


def _features(data: np.ndarray, offsets: np.ndarray):
    """Distinct hashed words of each text, flat, how many each has, dense features, and token counts."""
    starts, ends, counts = tx.words(data, offsets, tx.ALNUM)
    at = (tx.word_hashes(tx.lower_ascii(data), starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    both = np.unique((of << BITS) | at)
    distinct = np.bincount(both >> BITS, minlength=len(counts))
    repeats = np.zeros(len(counts))
    if len(at) > 1:
        same = (at[1:] == at[:-1]) & (of[1:] == of[:-1])
        repeats = np.bincount(of[1:][same], minlength=len(counts)).astype(float)
    letters = np.bincount(of, weights=ends - starts, minlength=len(counts))
    size = np.maximum(np.diff(offsets), 1)
    n = np.maximum(counts, 1)
    dense = np.stack([distinct / n, repeats / n, letters / size, np.log1p(counts) / 5], 1)
    return both & ((1 << BITS) - 1), distinct, dense, counts


def _scores(at, distinct, dense, weights, bias) -> np.ndarray:
    n = len(distinct)
    scale = 1 / np.sqrt(np.maximum(distinct, 1))
    of = np.repeat(np.arange(n), distinct)
    words = np.stack([np.bincount(of, weights=weights[:, k][at], minlength=n) for k in range(weights.shape[1])], 1)
    return words * scale[:, None] + dense @ weights[-DENSE:] + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _collector(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in tx.pieces(batches, "text"):
        at, distinct, dense, _ = _features(data, offsets)
        yield pa.RecordBatch.from_arrays([batch.column("domain"), tx.lists(distinct, at.astype(np.int32), pa.int32()), tx.lists(np.full(len(distinct), DENSE), dense.ravel(), pa.float64())],
                                         ["domain", "at", "dense"])


def train(docs: DataFrame, labels: DataFrame, domain: Column, doc_id: str = "doc_id", text: str = "text", per_domain: int = PER_DOMAIN, rounds: int = 150) -> Classifier:
    """Multinomial logistic regression on about ``per_domain`` labelled documents of each domain.

    ``domain`` is a column of the labelled table; rows where it or the id is
    null teach nothing. The chosen labels (a bounded number of rows) are
    broadcast to the documents, so no text is shuffled.
    """
    known = labels.select(F.col(doc_id).alias("__id"), domain.alias("domain")).where("__id is not null and domain is not null")
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = tuple(sorted(counts))
    if not names:
        return Classifier(("all",), np.zeros(((1 << BITS) + DENSE, 1)), np.zeros(1))
    slots = 1 << 30
    bound = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(slots * min(1.0, per_domain / n)))])
    chosen = known.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(slots)) < bound[F.col("domain")])
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(chosen), "__id").select("domain", "text")
    got = sample.mapInArrow(_collector, "domain string, at array<int>, dense array<double>").toArrow().sort_by("domain").combine_chunks()
    y = np.array([names.index(d) for d in got["domain"].to_pylist()], dtype=int)
    k = len(names)
    weights, bias = np.zeros(((1 << BITS) + DENSE, k)), np.zeros(k)
    if not len(y):
        return Classifier(names, weights, bias)
    lists = got["at"].combine_chunks()
    at, distinct = lists.flatten().to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy())
    dense = got["dense"].combine_chunks().flatten().to_numpy().reshape(len(y), DENSE)
    truth = np.eye(k)[y]
    weight = (len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1)))[y]     # domains count the same
    of, scale = np.repeat(np.arange(len(y)), distinct), 1 / np.sqrt(np.maximum(distinct, 1))
    ahead, ahead_b = weights, bias
    for t in range(rounds):        # accelerated gradient steps
        off = (_softmax(_scores(at, distinct, dense, ahead, ahead_b)) - truth) * weight[:, None] / len(y)
        slope = np.stack([np.bincount(at, weights=(off[:, j] * scale)[of], minlength=(1 << BITS) + DENSE) for j in range(k)], 1)
        slope[-DENSE:] += dense.T @ off
        new, new_b = ahead - 1.5 * (slope + 1e-5 * ahead), ahead_b - 0.5 * off.sum(0)
        push = t / (t + 3)
        ahead, ahead_b, weights, bias = new + push * (new - weights), new_b + push * (new_b - bias), new, new_b
    return Classifier(names, weights, bias)


def _predictor(model: Classifier, column: str, carry: list[str]):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.pieces(batches, column):
            at, distinct, dense, counts = _features(data, offsets)
            p = _softmax(_scores(at, distinct, dense, model.weights, model.bias))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(counts.astype(np.int64)), tx.lists(np.full(len(p), p.shape[1]), p.ravel(), pa.float64())],
                                             [*[f"c{i}" for i in range(len(carry))], "n_tokens", "posterior"])
    return predict


def predict(docs: DataFrame, model: Classifier, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns with ``n_tokens`` and ``posterior`` (in the order of the domains)."""
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)],
                           T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(_predictor(model, text, carry), schema).toDF(*carry, "n_tokens", "posterior")


def _rate(steps, ceiling: float | None) -> Column:
    """Rate of a document after the steps, held between 0 and the ceiling each time."""
    start = F.lit(1.0 if ceiling is None else min(1.0, float(ceiling)))
    if not steps:
        return start

    def step(s: Column, x: Column) -> Column:
        down = sum((F.col("posterior")[k] * x["vector"][k] for k in range(len(steps[0][0]))), F.lit(0.0))
        rate = F.greatest(s["ahead"] - down, F.lit(0.0))
        rate = rate if ceiling is None else F.least(rate, F.lit(float(ceiling)))
        return F.struct(rate.alias("rate"), (rate + x["push"] * (rate - s["rate"])).alias("ahead"))

    each = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in v]).alias("vector"), F.lit(float(push)).alias("push")) for v, push in steps])
    return F.aggregate(each, F.struct(start.alias("rate"), start.alias("ahead")), step, lambda s: s["rate"])


def _reacher(steps, ceiling: float | None, price: np.ndarray):
    """Tokens reached after the steps; of the price of each document, the tokens times its negative part, and the least price."""
    k = len(price)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros(k + 1), 0.0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy().astype(float)
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            rate = ahead = np.full(len(n), 1.0 if ceiling is None else min(1.0, ceiling))
            for v, push in steps:
                new = np.clip(ahead - p @ np.array(v), 0.0, ceiling)
                rate, ahead = new, new + push * (new - rate)
            below = np.minimum(p @ price, 0.0)
            total += np.r_[(n * rate) @ p, n @ below]
            least = min(least, below.min(initial=0.0))
        yield pa.RecordBatch.from_arrays([tx.lists(np.array([k + 1]), total, pa.float64()), pa.array([least])], ["sums", "least"])
    return add


def _descend(rows: DataFrame, have: np.ndarray, gram: np.ndarray, target: np.ndarray, w: np.ndarray, ceiling: float | None):
    """Steps of accelerated projected gradient and the tokens they reach; None if neither the targets nor a proof are reached.

    The gradient is scaled by the largest curvature of the weighted Gram matrix of the domains. The prices
    y = w * miss give the lower bound: half the weighted squares of e are, for
    all rates r allowed, at least - y ** 2 / 2w - y * target + the sum of tokens * r * price,
    where a document's price is its posterior times y.
    """
    k, total = len(target), target.sum()
    at_least = np.sqrt(w)
    reach = np.linalg.eigvalsh(at_least[:, None] * gram * at_least).max()
    steps: list[tuple[tuple[float, ...], float]] = []
    reached = have if ceiling is None else have * min(1.0, ceiling)
    ahead, bound, age = reached, -np.inf, 0
    for _ in range(PASSES):
        if np.abs(reached - target).max() <= CLOSE * total:
            return steps, reached
        price = w * (ahead - target)
        steps.append((tuple(float(x) for x in price / reach), 0.0))
        added = rows.select("n_tokens", "posterior").mapInArrow(_reacher(steps, ceiling, price), "sums array<double>, least double")      # a row a task
        *found, least = added.agg(*[F.sum(F.col("sums")[i]) for i in range(k + 1)], F.min("least")).first()
        new, below = np.array(found[:k]), found[k]
        if ceiling is None:
            price, below = price - least, 0.0      # posteriors sum to 1: no document has a negative price now
        bound = max(bound, -(price * price / w).sum() / 2 - price @ target + (ceiling or 0.0) * below)
        miss, before = ((w * (x - target) ** 2).sum() / 2 for x in (new, reached))
        age = 0 if miss > before else age + 1      # a step that went too far takes its momentum away
        push = age / (age + 3)
        steps[-1] = (steps[-1][0], push)
        ahead, reached = new + push * (new - reached), new
        if miss - bound <= PROVED / 2 * miss:
            return steps, reached
    return (steps, reached) if np.abs(reached - target).max() <= CLOSE * total else None


def _adder(tries: np.ndarray, ceiling: float | None):
    """Of each vector tried: half the squared rates' distance from 1, the tokens reached, and the Gram matrix of the rows off the bounds."""
    k = tries.shape[1]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(tries), 1 + k + k * k))
        for batch in batches:
            n = batch.column("n_tokens").to_numpy().astype(float)
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            for i, v in enumerate(tries):
                raw = 1 - p @ v
                r = np.clip(raw, 0.0, ceiling)
                free = np.where(r == raw, n, 0.0)
                total[i] += np.r_[(n * (r - 1) ** 2).sum() / 2, (n * r) @ p, ((p * free[:, None]).T @ p).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tries)), pa.int32()), tx.lists(np.full(len(tries), total.shape[1]), total.ravel(), pa.float64())], ["i", "sums"])
    return add


def _tried(rows: DataFrame, tries: np.ndarray, ceiling: float | None) -> list[tuple[float, np.ndarray, np.ndarray]]:
    k = tries.shape[1]
    parts = rows.select("n_tokens", "posterior").mapInArrow(_adder(tries, ceiling), "i int, sums array<double>")      # a few rows a task
    sums = {r["i"]: r for r in parts.repartition(1).groupBy("i").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(1 + k + k * k)]).collect()}
    flat = [np.array([sums[i][f"s{j}"] for j in range(1 + k + k * k)]) for i in range(len(tries))]
    return [(float(x[0]), x[1:1 + k], x[1 + k:].reshape(k, k)) for x in flat]


def fit(docs: DataFrame, model: Classifier, weights: dict[str, float], ceiling: float | None = None, keep_total: bool = True, text: str = "text") -> Mix:
    """Rates whose expected tokens per domain meet ``weights`` (shares of the mix; domains not named get none).

    The mix is as large as the corpus (``keep_total``), or as large as it can be
    without any domain needing more tokens than it has; use that with a ceiling of 1.
    The squared misses are weighted by the size of each domain, and where the targets
    cannot be met their weighted sum is the least possible. An empty table, or texts
    without words only, give no steps.

    Where projected gradient does not end in PASSES, the rates also change no more from 1 than asked
    for: with e the misses, they minimize PULL * half the sum of tokens *
    (rate - 1) ** 2 plus half the weighted squares of e. The dual problem has one
    number a domain, and what its gradient leaves open is the gap to that minimum.
    """
    k = len(model.domains)
    rows = settle(predict(docs, model, [], text), "mix-posteriors")
    p = [F.col("posterior")[i] for i in range(k)]
    tokens = F.col("n_tokens").cast("double")
    sums = rows.agg(*[F.sum(tokens * x) for x in p], *[F.sum(tokens * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    have = np.array([x or 0.0 for x in sums[:k]])
    gram = np.array([x or 0.0 for x in sums[k:]]).reshape(k, k)
    share = np.array([weights.get(d, 0.0) for d in model.domains])
    share = share / share.sum() if share.sum() else np.full(k, 1 / k)
    total = have.sum() if keep_total else min((h / s for h, s in zip(have, share, strict=True) if s > 0), default=0.0)
    target = share * total
    if not have.sum():
        return Mix(model, (), ceiling, dict(zip(model.domains, target)), dict(zip(model.domains, have)))
    w = 1 / np.maximum(np.diag(gram), 1e-9 * have.sum())
    name = lambda v: {d: float(x) for d, x in zip(model.domains, v, strict=True)}
    descended = _descend(rows, have, gram, target, w, ceiling)
    if descended is not None:
        return Mix(model, tuple(descended[0]), ceiling, name(target), name(descended[1]))
    soft = PULL / w        # as a share of the largest possible weight
    vector, best = np.zeros(k), None
    step = np.zeros(k)
    while True:
        tries = np.stack([vector + x * step for x in (LENGTHS if step.any() else (0.0,))])
        found = _tried(rows, tries, ceiling)
        # value of the dual, and its gradient
        told = [(off + v @ (sums - target) - v @ (soft * v) / 2, i) for i, (v, (off, sums, _)) in enumerate(zip(tries, found, strict=True))]
        value, i = max(told)
        if best is not None and value <= best:         # a shorter step rises, but at the top, as far as doubles tell
            step = step * LENGTHS[-1] / 2
            if (vector + step == vector).all():
                break
            continue
        best, vector, (_, reached, free) = value, tries[i], found[i]
        slope = reached - target - soft * vector
        if np.abs(reached - target).max() <= CLOSE * total or np.abs(slope).max() <= STILL * total:
            break
        step = np.linalg.solve(free + np.diag(soft), slope)
    steps = [(tuple(float(x) for x in vector), 0.0)] if vector.any() else []
    return Mix(model, tuple(steps), ceiling, name(target), name(reached))


def apply(docs: DataFrame, mix: Mix, carry: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The carried columns (default: all) with n_tokens, posterior, domain, rate and copies.

    ``copies`` is how often the document enters the mix: the whole part of the
    rate, plus one with the probability of the rest, drawn by a hash of
    ``key``; rows of equal key are drawn alike, and a null key is a key. Null
    and empty texts have no tokens and a posterior of their own. Carried columns named
    like a result give way to it.
    """
    made = ("n_tokens", "posterior", "domain", "rate", "copies")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    out = predict(docs, mix.classifier, carry, text).withColumn("rate", _rate(mix.steps, mix.ceiling))
    names = F.array(*[F.lit(d) for d in mix.classifier.domains])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (out.withColumn("domain", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")))
            .withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")))
