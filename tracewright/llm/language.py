"""Language of a text in two steps: its family, then the language within it.

Both steps are one-versus-one linear support vector machines on hashed byte
trigrams: families against each other, then the languages of one family. A text
is scored by adding one weight per trigram, so prediction is a table look-up
over the bytes of a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import text as tx

BITS = 12                  # trigrams are hashed to 2 ** BITS features
PER_LANGUAGE = 1000        # labelled documents of a language to learn from, about
UNKNOWN = "und"

# Families of ISO 639-1 codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


@dataclass(frozen=True)
class Machine:
    """Separates ``one`` (positive) from ``other``; slope and shift turn a margin into a probability."""
    one: str
    other: str
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


@dataclass(frozen=True)
class Model:
    families: tuple[Machine, ...]
    languages: dict[str, tuple[Machine, ...]]      # by family
    members: dict[str, tuple[str, ...]]            # languages of each family


_FOLD = np.where(tx.byte_class(lambda b: 65 <= b <= 90), np.arange(256) + 32, np.where(tx.byte_class(lambda b: 97 <= b <= 122 or b >= 128), np.arange(256), 32)).astype(np.uint32)


def _trigrams(data: np.ndarray) -> np.ndarray:
    x = _FOLD[data]
    code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in tx.pieces(batches, "text"):
        grams = _trigrams(data) if len(data) > 2 else np.empty(0, np.int64)
        out = []
        for a, e in zip(offsets[:-1], offsets[1:], strict=True):
            at, n = np.unique(grams[a:max(e - 2, a)], return_counts=True)
            out.append((at.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)))
        sizes = np.array([len(a) for a, _ in out])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), tx.lists(sizes, np.concatenate([a for a, _ in out]), pa.int32()), tx.lists(sizes, np.concatenate([v for _, v in out]), pa.float32())],
            ["lang", "at", "share"])


def _separate(x: np.ndarray, y: np.ndarray, strength: float = 30.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps.

    Each side counts the same in total, however many samples it has.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        v /= np.linalg.norm(v)
    step = 1 / (1 / strength + 2 * float(np.linalg.norm(x.T @ (weight * (x @ v)))))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead / strength - 2 * (x.T @ (weight * y * slack)))
        ahead, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the margins."""
    t = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y < 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q = p * (1 - p) + 1e-6
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def _one_versus_one(x: np.ndarray, names: np.ndarray) -> tuple[Machine, ...]:
    machines = []
    for one, other in combinations(sorted(set(names)), 2):
        mine = (names == one) | (names == other)
        y = np.where(names[mine] == one, 1, -1).astype(np.float32)
        w, b = _separate(x[mine], y)
        slope, shift = _calibrate(x[mine] @ w + b, y)
        machines.append(Machine(one, other, w.astype(np.float64), b, slope, shift))
    return tuple(machines)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from about ``per_language`` documents of each language, chosen by a hash of ``key``.

    Rows with a null language or text are left out. Fewer documents of a language are all used.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model((), {}, {})
    slots = 1 << 30
    bound = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(slots * min(1.0, per_language / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(slots)) < bound[F.col("lang")])
    got = chosen.select("lang", "text").mapInArrow(_features, "lang string, at array<int>, share array<float>").toArrow()
    got = got.sort_by("lang")
    names = np.array(got["lang"].to_pylist(), dtype=object)
    if not len(names):
        return Model((), {}, {})
    x = np.zeros((len(names), 1 << BITS), np.float32)
    for i, (at, share) in enumerate(zip(got["at"], got["share"], strict=True)):
        x[i, at.values.to_numpy()] = share.values.to_numpy()
    scale = float(1 / np.sqrt((x * x).sum(1).mean() + 1e-12))       # machines learn on vectors of about length 1
    x *= scale
    families = np.array([family_of(n) for n in names], dtype=object)
    shrink = lambda ms: tuple(Machine(m.one, m.other, m.weights * scale, m.bias, m.slope, m.shift) for m in ms)
    return Model(shrink(_one_versus_one(x, families)),
                 {f: shrink(_one_versus_one(x[families == f], names[families == f])) for f in sorted(set(families))},
                 {f: tuple(sorted(set(names[families == f]))) for f in sorted(set(families))})


def _decide(machines: tuple[Machine, ...], names: tuple[str, ...], grams: np.ndarray, spans: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Winner of the votes (ties: larger sum of probabilities) and its smallest probability, for each text."""
    starts, ends = spans
    n = len(starts)
    votes, sums, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.ones((len(names), n))
    place = {name: i for i, name in enumerate(names)}
    some = ends > starts
    for m in machines:
        total = np.zeros(n)
        if some.any():
            edges = np.stack([starts[some], ends[some]], 1).ravel()
            values = np.append(m.weights[grams], 0.0)
            total[some] = np.add.reduceat(values, edges)[::2]
        margin = total / np.maximum(ends - starts, 1) + m.bias
        p = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
        for name, q in ((m.one, p), (m.other, 1 - p)):
            i = place[name]
            votes[i] += q >= 0.5
            sums[i] += q
            least[i] = np.minimum(least[i], q)
    best = (votes + sums / (len(names) + 1)).argmax(0)
    return best, least[best, np.arange(n)]


def _predictor(model: Model, column: str, carry: list[str]):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = tuple(model.members)
        letter = tx.byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122)
        for batch, data, offsets in tx.pieces(batches, column):
            n = len(offsets) - 1
            grams = _trigrams(data) if len(data) > 2 else np.empty(0, np.int64)
            spans = [offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1])]
            seen = np.concatenate([[0], np.cumsum(letter[data])])
            spoken = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~spoken & (offsets[1:] > offsets[:-1])):     # letters beyond ASCII
                spoken[i] = any(c.isalpha() for c in bytes(data[offsets[i]:offsets[i + 1]]).decode(errors="replace"))
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if families:
                of, sure = _decide(model.families, families, grams, spans)
                for f, family in enumerate(families):
                    mine = np.flatnonzero((of == f) & spoken)
                    if len(mine):
                        inner, p = _decide(model.languages[family], model.members[family], grams, [s[mine] for s in spans])
                        names[mine] = np.array(model.members[family], object)[inner]
                        score[mine] = sure[mine] * p
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(names, pa.string()), pa.array(score)],
                                             [*[f"c{i}" for i in range(len(carry))], "lang_pred", "score"])
    return predict


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """The carried columns (default: all) with ``lang_pred`` and ``score`` (0 to 1).

    Null texts and texts without letters get ``und`` and score 0, as does every
    text if nothing was learned. Texts are read whole. Rows keep their place,
    so repeated rows and clashing ids do not matter; carried columns named like
    a result give way to it.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)],
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(_predictor(model, text, carry), schema).toDF(*carry, "lang_pred", "score")
