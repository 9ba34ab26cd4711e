"""Secrets in texts, by fixed patterns and by character models of random strings.

Everything is a column expression. Positions of all matches of a pattern come
from splitting the text at it: the pieces and the matches alternate, so their
lengths add up to the positions. The lengths are added up in blocks, so that a
text of very many matches needs about the power 1.5 of their number.

Besides the patterns, long tokens are compared under two character Markov
models, one of random strings and one of ordinary identifiers. Both are learned
from tokens labelled by the patterns: values found by them are random, other
words of the texts are ordinary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANDOM_SAMPLE = 20_000     # documents whose pattern values teach the model of random strings, about
WORD_SAMPLE = 2_000        # documents whose words teach the model of identifiers, about
LEAST_RATIO = 0.5          # log-likelihood ratio per step (nats) from which a token counts as random
CODES = 128
BLOCK = 128                # matches whose lengths are added up together

# What is looked for, and in which order kinds of equal start stand.
ASSIGN = """(?i)(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
SPAN = "struct<start:int,rank:int,end:int,value:string>"


def _let(value: Column, body) -> Column:
    """The body with the value computed once; columns named inside of a lambda are computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda s, x: s + x["gap"] + x["own"])


def _blocks(lengths: Column) -> Column:
    """Totals of the blocks."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * BLOCK + 1, BLOCK)))


def _ahead(lengths: Column, blocks: Column, i: Column) -> Column:
    """Total of the first i entries."""
    b = F.floor(i / BLOCK).cast("int")
    return F.aggregate(F.slice(blocks, 1, b), F.lit(0), lambda s, x: s + x) + _total(F.slice(lengths, b * BLOCK + 1, i - b * BLOCK))


def _spans(text: Column, pattern: str, rank: int, value_group: int = 0, least: int = 0) -> Column:
    """Matches of the pattern as (start, rank, end, value); those with a shorter value are left out."""
    p = F.lit(pattern)
    found, values, parts = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(value_group)), F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda a, b: F.struct(F.char_length(a).alias("gap"), F.char_length(b).alias("own")))
    spans = _let(F.struct(lengths.alias("l"), values.alias("v"), found.alias("m")), lambda z: _let(_blocks(z["l"]), lambda blocks: F.transform(z["l"], lambda x, i: _let(
        _ahead(z["l"], blocks, i) + x["gap"], lambda start: F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["own"]).alias("end"), F.get(z["v"], i).alias("value"))))))
    if least:
        spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= least)
    return F.when(F.regexp_like(text, p), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)")).cast(f"array<{SPAN}>")


def with_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__text`` (null: empty) and the spans of the three patterns."""
    return (docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
            .withColumns({"__assign": _spans(F.col("__text"), ASSIGN, 0, 2, 8), "__access": _spans(F.col("__text"), ACCESS, 1), "__hex": _spans(F.col("__text"), HEX, 2)}))


def _steps(token: Column) -> Column:
    """Index of each pair of neighbouring characters in a table of CODES x CODES."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    n = F.greatest(F.char_length(token) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: a * CODES + b + 1)


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", random_sample: int = RANDOM_SAMPLE, word_sample: int = WORD_SAMPLE) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair.

    Learns from about so many documents as the two bounds say, chosen by a hash
    of ``key``. The counts are smoothed by adding one to every pair of the
    characters a token can hold, so pairs never seen weigh little.
    """
    n = max(docs.count(), 1)
    slots = 1 << 30
    chosen = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(slots))
    sample = with_patterns(docs.where(chosen < int(slots * min(1.0, random_sample / n))).select(F.col(key).alias("key"), F.col(text).alias("text")))
    values = F.transform(F.concat("__assign", "__access", "__hex"), lambda s: F.struct(F.lit(1).alias("kind"), s["value"].alias("token")))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("__text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.transform(F.regexp_extract_all(plain, F.lit("[A-Za-z0-9_]{6,}"), F.lit(0)), lambda w: F.struct(F.lit(0).alias("kind"), w.alias("token")))
    few = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(slots)) < int(slots * min(1.0, word_sample / n))
    tokens = sample.select(F.explode(F.concat(values, F.when(few, words).otherwise(F.expr("cast(array() as array<struct<kind:int,token:string>>)")))).alias("t"))
    counts = tokens.select("t.kind", F.explode(_steps(F.col("t.token"))).alias("step")).groupBy("kind", "step").agg(F.count(F.lit(1)).alias("n"))
    seen = {(r["kind"], r["step"]): r["n"] for r in counts.collect()}       # at most two numbers for each pair of characters
    inside = [c for c in range(CODES) if chr(c).isalnum() or chr(c) in "+/_.=-"]

    rows = {(k, a): sum(seen.get((k, a * CODES + b + 1), 0) for b in inside) + len(inside) for k in (0, 1) for a in inside}
    table = [0.0] * (CODES * CODES)
    for a in inside:
        for b in inside:
            i = a * CODES + b
            table[i] = math.log((seen.get((1, i + 1), 0) + 1) / rows[1, a]) - math.log((seen.get((0, i + 1), 0) + 1) / rows[0, a])
    return table


def find_secrets(docs: DataFrame, table: list[float], text: str = "text", least_ratio: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``secrets``: spans (start, end in code points, end exclusive; kind; value), by start, then kind.

    Pattern spans all stay; a long token joins them as ``markov`` if it touches
    none of them, holds a letter, and its mean log-likelihood ratio per step
    reaches ``least_ratio``. A null text is an empty one and has no spans. Rows
    keep their place, so repeated rows are judged alike; an older column named
    secrets is replaced.
    """
    ratios = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")
    base = F.concat("__assign", "__access", "__hex")
    score = lambda t: F.aggregate(_steps(t), F.lit(0.0), lambda s, i: s + F.element_at(ratios, i)) / (F.char_length(t) - 1)
    spotted = F.filter(F.col("__tokens"), lambda t: t["value"].rlike("[A-Za-z]") & ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
                       & (score(t["value"]) >= least_ratio))
    out = (with_patterns(docs, text).withColumns({"__base": base, "__tokens": _spans(F.col("__text"), TOKEN, 3)})
           .withColumn("secrets", F.transform(F.array_sort(F.concat("__base", spotted)), lambda s: F.struct(
               s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1).alias("kind"), s["value"].alias("value")))))
    return out.drop("__text", "__assign", "__access", "__hex", "__base", "__tokens")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
