"""Words of documents that repeat passages of a benchmark, found by winnowing.

Documents and items are fingerprinted alike: of every run of ``window``
consecutive k-gram hashes the smallest is kept. Two texts that share
``k + window - 1`` words keep the same hash at the same place of the shared
span, so the join of the fingerprints meets every such span. Each hit is then
extended word by word to the longest common span, which decides exactly.

Items shorter than that length take their whole sequence as one fingerprint,
and documents keep the n-grams of the lengths that occur among those items.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm import text as tx
from tracewright.session import settle

KNOWN_LIMIT = 1_000_000    # item fingerprints that may travel to every task as a filter (8 MB)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _split(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _slide(values: np.ndarray, w: int, pick) -> np.ndarray:
    out = values[:len(values) - w + 1].copy()
    for j in range(1, w):
        pick(out, values[j:j + len(out)], out=out)
    return out


def winnow(grams: np.ndarray, counts: np.ndarray, w: int) -> np.ndarray:
    """Which k-gram hashes are the smallest of some window of w (ties: all of them).

    A text with fewer than w hashes keeps all.
    """
    keep = np.repeat(counts < w, counts)
    if len(grams) >= w:
        low = _slide(grams, w, np.minimum)
        ends = np.repeat(np.cumsum(counts), counts)
        whole = np.arange(len(low)) + w <= ends[:len(low)]
        low = np.where(whole, low, np.uint64(0))       # windows over two texts count for nothing
        padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
        keep |= _slide(padded, w, np.maximum)[:len(grams)] == grams
    return keep


def _fingerprints(data, offsets, k: int, w: int, short: list[int], whole_short: bool):
    """Word counts, and (text, hash, word index) of the fingerprints of a piece.

    whole_short: as for items, where a text of fewer than k + w - 1 words has one fingerprint.
    """
    starts, ends, counts = tx.words(data, offsets, tx.ALNUM)
    hashes = tx.word_hashes(data, starts, ends)
    first = np.cumsum(counts) - counts
    found = []
    long_enough = counts >= k + w - 1
    grams, at, n = tx.gram_hashes(hashes, counts, k)
    keep = winnow(grams, n, w) & np.repeat(long_enough, n)
    of = np.repeat(np.arange(len(counts)), n)
    found.append((of[keep], grams[keep], at[keep]))
    for size in short:
        grams, at, n = tx.gram_hashes(hashes, counts, size)
        of = np.repeat(np.arange(len(counts)), n)
        grams = tx.mix(grams + np.uint64(size))         # apart from k-grams of the same words
        if whole_short:
            keep = counts[of] == size
            of, grams, at = of[keep], grams[keep], at[keep]
        found.append((of, grams, at))
    of, grams, at = (np.concatenate(x) for x in zip(*found, strict=True))
    return counts, of, grams, at - first[of]


def _scanner(text: str, carry: list[str], k: int, w: int, short: list[int], known: np.ndarray | None, items: bool):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.pieces(batches, text):
            counts, of, grams, at = _fingerprints(tx.lower_ascii(data), offsets, k, w, short, items)
            if known is not None:
                place = np.searchsorted(known, grams)
                keep = known[np.minimum(place, len(known) - 1)] == grams if len(known) else np.zeros(len(grams), bool)
                of, grams, at = of[keep], grams[keep], at[keep]
            order = np.argsort(of, kind="stable")
            per = np.bincount(of, minlength=len(counts))
            texts = batch.column(text)
            texts = texts.take(pa.array(np.arange(len(per)), mask=per == 0))      # null where nothing was met
            columns = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts), texts, tx.lists(per, grams[order].view(np.int64), pa.int64()), tx.lists(per, at[order].astype(np.int32), pa.int32())],
                [*[f"c{i}" for i in range(len(carry))], "n_words", "text", "hashes", "places"])
    return scan


def _scan(df: DataFrame, carry: list[str], text: str, k: int, w: int, short: list[int], known, items: bool) -> DataFrame:
    columns = list(dict.fromkeys([*carry, text]))
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))])
    return df.select(*columns).mapInArrow(_scanner(text, carry, k, w, short, known, items), schema)


def shared_spans(doc: list[bytes], item: list[bytes], hits: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Longest common spans of at least ``least`` words through the hits (place in the document, place in the item)."""
    spans, seen = [], {}
    for p, q in sorted(hits):
        if seen.get(p - q, -1) >= p:      # inside a span of the same diagonal
            continue
        if doc[p] != item[q]:
            continue
        a, b = p, q
        while a and b and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        e, f = p + 1, q + 1
        while e < len(doc) and f < len(item) and doc[e] == item[f]:
            e, f = e + 1, f + 1
        seen[p - q] = e - 1
        if e - a >= least:
            spans.append((a, e))
    return spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def _extender(length: int):
    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc, spans, ids = _split(row["text"]), [], set()
                for it in row["met"] or []:
                    item = _split(it["item"])
                    got = shared_spans(doc, item, [(h["place"], h["item_place"]) for h in it["hits"]], min(length, len(item)))
                    spans += got
                    if got and it["item_id"] is not None:
                        ids.add(it["item_id"])
                yield pa.RecordBatch.from_pylist(
                    [{"row": row["row"], "spans": [{"start": a, "end": e} for a, e in _merged(spans)], "item_ids": sorted(ids)}],
                    pa.schema([("row", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))]))
    return extend


def find_leaks(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", length: int = 10, k: int = 5) -> DataFrame:
    """The carried columns of every document with n_words, spans and item_ids.

    ``spans`` are the merged word ranges [start, end) inside occurrences of a
    window (``length`` consecutive words of an item, or all words of a shorter
    one); ``item_ids`` the items met, as sorted text.

    Words are runs of digits, letters and characters beyond ASCII, lower-cased
    in A-Z. Null and empty texts have no words and no spans; items without
    words match nothing; items of equal id count once; an item with a null id
    marks words but is not listed. Repeated documents are judged one by one.
    ``carry`` may hold any columns (default: all); those named like a result
    give way to it.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "spans", "item_ids")]
    w = length - k + 1
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("item")).distinct()
    scanned = settle(_scan(items, ["item_id", "item"], "item", k, w, list(range(1, length)), None, True), "bench-fingerprints")
    prints = (scanned.select(F.col("c0").alias("item_id"), F.col("c1").alias("item"), F.explode(F.arrays_zip("hashes", "places")).alias("x"))
              .select("item_id", "item", F.col("x.hashes").alias("hash"), F.col("x.places").alias("item_place")))
    short = sorted(r[0] for r in scanned.where(F.col("n_words").between(1, length - 1)).select("n_words").distinct().collect())
    n = prints.count()
    known = None
    if n <= KNOWN_LIMIT:       # beyond, all fingerprints of the documents take part in the join
        known = np.unique(np.array([r[0] for r in prints.select("hash").distinct().collect()], np.int64).view(np.uint64))

    rows = settle(_scan(docs, carry, text, k, w, short, known, False).withColumn("row", F.monotonically_increasing_id()), "doc-fingerprints")
    met = F.size("hashes") > 0
    hits = (rows.where(met).select("row", F.explode(F.arrays_zip("hashes", "places")).alias("x"))
            .select("row", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
            .join(prints, "hash").groupBy("row", "item_id", "item").agg(F.collect_list(F.struct("place", "item_place")).alias("hits"))
            .groupBy("row").agg(F.collect_list(F.struct("item_id", "item", "hits")).alias("met")))
    found = (rows.where(met).select("row", "text").join(hits, "row")
             .mapInArrow(_extender(length), "row long, spans array<struct<start:long,end:long>>, item_ids array<string>"))
    none = {"spans": F.expr("cast(array() as array<struct<start:long,end:long>>)"), "item_ids": F.expr("cast(array() as array<string>)")}
    names = [f"c{i}" for i in range(len(carry))]
    clean = rows.where(~met).select(*names, "n_words", *[v.alias(k) for k, v in none.items()])
    hit = (rows.where(met).select(*names, "n_words", "row").join(found, "row", "left")
           .select(*names, "n_words", *[F.coalesce(F.col(k), v).alias(k) for k, v in none.items()]))
    return clean.unionAll(hit).toDF(*carry, "n_words", "spans", "item_ids")


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
