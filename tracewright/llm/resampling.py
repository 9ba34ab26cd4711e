"""Sample of documents that follows the n-grams of a target collection.

Texts are lower-cased and every run of separators becomes one space. One
regular expression is run over the result with overlapping matches: each match
starts at the space before a word and takes up to three words, and the space
behind a word, looked ahead for, ends it. The groups of a match are the spans of
the n-grams that start there, and their CRC-32 is continued from one to the
next. Counts of hashed n-grams in both collections give each of ``BUCKETS``
buckets a gain; a document weighs what its n-grams gain together. Adding
Gumbel noise to the weights and taking the highest draws without replacement.

Texts are hashed once: their buckets are written, counted, and read again to
be weighed.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle

BUCKETS = 10_000
LEAST_WORDS = 20       # a document with fewer words is never drawn
OUT_BYTES = 8 << 20    # bucket bytes that go out in one batch; a longer text makes its own

# Words are runs of digits, letters and everything beyond ASCII.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GRAMS = regex.compile(rb" ([^ ]++)(?:( [^ ]++)( [^ ]++)?+)?+(?= )")


def collapse(text: str | None) -> bytes:
    """Lower-case words, each between single spaces."""
    words = (text or "").encode().lower().translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b""


def gram_crcs(line: bytes) -> list[int]:
    """CRC-32 of all runs of one to three words, repeats included, by their first word."""
    crc, out = zlib.crc32, []
    put = out.append
    for match in _GRAMS.finditer(line, overlapped=True):
        one, two, three = match.groups()
        c = crc(one)
        put(c)
        if two is not None:
            c = crc(two, c)
            put(c)
            if three is not None:
                put(crc(three, c))
    return out


def _hash_rows(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    def batch(first: int, last: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids[first:last], pa.array(words, pa.int64()), pa.array(grams, pa.int64()), pa.array(found, pa.binary())],
                                          ["doc_id", "n_words", "n_features", "buckets"])

    for rows in batches:
        ids, texts = rows.column("doc_id"), rows.column("text")
        words, grams, found, size, first = [], [], [], 0, 0
        for i in range(len(texts)):
            line = collapse(texts[i].as_py())
            at = (np.array(gram_crcs(line), np.uint32) % buckets).astype("<u2").tobytes()
            words.append(max(line.count(b" ") - 1, 0))
            grams.append(len(at) // 2)
            found.append(at)
            size += len(at)
            if size >= OUT_BYTES:
                yield batch(first, i + 1)
                words, grams, found, size, first = [], [], [], 0, i + 1
        if words:
            yield batch(first, len(texts))


def hashed(docs: DataFrame, doc_id: Column, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the bucket of every n-gram (two bytes each); a null text has none."""
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _hash_rows(b, buckets), f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all rows fall into each bucket. One number per bucket and task is shuffled, one per bucket collected."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket: thousandths of the log ratio of its smoothed shares in the target and in the source, rounded down."""
    size = len(source)
    whole = (float(source.sum()) + size, float(target.sum()) + size)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * whole[0] / ((float(s) + 1) * whole[1]))) for s, t in zip(source, target, strict=True)], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: what the n-grams of a row gain together."""
    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(v.as_buffer(), "<u2")].sum()) for v in batch.column("buckets")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(sums, pa.int64())],
                                             ["doc_id", "n_words", "n_features", "weight"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(total, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id (a null id counts as an empty one)."""
    h = F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, among: Column, percent: int) -> DataFrame:
    """Adds ``rank`` of the drawn rows: of the rows ``among``, so many per hundred (rounded down) with the highest score, ties to the smaller id.

    Rows are put in order by ranges; a count per range gives each its first
    rank, so no task sees more than its range.
    """
    order = [F.col("among").desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("line")]
    rows = rows.withColumns({"among": F.coalesce(among, F.lit(False)), "line": F.monotonically_increasing_id()})
    ranges = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), "sample-ranges")
    sizes = sorted(ranges.groupBy("part").agg(F.count(F.lit(1)), F.count_if("among")).collect())       # a row per range
    before = list(zip([part for part, _, _ in sizes], accumulate([n for _, n, _ in sizes], initial=0)))
    drawn = percent * sum(n for _, _, n in sizes) // 100
    first = ranges.sparkSession.createDataFrame(before, "part int, before long")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("line"))
    return (ranges.join(F.broadcast(first), "part").withColumn("rank", place)
            .withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).drop("among", "line", "part", "before"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 5, seed: str = "42", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rows that are not drawn have no rank.

    Null and empty texts have no words and weigh nothing; repeated rows are
    all scored alike and ranked side by side; with an empty table of documents
    there are no rows, with an empty target all buckets count from one. Other
    columns are not looked at.
    """
    rows = settle(hashed(docs, F.col(doc_id), F.col(text)), "sample-buckets")
    goal = bucket_counts(hashed(target, F.lit(None).cast("long"), F.col(text)))
    scored = weigh(rows, gains(bucket_counts(rows), goal)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
