import bisect
import hashlib
import random

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import fingerprints as fp
from tracewright.llm import queries

WORDS = "heron marsh reed lagoon otter willow delta pier gull tide ferry dune".split()
SYMBOL = regex.compile(r"[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]{1,8}|\S", regex.V1)


def hash64(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain(text, k=3, depth=2, orders=64):
    """Orders walked one by one over a list of (hash, place)."""
    if not text:
        return []
    symbols = [hash64(s.encode()) for s in SYMBOL.findall(text) or [text]]
    grams = [hash64(*symbols[i:i + k]) for i in range(max(len(symbols) - k + 1, 1))]
    seen, circle = {}, []
    for place, g in enumerate(grams, 1):
        number = seen[g >> 31] = seen.get(g >> 31, -1) + 1
        circle.append((hash64(g >> 31, number.to_bytes(4, "little")) >> 31 << 31) + place)
    circle.sort()
    out = []
    for j in range(orders):
        first = bisect.bisect_left(circle, j * ((1 << 64) // orders) - (1 << 63))
        places = sorted(circle[(first + d) % len(circle)] & ((1 << 31) - 1) for d in range(min(depth, len(circle))))
        out.append(hash64(*[grams[p - 1] for p in places]) & 65535)
    return out


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return ["", None, "a", "   ", "one two", "one two three", "same line again\n" * 60, "漢字かな交じり文 ok", "x" * 50_000, "é😀ß!" * 30, *[prose(rng, rng.randint(1, 200)) for _ in range(15)]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[12], None, None), (None, None, None, None), (3, texts[12], "x", 2), (3, texts[12], "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, __order int").repartition(3).cache()


def test_entries_equal_plain_version(docs):
    rows = fp.with_fingerprint(docs.select("text"), "text", "found").collect()
    assert all(r["found"] == plain(r["text"]) for r in rows)


def test_followers_and_edits(spark, docs):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    for blocks in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", blocks)
        rows = fp.with_edited(docs).collect()
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert len(rows) == docs.count()
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
        assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())
        unique = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 3)}
        for i, r in unique.items():
            if i + 1 in unique:
                n = len(r["text"]) // 4
                assert r["next"]["text"] == unique[i + 1]["text"]
                assert r["edited"] == r["text"][:len(r["text"]) - n] + unique[i + 1]["text"][:n]
            assert r["edited_fingerprint"] == plain(r["edited"]) and r["fingerprint"] == plain(r["text"])
        # every row follows exactly one other, also where ids repeat or are null
        assert sorted(r["next"]["text"] for r in rows) == sorted(r["text"] for r in rows)
        nulls = [r for r in rows if r["doc_id"] is None]
        assert sum(r["next"]["text"] == unique[0]["text"] for r in nulls) >= 1


def test_alone_and_empty(spark):
    one = fp.with_edited(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["next"]["text"] == "abcdefgh" and one[0]["edited"] == "abcdefab"
    assert fp.with_edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_order_counts(spark):
    """A text turned inside out keeps its words and loses its order."""
    words = prose(random.Random(4), 300).split()
    texts = [" ".join(words), " ".join(words[150:] + words[:150]), " ".join(words[:-30]), " ".join(reversed(words))]
    marks = [r["found"] for r in fp.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "found").orderBy("i").collect()]
    near = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / 64
    assert near(marks[0], marks[2]) > 0.65 > 0.62 > near(marks[0], marks[1]) > near(marks[0], marks[3]) == 0


def test_query_columns(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert len(r["edited_sha256"]) == 64 and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert len(r["fingerprint"]) in (0, 256)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == "" and by[0]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and by[0]["near_edited"] == 1.0
    assert by[12]["fingerprint"] == "".join(f"{x:04x}" for x in plain(docs.where("doc_id = 12").first()["text"]))
    assert dict(docs.limit(0).select(fp.written(F.array(F.lit(1)))).dtypes)
