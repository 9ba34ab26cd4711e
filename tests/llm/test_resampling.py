import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tracewright.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def by_hand(docs, target, percent=5):
    found = [(i, *grams(t)) for i, t in docs]
    source, goal = Counter(b for _, _, g in found for b in g), Counter(b for t in target for b in grams(t)[1])
    n, m = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (n + 10000) / ((source[b] + 1) * (m + 10000)))) for b in range(10000)]
    rows = []
    for i, words, g in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def key(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(21)
    words = ["Tram", "rail", "depot", "signal", "coach", "Δρόμος", "straße", "42", "é"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ",", "--", "\n\t", "\x00"]) for _ in range(rng.randint(0, 120))) for _ in range(160)]
    texts += [None, "", " ,;. ", "ÄÖÜ İ ſ K", "word", "two words", "a b c", "y" * 40_000, "a " * 20_000, "[brackets]_under`tick{x}~"]
    return [*enumerate(texts), (5, texts[9]), (5, texts[9]), (None, texts[10]), (None, None), (-3, texts[11])]


def test_equals_plain_version(spark, docs, tmp_path):
    target = ["tram depot signal coach rail", None, "", "Tram rail depot " * 30]
    spark.createDataFrame([(i, t, "clash", 7) for i, t in docs], "doc_id long, text string, rank string, weight int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op12_resampling(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert key(map(tuple, out.collect())) == key(by_hand(docs, target))


def test_many_draws_over_small_ranges(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = resampling.resample(frame, frame.where("doc_id < 20"), percent=60)
    assert key(map(tuple, out.collect())) == key(by_hand(docs, [t for i, t in docs if i is not None and i < 20], 60))


def test_empty_tables(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    none = frame.limit(0)
    assert resampling.resample(none, frame).collect() == [] and resampling.resample(none, none).collect() == []
    assert key(map(tuple, resampling.resample(frame, none).collect())) == key(by_hand(docs, []))


def test_overlapping_matches_emit_every_gram():
    line = resampling.collapse("One two, THREE four")
    assert line == b" one two three four "
    want = ["one", "one two", "one two three", "two", "two three", "two three four", "three", "three four", "four"]
    assert resampling.gram_crcs(line) == [zlib.crc32(g.encode()) for g in want]
    assert resampling.collapse(" -- ") == b"" and resampling.gram_crcs(b"") == []


def test_sample_leans_to_the_target(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["lathe", "drill", "chuck"] if i % 4 == 0 else ["sonnet", "stanza", "rhyme"]) for _ in range(40))) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "lathe drill chuck " * 20)], "item_id long, text string")
    drawn = [r["doc_id"] for r in resampling.resample(frame, target).where("rank is not null").collect()]
    assert len(drawn) == 20 and all(i % 4 == 0 for i in drawn)
