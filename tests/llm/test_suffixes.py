import random
from collections import Counter

from tests.llm.test_operators import repeats, repeats_by_hand
from tracewright.llm import suffixes


def test_many_different_parts_around_one_anchor(spark, monkeypatch):
    """A fixed passage with other bytes before and after it in each document: no task sorts the whole group, and the result is the same."""
    rng = random.Random(17)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(47))
    rows = [(i % 280, f"{rng.randint(0, 99):02d}{passage}{rng.randint(0, 9999):04d}" + "".join(rng.choice("klmn") for _ in range(rng.randint(0, 40)))) for i in range(300)]
    matched = suffixes._match

    def watched(length):
        match = matched(length)

        def watch(parts):
            assert max(Counter(parts["group"].to_pylist()).values()) <= 100
            return match(parts)
        return watch

    monkeypatch.setattr(suffixes, "LARGE", 100, raising=False)
    monkeypatch.setattr(suffixes, "_match", watched)
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == repeats_by_hand(rows)


def test_windows_by_themselves(spark, monkeypatch):
    """Both ways of deciding a group give the same spans."""
    rng = random.Random(18)
    source = "".join(rng.choice("abcdefgh") for _ in range(200)) + "ab" * 60 + "z" * 90
    rows = []
    for _ in range(50):
        text = "".join(source[(a := rng.randrange(len(source))):a + rng.randint(20, 160)] + rng.choice("KLM") for _ in range(3))
        rows.append((rng.randrange(40), text))
    monkeypatch.setattr(suffixes, "LARGE", 0)
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == repeats_by_hand(rows)


def passages(seed, n):
    """Texts of pieces of one source, some of them copies, with null and repeated ids."""
    rng = random.Random(seed)
    source = "".join(rng.choice("abcdefgh é") for _ in range(300)) + "ab" * 60 + "z" * 90
    rows = []
    for i in range(n):
        text = "".join(source[(a := rng.randrange(len(source))):a + rng.randint(20, 160)] + rng.choice("KLM") for _ in range(3))
        rows.append((rng.randrange(2 * n // 3), rows[-1][1] if i % 5 == 4 else text))
    return rows


def test_parts_window_by_window_in_their_task(spark, monkeypatch):
    rows = passages(19, 60)
    monkeypatch.setattr(suffixes, "LARGE", 1)
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == repeats_by_hand(rows)


def test_anchors_of_many_texts(spark, monkeypatch):
    """All anchors are spread, or those of more than eight texts only."""
    rows = passages(20, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in 0, 8:
        monkeypatch.setattr(suffixes, "HOT", most)
        assert repeats(docs) == repeats_by_hand(rows)


def test_copies_of_texts(spark):
    """Copies go whole by their text; short ones stay; null ids neither cut nor are cut."""
    long, short = "one and the same text, long enough to hold a window of fifty bytes", "too short"
    rows = [(7, long), (3, long), (3, long), (9, long + " and more"), (1, short), (2, short), (5, None), (6, "")]
    docs = spark.createDataFrame(rows + [(None, long), (None, "x" + long)], "doc_id long, text string")
    cut = suffixes.remove_repeats(docs)
    assert repeats(cut.sparkSession.createDataFrame(rows, "doc_id long, text string")) == repeats_by_hand(rows)
    found = cut.collect()
    assert all(not r["spans"] for r in found if r["doc_id"] is None or r["doc_id"] == 3) and len(found) == 10
    assert [(s["start"], s["end"]) for r in found if r["doc_id"] == 9 for s in r["spans"]] == [(0, len(long))]


def test_small_packs(spark, monkeypatch):
    """Anchors and contexts of a text may be in many packs, and a bucket in many blocks."""
    rows = passages(22, 60)
    for most in 1, 7:
        monkeypatch.setattr(suffixes, "PACK", most)
        monkeypatch.setattr(suffixes, "CUT", most)
        assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == repeats_by_hand(rows)


def test_what_travels(spark, capsys):
    """Texts are dealt once for the contexts and the cut, and anchors and contexts as packed rows, so that little is written."""
    rng = random.Random(21)
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(300))) for i in range(200)]
    rows += [(1000 + i, rows[i][1][:200] + str(i)) for i in range(50)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == repeats_by_hand(rows)
        cut.collect()
        cut.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "ReusedExchange" in capsys.readouterr().out
