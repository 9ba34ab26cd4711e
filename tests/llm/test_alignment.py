import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from tracewright.llm import alignment, queries


@pytest.fixture(scope="module")
def encoders():
    a = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def ranges(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def cut(text, encoders):
    """Ids with byte ranges on both sides; nothing where the tokens do not spell the text."""
    a, b = encoders
    letters = alignment._byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in (b.encode(text) if text else []) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode() if text else b""
    if b"".join(r for _, r in left) != whole or b"".join(r for _, r in right) != whole:
        return [], []
    return ranges(left), ranges(right)


def by_hand(docs, encoders):
    rows, counts = [], Counter()
    for i, text in docs:
        left, right = cut(text or "", encoders)
        links = [(x, y) for x, s, e in left for y, u, v in right if s < v and u < e]
        counts.update(links)
        both = sorted({e for *_, e in left} & {e for *_, e in right})
        groups = [",".join(str(x) for x, _, e in left if lo < e <= hi) + "|" + ",".join(str(y) for y, _, e in right if lo < e <= hi) for lo, hi in zip([0, *both], both)]
        rows.append((i, len(left), len(right), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(i, a, b, len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), ";".join(g)) for i, a, b, g, links in rows]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(31)
    odd = ["<|endoftext|> is plain text", "<s>tags</s> <unk>", "tabs\tand\n\n  runs   of space ", "naïve Ærøskøbing 東京 สวัสดี 😀👩‍👩‍👧", "▁under", "zero\x00byte", "", None, " ", "a", "don't we'll I'M",
           "1234567890" * 30, "q" * 5000, "é" * 700, "é   x", "".join(chr(rng.randint(32, 0x2FFF)) for _ in range(400))]
    texts = odd + [" ".join(rng.choice(["antidisestablishment", "keyboard", "the", "Schloss", "rivière", "x9-7"]) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    return [*enumerate(texts), (4, texts[20]), (4, texts[20]), (None, texts[21]), (None, None)]


def same(have, want):
    return sorted(have, key=str) == sorted(want, key=str)


def test_equals_plain_version(spark, docs, encoders, monkeypatch):
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, groups string, block int").repartition(3)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = by_hand(docs, encoders)
    assert same(map(tuple, alignment.align_documents(frame).select(*columns).collect()), want)
    for size in (1, 2000):                 # many blocks and calls
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        monkeypatch.setattr(alignment, "CALL_BYTES", size)
        assert same(map(tuple, alignment.align_documents(frame).select(*columns).collect()), want)


def test_query(spark, docs, encoders, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in queries.op13_alignment(spark, str(tmp_path)).collect()]
    assert same(rows, [(*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[1] else "") for w in by_hand(docs, encoders)])


def test_translation_table(spark, docs, encoders):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.translation_table(alignment.aligned(frame)).collect()}
    counts = Counter()
    for _, text in docs:
        left, right = cut(text or "", encoders)
        counts.update((x, y) for x, s, e in left for y, u, v in right if s < v and u < e)
    assert {p: n for p, (n, _) in found.items()} == dict(counts)
    assert all(best == (n == max(m for (_, b), (m, _) in found.items() if b == p[1])) for p, (n, best) in list(found.items())[:200])


def test_empty(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nothing = alignment.align_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert all(r["n_a"] == r["n_b"] == r["n_groups"] == r["n_links"] == r["n_best"] == r["count_sum"] == 0 and r["groups"] == "" for r in nothing) and len(nothing) == 2


def test_fast_encoder_is_the_file_itself(encoders):
    """The ranks read from the file give the ids of the file's own encoder."""
    rng = random.Random(5)
    own = alignment.ByteTokens(alignment.BYTE_BPE)
    ranges_ = [(32, 126), (0xA0, 0x24F), (0x370, 0x5FF), (0x900, 0xDFF), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0x2000, 0x206F), (0x1F600, 0x1F64F)]
    texts = ["".join(chr(rng.randint(*rng.choice(ranges_))) if rng.random() < 0.8 else rng.choice(" \n\t'") for _ in range(80)) for _ in range(400)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in encoders[0].encode_batch(texts, add_special_tokens=False)]
