"""Alignment of the tokens of two tokenizers over the same bytes.

Both tokenizers cut a text; the running totals of their token bytes are the
places where tokens end. A dictionary from each end to the index of its token
on either side, and the common keys of both in order, cut the two id lists into
groups; inside a group every pair of tokens whose bytes overlap is a link.

How often two ids are linked in the whole collection is counted over blocks of
documents: a block names each of its id pairs once, with its number of links.
The sums are joined back to the blocks by pair, gathered per block, and looked
up by the links of the block's documents. Only a block's distinct pairs travel,
never a row per link.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import settle

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
CALL_BYTES = 1 << 18       # text bytes that one call of a tokenizer takes; a longer text makes its own call
BLOCK_BYTES = 4 << 20      # text bytes of a block; a longer text makes its own block
SHIFT = 32                 # an id pair is one whole number: id of A, then id of B

# The pattern that splits a text before the merges of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tokens:
    """Bytes of all tokens, side by side."""

    def _keep(self, spelled: dict[int, bytes]) -> None:
        table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.lengths = np.array([len(t) for t in table])
        self._flat, self._first = np.frombuffer(b"".join(table), np.uint8), np.cumsum(self.lengths) - self.lengths

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of a list of tokens, given where each ends."""
        n = self.lengths[ids]
        return self._flat[np.arange(n.sum()) + np.repeat(self._first[ids] - ends + n, n)].tobytes()


class ByteTokens(_Tokens):
    """A byte-level vocabulary from its JSON file; text that looks like a special token is plain text.

    Where ids follow the order of the merges, and the file splits texts in the
    usual way, the ids double as merge ranks and a faster encoder gives the same
    tokens; in any other case the file's own encoder is used.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        spelled = {i: bytes(letters[c] for c in t) if i not in special and all(c in letters for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
        self._keep(spelled)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
        ranked = ([vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                  and pre.get("use_regex", True) and not spec.get("normalizer") and sorted(vocab.get(c, -1) for c in letters) == list(range(256)))
        if ranked:
            import tiktoken
            own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in spelled.items() if i not in special}, special_tokens={})
            self.encode = lambda texts: [own.encode_to_numpy(t, disallowed_special=()) for t in texts]
        else:
            import tokenizers
            own = tokenizers.Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class PieceTokens(_Tokens):
    """A vocabulary of pieces with bytes to fall back on; it puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self._keep({i: bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i in range(own.get_piece_size()) for p in [own.id_to_piece(i)]})
        self.encode = lambda texts: own.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def _tokens(kind: type, path: str):
    return kind(path)


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Where groups begin and end in both lists, from the ends of their tokens."""
    at_a, at_b = dict(zip(ends_a, range(1, len(ends_a) + 1))), dict(zip(ends_b, range(1, len(ends_b) + 1)))
    shared = list(map(at_b.get, at_a))          # ends ascend, so the common ones come in order; None where B goes on
    return [0, *compress(at_a.values(), shared)], [0, *filter(None, shared)]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of both tokens of every link, group by group.

    The ends of both sides cut the bytes of a group into pieces; two tokens that
    overlap share exactly one of them.
    """
    ends = np.concatenate([ends_a, ends_b])
    ends.sort()
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def written(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, names: list[str]) -> str:
    """The groups as text: ids of A, then of B. ``names`` has each id followed by a comma, a bar and a semicolon in turn."""
    group_a, group_b = np.repeat(np.arange(len(cut_a) - 1), np.diff(cut_a)), np.repeat(np.arange(len(cut_b) - 1), np.diff(cut_b))
    codes = np.empty(len(a) + len(b), np.int64)
    mark_a, mark_b = 3 * a, 3 * b
    mark_a[cut_a[1:] - 1] += 1
    mark_b[cut_b[1:] - 1] += 2
    codes[np.arange(len(a)) + cut_b[group_a]] = mark_a          # before a token of A stand the tokens of B of earlier groups
    codes[np.arange(len(b)) + cut_a[group_b + 1]] = mark_b      # before a token of B also those of A of its own group
    return "".join(map(names.__getitem__, codes.tolist()))[:-1]


class _Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = _tokens(ByteTokens, path_a), _tokens(PieceTokens, path_b)
        self.names = [f"{i}{mark}" for i in range(max(len(self.a.lengths), len(self.b.lengths))) for mark in ",|;"]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, the groups as text, and the id pair of each link."""
        spaced = [" " + t for t in texts]
        for text, a, b in zip(spaced, self.a.encode(spaced), self.b.encode(texts), strict=True):
            whole, ids_a, ids_b = text.encode(), np.asarray(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(self.a.lengths[ids_a]), np.cumsum(self.b.lengths[ids_b])
            if len(whole) == 1 or self.a.spell(ids_a, ends_a) != whole or self.b.spell(ids_b, ends_b) != whole:
                yield 0, 0, 0, "", np.empty(0, np.int64)
                continue
            cut_a, cut_b = map(np.array, cuts(ends_a.tolist(), ends_b.tolist()))
            left, right = links(ends_a, ends_b)
            yield len(ids_a), len(ids_b), len(cut_a) - 1, written(ids_a, ids_b, cut_a, cut_b, self.names), ids_a[left] << SHIFT | ids_b[right]


NUMBERS = ("n_a", "n_b", "n_groups")


def _align_rows(batches: Iterable[pa.RecordBatch], path_a: str, path_b: str, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    """Rows of documents, their links as places in the list of distinct pairs that the first row of their block carries."""
    from pyspark import TaskContext
    aligner, part, blocks = _Aligner(path_a, path_b), TaskContext.get().partitionId(), 0

    def block(ids: list[pa.Array], found: list) -> pa.RecordBatch:
        every = np.concatenate([f[4] for f in found])
        pairs, at, n = np.unique(every, return_inverse=True, return_counts=True)
        cuts = np.cumsum([0] + [len(f[4]) for f in found])
        at = at.astype("<i4")
        blank = [None] * (len(found) - 1)
        columns = {"doc_id": pa.concat_arrays(ids), "block": pa.array([part << SHIFT | blocks] * len(found), pa.int64()), **{c: pa.array([f[k] for f in found], pa.int64()) for k, c in enumerate(NUMBERS)},
                   "groups": pa.array([f[3] for f in found], pa.string()),
                   "links": pa.array([at[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
                   "pairs": pa.array([pairs.tolist(), *blank], pa.list_(pa.int64())), "times": pa.array([n.tolist(), *blank], pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict(columns)

    ids, found, size = [], [], 0
    for batch in batches:
        texts = batch.column("text")
        lo = 0
        while lo < len(texts):
            call, some, hi = [], 0, lo
            while hi < len(texts) and (not call or some < CALL_BYTES):
                call.append(texts[hi].as_py() or "")
                some += len(call[-1])
                hi += 1
            found += [(a, b, g, shown if keep_groups or not a else hashlib.sha256(shown.encode()).hexdigest(), pairs) for a, b, g, shown, pairs in aligner.texts(call)]
            ids.append(batch.column("doc_id").slice(lo, hi - lo))
            lo, size = hi, size + some
            if size >= BLOCK_BYTES:
                yield block(ids, found)
                ids, found, size, blocks = [], [], 0, blocks + 1
    if found:
        yield block(ids, found)


def aligned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, keep_groups: bool = True) -> DataFrame:
    """Written rows doc_id, block, n_a, n_b, n_groups, groups, links, pairs, times; see ``with_counts`` for what a reader needs of them."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, block long, n_a long, n_b long, n_groups long, groups string, links binary, pairs array<long>, times array<long>"
    return settle(rows.mapInArrow(lambda b: _align_rows(b, path_a, path_b, keep_groups), schema), "token-links")


def pair_counts(rows: DataFrame) -> DataFrame:
    """block, at, pair, count, best: each pair that a block names, how many links of all rows hold it, and whether no other pair of its B id holds more.

    A pair comes once per block, so even the most frequent one has no more rows
    than there are blocks. The best count of each B id is one row per entry of
    the vocabulary.
    """
    named = rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "p"))
    named = named.select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counted = (named.withColumn("count", F.sum("n").over(Window.partitionBy("pair"))).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1)).drop("n"))
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(F.broadcast(most), "b").select("block", "at", "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of ``aligned``."""
    def look_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = pairs.column("at").to_numpy()
        count[at], best[at] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        links = [np.frombuffer(v.as_buffer(), "<i4") for v in docs.column("links")]
        sums = {"n_links": [len(x) for x in links], "n_best": [int(best[x].sum()) for x in links], "count_sum": [int(count[x].sum()) for x in links]}
        return pa.table({c: docs.column(c) for c in kept} | {c: pa.array(v, pa.int64()) for c, v in sums.items()})

    kept = ["doc_id", *NUMBERS, "groups"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, n_links long, n_best long, count_sum long"
    counts = pair_counts(rows).select(F.col("block").alias("of_block"), "at", "count", "best")
    return rows.select("block", "links", *kept).groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(look_up, schema)


def translation_table(rows: DataFrame) -> DataFrame:
    """a, b, count, best: how often each id of A is linked to each id of B in the whole collection."""
    pair = F.col("pair")
    return (pair_counts(rows).select("pair", "count", "best").distinct()
            .select(F.shiftright(pair, SHIFT).alias("a"), pair.bitwiseAND((1 << SHIFT) - 1).alias("b"), "count", "best"))


def align_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str = BYTE_BPE, path_b: str = PIECE_BPE, keep_groups: bool = True) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, groups, n_links, n_best, count_sum.

    ``groups`` lists the ids of A and B, ``a1,a2|b1;a3|b2,b3``, or is the
    SHA-256 of that list in hexadecimal if ``keep_groups`` is false. A null or
    empty text, and one that the tokens of A or B do not spell byte by byte, has
    no tokens: zeros and an empty string. Repeated rows, null ids and very long
    texts are rows like all others; an empty table gives no rows. Other columns
    are not looked at. The vocabulary files must lie at the same path on all
    executors.
    """
    return with_counts(aligned(docs, doc_id, text, path_a, path_b, keep_groups))
