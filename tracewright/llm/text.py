"""Vectorised work on the bytes of many texts at once.

An Arrow batch holds its texts in one buffer. The helpers cut batches into
pieces of bounded size (one text at least) and find words, word hashes and
n-gram hashes of a whole piece with a few numpy passes, so that no Python loop
runs over words or characters. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20     # text bytes worked on at once; a longer text makes its own piece

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_WEIGHTS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POSITION = np.random.default_rng(7).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def byte_class(inside) -> np.ndarray:
    """Truth table over byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Runs of digits, ASCII letters and everything beyond ASCII.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Runs of anything but a space, tab, line feed, vertical tab, form feed or carriage return.
SOLID = byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and the offsets of their texts."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        texts = batch.column(i)
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        if len(texts) == 0:
            continue
        _, offsets, values = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = int(max(lo + 1, np.searchsorted(offsets, offsets[lo] + limit, "right") - 1))
            part = offsets[lo:hi + 1]
            yield batch.slice(lo, hi - lo), data[part[0]:part[-1]], part - part[0]
            lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (the finaliser of the splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    m = inside[data]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets, "left"))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum())) - np.repeat(first, lens)
    byte = data[within + np.repeat(starts, lens)]
    # the block number of very long words enters too, or blocks could change places
    value = _WEIGHTS[byte] * (_POSITION[within & 4095] + (within >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64))


def gram_hashes(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words within a text, the index of their first word, and how many each text has."""
    n = np.maximum(counts - k + 1, 0)
    if len(hashes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), n
    size = len(hashes) - k + 1
    total = np.full(size, k, np.uint64)
    for j in range(k):
        total += hashes[j:j + size] * _POSITION[j]
    ends = np.cumsum(counts)
    own = np.repeat(ends, counts)          # end of the text of each word
    at = np.arange(size)
    at = at[at + k <= own[:size]]
    return mix(total[at]), at, n


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
