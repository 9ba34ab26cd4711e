"""Byte strings of 50 and more that repeat across documents, by suffix arrays.

Copies of a whole text go by their text alone; one row of each text, that of the
smallest id, is compared with the other texts. Equal windows of ``length`` bytes
have the same smallest k-gram hash at the same place, so every window belongs to
one anchor, and equal windows meet under the hash of their anchors. Anchors of
one text only are dropped. For the others the bytes of their windows (their
context, about 63 bytes) are fetched. The windows of a context are dealt by the
distance of their anchor into bins of eight; the bytes from the first to the last
window of a bin are a part. Equal windows are in the same bin and agree in all
the bytes that the windows of the bin have in common, so parts meet under
those, and the parts of one group are put in one suffix array, in which equal
windows stand side by side. Groups of very many parts are decided window by
window. Anchors and contexts travel packed, many to a row.

Anchors of very many texts are taken out and spread: equal contexts become one,
their parts are dealt over all tasks, and in groups of very many parts each
window is decided by a minimum, so that no task holds such an anchor.

Suffix arrays are built by linear grouping: suffixes are grouped by their
Lyndon prefixes, from the highest group down, along pointers to the previous
smaller group; one pass over the groups then writes the order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import text as tx
from tracewright.session import discard, settle

GRAM = 20                  # bytes of an anchor
BIN = 8                    # distances of an anchor that go together
BATCH = 1 << 14            # bytes of parts sorted together, about
LARGE = 1 << 12            # parts of a group that are sorted together, at most
HOT = 1 << 17              # texts of an anchor that meet in one task, at most
TASK = 50_000              # parts of all groups of a task, about
BUCKETS = 16               # that anchors are dealt into, at least
PACK = 1 << 20             # anchors packed at a time, about
CUT = 1 << 17              # contexts packed, or decided, at a time, about
SHORT = 6                  # bytes of an anchor's hash that travel within its bucket
BLOCK = 1 << 16            # positions hashed at a time, so that they stay in the cache


def suffix_array(s: np.ndarray | bytes) -> list[int]:
    """Order of the suffixes of a byte string (the end sorts before any byte)."""
    s = list(s)
    n = len(s)
    sizes = np.bincount(np.array(s, np.int64), minlength=256) if n else np.zeros(256, int)
    starts = np.cumsum(sizes) - sizes
    head = [int(starts[c]) for c in s]             # start of the group of each suffix
    row = [int(i) for i in np.argsort(np.array(s, np.int64), kind="stable")]
    place = [0] * n
    for i, x in enumerate(row):
        place[x] = i
    tail = {int(a): int(a + m) for a, m in zip(starts, sizes, strict=True) if m}     # end of each group
    before = [-1] * n                              # previous suffix of a smaller group
    top = n
    while top:
        low = head[row[top - 1]]
        children: dict[int, int] = defaultdict(int)
        for x in sorted(row[low:top]):
            j = x - 1
            while j >= 0 and head[j] >= low:
                j = before[j]
            before[x] = j
            if j >= 0:
                children[j] += 1
        times: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, m in children.items():              # a prefix grows by as many copies of this group as follow it
            times[-m, head[p]].append(p)
        for (_, group), grown in sorted(times.items()):
            end = tail[group]
            last = end
            for p in grown:
                last -= 1
                q, at = row[last], place[p]
                row[at], row[last], place[q], place[p] = q, p, at, last
            for p in grown:
                head[p] = last
            tail[group] = last
            tail[last] = end
        top = low
    order, free, placed = [-1] * n, {}, [False] * n

    def chain(j: int) -> None:
        while j >= 0 and not placed[j]:
            placed[j] = True
            at = free.get(head[j], head[j])
            order[at] = j
            free[head[j]] = at + 1
            j = before[j]

    chain(n - 1)
    for i in range(n):
        chain(order[i] - 1)
    return order


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest value in each run of n."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out, width = np.minimum(out[:len(out) - step], out[step:]), width + step
    return out


def _first(values: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the smallest value of the runs that start at ``at`` stands first, counted from there."""
    dist, left, k = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(left):
        here = values[at[left] + k] == least[at[left]]
        dist[left[here]] = k
        left, k = left[~here], k + 1
    return dist


def _gram_hash(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    word = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,))      # the eight bytes at every place
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        x = word[lo:hi] * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x += word[lo + 8:hi + 8]
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        x += word[lo + GRAM - 8:hi + GRAM - 8]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        out[lo:hi] = x
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of a piece: text, hash, first window, number of windows after it, and distance of the k-gram.

    Windows next to each other that have the same k-gram as their first
    smallest one share an anchor. Windows are counted from the start of the piece.
    """
    if len(data) < length:
        return (np.empty(0, np.int64),) * 5
    h = _gram_hash(data)
    least = _least(h, length - GRAM + 1)
    new = least[1:] != least[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(least))]
    new[edges - 1] = True                         # texts do not share anchors
    runs = np.r_[0, np.flatnonzero(new) + 1]
    lasts = np.r_[runs[1:], len(least)] - 1
    dist = _first(h, least, runs)
    over = lasts > runs + dist                    # the value stands there again: each window by itself, joined below
    if over.any():
        sizes = (lasts - runs + 1)[over]
        each = np.repeat(runs[over], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        near = _first(h, least, each)
        owner = each + near
        start = np.r_[True, (owner[1:] != owner[:-1]) | (np.repeat(np.flatnonzero(over), sizes)[1:] != np.repeat(np.flatnonzero(over), sizes)[:-1])]
        ends = np.r_[np.flatnonzero(start)[1:], len(each)] - 1
        runs, lasts, dist = (np.r_[x[~over], y] for x, y in ((runs, each[start]), (lasts, each[ends]), (dist, near[start])))
        order = np.argsort(runs)
        runs, lasts, dist = runs[order], lasts[order], dist[order]
    text = np.searchsorted(offsets, runs, "right") - 1
    lasts = np.minimum(lasts, offsets[text + 1] - length)      # windows end with their text
    whole = lasts >= runs
    return text[whole], h[(runs + dist)[whole]].view(np.int64), runs[whole], (lasts - runs)[whole], dist[whole]


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """Rows of one bucket as one compressed value."""
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(column: pa.ChunkedArray) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in column)


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and spread hash of each anchor."""
    h = tx.mix(h.view(np.uint64))
    return ((h >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64), h


def _short(h: np.ndarray) -> np.ndarray:
    """The first bytes of each hash, in a row."""
    return np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].ravel()


def _long(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, :SHORT] = raw.reshape(-1, SHORT)
    return out.view("<u8").ravel()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _values(sizes: np.ndarray, raw: np.ndarray) -> pa.Array:
    """A binary column from the sizes of its values and their bytes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def _rows(buckets: list[int], packs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packs, pa.binary())], ["bucket", "pack"])


def _scan(length: int, buckets: int):
    """The distinct anchors of each text, packed by bucket: names of the texts, number of anchors of each, short hashes."""
    def flush(name: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        bucket, h = _dealt(h, buckets)
        order = np.lexsort((h, name, bucket))
        bucket, name, h = bucket[order], name[order], h[order]
        one = _heads(bucket, name, h)
        bucket, name, h = bucket[one], name[one], h[one]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        own, packs = [], []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[k], edges[k + 1]
            starts = _heads(name[lo:hi])
            sizes = np.diff(np.r_[starts, hi - lo])
            own.append(k)
            packs.append(_packed({"name": pa.array(name[lo:hi][starts]), "short": _values(sizes * SHORT, _short(h[lo:hi]))}))
        return _rows(own, packs)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hashes, n = [], [], 0
        for batch, data, offsets in tx.pieces(batches, "text"):
            text, h, *_ = anchors(data, offsets, length)
            names.append(batch.column("name").to_numpy()[text])
            hashes.append(h)
            n += len(h)
            if n >= PACK:
                yield flush(np.concatenate(names), np.concatenate(hashes))
                names, hashes, n = [], [], 0
        if n:
            yield flush(np.concatenate(names), np.concatenate(hashes))
    return scan


def _shared(most: int):
    def shared(table: pa.Table) -> pa.Table:
        """For each text its anchors that another text has too: short hashes, those of very many texts apart."""
        met = _unpacked(table.column("pack")).combine_chunks()
        short = met.column("short").combine_chunks()
        h = _long(np.frombuffer(b"".join(short.to_pylist()), np.uint8))
        name = np.repeat(met.column("name").to_numpy(), np.diff(np.frombuffer(short.buffers()[1], np.int32, len(short) + 1, short.offset * 4)) // SHORT)
        order = np.argsort(h, kind="stable")
        h, name = h[order], name[order]
        starts = _heads(h)
        several = np.minimum.reduceat(name, starts) != np.maximum.reduceat(name, starts) if len(h) else np.empty(0, bool)
        sizes = np.diff(np.r_[starts, len(h)])
        hot = np.zeros(len(starts), bool)
        for i in np.flatnonzero(several & (sizes > most)).tolist():     # copies of a text count once
            hot[i] = len(np.unique(name[starts[i]:starts[i] + sizes[i]])) > most
        live, hot = np.repeat(several, sizes), np.repeat(hot, sizes)
        h, name, hot = h[live], name[live], hot[live]
        order = np.lexsort((h, hot, name))
        order = order[_heads(name[order], h[order])]
        h, name, hot = h[order], name[order], hot[order]
        starts = _heads(name)
        found = np.add.reduceat(hot, starts, dtype=np.int64) if len(starts) else starts
        return pa.table({"name": pa.array(name[starts]), "met": _values((np.diff(np.r_[starts, len(h)]) - found) * SHORT, _short(h[~hot])), "hot": _values(found * SHORT, _short(h[hot]))})
    return shared


def _live(batch: pa.RecordBatch, column: str, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which anchors of a piece are in the lists of their texts."""
    lists = batch.column(column).to_pylist()
    met = _long(np.frombuffer(b"".join(x for one in lists for x in one), np.uint8))
    own = np.repeat(np.arange(len(lists)), [sum(map(len, one)) // SHORT for one in lists])
    key = lambda text, h: tx.mix(h + tx.mix(text.astype(np.uint64)))
    return np.isin(key(text, _long(_short(tx.mix(h.view(np.uint64))))), key(own, met))


def _contexts(length: int):
    """The contexts of the anchors of very many texts, one a row."""
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.pieces(batches, "text"):
            text, h, at, more, gram = anchors(data, offsets, length)
            live = _live(batch, "hot", text, h)
            text, h, at, more, gram = (x[live] for x in (text, h, at, more, gram))
            raw = data.tobytes()
            context = [raw[x:x + n] for x, n in zip(at.tolist(), (more + length).tolist(), strict=True)]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array((at - offsets[text]).astype(np.int32)),
                                              pa.array(gram.astype(np.int32)), pa.array(context, pa.binary())], ["anchor", "doc_id", "row", "first", "gram", "context"])
    return cut


def _packed_contexts(length: int, buckets: int):
    """The contexts of all other anchors that another text has too, packed by the bucket of their anchor."""
    def flush(columns: list[tuple]) -> pa.RecordBatch:
        h, row, doc, first, gram, size = (np.concatenate([c[i] for c in columns]) for i in range(6))
        data = np.concatenate([c[6] for c in columns])
        at = np.cumsum(size) - size
        bucket, h = _dealt(h, buckets)
        order = np.lexsort((gram, h, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        own, packs = [], []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            o = order[edges[k]:edges[k + 1]]
            own.append(k)
            packs.append(_packed({"anchor": pa.array(h[o]), "row": pa.array(row[o]), "doc_id": pa.array(doc[o]), "first": pa.array(first[o].astype(np.int32)),
                                  "gram": pa.array(gram[o].astype(np.int32)), "context": _values(size[o], data[_ranges(at[o], size[o])])}))
        return _rows(own, packs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, n = [], 0
        for batch, data, offsets in tx.pieces(batches, "text"):
            text, h, at, more, gram = anchors(data, offsets, length)
            live = _live(batch, "met", text, h)
            text, h, at, more, gram = (x[live] for x in (text, h, at, more, gram))
            row, doc = (batch.column(c).to_numpy()[text] for c in ("row", "doc_id"))
            first, size = at - offsets[text], more + length
            for lo in range(0, len(h), CUT):               # of very long texts too
                columns.append((*(x[lo:lo + CUT] for x in (h, row, doc, first, gram, size)), data[_ranges(at[lo:lo + CUT], size[lo:lo + CUT])]))
                n += len(columns[-1][0])
                if n >= CUT:
                    yield flush(columns)
                    columns, n = [], 0
        if n:
            yield flush(columns)
    return cut


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of runs that start and end anywhere, one run after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
    """Eight bytes each that together hold all bytes of the pieces, which are ``least`` to ``least`` + BIN - 1 bytes long."""
    word = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    return [word[starts + k] for k in range(0, least - 7, 8)] + [word[starts + sizes - 16], word[starts + sizes - 8]]


def _hashed(seed: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    x = seed
    for w in words:
        x = tx.mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
    return x


def _decided(anchor: np.ndarray, doc: np.ndarray, gram: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, length: int, large: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, start and end of the runs of windows that a smaller document has in a context of the same anchor."""
    near = gram - (size - length)                     # distance in the last window
    bins = gram // BIN - near // BIN + 1
    of = np.repeat(np.arange(len(gram)), bins)
    b = near[of] // BIN + np.arange(len(of)) - np.repeat(np.cumsum(bins) - bins, bins)
    low, high = b * BIN, np.minimum(b * BIN + BIN, length - GRAM + 1) - 1
    start = gram[of] - np.minimum(high, gram[of])
    part = gram[of] - np.maximum(low, near[of]) + length - start
    common, width = at[of] + gram[of] - low, length - (high - low)
    group = _hashed(tx.mix(anchor[of] + b.astype(np.uint64)), _words(data, common, width, length - BIN + 1))
    order = np.argsort(group, kind="stable")
    heads = _heads(group[order])
    docs = doc[of[order]]
    shared = np.minimum.reduceat(docs, heads) < np.maximum.reduceat(docs, heads)
    order = order[np.repeat(shared, np.diff(np.r_[heads, len(order)]))]
    if not len(order):
        return (np.empty(0, np.int64),) * 3
    of, start, part, group = of[order], start[order], part[order], group[order]
    words = _words(data, at[of] + start, part, length)
    order = np.lexsort((_hashed(part.astype(np.uint64), words), group))
    of, start, part, group, words = of[order], start[order], part[order], group[order], [w[order] for w in words]
    heads = _heads(group, part, *words)               # equal parts of a group are sorted once
    kind = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(of)]))
    least = np.minimum.reduceat(doc[of], heads)
    n = part[heads] - length + 1
    lows = np.where(np.arange(BIN) < n[:, None], least[:, None], np.iinfo(np.int64).max)      # smallest document of each window of each part
    groups = _heads(group[heads])
    kinds = np.diff(np.r_[groups, len(heads)])
    raw = data.tobytes()
    wait: list[int] = []
    held = 0
    for g in np.flatnonzero(kinds > 1).tolist():
        own = range(int(groups[g]), int(groups[g] + kinds[g]))
        if len(own) > large:
            _sorted_windows(lows, np.array(own), n, data, at[of[heads]] + start[heads], length)
            continue
        wait.extend(own)
        held += int(part[heads[own.start:own.stop]].sum())
        if held >= BATCH:
            _by_suffixes(lows, wait, raw, at[of[heads]] + start[heads], part[heads], least, group[heads], length)
            wait, held = [], 0
    if wait:
        _by_suffixes(lows, wait, raw, at[of[heads]] + start[heads], part[heads], least, group[heads], length)
    gone = np.zeros((len(of), BIN + 2), np.int8)
    gone[:, 1:-1] = lows[kind] < doc[of][:, None]
    turn = np.diff(gone, axis=1)
    i, a = np.nonzero(turn > 0)
    _, e = np.nonzero(turn < 0)
    return of[i], start[i] + a, start[i] + e - 1 + length


def _by_suffixes(lows: np.ndarray, kinds: list[int], raw: bytes, at: np.ndarray, size: np.ndarray, least: np.ndarray, group: np.ndarray, length: int) -> None:
    starts, sizes = at[kinds].tolist(), size[kinds].tolist()
    hits = equal_windows([raw[x:x + n] for x, n in zip(starts, sizes, strict=True)], least[kinds].tolist(), np.unique(group[kinds], return_inverse=True)[1].tolist(), length)
    for c, windows in hits.items():
        for w, low in windows:
            lows[kinds[c], w] = low


def _sorted_windows(lows: np.ndarray, kinds: np.ndarray, n: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> None:
    """What _by_suffixes does, for one group of any size: each window by itself."""
    of, w = np.repeat(kinds, n[kinds]), _ranges(np.zeros(len(kinds), np.int64), n[kinds])
    window = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at[of] + w]).view(f"V{length}").ravel()
    _, same = np.unique(window, return_inverse=True)
    least = np.full(same.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, lows[of, w])
    lows[of, w] = least[same]


def _matched(length: int, large: int):
    def match(table: pa.Table) -> pa.Table:
        """Rows and their byte ranges (start, end, start, end ...) that a smaller document has, for the contexts of a bucket."""
        found = _unpacked(table.column("pack"))
        anchor = found.column("anchor").to_numpy()
        found = found.take(pa.array(np.argsort(anchor, kind="stable")))
        anchor = found.column("anchor").to_numpy()
        edges = np.r_[_heads(anchor), len(anchor)]
        rows, starts, ends = [], [], []
        lo = 0
        while lo < len(anchor):
            hi = int(edges[max(np.searchsorted(edges, lo + CUT, "right") - 1, np.searchsorted(edges, lo, "right"))])      # anchors stay whole
            block = found.slice(lo, hi - lo).combine_chunks()
            context = block.column("context").combine_chunks()
            offsets = np.frombuffer(context.buffers()[1], np.int32, len(context) + 1, context.offset * 4).astype(np.int64)
            data = np.frombuffer(context.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            of, a, e = _decided(block.column("anchor").to_numpy(), block.column("doc_id").to_numpy(), block.column("gram").to_numpy().astype(np.int64), data,
                                offsets[:-1] - offsets[0], np.diff(offsets), length, large)
            first = block.column("first").to_numpy()[of].astype(np.int64)
            rows.append(block.column("row").to_numpy()[of])
            starts.append(first + a)
            ends.append(first + e)
            lo = hi
        row, a, e = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, starts, ends))
        order = np.lexsort((a, row))
        row, a, e = row[order], a[order], e[order]
        if len(row):
            base = np.cumsum(np.r_[False, row[1:] != row[:-1]]) << 32      # ranges of a row that touch become one
            far = np.maximum.accumulate(base + e)
            heads = np.flatnonzero(np.r_[True, (base + a)[1:] > far[:-1]])
            row, a, e = row[heads], a[heads], (far - base)[np.r_[heads[1:], len(far)] - 1]
        heads = _heads(row)
        ranges = np.stack([a, e], 1).astype(np.int32).ravel()
        return pa.table({"row": pa.array(row[heads]), "ranges": tx.lists(2 * np.diff(np.r_[heads, len(row)]), ranges, pa.int32())})
    return match


def _parts(length: int):
    """The windows of each context by bins of the distance of their anchor: what a bin has in common, and its bytes."""
    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, gram = batch.column("context").to_pylist(), batch.column("gram").to_pylist()
            of, bins, common, start, part = [], [], [], [], []
            for i, (c, far) in enumerate(zip(context, gram, strict=True)):
                near = far - (len(c) - length)             # distance in the last window
                for b in range(near // BIN, far // BIN + 1):
                    low, high = b * BIN, min(b * BIN + BIN, length - GRAM + 1) - 1
                    a = far - min(high, far)
                    of.append(i)
                    bins.append(b)
                    common.append(c[far - low:far - high + length])
                    start.append(a)
                    part.append(c[a:far - max(low, near) + length])
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("anchor").take(at), batch.column("low").take(at), pa.array(bins, pa.int32()),
                                              pa.array(common, pa.binary()), pa.array(start, pa.int32()), pa.array(part, pa.binary())], ["id", "anchor", "low", "bin", "common", "start", "part"])
    return deal


def equal_windows(contexts: list[bytes], lows: list[int], groups: list[int], length: int) -> dict[int, list[tuple[int, int]]]:
    """For each context the windows (start, smallest document) that a smaller document has in another context of the group."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([len(c) for c in contexts])
    order = np.array(suffix_array(data))
    of = np.searchsorted(ends, order, "right")
    whole = order + length <= ends[of]
    order, of = order[whole], of[whole]
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if not len(order):
        return out
    rows = np.lib.stride_tricks.sliding_window_view(data, length)[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(1)]
    run = np.cumsum(new) - 1
    low, group = np.array(lows)[of], np.array(groups)[of]
    _, key = np.unique(np.stack([run, group], 1), axis=0, return_inverse=True)
    key = key.ravel()
    least = np.full(key.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, key, low)
    for i in np.flatnonzero(least[key] < low):
        c = int(of[i])
        out[c].append((int(order[i] - (ends[c] - len(contexts[c]))), int(least[key[i]])))
    return out


def _match(length: int):
    def match(table: pa.Table) -> pa.Table:
        """For each context the windows that a smaller document has, as runs with one smallest such document."""
        part, low, name, group, start = (table[c].to_pylist() for c in ("part", "low", "id", "group", "start"))
        found = {"id": [], "start": [], "end": [], "low": []}
        order = sorted(range(len(part)), key=lambda i: group[i])
        lo = 0
        while lo < len(order):
            hi, size = lo, 0
            least: dict[tuple[int, bytes], int] = {}       # equal parts of a group are sorted once
            kinds: dict[int, int] = defaultdict(int)
            while hi < len(order) and (size < BATCH or group[order[hi]] == group[order[hi - 1]]):
                i = order[hi]
                key = group[i], part[i]
                if key not in least:
                    size += len(part[i])
                    kinds[group[i]] += 1
                least[key] = min(least.get(key, low[i]), low[i])
                hi += 1
            several = [k for k in least if kinds[k[0]] > 1]
            hits = equal_windows([p for _, p in several], [least[k] for k in several], [g for g, _ in several], length) if several else {}
            better = {several[c]: dict(windows) for c, windows in hits.items()}
            for i in order[lo:hi]:
                key = group[i], part[i]
                known, own = better.get(key, {}), least[key]
                if not known and own >= low[i]:
                    continue
                a, run = 0, None               # first window of the run, and its document
                for w in range(len(part[i]) - length + 2):
                    at = min(known.get(w, own), own) if w <= len(part[i]) - length else None
                    if at != run:
                        if run is not None and run < low[i]:
                            for c, x in (("id", name[i]), ("start", start[i] + a), ("end", start[i] + w - 1 + length), ("low", run)):
                                found[c].append(x)
                        a, run = w, at
            lo = hi
        return pa.table({"id": pa.array(found["id"], pa.int64()), "start": pa.array(found["start"], pa.int32()), "end": pa.array(found["end"], pa.int32()), "low": pa.array(found["low"], pa.int64())})
    return match


def _by_window(parts: DataFrame, length: int) -> DataFrame:
    """What _match finds, for groups of any size: each window of a part by itself."""
    each = parts.select("id", "low", "start", "part", F.explode(F.sequence(F.lit(0), F.octet_length("part") - length)).alias("w"))
    each = each.select("id", "low", (F.col("start") + F.col("w")).alias("start"), F.expr(f"substring(part, w + 1, {length})").alias("window"))
    least = each.groupBy("window").agg(F.min("low").alias("lo"), F.max("low").alias("hi")).where("lo < hi").select("window", "lo")
    return each.join(least, "window").where("lo < low").select("id", "start", (F.col("start") + length).alias("end"), F.col("lo").alias("low"))


def _hot(rows: DataFrame, live: DataFrame, length: int) -> DataFrame:
    """Rows and their byte ranges that a smaller document has, for the anchors of very many texts."""
    found = settle(rows.join(live.where("size(hot) > 0").select("row", "hot"), "row").mapInArrow(_contexts(length), "anchor long, doc_id long, row long, first int, gram int, context binary")
                   .withColumn("id", F.xxhash64("anchor", "context")), "repeat-contexts")
    contexts = settle(found.groupBy("id", "anchor", "gram", "context").agg(F.min("doc_id").alias("low")), "repeat-kinds")
    dealt = contexts.mapInArrow(_parts(length), "id long, anchor long, low long, bin int, common binary, start int, part binary")
    keyed = dealt.select("id", "low", "start", "part", F.xxhash64("anchor", "bin", "common").alias("group"))
    # dealt twice, as most parts have no equal in another document and need not be written
    many = settle(keyed.groupBy("group").agg(F.min("low").alias("lo"), F.max("low").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("group", "n"), "repeat-groups")
    sizes = many.where(F.col("n") <= LARGE).agg(F.count(F.lit(1)), F.sum("n")).first()
    batches = max(1, sizes[0] // 500, (sizes[1] or 0) // TASK)
    small = keyed.join(many.where(F.col("n") <= LARGE).select("group"), "group").withColumn("batch", F.pmod(F.xxhash64("group"), F.lit(batches)))
    windows = small.groupBy("batch").applyInArrow(_match(length), "id long, start int, end int, low long")
    large = many.where(F.col("n") > LARGE).select("group")
    if not large.isEmpty():
        windows = windows.unionByName(_by_window(keyed.join(large, "group"), length))
    windows = settle(windows.groupBy("id").agg(F.collect_list(F.struct("start", "end", "low")).alias("windows")), "repeat-windows")

    own = found.select("id", "doc_id", "row", "first", F.octet_length("context").alias("size")).join(contexts.select("id", "low"), "id").join(windows, "id", "left")
    whole = F.array(F.col("first"), F.col("first") + F.col("size"))
    some = F.flatten(F.transform(F.filter("windows", lambda w: w["low"] < F.col("doc_id")), lambda w: F.array(F.col("first") + w["start"], F.col("first") + w["end"])))
    ranges = own.select("row", F.when(F.col("low") < F.col("doc_id"), whole).otherwise(some).alias("ranges")).where("size(ranges) > 0")
    ranges = settle(ranges.groupBy("row").agg(F.flatten(F.collect_set("ranges")).alias("ranges")), "repeat-ranges")
    discard(found, contexts, many, windows)
    return ranges


def _cutter():
    import hashlib
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def merged(ranges: list[int] | None) -> list[dict]:
        out: list[dict] = []
        for a, e in sorted(zip(ranges[::2], ranges[1::2], strict=True)) if ranges else []:
            if out and a <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], e)
            else:
                out.append({"start": a, "end": e})
        return out

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in tx.pieces(batches, "text"):
            spans = [merged(x) for x in batch.column("ranges").to_pylist()]
            kept = []
            for a, e, gone in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans, strict=True):
                edges = [0, *[x for s in gone for x in (s["start"], s["end"])], e - a]
                kept.append(b"".join(data[a + x:a + y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()),
                                              pa.array([hashlib.sha256(x).hexdigest() for x in kept])], schema=schema)
    return cut


def remove_repeats(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (byte ranges removed), kept (the rest) and kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes that covers it also starts in
    a document with a smaller id; strings are judged on the input. Ids are
    integers. Null texts are empty. Rows of equal id do not touch each other;
    rows with a null id are neither cut nor cut others. Texts shorter than ``length``
    stay whole. An empty table gives no rows. Texts and anchors are compared by
    64-bit hashes, windows byte by byte.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    name = F.xxhash64(F.md5("text"))
    rows = rows.withColumn("row", F.xxhash64(name, "doc_id"))                 # rows that agree in both share their result
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    long = rows.where((F.col("doc_id").isNotNull()) & (F.octet_length("text") >= length))
    keys = settle(long.select("row", "doc_id", name.alias("name"), F.octet_length("text").alias("size")).distinct(), "repeat-rows")
    texts = keys.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    met = long.select(name.alias("name"), "text").mapInArrow(_scan(length, buckets), "bucket int, pack binary")
    shared = met.groupBy("bucket").applyInArrow(_shared(HOT), "name long, met binary, hot binary")
    shared = shared.groupBy("name").agg(F.collect_list("met").alias("met"), F.filter(F.collect_list("hot"), lambda x: F.octet_length(x) > 0).alias("hot"))
    live = settle(shared.join(texts, "name").select(F.xxhash64("name", "low").alias("row"), "met", "hot"), "repeat-anchors")

    # the texts are dealt by row once, for the contexts and for the cut
    contexts = rows.join(live.select("row", "met"), "row").mapInArrow(_packed_contexts(length, buckets), "bucket int, pack binary")
    ranges = contexts.groupBy("bucket").applyInArrow(_matched(length, LARGE), "row long, ranges array<int>")
    copies = keys.join(texts.where("low < high").select("name", "low"), "name").where("low < doc_id")
    ranges = ranges.unionByName(copies.select("row", F.array(F.lit(0), "size").alias("ranges")))
    if not live.where("size(hot) > 0").isEmpty():
        ranges = ranges.unionByName(_hot(rows, live, length))
    ranges = ranges.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return (rows.join(ranges, "row", "left").select("doc_id", "text", "ranges")
            .mapInArrow(_cutter(), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"))
