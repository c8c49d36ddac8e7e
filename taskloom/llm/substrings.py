"""Repeated byte strings by a suffix sort that compares hashes."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import text_batches, texts
from taskloom.llm.repeats import NULL_ID, PrefixHashes, covered, documents, mixed, repeated_spans, with_spans

WINDOW = 100
GRAM = 32

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_symbols(text: str) -> np.ndarray:
    return _BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]


def byte_body(text: str):
    data = text.encode("utf-8", "surrogatepass")
    return lambda start, stop: data[start:stop]


def window_digests(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = [xxhash.xxh3_128_intdigest(data[i : i + len(data) - size + 1]) for i in range(size)]
    mask = (1 << 64) - 1
    return np.array([x >> 64 for x in both], dtype=np.uint64), np.array([x & mask for x in both], dtype=np.uint64)


class SuffixSort:
    """Sorts suffixes of one byte array by group and their first ``window`` bytes.

    Two suffixes are compared by a binary search for their common extension, with prefix
    hashes telling whether the halves are equal, and the byte after it. All merges of a
    mergesort level run together: each suffix finds its place in the neighbouring run.
    """

    def __init__(self, data: np.ndarray, position: np.ndarray, group: np.ndarray, window: int):
        self.data, self.position, self.group, self.window = data, position, group, window
        self.hashes = PrefixHashes(_BYTES[data])
        self.whole = self.hashes.of(position, window)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes agree in all of the window."""
        return self.whole[a] == self.whole[b]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of pairs of positions, at most ``window``."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.window, dtype=np.int64)
        for _ in range(self.window.bit_length()):
            mid = (low + high + 1) >> 1
            equal = self.hashes.of(a, mid) == self.hashes.of(b, mid)
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; ``tie`` where they are equal."""
        out = tie.copy()
        differ = np.flatnonzero(~self.same(a, b))
        a, b = self.position[a[differ]], self.position[b[differ]]
        at = np.minimum(self.extension(a, b), self.window - 1)
        out[differ] = self.data[a + at] < self.data[b + at]
        return out

    def order(self) -> np.ndarray:
        """Suffix numbers in sorted order; equal ones keep their order."""
        lead = np.zeros(len(self.position), dtype=np.uint64)
        for i in range(8):
            lead = lead << np.uint64(8) | self.data[self.position + i].astype(np.uint64)
        # groups and first bytes are sorted at once; the mergesort works on what they leave equal
        order = np.lexsort((np.arange(len(lead)), lead, self.group))
        g, h = self.group[order], lead[order]
        block = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
        size = np.diff(np.concatenate([block, [len(order)]]))
        width = 1
        while (size > width).any():
            busy = np.repeat(size > width, size)
            base, n = np.repeat(block, size)[busy], np.repeat(size, size)[busy]
            slot = np.flatnonzero(busy) - base
            run = slot // width
            other = (run ^ 1) * width
            low = np.minimum(other, n)
            high, first = np.minimum(other + width, n), low.copy()
            mine, left = order[base + slot], run % 2 == 0
            open_ = np.flatnonzero(low < high)
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                theirs = order[base[open_] + mid]
                # of equal suffixes those of the left run come first
                goes = self.before(theirs, mine[open_], ~left[open_])
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            place = (run // 2) * 2 * width + slot % width + (low - first)
            merged = order.copy()
            merged[base + place] = mine
            order = merged
            width *= 2
        return order


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    out = np.ones(len(a), dtype=bool)
    for k in range(0, len(a), 20_000):
        i, j = a[k : k + 20_000, None] + np.arange(window), b[k : k + 20_000, None] + np.arange(window)
        out[k : k + 20_000] = (data[i] == data[j]).all(axis=1)
    return out


def repeated_windows(groups: list, window: int = WINDOW) -> list[tuple]:
    """(id, twin, start, size) of the windows of the groups' contexts that stand in an earlier place
    of their group. Every pair that the hashes call equal is compared byte by byte; if one is
    not, the classes are made anew from the bytes themselves."""
    rows = [row for group in groups for row in group]
    if not rows:
        return []
    data = np.frombuffer(b"".join(r[4] for r in rows) + bytes(8), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r[4]) for r in rows])[:-1]])
    size = np.array([r[3] for r in rows], dtype=np.int64)
    context = np.repeat(np.arange(len(rows)), size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    position = begin[context] + offset
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[context]
    ids = np.array([r[0] for r in rows], dtype=np.int64)[context]
    twins = np.array([r[1] for r in rows], dtype=np.int64)[context]
    start = np.array([r[2] for r in rows], dtype=np.int64)[context] + offset
    sort = SuffixSort(data, position, group, window)
    order = sort.order()
    a, b = position[order[:-1]], position[order[1:]]
    same = (group[order[1:]] == group[order[:-1]]) & sort.same(order[:-1], order[1:])
    if not _equal_bytes(data, a[same], b[same], window).all():
        content = data.tobytes()
        key = [(g, content[p : p + window]) for g, p in zip(group.tolist(), position.tolist())]
        order = np.array(sorted(range(len(key)), key=key.__getitem__))
        same = np.array([key[i] == key[j] for i, j in zip(order[:-1], order[1:])], dtype=bool)
    cls = np.concatenate([[0], np.cumsum(~same)])
    # within a class the place in the corpus decides
    order = order[np.lexsort((start[order], twins[order], ids[order], cls))]
    first = order[np.searchsorted(cls, cls)]
    later = (ids[order] != ids[first]) | (twins[order] != twins[first]) | (start[order] != start[first])
    found = np.sort(order[later])
    if not len(found):
        return []
    cut = np.concatenate([[True], (np.diff(found) != 1) | (context[found[1:]] != context[found[:-1]])])
    head = np.flatnonzero(cut)
    runs = np.diff(np.concatenate([head, [len(found)]]))
    at = found[head]
    return list(zip(ids[at].tolist(), twins[at].tolist(), start[at].tolist(), runs.tolist()))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, spans)`` of every row of ``docs (doc_id, text)``.

    Texts are UTF-8 bytes. A byte goes if a string of ``window`` bytes covers it that also starts
    earlier: in a document with a smaller id, or before it in the same. Strings are judged on
    the input and never reach over two documents. ``spans`` are the maximal removed runs, ``kept``
    the other bytes (a removed run may part a character, so these are no string).

    Null and empty texts have no bytes. A null ``doc_id`` is smaller than all others. Rows that
    share their id are ordered by a hash of the text; equal rows are one document and each gets its
    result. An empty table gives no rows; other columns are not read. Extra options: ``anchor_texts``.
    """
    own = documents(docs)

    def compare(groups):
        return repeated_windows(groups, window)

    spans = repeated_spans(own, byte_symbols, byte_body, compare, window_digests, window, gram, True, **options)

    def run(batches):
        for batch in text_batches(batches):
            rows = []
            for i, text, found in zip(batch.column(0).to_pylist(), texts(batch), batch.column(3).to_pylist()):
                data, gone = text.encode("utf-8", "surrogatepass"), covered(found, window)
                ends = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
                marks = [{"start": a, "end": b} for a, b in gone]
                rows.append((None if i == NULL_ID else i, len(data), len(data) - len(kept), len(gone), kept, marks))
            long = pa.int64()
            kinds = [long, long, long, long, pa.binary(), pa.list_(pa.struct([("start", long), ("end", long)]))]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return with_spans(own, spans, "left").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


