"""Benchmark passages in documents: q-gram lemma filter and banded alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import in_batches, own_columns, texts, worker_cache

Q = 12
#: Edits allowed for each character of a passage.
EDIT_RATE = 0.05
#: Passages with fewer characters, after normalisation, are no evidence and not searched.
MIN_CHARS = 24
#: Bytes of passages that are searched for at once; more passages take more passes.
BLOCK_BYTES = 4_000_000
#: Shared q-grams that are counted at once; their number is bounded by memory, not by the texts.
PART_HITS = 1_000_000
_FILTER_BITS = 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


def _lower_table() -> np.ndarray:
    """For each code point its lower-case one, a space where it is no letter or digit."""
    out = np.full(0x110000, _SPACE, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def normalise(given: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, each run of other characters as one space, a zero
    after each text; the position of each in its own text; where each text begins."""
    table = worker_cache("lower table", _lower_table)
    joined = np.frombuffer("\0".join([*given, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, given), dtype=np.int64, count=len(given))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    ends = begins[1:] - 1
    codes = table[joined]
    keep = codes != _SPACE
    keep[1:] |= keep[:-1].copy()
    keep[ends] = True
    codes = codes.copy()
    codes[ends] = 0
    kept = np.flatnonzero(keep)
    starts = np.searchsorted(kept, begins)
    text = np.searchsorted(begins, kept, side="right") - 1
    return codes[kept], kept - begins[text], starts


def qgram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A polynomial hash of each q-gram, built from those of half its length."""
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    h, size, power = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), 1, _BASE
    out, done = None, 0
    while True:
        if q & size:
            out, done = (h, size) if out is None else (h[: len(out) - size] * _factor(done) + out[size:], done + size)
        if done == q:
            return out[: len(codes) - q + 1]
        h = h[:-size] * power + h[size:]
        size, power = 2 * size, _factor(2 * size)


def _factor(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


@dataclass
class PassageIndex:
    """Passages as code points, and their q-grams sorted by hash."""

    items: list[int]
    passages: list[np.ndarray]
    budgets: np.ndarray
    hashes: np.ndarray
    passage: np.ndarray
    offset: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, rate: float) -> "PassageIndex":
        items, passages, seen = [], [], {}
        for item, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            codes = normalise([text or ""])[0][:-1]
            if len(codes) and codes[0] == _SPACE:
                codes = codes[1:]
            if len(codes) and codes[-1] == _SPACE:
                codes = codes[:-1]
            if len(codes) >= max(MIN_CHARS, q) and codes.tobytes() not in seen:
                seen[codes.tobytes()] = item
                items.append(item)
                passages.append(codes)
        lengths = np.array([len(p) for p in passages], dtype=np.int64)
        # the lemma must leave one q-gram at least
        budgets = np.minimum((lengths * rate).astype(np.int64), (lengths - q) // q)
        hashes = [qgram_hashes(p, q) for p in passages]
        count = np.array([len(h) for h in hashes], dtype=np.int64)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(passages)), count)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        return cls(items, passages, budgets, flat[order], owner[order], offset[order])

    def filter(self) -> np.ndarray:
        def make():
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True
            return bits

        key = f"filter {len(self.hashes)} {int(np.bitwise_xor.reduce(self.hashes)) if len(self.hashes) else 0}"
        return worker_cache(key, make)


def banded_distance(passage: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best alignment of the whole passage inside each region.

    ``regions`` is a matrix with a row for each region, ``len(passage)`` columns and the width
    of the diagonal band more; cells outside the band are not computed. Ties end first.
    """
    n, width = len(regions), regions.shape[1] - len(passage)
    steps = np.arange(width)
    cost = np.zeros((n, width), dtype=np.int32)
    for i, c in enumerate(passage):
        new = cost + (regions[:, i : i + width] != c)
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    best = cost.argmin(axis=1)
    return cost[np.arange(n), best], best + len(passage)


def _search(index: PassageIndex, given: list[str], q: int) -> list[tuple[int, int, int, int, int]]:
    """(row, passage, start, end, edits) of all regions within the budget, merged where they overlap."""
    codes, position, starts = normalise(given)
    h = qgram_hashes(codes, q)
    if not len(h) or not len(index.hashes):
        return []
    at = np.flatnonzero(index.filter()[h >> np.uint64(64 - _FILTER_BITS)])
    first = np.searchsorted(index.hashes, h[at])
    last = np.searchsorted(index.hashes, h[at], side="right")
    n = last - first
    at, first, n = at[n > 0], first[n > 0], n[n > 0]
    if not len(at):
        return []
    step = index.budgets + 1
    # q-grams that many passages share are dealt out in bounded parts, whose counts are added up
    counted = []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // PART_HITS)) + 1):
        repeats, begins = n[part], first[part]
        entry = np.repeat(begins - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
        where = np.repeat(at[part], repeats)
        passage = index.passage[entry]
        # overlapping bands of twice the width that edits can move an occurrence
        band = (where - index.offset[entry]) // step[passage]
        row = np.searchsorted(starts, where, side="right") - 1
        keys = np.stack([np.tile(row, 2), np.tile(passage, 2), np.concatenate([band, band - 1])], axis=1)
        counted.append(np.unique(keys, axis=0, return_counts=True))
    keys, counts = counted[0]
    if len(counted) > 1:
        keys, of = np.unique(np.concatenate([k for k, _ in counted]), axis=0, return_inverse=True)
        counts = np.bincount(of.ravel(), weights=np.concatenate([c for _, c in counted]))
    lengths = np.array([len(p) for p in index.passages])
    need = lengths[keys[:, 1]] - q + 1 - index.budgets[keys[:, 1]] * q
    keys = keys[counts >= need]
    found: list[tuple[int, int, int, int, int]] = []
    for p in np.unique(keys[:, 1]):
        text, k = index.passages[p], int(index.budgets[p])
        rows, bands = keys[keys[:, 1] == p][:, [0, 2]].T
        width = 2 * (k + 1) + 2 * k + 1
        base = bands * (k + 1) - k
        columns = base[:, None] + np.arange(len(text) + width)
        inside = (columns >= starts[rows][:, None]) & (columns < starts[rows + 1][:, None])
        regions = np.where(inside, codes[np.clip(columns, 0, len(codes) - 1)], 0)
        edits, end = banded_distance(text, regions)
        ok = np.flatnonzero(edits <= k)
        if not len(ok):
            continue
        # the same alignment backwards, from where it ended, gives the start
        size = len(text) + 2 * k + 1
        columns = (base + end)[ok][:, None] - 1 - np.arange(size)
        inside = (columns >= starts[rows[ok]][:, None]) & (columns < starts[rows[ok] + 1][:, None])
        back = np.where(inside, codes[np.clip(columns, 0, len(codes) - 1)], 0)
        spans = []
        for j, length in zip(ok, _anchored_lengths(text[::-1], back, edits[ok], k)):
            stop = int(base[j] + end[j])
            spans.append((int(rows[j]), stop - int(length), stop, int(edits[j])))
        spans.sort()
        merged: list[tuple[int, int, int, int]] = []
        for r, s, e, d in spans:
            if merged and merged[-1][0] == r and s < merged[-1][2]:
                merged[-1] = min(merged[-1], (r, s, e, d), key=lambda x: (x[3], x[1]))
            else:
                merged.append((r, s, e, d))
        found += [(r, int(p), int(position[s]), int(position[e - 1]) + 1, d) for r, s, e, d in merged]
    return found


def _anchored_lengths(passage: np.ndarray, regions: np.ndarray, edits: np.ndarray, k: int) -> np.ndarray:
    """Characters of each region's start that align with the passage at the given edits, most likely as many."""
    n, width = len(regions), 2 * k + 1
    regions = np.concatenate([np.zeros((n, k), dtype=regions.dtype), regions], axis=1)
    steps = np.arange(width)
    cost = np.where(steps >= k, steps - k, 1 << 20) * np.ones((n, 1), dtype=np.int64)
    for i, c in enumerate(passage):
        new = cost + (regions[:, i : i + width] != c)
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        new[:, : max(0, k - i - 1)] = 1 << 20  # would begin before the region
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    rank = np.where(cost == edits[:, None], np.abs(steps - k), 1 << 20)
    return rank.argmin(axis=1) - k + len(passage)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``(doc_id, item_id, start, end, edits)``: regions of documents that hold a benchmark passage.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; other columns
    are not read. Texts are compared in lower case with runs of other characters than letters
    and digits as one space. A region holds a passage of m characters if k = ``edit_rate`` * m
    edits turn one into the other; such a region shares m - q + 1 - k * q q-grams with it on
    neighbouring diagonals, so only bands with as many are aligned. ``start`` and ``end`` are
    characters of the given text. Equal passages are one, named by the smallest ``item_id``;
    those under ``MIN_CHARS`` characters are not searched. Null texts hold nothing. Repeated rows
    give repeated regions; null ids stay; empty tables give no rows.

    Passages are broadcast in blocks of a fixed number of bytes; a larger benchmark takes
    more passes over the documents, each with the same memory.
    """
    spark = docs.sparkSession
    rows = own_columns(docs, "doc_id", "text")
    passages = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = passages.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = None
    for b in range(blocks):
        own = passages.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        index = PassageIndex.build([(r["item_id"], r["text"]) for r in own.collect()], q, edit_rate)
        shared = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = _search(shared.value, texts(batch), q)
            r, p, start, end, edits = zip(*found) if found else ((), (), (), (), ())
            long = pa.int64()
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(r, long)),
                    pa.array([shared.value.items[i] for i in p], long),
                    pa.array(start, long),
                    pa.array(end, long),
                    pa.array(edits, long),
                ],
                names=["doc_id", "item_id", "start", "end", "edits"],
            )

        part = rows.mapInArrow(in_batches(run), "doc_id long, item_id long, start long, end long, edits long")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage, with all their columns.

    Each row is judged by its own text, named by its hash; ids may be null or repeated.
    """
    hashed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = find_passages(hashed, benchmark, **options).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, F.xxhash64("text") == F.col("_leak"), "left_anti")
