"""Repeated windows of long texts, found through shared anchors.

Substring operators ask which windows of W symbols (bytes or words) also stand elsewhere. Shipping
every window would multiply the corpus, so windows are dealt out in runs:

* Every K-gram has a hash. A window's anchor is the least hash of its K-grams, so equal windows
  have equal anchors. Neighbouring windows with one anchor form a run, about (W - K) / 2 windows
  long; the runs part the windows of a text.
* ``anchored_runs`` gives one row for each run: anchor, hash of the run's whole text, place.
* ``sifted`` brings runs with one anchor together. A run that stands alone holds no repeat and
  goes. Of runs with equal text all but the first are repeats as a whole. First runs that share
  their anchor with another text, or hold its K-gram twice, are left to be compared.
* ``contexts`` cuts the texts of those runs from their documents, ``compared`` deals them out by
  anchor to the operator's own comparison, and ``window_repeats`` does the same without one task
  for an anchor that stands in too many texts.

Only hashes and places are shuffled for all runs; texts are shuffled once, by document. A run
that has an equal one in the same batch is settled before the shuffle, so copies and frequent
passages bring each task's share down to their distinct texts.

Documents have the columns ``id`` (null counts as the smallest), ``twin`` (0, or a hash of the
text where ids are repeated: equal rows are one document, each gets its result) and ``text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import own_columns, text_batches, texts, written

NULL_ID = -(2**63)
#: A run is cut after this many times the anchor spacing, so that no text makes a long one.
LONGEST_RUN = 4
#: Texts of one anchor that a task compares in memory; more go to ``window_repeats``.
ANCHOR_TEXTS = 10_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

RUNS = "deal long, anchor long, content long, id long, twin long, start int, size int, again boolean"
SPANS = "id long, twin long, start int, size int, repeat boolean, anchor long"
CONTEXTS = "anchor long, id long, twin long, start int, size int, body binary"
COMPARED = "id long, twin long, start int, size int, high long, low long"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed polynomial hashes of all K-grams of 64-bit symbols, by doubling."""
    h, size, out, done = symbols, 1, None, 0
    while True:
        if k & size:
            out, done = (h, size) if out is None else (h[: len(out) - size] * _power(done) + out[size:], done + size)
        if done == k:
            return mixed(out[: len(symbols) - k + 1])
        h = h[:-size] * _power(size) + h[size:]
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class PrefixHashes:
    """Prefix polynomial hashes modulo 2^64; substrings are compared in constant time."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.power = np.ones(n + 1, dtype=np.uint64)
        inverse = np.ones(n + 1, dtype=np.uint64)
        filled = 1
        while filled <= n:  # powers by doubling
            more = min(filled, n + 1 - filled)
            self.power[filled : filled + more] = self.power[:more] * _power(filled)
            inverse[filled : filled + more] = inverse[:more] * np.uint64(pow(int(_INVERSE), filled, 1 << 64))
            filled += more
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * inverse[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of substrings; equal for equal ones wherever they begin."""
        return (self.sums[start + size] - self.sums[start]) * self.power[start]


def runs_of(symbols: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, start, windows, again) of the runs of one text.

    ``again``: the anchor's K-gram stands twice in the run, so windows of the run may be equal.
    """
    width = window - k + 1
    h = gram_hashes(symbols, k)
    least = sliding_min(h, width)
    n = len(least)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([start, [n]]))
    longest = LONGEST_RUN * width
    if (size > longest).any():
        parts = -(-size // longest)
        at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(np.repeat(size, parts) - at * longest, longest)
        start = np.repeat(start, parts) + at * longest
    anchor = least[start]
    content = mixed(PrefixHashes(symbols).of(start, size + window - 1))
    span = size + width - 1
    owner = np.repeat(np.arange(len(start)), span)
    place = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + start[owner]
    again = np.bincount(owner[h[place] == anchor[owner]], minlength=len(start)) > 1
    return anchor, content, start, size, again


def documents(docs: DataFrame) -> DataFrame:
    """``(id, twin, text)`` of the rows of ``docs (doc_id, text)``."""
    rows = own_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text")
    shared = rows.groupBy("id").count().where("count > 1").limit(1).count()
    twin = F.xxhash64("text") if shared else F.lit(0).cast("long")
    return rows.select("id", twin.alias("twin"), "text")


def _later(content: list[np.ndarray], ids: np.ndarray, twins: np.ndarray, starts: np.ndarray, same_doc: bool):
    """Of rows sorted by (content, id, twin, start): those whose content stands in an earlier place
    (``same_doc``) or in a document with a smaller id; and the first row of each row's content."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = False
    for c in content:
        new[1:] |= c[1:] != c[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    later = ids > ids[first]
    if same_doc:
        later |= (ids == ids[first]) & ((twins != twins[first]) | (starts != starts[first]))
    return later, first


def _batch(spec: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in spec.split(",")]
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(kinds[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[f[0] for f in fields])


def anchored_runs(docs: DataFrame, symbols: Callable[[str], np.ndarray], window: int, k: int, same_doc: bool) -> DataFrame:
    """The runs of all texts. A negative ``size`` marks a run that is a repeat as a whole, because
    the same batch has an equal run before it; such rows are dealt out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = []
            for i, twin, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch)):
                own = symbols(text)
                if len(own) >= window:
                    a, c, s, n, g = runs_of(own, window, k)
                    found.append((a, c, np.full(len(a), i, np.int64), np.full(len(a), twin, np.int64), s, n, g))
            if not found:
                continue
            columns = [np.concatenate(x) for x in zip(*found)]
            order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
            anchor, content, ids, twins, start, size, again = (x[order] for x in columns)
            later, _ = _later([anchor, content], ids, twins, start, same_doc)
            place = mixed(ids.view(np.uint64) * _BASE + start.astype(np.uint64))
            deal = np.where(later, place, anchor)
            yield _batch(RUNS, [deal, anchor, content, ids, twins, start, np.where(later, -size, size), again])

    return docs.mapInArrow(run, RUNS)


def sifted(runs: DataFrame, same_doc: bool) -> DataFrame:
    """Runs that matter, as SPANS: repeats as a whole, and first runs left to compare; written once.

    A task reads its anchors in order and holds back only the first text of the last one, so a
    frequent anchor takes time in proportion and no memory.
    """

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 8)]
            settled = columns[5] < 0
            if settled.any():
                a, _, ids, twins, start, size, _ = (c[settled] for c in columns)
                yield _batch(SPANS, [ids, twins, start, -size, np.ones(len(a), bool), a])
                columns = [c[~settled] for c in columns]
            if not len(columns[0]):
                continue
            fresh = held is None
            if not fresh:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            anchor, content, ids, twins, start, size, again = columns
            later, first = _later([anchor, content], ids, twins, start, same_doc)
            group = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
            sizes = np.diff(np.concatenate([group, [len(anchor)]]))
            several = np.logical_or.reduceat(content != np.repeat(content[group], sizes), group)
            if fresh and last is not None and last[0] == anchor[0]:
                several[0] = True
                same = np.flatnonzero(content[: sizes[0]] == last[1])
                later[same] |= ids[same] > last[2]
                if same_doc:
                    later[same] |= (twins[same] != last[3]) | (start[same] != last[4])
            else:
                last = None
            keep = np.zeros(len(anchor), dtype=bool)
            if several[-1]:
                f = first[-1]
                if last is None or f or last[1] != content[f] or len(group) > 1:
                    last = (anchor[f], content[f], ids[f], twins[f], start[f])
                held = None
            else:
                keep[group[-1] :] = ~later[group[-1] :]
                held, last = [c[keep] for c in columns], None
            sent = ~keep & (later | np.repeat(several, sizes) | (again & same_doc))
            if sent.any():
                yield _batch(SPANS, [c[sent] for c in (ids, twins, start, size, later, anchor)])
        if held is not None and same_doc and held[6].any():
            own = [c[held[6]] for c in held]
            yield _batch(SPANS, [*own[2:6], np.zeros(len(own[0]), bool), own[0]])

    dealt = runs.repartition("deal").sortWithinPartitions("deal", "anchor", "content", "id", "twin", "start")
    return written(dealt.mapInArrow(sift, SPANS))


def with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """``(id, twin, text, spans)``: the documents with the list of their spans."""
    lists = spans.groupBy("id", "twin").agg(F.collect_list(F.struct("start", "size", "anchor")).alias("spans"))
    return docs.join(lists, ["id", "twin"], how).select("id", "twin", "text", "spans")


def contexts(docs: DataFrame, spans: DataFrame, body: Callable[[str], Callable[[int, int], bytes]], window: int) -> DataFrame:
    """The texts of the runs left to compare, as CONTEXTS. ``body(text)(start, stop)`` cuts symbols."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in text_batches(batches):
            rows = []
            lists = batch.column(3).to_pylist()
            for i, twin, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), lists):
                of = body(text)
                for x in own:
                    s, n = x["start"], x["size"]
                    rows.append((x["anchor"], i, twin, s, n, of(s, s + n + window - 1)))
            for k in range(0, len(rows), 20_000):
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows[k : k + 20_000]), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in CONTEXTS.split(",")])

    left = with_spans(docs, spans.where("not repeat"), "inner")
    return left.mapInArrow(cut, CONTEXTS)


def compared(found: DataFrame, compare: Callable, digests: Callable, anchor_texts: int = ANCHOR_TEXTS) -> DataFrame:
    """Deals contexts out by anchor. ``compare(groups)`` gets a list of whole groups, each a list of
    (id, twin, start, size, body) in order, and gives (id, twin, start, size) of repeated windows.
    Of an anchor with more than ``anchor_texts`` texts every window comes out with a digest of 128
    bits (``digests(body, size)``) and is left to ``window_repeats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, crowded, ready, amount = None, [], False, [], 0

        def windows(rows):
            for i, twin, start, size, data in rows:
                high, low = digests(data, size)
                fill = np.full(size, i, np.int64), np.full(size, twin, np.int64)
                yield _batch(COMPARED, [*fill, start + np.arange(size), np.zeros(size, np.int32), high, low])

        def settle(groups):
            rows = compare(groups)
            if rows:
                columns = [np.array(c, dtype=np.int64) for c in zip(*rows)]
                none = np.zeros(len(rows), np.int64)
                yield _batch(COMPARED, [*columns, none, none])

        for batch in batches:
            names = ("anchor", "id", "twin", "start", "size", "body")
            for anchor, *row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                if anchor != current:
                    if len(group):
                        ready.append(group)
                        amount += sum(len(r[4]) for r in group)
                    if amount > 1_500_000:
                        yield from settle(ready)
                        ready, amount = [], 0
                    current, group, crowded = anchor, [], False
                group.append(row)
                if crowded or len(group) > anchor_texts:
                    yield from windows(group)
                    group, crowded = [], True
        yield from settle([*ready, group] if group else ready)

    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "id", "twin", "start")
    return dealt.mapInArrow(run, COMPARED)


def window_repeats(windows: DataFrame, same_doc: bool) -> DataFrame:
    """Repeated windows among rows with a digest each: the first place of a digest is found by an
    aggregate that combines before the shuffle, and a join that splits hot digests marks the others."""
    first = windows.groupBy("high", "low").agg(F.min(F.struct("id", "twin", "start")).alias("first"), F.count("*").alias("n"))
    own = F.struct("id", "twin", "start")
    later = own != F.col("first") if same_doc else F.col("id") > F.col("first.id")
    joined = windows.join(first.where("n > 1"), ["high", "low"]).where(later)
    return joined.select("id", "twin", "start", F.lit(1).alias("size"))


def repeated_spans(
    docs: DataFrame,
    symbols: Callable[[str], np.ndarray],
    body: Callable[[str], Callable[[int, int], bytes]],
    compare: Callable,
    digests: Callable,
    window: int,
    k: int,
    same_doc: bool,
    anchor_texts: int = ANCHOR_TEXTS,
) -> DataFrame:
    """``(id, twin, start, size, anchor)``: runs of windows that stand in an earlier place too."""
    spans = sifted(anchored_runs(docs, symbols, window, k, same_doc), same_doc)
    found = written(compared(contexts(docs, spans, body, window), compare, digests, anchor_texts))
    crowded = window_repeats(found.where("size = 0").select("id", "twin", "start", "high", "low"), same_doc)
    settled = found.where("size > 0").select("id", "twin", "start", "size").unionByName(crowded)
    whole = spans.where("repeat").select("id", "twin", "start", "size")
    return whole.unionByName(settled).withColumn("anchor", F.lit(0).cast("long"))


def covered(spans: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols that the repeated windows of a document cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["start"] + x["size"] + window - 1) for x in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out
