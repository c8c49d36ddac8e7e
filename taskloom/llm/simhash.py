"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import in_batches, own_columns, texts, written
from taskloom.operators.clusters import connected_components

SHINGLE_WORDS = 3
SEED = 42
#: Bits in which linked fingerprints differ at most.
THRESHOLD = 2
#: Fingerprints of an anchor that are compared in memory; larger anchors go the way of _shared_points.
ANCHOR_LIMIT = 1024
NULL_ID = -(2**63)

_ONE = np.uint64(1)


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the shingles of ``width`` words, A-Z in lower case, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII spaces split
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


class AnchorCode:
    """A covering code of 64-bit words: the product of two perfect Golay codes of 23 bits, a
    perfect Hamming code of 15 bits and the 3 bits left. Its covering radius is 3 + 3 + 1."""

    GENERATOR = 0b110001110101
    radius = 7

    def __init__(self):
        remainders = np.zeros(1 << 23, dtype=np.uint16)
        values = np.arange(1 << 23, dtype=np.uint32)
        for bit in range(22, 10, -1):
            values ^= np.where(values >> bit & 1, np.uint32(self.GENERATOR << (bit - 11)), np.uint32(0))
        remainders[:] = values
        self.remainder = remainders
        self.error = np.zeros(1 << 11, dtype=np.uint64)
        for weight in range(4):
            for places in combinations(range(23), weight):
                pattern = sum(1 << p for p in places)
                self.error[remainders[pattern]] = pattern
        syndrome = np.zeros(1 << 15, dtype=np.int64)
        for bit in range(15):
            syndrome ^= np.where(np.arange(1 << 15) >> bit & 1, bit + 1, 0)
        self.flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The code word nearest to each word."""
        low, mid = x & np.uint64(0x7FFFFF), x >> np.uint64(23) & np.uint64(0x7FFFFF)
        high = x >> np.uint64(46) & np.uint64(0x7FFF)
        fix = self.error[self.remainder[low]] | self.error[self.remainder[mid]] << np.uint64(23)
        return x ^ (fix | self.flip[high] << np.uint64(46))


def ball(radius: int) -> np.ndarray:
    """All 64-bit words with at most ``radius`` bits set."""
    return np.array(
        [sum(1 << b for b in places) for r in range(radius + 1) for places in combinations(range(64), r)], dtype=np.uint64
    )


def anchors(x: np.ndarray, code: AnchorCode, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(index into x, anchor): the anchors that each fingerprint is copied to.

    Fingerprints within the threshold have a point between them, at most half the threshold
    (rounded up) from either; both go to the anchor that is nearest to this point. It lies
    within the covering radius plus half the threshold; other anchors at this distance are
    not needed.
    """
    near = np.sort(code.nearest(x[:, None] ^ ball(-(-threshold // 2))[None, :]), axis=1)
    first = np.ones(near.shape, dtype=bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    row, _ = np.nonzero(first)
    return row, near[first]


def local_links(x: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """For each fingerprint of an anchor, the position of the first one of its local component."""
    n = len(x)
    linked = np.empty((n, n), dtype=bool)
    for i in range(n):
        linked[i] = np.bitwise_count(x ^ x[i]) <= threshold
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _code() -> AnchorCode:
    from taskloom.llm.common import worker_cache

    return worker_cache("anchor code", AnchorCode)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every row as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, width) for t in texts(batch)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), _signed(found)], names=["doc_id", "fp"])

    return own_columns(docs, "doc_id", "text").mapInArrow(in_batches(run), "doc_id long, fp long")


def _shared_points(fps: DataFrame, threshold: int) -> DataFrame:
    """Links of fingerprints by the points within half the threshold of each; no comparison is needed,
    as all fingerprints around a point are linked. For anchors that hold too many to compare."""
    masks = F.array(*[F.lit(int(m) - (1 << 64) if m >> _ONE * 63 else int(m)) for m in ball(threshold // 2)])
    points = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where("b <> last")
    return points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, threshold: int = THRESHOLD, anchor_limit: int = ANCHOR_LIMIT) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints (distinct longs ``fp``) within ``threshold`` bits.

    Every fingerprint goes to its anchors and is compared with the others there; an anchor
    gives each fingerprint one link at most. Anchors with more than ``anchor_limit``
    fingerprints are not compared: their fingerprints are linked by shared points, for which
    the threshold must be even.
    """

    def replicate(batches):
        code = _code()
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(x), 20_000):
                row, anchor = anchors(x[k : k + 20_000], code, threshold)
                yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(x[k + row])], names=["anchor", "fp"])

    def compare(batches):
        held_anchor, held, over = None, [], False

        def close():
            x = np.array(held, dtype=np.int64).view(np.uint64)
            if over:
                return [(int(v), int(v), True) for v in held]
            if len(x) < 2:
                return []
            label = local_links(x, threshold)
            return [(held[i], held[j], False) for i, j in enumerate(label) if i != j]

        for batch in batches:
            out = []
            anchor, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            bounds = np.concatenate([[0], cuts, [len(anchor)]]) if len(anchor) else []
            for start, end in zip(bounds[:-1], bounds[1:]):
                if anchor[start] != held_anchor:
                    if len(held) > 1 or over:
                        out += close()
                    held_anchor, held, over = anchor[start], [], False
                held += fp[start:end].tolist()
                if len(held) > anchor_limit:
                    over = True
                if over:
                    out += close()
                    held = []
            if out:
                yield _link_batch(out)
        if held:
            out = close()
            if out:
                yield _link_batch(out)

    copies = fps.select("fp").mapInArrow(replicate, "anchor long, fp long")
    dealt = copies.repartition("anchor").sortWithinPartitions("anchor")
    found = written(dealt.mapInArrow(compare, "a long, b long, over boolean"))
    crowded = found.where("over").select(F.col("a").alias("fp")).distinct()
    return found.where("not over").select("a", "b").unionByName(_shared_points(crowded, threshold))


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, over = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(over, pa.bool_())], names=["a", "b", "over"]
    )


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs (doc_id, text)``.

    Documents whose fingerprints differ in at most ``threshold`` bits are linked;
    ``component_id`` is the smallest ``doc_id`` that links reach. Equal fingerprints are one
    node, so copies cost nothing. Null and empty texts have fingerprint zero and are linked like
    any other. A null ``doc_id`` counts as smaller than all others. Repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, width))
    distinct = prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("least"))
    distinct = written(distinct)
    roots = connected_components(links(distinct, threshold))
    grouped = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = grouped.join(least, "root").select("fp", "component_id")
    joined = prints.join(of_print, "fp")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"),
    )


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, width: int = SHINGLE_WORDS) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that with the smallest ``doc_id``.

    All columns stay. A null ``doc_id`` is the smallest; of rows that share the id one stays.
    An empty table stays empty.
    """
    found = near_duplicates(docs, threshold, width)
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").dropDuplicates(["doc_id"])
