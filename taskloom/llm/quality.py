"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import in_batches, own_columns, texts, written
from taskloom.llm.words import Words

BUCKETS = 1 << 16
#: n-grams of the raw corpus that the target is smoothed with, so that a small target has no strong opinions.
PRIOR = 2.0 * BUCKETS
#: Mean log-likelihood ratio an n-gram that a document needs at least.
THRESHOLD = -0.1
#: Target ids that tasks hold at once, 32 MB.
BLOCK_IDS = 4_000_000
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
_BATCH = 6_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


def hashed_ngrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every pair of neighbouring words of a row."""
    each = np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in words.distinct.to_pylist()), dtype=np.uint64, count=len(words.distinct)
    )
    h = each[words.codes] if len(each) else np.zeros(0, dtype=np.uint64)
    pair = _mix(h[:-1] * _A + h[1:])
    same = words.doc[:-1] == words.doc[1:]
    modulus = np.uint64(BUCKETS - 1)
    row = np.concatenate([words.doc, words.doc[:-1][same]])
    return row, np.concatenate([_mix(h) & modulus, pair[same] & modulus]).astype(np.int64)


def repeat_words(words: Words, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of ``width`` words found twice or more in the row."""
    n = len(words.codes)
    if n < width:
        return np.zeros(words.rows, dtype=np.int64)
    h = _mix(words.codes.astype(np.uint64) * _A + _B)
    step = 1
    while step < width:
        h = _mix(h[:-step] * _A + h[step:])
        step *= 2
    starts = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    key = h[starts] ^ _mix(words.doc[starts].astype(np.uint64) + _A)
    order = np.argsort(key, kind="stable")
    at = starts[order]
    equal = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = at[equal], at[equal + 1]
    ok = words.doc[a] == words.doc[b]
    for k in range(width):
        ok &= words.codes[a + k] == words.codes[b + k]
    found = np.union1d(a[ok], b[ok])
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=words.rows)


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


@dataclass
class NgramRatio:
    """``log(target / raw)`` of each bucket."""

    ratio: np.ndarray


def _bucket_counts(docs: DataFrame, targets: np.ndarray, with_raw: bool) -> np.ndarray:
    """n-grams by bucket, of the documents whose id is among the sorted ``targets`` and of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(targets)

    def count(batches):
        ids = shared.value
        total = np.zeros((2, BUCKETS), dtype=np.int64)

        def add(batch):
            doc = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, doc), max(len(ids) - 1, 0))
            wanted = (ids[at] == doc) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(doc), bool)
            if not with_raw:
                batch = batch.filter(pa.array(wanted))
                wanted = wanted[wanted]
            row, bucket = hashed_ngrams(Words(batch))
            total[0] += np.bincount(bucket[wanted[row]], minlength=BUCKETS)
            total[1] += np.bincount(bucket, minlength=BUCKETS)

        for _ in in_batches(add, _BATCH)(batches):
            pass
        bucket = np.flatnonzero(total.any(axis=0))
        columns = [pa.array(bucket, pa.int32()), pa.array(total[0, bucket]), pa.array(total[1, bucket])]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "target", "raw"])

    rows = docs.mapInArrow(count, "bucket int, target long, raw long")
    found = rows.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    counts = np.zeros((2, BUCKETS))
    counts[0, found["bucket"]] = found["target"]
    counts[1, found["bucket"]] = found["raw"]
    shared.destroy()
    return counts


def fit(docs: DataFrame, trusted: DataFrame, block_ids: int = BLOCK_IDS) -> NgramRatio:
    """Bucket probabilities of the trusted target and of the raw corpus, over all their texts.

    ``docs`` has ``doc_id`` and ``text``, ``trusted`` a ``doc_id`` for each target document (null
    and repeated ids do not matter). Each task counts its own n-grams into a fixed number of
    buckets, so what is shuffled and collected does not depend on hot words, and no text is
    shuffled: the target ids go to the tasks in blocks of about ``block_ids``, 8 bytes each. One scan counts
    the corpus and the first block, each further block is a scan of its own. Without target or
    corpus every ratio is 0.
    """
    rows = own_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = written(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct())
    blocks = max(1, -(-ids.count() // block_ids))
    counts = np.zeros((2, BUCKETS))
    for k in range(blocks):
        block = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).toPandas()["doc_id"].to_numpy(dtype=np.int64)
        found = _bucket_counts(rows, np.sort(block), with_raw=k == 0)
        counts[0] += found[0]
        if k == 0:
            counts[1] = found[1]
    if not counts[0].sum() or not counts[1].sum():
        return NgramRatio(np.zeros(BUCKETS))
    raw = (counts[1] + 1.0) / (counts[1] + 1.0).sum()
    target = (counts[0] + PRIOR * raw) / (counts[0].sum() + PRIOR)
    return NgramRatio(np.log(target) - np.log(raw))


SCHEMA = """doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,
    base_failed boolean, kept boolean, ratio double"""


def judge(docs: DataFrame, model: NgramRatio, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, rules and verdict of every row of ``docs``; reads ``doc_id`` and ``text`` only.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.
    ``ratio`` is the log-likelihood ratio divided by the number of n-grams; ``kept`` is true if
    the base did not fail and the ratio reaches ``threshold``. Null and empty texts have no words
    and fail. Repeated rows and null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch)
        n = words.counts()
        row, bucket = hashed_ngrams(words)
        total = np.bincount(row, weights=shared.value.ratio[bucket], minlength=words.rows)
        ratio = total / np.maximum(np.bincount(row, minlength=words.rows), 1)
        lengths = pc.utf8_length(words.distinct).to_numpy(zero_copy_only=False)
        chars = words.sums(lengths[words.codes]) if len(lengths) else np.zeros(words.rows)
        given = texts(batch)
        repeat = repeat_words(words)
        failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
        columns = [
            batch.column(0),
            pa.array(n.astype(np.int64)),
            pa.array(chars.astype(np.int64)),
            pa.array([sum(map(t.count, SYMBOLS)) for t in given], pa.int64()),
            pa.array([duplicate_lines(t) for t in given], pa.int64()),
            pa.array(repeat.astype(np.int64)),
            pa.array(failed),
            pa.array(~failed & (ratio >= threshold)),
            pa.array(ratio),
        ]
        names = [c.split()[0] for c in SCHEMA.split(",")]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return own_columns(docs, "doc_id", "text").mapInArrow(in_batches(run, _BATCH), SCHEMA)
