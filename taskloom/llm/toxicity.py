"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import in_batches, own_columns, written
from taskloom.llm.words import Words

HASH_BITS = 20
FACTORS = 8
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Terms that the model learns, at most: those most associated with the label.
MAX_TERMS = 4_096
#: Least likelihood-ratio statistic of a term's association with the label.
LEAST_G2 = 15.0
SHARDS = 4
ROUNDS = 4
EPOCHS = 3
RATE = 0.1
DECAY = 1e-4
_BATCH = 6_000_000


def term_bucket(word: str) -> int:
    """Bucket of a word's letters in lower case; -1 without a letter."""
    letters = word if word.isalpha() else "".join(filter(str.isalpha, word))
    return zlib.crc32(letters.lower().encode()) >> (32 - HASH_BITS) if letters else -1


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct term of every row."""
    words = Words(batch)
    buckets = np.fromiter(map(term_bucket, words.distinct.to_pylist()), dtype=np.int64, count=len(words.distinct))
    own = buckets[words.codes]
    key = np.unique((words.doc.astype(np.int64) << HASH_BITS | own)[own >= 0])
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


@dataclass
class FactorizationMachine:
    """``bias + sum of weights + sum over pairs of factor products`` of the terms present."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slot: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
        self.slot[self.terms] = np.arange(len(self.terms))

    def __reduce__(self):
        return FactorizationMachine, (self.terms, self.bias, self.weights, self.factors)

    def logits(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        slot = self.slot[bucket]
        row, slot = row[slot >= 0], slot[slot >= 0]
        out = self.bias + np.bincount(row, weights=self.weights[slot], minlength=rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[slot, f]
            total = np.bincount(row, weights=v, minlength=rows)
            out += 0.5 * (total * total - np.bincount(row, weights=v * v, minlength=rows))
        return out

    def descend(self, examples: list[tuple[int, np.ndarray]], epochs: int) -> "FactorizationMachine":
        """Adaptive gradient steps over the examples, in their order."""
        bias, w, v = self.bias, self.weights.copy(), self.factors.copy()
        gb, gw, gv = 1.0, np.ones_like(w), np.ones_like(v)
        for _ in range(epochs):
            for label, x in examples:
                own = v[x]
                total = own.sum(axis=0)
                z = bias + w[x].sum() + 0.5 * float((total * total - (own * own).sum(axis=0)).sum())
                g = 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0))) - label
                gb += g * g
                bias -= RATE * g / gb**0.5
                dw, dv = g + DECAY * w[x], g * (total - own) + DECAY * own
                gw[x] += dw * dw
                gv[x] += dv * dv
                w[x] -= RATE * dw / np.sqrt(gw[x])
                v[x] -= RATE * dv / np.sqrt(gv[x])
        return FactorizationMachine(self.terms, bias, w, v)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """The model from ``docs (doc_id, text)`` and ``labels (doc_id, <label> 0/1)``.

    Fitted on a bounded sample, the ``train_rows`` labelled ids with the least hash; several
    labels of an id count as 1 if any does, null labels and ids are left out. Terms are chosen by
    their association with the label; shards of the sample descend from the same parameters,
    which are averaged after each round. Without labels the score of every text is 0.25.
    """
    spark = docs.sparkSession
    given = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    given = given.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # the sample has a row limit, so each task can hold it
    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, bucket = _terms(batch)
        offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bucket, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["label", "terms"])

    data = written(rows.mapInArrow(in_batches(features, _BATCH), "label int, terms array<int>"))
    positive, n = data.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    both, p, q = a + b, F.lit(float(positive)), F.lit(float(n - positive))

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    g2 = 2 * (
        part(a, both * p / n)
        + part(b, both * q / n)
        + part(p - a, (F.lit(float(n)) - both) * p / n)
        + part(q - b, (F.lit(float(n)) - both) * q / n)
    )
    counts = data.select("label", F.explode("terms").alias("term")).groupBy("term")
    counts = counts.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    kept = counts.select("term", g2.alias("g2")).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "term")
    terms = np.array(sorted(r["term"] for r in kept.limit(MAX_TERMS).collect()), dtype=np.int64) if n else np.zeros(0, int)
    start = np.random.default_rng(7).normal(0, 0.05, (len(terms), FACTORS))
    model = FactorizationMachine(terms, float(np.log((positive + 0.5) / (n - positive + 1.5))), np.zeros(len(terms)), start)
    if not len(terms):
        return model
    wanted = spark.sparkContext.broadcast(model.slot)

    def slots(batches):
        for batch in batches:
            held = [
                [int(s) for s in wanted.value[x] if s >= 0]
                for x in (np.asarray(t, dtype=np.int64) for t in batch.column(1).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int32()))], names=["label", "x"])

    short = written(
        data.repartition(SHARDS, F.xxhash64("terms")).sortWithinPartitions("terms", "label").mapInArrow(slots, "label int, x array<int>")
    )
    short = short.coalesce(SHARDS)
    for _ in range(ROUNDS):
        current = spark.sparkContext.broadcast(model)

        def descend(batches, current=current):
            examples = [
                (y, np.asarray(x, dtype=np.int64))
                for batch in batches
                for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ]
            if examples:
                order = np.random.default_rng(len(examples)).permutation(len(examples))
                got = current.value.descend([examples[i] for i in order], EPOCHS)
                values = np.concatenate([[len(examples), got.bias], got.weights, got.factors.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], names=["parameters"])

        found = [np.frombuffer(r[0]) for r in short.mapInArrow(descend, "parameters binary").collect()]
        share = np.array([x[0] for x in found])
        mean = np.average([x[1:] for x in found], axis=0, weights=share)
        m = len(terms)
        model = FactorizationMachine(terms, float(mean[0]), mean[1 : 1 + m], mean[1 + m :].reshape(m, FACTORS))
        current.unpersist()
    return model


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``; reads ``doc_id`` and ``text`` only.

    ``score`` is the probability of label 1 from all terms of the whole text, ``predicted`` is 1
    from 0.5 on. Null and empty texts have no terms and get the score of the bias. Repeated rows
    and null ids stay; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, bucket = _terms(batch)
        z = np.clip(shared.value.logits(row, bucket, batch.num_rows), -700, 700)
        p = 1.0 / (1.0 + np.exp(-z))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
        )

    rows = own_columns(docs, "doc_id", "text")
    return rows.mapInArrow(in_batches(run, _BATCH), "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Scored in place, so nothing is shuffled and repeated rows and ids do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, bucket = _terms(batch)
        return batch.filter(pa.array(shared.value.logits(row, bucket, batch.num_rows) < 0))

    return docs.mapInArrow(in_batches(run, _BATCH), docs.schema)
