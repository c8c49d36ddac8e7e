"""Language identification with unigram piece models summed over all segmentations."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.llm.common import in_batches, own_columns, worker_cache, written
from taskloom.llm.words import Words

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct texts of each language that the models are fitted on, about, at most.
TRAIN_DOCS = 2_000
#: Languages that are learned, at most: those with the most documents.
MAX_LANGUAGES = 200
EM_ROUNDS = 3
MAX_PIECE = 12
#: Longer words are scored in parts of this many bytes.
MAX_WORD = 40
SMOOTHING = 0.01
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BATCH = 6_000_000


class Vocabulary:
    """Pieces of a public byte-level vocabulary, found by a hash of their bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
        self.pieces = sorted({p for p in pieces if len(p) <= MAX_PIECE} | {bytes([b]) for b in range(256)})
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        assert (np.diff(self.sorted.astype(object)) > 0).all(), "two pieces share a hash"
        self.bits = 20
        self.filter = np.zeros(1 << self.bits, dtype=bool)
        self.filter[hashes >> np.uint64(64 - self.bits)] = True

    def __len__(self) -> int:
        return len(self.pieces)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h + b + 1) * int(_BASE)) & (2**64 - 1)
        return h

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes; the number of pieces where there is none."""
        out = np.full(len(hashes), len(self.pieces), dtype=np.int64)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - self.bits)])
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == hashes[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out


def _by_length(words: list[bytes]):
    """(positions, byte matrix) for each word length; a word starts with a space."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else lengths
    for n in np.unique(lengths):
        where = np.flatnonzero(lengths == n)
        for part in np.array_split(where, -(-len(where) // 50_000)):
            yield part, flat[begins[part][:, None] + np.arange(n)]


def _lattice(vocabulary: Vocabulary, matrix: np.ndarray):
    """(start, length, piece numbers of the column) for every span of the words."""
    n = matrix.shape[1]
    values = matrix.astype(np.uint64) + np.uint64(1)
    for i in range(n):
        h = np.zeros(len(matrix), dtype=np.uint64)
        for size in range(1, min(MAX_PIECE, n - i) + 1):
            h = (h + values[:, i + size - 1]) * _BASE
            yield i, size, vocabulary.ids(h)


def word_log_likelihoods(vocabulary: Vocabulary, probability: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log of the summed probability of all segmentations: a row a word, a column a language.

    ``probability`` has a row for each piece and a last one of zeros.
    """
    out = np.zeros((len(words), probability.shape[1]))
    for where, matrix in _by_length(words):
        n = matrix.shape[1]
        alpha = np.zeros((n + 1, len(matrix), probability.shape[1]))
        alpha[0] = 1.0
        for i, size, ids in _lattice(vocabulary, matrix):
            hit = np.flatnonzero(ids < len(vocabulary))
            alpha[i + size][hit] += alpha[i][hit] * probability[ids[hit]]
        out[where] = np.log(alpha[n])
    return out


def expected_counts(vocabulary: Vocabulary, probability: np.ndarray, words: list[bytes], n: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of ``n`` copies of each word (one language)."""
    total = np.zeros(len(vocabulary) + 1)
    for where, matrix in _by_length(words):
        length = matrix.shape[1]
        spans = [(i, size, ids, probability[ids]) for i, size, ids in _lattice(vocabulary, matrix)]
        alpha, beta = np.zeros((length + 1, len(matrix))), np.zeros((length + 1, len(matrix)))
        alpha[0] = beta[length] = 1.0
        for i, size, _, p in spans:
            alpha[i + size] += alpha[i] * p
        for i, size, _, p in reversed(spans):
            beta[i] += p * beta[i + size]
        weight = n[where] / alpha[length]
        for i, size, ids, p in spans:
            total += np.bincount(ids, weights=alpha[i] * p * beta[i + size] * weight, minlength=len(total))
    return total[:-1]


def _pieces_of(word: str) -> list[bytes]:
    data = b" " + word.encode()
    return [data[k : k + MAX_WORD] for k in range(0, len(data), MAX_WORD)]


@dataclass
class LanguageModel:
    languages: list[str]
    #: A row for each piece and one of zeros; a column for each language.
    probability: np.ndarray
    vocabulary_path: str

    def vocabulary(self) -> Vocabulary:
        return worker_cache(f"pieces {self.vocabulary_path}", lambda: Vocabulary(self.vocabulary_path))


def fit(
    docs: DataFrame,
    vocabulary_path: str | None = None,
    train_docs: int = TRAIN_DOCS,
    rounds: int = EM_ROUNDS,
) -> LanguageModel:
    """Piece probabilities of each language by expectation maximisation over word counts.

    Takes a bounded sample: at most about ``train_docs`` distinct texts of each language, chosen by
    a hash of the text, and the ``MAX_LANGUAGES`` languages with the most documents. Copies of a
    text count once. Rows with a null text or language are left out. Words are counted and expected counts are summed by
    Spark; the driver receives one number for each piece and language.
    """
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    labelled = own_columns(docs, "text", "lang").where("text is not null and lang is not null")
    labelled = labelled.withColumn("hash", F.xxhash64("text"))
    distinct = labelled.groupBy("lang", "hash").agg(F.count("*").alias("rows"))
    sizes = distinct.groupBy("lang").agg(F.sum("rows").alias("rows"), F.count("*").alias("texts"))
    sizes = sizes.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    vocabulary = Vocabulary(path)
    probability = np.zeros((len(vocabulary) + 1, len(languages)))
    probability[:-1] = 1.0 / len(vocabulary)
    if not languages:
        return LanguageModel([], probability, path)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["texts"]))])
    chosen = labelled.where(F.pmod("hash", F.lit(1 << 20)) < share[F.col("lang")] * float(1 << 20))
    chosen = chosen.dropDuplicates(["lang", "hash"]).select("text", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch)
        lang = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
        key = lang.indices.to_numpy(zero_copy_only=False)[words.doc].astype(np.int64) * len(words.distinct) + words.codes
        keys, n = np.unique(key, return_counts=True)
        code = np.maximum(len(words.distinct), 1)
        return pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(keys // code)), words.distinct.take(pa.array(keys % code)), pa.array(n)],
            names=["lang", "word", "n"],
        )

    counts = chosen.mapInArrow(in_batches(count, _BATCH), "lang string, word string, n long")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(probability)

        def expect(batches, shared=shared):
            vocab = worker_cache(f"pieces {path}", lambda: Vocabulary(path))
            total = np.zeros((len(languages), len(vocab)))
            for batch in batches:
                names = np.array(batch.column(0).to_pylist())
                words, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, name in enumerate(languages):
                    own = np.flatnonzero(names == name)
                    parts = [(p, n[j]) for j in own for p in _pieces_of(words[j])]
                    if parts:
                        weights = np.array([x for _, x in parts], dtype=float)
                        total[k] += expected_counts(vocab, shared.value[:, k], [p for p, _ in parts], weights)
            k, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])],
                names=["k", "piece", "uses"],
            )

        sums = counts.mapInArrow(expect, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses"))
        uses = np.full((len(vocabulary), len(languages)), SMOOTHING)
        found = sums.toPandas()
        uses[found["piece"], found["k"]] += found["uses"]
        probability = np.zeros_like(probability)
        probability[:-1] = uses / uses.sum(axis=0)
        shared.unpersist()
    return LanguageModel(languages, probability, path)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row of ``docs``; reads ``doc_id`` and ``text`` only.

    The score is the posterior probability of the language, equal priors, from the whole text.
    Null texts, texts without a letter and models without a language give ``und`` and 0.0. Ties
    go to the language that sorts first. Repeated rows and null ids stay; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        fitted = shared.value
        n = len(fitted.languages)
        total = np.zeros((batch.num_rows, max(n, 1)))
        if n:
            words = Words(batch)
            parts = [(k, p) for k, w in enumerate(words.distinct.to_pylist()) for p in _pieces_of(w)]
            by_part = word_log_likelihoods(fitted.vocabulary(), fitted.probability, [p for _, p in parts])
            owner = np.array([k for k, _ in parts], dtype=np.int64)
            for k in range(n):
                by_word = np.bincount(owner, weights=by_part[:, k], minlength=len(words.distinct))
                total[:, k] = words.sums(by_word[words.codes])
        text = batch.column(batch.schema.get_field_index("text"))
        letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
        known = letters & (n > 0)
        best = total.argmax(axis=1)
        top = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [fitted.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names), pa.array(np.where(known, top, 0.0))], names=["doc_id", "lang_pred", "score"]
        )

    rows = own_columns(docs, "doc_id", "text")
    return rows.mapInArrow(in_batches(score, _BATCH), "doc_id long, lang_pred string, score double")
