"""Vectors for texts: a precomputed table, a user function, or hashed TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[list[str]], list[list[float]]]
DIMS = 256
WORD_GAP = r"[^\p{L}\p{M}\p{N}_]+"


def score_texts(df: DataFrame, scorer: Scorer, text: str, batch: int = 32) -> DataFrame:
    """Add ``embedding`` by calling ``scorer`` on groups of ``batch`` texts inside Arrow tasks."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = scorer([t or "" for t in part.column(text).to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError("the scorer must return one vector per text")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*names, "embedding"]
                )

    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def _term_counts(df: DataFrame, text: str, dims: int) -> DataFrame:
    """Add ``_tf``: counts of the words of a text in ``dims`` buckets of their MD5; null counts as empty."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_GAP)
    bucket = lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims).cast("string")
    buckets = F.transform(F.filter(words, lambda w: w != ""), bucket)
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(dims)], inputCol="_words", outputCol="_tf")
    return counter.transform(df.withColumn("_words", buckets)).drop("_words")


def fit_idf(df: DataFrame, text: str, dims: int = DIMS) -> IDFModel:
    """Weights ``ln((rows + 1) / (rows with the bucket + 1))`` of the buckets over all texts."""
    return IDF(inputCol="_tf", outputCol="_idf").fit(_term_counts(df.select(text), text, dims))


def hashed_tfidf(df: DataFrame, text: str, dims: int = DIMS, idf: IDFModel | None = None) -> DataFrame:
    """Add ``embedding``: TF-IDF of hashed words, scaled to length 1; a text without words gets zeros.

    Pass the ``idf`` of the texts that are searched to embed the questions asked of them.
    """
    idf = idf or fit_idf(df, text, dims)
    weighed = idf.transform(_term_counts(df, text, len(idf.idf)))
    unit = Normalizer(inputCol="_idf", outputCol="_unit").transform(weighed)
    return unit.withColumn("embedding", vector_to_array("_unit")).drop("_tf", "_idf", "_unit")


def attach_embeddings(
    df: DataFrame,
    vectors: DataFrame | None = None,
    scorer: Scorer | None = None,
    text: str = "text",
    key: str = "key",
    dims: int = DIMS,
) -> DataFrame:
    """Add ``embedding`` from a table ``(key, embedding)``, from a scorer, or as hashed TF-IDF."""
    df = df.drop("embedding")
    if vectors is not None:
        return df.join(vectors.select(key, "embedding"), key, "left")
    if scorer is not None:
        return score_texts(df, scorer, text)
    return hashed_tfidf(df, text, dims)
