"""Vector expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when a norm is 0 or the lengths differ."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0)).otherwise(dot(a, b) / scale)


def unit(a) -> Column:
    """Vector scaled to length 1; a zero vector stays zero."""
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def mean_vector(a) -> Column:
    """Component-wise mean as an aggregate.

    The ML summarizer keeps one running vector per group and merges partial results
    before the shuffle, so a hot group never travels row by row.
    """
    a = F.col(a) if isinstance(a, str) else a
    return vector_to_array(Summarizer.mean(array_to_vector(a)))


def sum_vector(a) -> Column:
    """Component-wise sum as an aggregate, merged before the shuffle."""
    a = F.col(a) if isinstance(a, str) else a
    return vector_to_array(Summarizer.sum(array_to_vector(a)))
