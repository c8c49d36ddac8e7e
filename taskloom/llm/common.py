"""Helpers that several operators of this package share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.session import shuffles_removed

BATCH_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches.

    Where the setting is missing only a local master may fall back to a folder of this
    machine; a cluster without it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="taskloom-shared-")
    return f"{root.rstrip('/')}/{uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column has about ``limit`` bytes, one row at least.

    Keeps the working memory of a task independent of the batch size and of long rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index("text"))
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def in_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = BATCH_CHARS):
    """A function for ``mapInArrow`` that calls ``fn`` with bounded slices."""

    def run(batches):
        for part in text_batches(batches, limit):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return run


def texts(batch: pa.RecordBatch) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def crc_fold(doc_id: str, folds: int):
    """``crc32`` of the decimal text of an id, modulo the number of folds; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads; extra columns with clashing names are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def worker_cache(name: str, make: Callable[[], object]):
    """An object that a Python worker makes once and keeps for its later tasks.

    A worker serves one operator after another: what a module's ``make`` has left goes when another
    module asks, and of one module only the last two objects stay.
    """
    global _OWNER
    if _OWNER != (os.getpid(), make.__module__):
        _CACHE.clear()
        _OWNER = os.getpid(), make.__module__
    found = _CACHE.pop(name) if name in _CACHE else make()
    _CACHE[name] = found
    while len(_CACHE) > 2:
        del _CACHE[next(iter(_CACHE))]
    return found


_CACHE: dict = {}
_OWNER: tuple[int, str] | None = None
