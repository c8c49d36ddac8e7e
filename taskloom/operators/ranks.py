"""Positions, running totals and order statistics without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.session import cut_lineage


def _in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition ``df`` by ``order`` and fix the range number of each row as data."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    return cut_lineage(ranged)


def with_position(df: DataFrame, order: list, name: str = "position") -> DataFrame:
    """Row number (from 1) over the whole table in the given total order.

    Rows are range-partitioned; each range is numbered on its own and shifted by the row
    counts of the ranges before it (one row per range, so that table is small by nature).
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = _in_ranges(df, order)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    w = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_rn", F.row_number().over(w))
        .join(offsets, "_range")
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_range", "_rn", "_offset")
    )


def with_total_before(df: DataFrame, order: list, value: str, name: str = "spent_before") -> DataFrame:
    """Sum of ``value`` over all rows that come before a row in the given total order."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = _in_ranges(df, order)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_offset"))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0.0)))
        .join(offsets, "_range")
        .withColumn(name, F.col("_in") + F.col("_offset"))
        .drop("_range", "_in", "_offset")
    )


def with_max_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The largest ``value`` of all rows with a smaller ``order``, a long column; null for the first ones.

    Equal orders share a range, and of each range only its maximum is passed on to the next.
    """
    ranged = _in_ranges(df, [F.col(order)])
    tops = ranged.groupBy("_range").agg(F.max(value).alias("_top"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select("_range", F.max("_top").over(before).alias("_before"))
    w = Window.partitionBy("_range").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_in", F.max(value).over(w)).join(offsets, "_range")
    return inside.withColumn(name, F.greatest("_in", "_before")).drop("_range", "_in", "_before")


def kth_smallest(df: DataFrame, group: list[str], value: str, rank, width: float = 1e-4) -> DataFrame:
    """Per group the value at a 1-based ascending rank; ``rank`` maps the group size to it.

    Counting by fixed-width bucket finds the bucket of the rank, and only that bucket is
    counted again by value. Both counts merge before their shuffle, so a group of any size
    costs its number of buckets, not its rows. Returns ``group + [value]``; groups whose
    rank is outside 1..n are absent.
    """
    keyed = df.select(*group, F.col(value)).where(F.col(value).isNotNull())
    keyed = keyed.withColumn("_b", F.floor(F.col(value) / width))
    hist = keyed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*group)
    hit = (
        hist.withColumn("_cum", F.sum("_n").over(up_to))
        .withColumn("_rank", rank(F.sum("_n").over(whole)))
        .where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_n") < F.col("_rank")))
        .select(*group, "_b", (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_left"))
    )
    fine = keyed.join(hit, [*group, "_b"]).groupBy(*group, value, "_left").agg(F.count("*").alias("_n"))
    by_value = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        fine.withColumn("_cum", F.sum("_n").over(by_value))
        .where((F.col("_cum") >= F.col("_left")) & (F.col("_cum") - F.col("_n") < F.col("_left")))
        .select(*group, value)
    )


def percentile_linear(df: DataFrame, value: str, q: float, width: float = 1e-4) -> DataFrame:
    """One row with the ``q`` quantile of ``value``, linearly interpolated between ranks."""
    one = df.select(F.lit(0).alias("_g"), F.col(value))
    place = lambda n: F.lit(q) * (n - 1)
    low = kth_smallest(one, ["_g"], value, lambda n: F.floor(place(n)) + 1, width)
    high = kth_smallest(one, ["_g"], value, lambda n: F.ceil(place(n)) + 1, width)
    size = one.where(F.col(value).isNotNull()).groupBy("_g").agg(F.count("*").alias("_n"))
    share = place(F.col("_n")) - F.floor(place(F.col("_n")))
    return (
        low.withColumnRenamed(value, "_lo")
        .join(high.withColumnRenamed(value, "_hi"), "_g")
        .join(size, "_g")
        .select((F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias(value))
    )


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row (the one row is broadcast)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")
