"""Derived item metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_metadata(items: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Add priority (default Medium), created_month, has_children and dependency_count.

    An item has children when another item names it as parent or epic. ``links`` has
    ``(key, depends_on)``; without it the count is 0.
    """
    parents = (
        items.select(F.col("parent_key").alias("key"))
        .unionByName(items.select(F.col("epic_key").alias("key")))
        .where("key is not null")
        .distinct()
        .withColumn("_has", F.lit(True))
    )
    priority = F.coalesce("priority", F.lit("Medium")) if "priority" in items.columns else F.lit("Medium")
    out = (
        items.withColumn("priority", priority)
        .withColumn("created_month", F.date_format("created", "yyyy-MM"))
        .join(parents, "key", "left")
        .withColumn("has_children", F.coalesce("_has", F.lit(False)))
        .drop("_has")
    )
    if links is None:
        return out.withColumn("dependency_count", F.lit(0).cast("bigint"))
    counts = links.groupBy("key").agg(F.count_distinct("depends_on").alias("dependency_count"))
    return out.join(counts, "key", "left").withColumn("dependency_count", F.coalesce("dependency_count", F.lit(0)))
