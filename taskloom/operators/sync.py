"""Change detection, incremental sync and tracking state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.text import content_hash, project_key
from taskloom.operators.filters import for_project


#: Column with the hash bucket of a row, in tables whose rows lie and move by bucket.
BUCKET = "_bucket"


def newest(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in ``order``; rows with a bucket move once, by bucket, and are ranked inside it."""
    bucketed = BUCKET in rows.columns
    rows = rows.repartition(BUCKET) if bucketed else rows
    w = Window.partitionBy(*([BUCKET] if bucketed else []), key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def upsert(target: DataFrame, changes: DataFrame, key: str = "key", order: str = "updated") -> DataFrame:
    """Union of both tables with the newest row per key; at equal times a change wins."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return newest(both, key, [F.desc(order), F.desc("_new")]).drop("_new")


def missing_vectors(items: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """Keys of items that have no vector; an upsert with vectors needs this to be empty."""
    return items.join(vectors.where(F.col("embedding").isNotNull()), key, "left_anti").select(key)


def upsert_with_vectors(target: DataFrame, items: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    if not missing_vectors(items, vectors, key).isEmpty():
        raise ValueError("every item needs a vector")
    stored = items.drop("embedding").join(vectors.select(key, "embedding"), key)
    return upsert(target, stored.withColumn("description", F.coalesce("description", F.lit(""))), key)


def upsert_chunks(target: DataFrame, chunks: DataFrame) -> DataFrame:
    """Replace all chunks of the items that come with new chunks, so none goes stale."""
    cut_again = chunks.select("source_key").distinct()
    kept = target.join(cut_again, "source_key", "left_anti")
    return upsert(kept, chunks, "chunk_id")


def delete_keys(items: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return items.join(keys.select(key).distinct(), key, "left_anti")


def get_by_key(items: DataFrame, value: str, key: str = "key") -> DataFrame:
    """The row of one key, or no row."""
    return items.where(F.col(key) == value).limit(1)


PATCH_FIELDS = ["summary", "status", "priority"]


def patch_preview(items: DataFrame, patches: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """What a patch would change: ``(key, field, old, new)``. Null patch values change nothing."""
    fields = fields or [f for f in PATCH_FIELDS if f in patches.columns]
    p = patches.select("key", *[F.col(f).alias(f"_{f}") for f in fields])
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"_{f}").cast("string").alias("new"))
            for f in fields
        ]
    )
    rows = items.join(p, "key").select("key", F.explode(pairs).alias("c")).select("key", "c.*")
    return rows.where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def apply_patches(items: DataFrame, patches: DataFrame, dry_run: bool = True, fields: list[str] | None = None) -> DataFrame:
    """Patched items, or with ``dry_run`` (the default) only the preview."""
    fields = fields or [f for f in PATCH_FIELDS if f in patches.columns]
    if dry_run:
        return patch_preview(items, patches, fields)
    p = patches.select("key", *[F.col(f).alias(f"_{f}") for f in fields])
    out = items.join(p, "key", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return out.select(items.columns)


# --------------------------------------------------------------- change detection


def with_hash(items: DataFrame) -> DataFrame:
    return items.withColumn("content_hash", content_hash())


def changed_only(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items whose hash is not stored yet or differs; adds ``content_hash``."""
    stored = state.select("key", F.col("content_hash").alias("_old"))
    return (
        with_hash(items)
        .join(stored, "key", "left")
        .where(~F.col("content_hash").eqNullSafe(F.col("_old")))
        .drop("_old")
    )


def to_process(new_items: DataFrame, updated_items: DataFrame, state: DataFrame) -> DataFrame:
    """New items as they are plus updated items that really changed."""
    return with_hash(new_items).unionByName(changed_only(updated_items, state))


def tracking_rows(items: DataFrame, now: str) -> DataFrame:
    """Tracking state of processed items (needs ``content_hash``)."""
    hashed = items if "content_hash" in items.columns else with_hash(items)
    return hashed.select(
        "key",
        "content_hash",
        F.to_timestamp(F.lit(now)).alias("last_processed"),
        project_key().alias("project_key"),
        "issue_type",
        "epic_key",
        "parent_key",
        F.col("updated").alias("last_updated"),
    )


def track(tracked: DataFrame, processed: DataFrame, now: str) -> DataFrame:
    """Tracking state after a run: processed items replace their earlier rows."""
    return upsert(tracked, tracking_rows(processed, now), "key", "last_processed")


def expire(tracked: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Tracking rows processed within the last ``days`` days."""
    return tracked.where(F.col("last_processed") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def tracked_keys(tracked: DataFrame, project: str | None = None) -> DataFrame:
    rows = tracked.where(F.col("project_key") == project) if project else tracked
    return rows.select("key").distinct()


def tracked_epics(tracked: DataFrame, project: str | None = None) -> DataFrame:
    """Keys of tracked epics and all epics that tracked items refer to."""
    rows = tracked.where(F.col("project_key") == project) if project else tracked
    own = rows.where(F.lower("issue_type") == "epic").select("key")
    named = rows.select(F.col("epic_key").alias("key")).where("key is not null and key <> ''")
    return own.unionByName(named).distinct()


def project_stats(tracked: DataFrame) -> DataFrame:
    """Tracked items, first and last processing time per project."""
    return tracked.groupBy("project_key").agg(
        F.count("*").alias("items_count"),
        F.min("last_processed").alias("first_seen"),
        F.max("last_processed").alias("last_sync"),
    )


def mark_synced(sync: DataFrame, project: str, at: str) -> DataFrame:
    """Set the last sync time of one project, adding it when it is new."""
    stamp = F.to_timestamp(F.lit(at))
    mine = F.col("project_key") == project
    marked = sync.withColumn("last_sync", F.when(mine, stamp).otherwise(F.col("last_sync")))
    fresh = (
        sync.agg(F.count_if(mine).alias("n"))
        .where("n = 0")
        .select(
            F.lit(project).alias("project_key"),
            stamp.alias("last_sync"),
            F.lit(0).cast("bigint").alias("items_count"),
            stamp.alias("first_seen"),
        )
    )
    return marked.unionByName(fresh)


def incremental_updates(items: DataFrame, tracked: DataFrame, project: str, last_sync: str) -> DataFrame:
    """Items of a project updated since the last sync that are epics or hang on tracked rows."""
    recent = for_project(items, project).where(F.col("updated") >= F.to_timestamp(F.lit(last_sync)))
    links = recent.select("key", "epic_key", "parent_key").where("epic_key is not null or parent_key is not null")
    epics = tracked_epics(tracked).select(F.col("key").alias("epic_key"))
    parents = tracked_keys(tracked).select(F.col("key").alias("parent_key"))
    # only keys and links move to meet the tracked rows, the whole rows once to meet what was found
    hanging = links.join(epics, "epic_key", "left_semi").unionByName(links.join(parents, "parent_key", "left_semi"))
    link = F.struct(F.col("epic_key").alias("epic"), F.col("parent_key").alias("parent"))
    hanging = hanging.groupBy("key").agg(F.collect_set(link).alias("_links"))
    same = lambda x: x["epic"].eqNullSafe(F.col("epic_key")) & x["parent"].eqNullSafe(F.col("parent_key"))
    kept = (F.col("issue_type") == "Epic") | F.exists("_links", same)
    # by the key alone, as later joins of these rows
    return recent.join(hanging, "key", "left").where(kept).select(recent.columns)


def state_stats(tracked: DataFrame) -> DataFrame:
    """Tracked rows, projects, and the time span of the state."""
    return tracked.agg(
        F.count("*").alias("tracked_items"),
        F.count_distinct("project_key").alias("projects_tracked"),
        F.min("last_processed").alias("first_processed"),
        F.max("last_processed").alias("last_processed"),
    )
