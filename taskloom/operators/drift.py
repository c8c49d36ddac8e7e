"""Scope drift of descriptions over time and evolution of epics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions import vector as V
from taskloom.functions.pairs import cases
from taskloom.operators.ranks import with_totals

# Similarity below which a change is a drift event, and the weights of events.
DRIFT_BELOW = 0.7
IMPACT_WEIGHTS = {"minor": 0.5, "moderate": 1.0, "major": 2.0}
TYPE_WEIGHTS = {"expansion": 1.2, "reduction": 1.0, "pivot": 2.0, "clarification": 0.3, "refactor": 0.5}
COST_WITH_HISTORY, COST_WITHOUT = 0.05, 0.01


def version_pairs(history: DataFrame, bucket: str = "month", columns: tuple[str, ...] = ("description",)) -> DataFrame:
    """Each version with the one before it: ``old_<column>`` and ``new_<column>`` per column.

    The predecessor is looked up inside (key, time bucket); only the first row of a bucket
    takes the last row of the key's previous bucket. A key with very many versions is thus
    split over its buckets. Versions of one instant are ordered by the columns, then by author,
    whatever the bucket. The first version of a key is not in the result.
    """
    keep = ["author", *columns]
    rows = history.select("key", "ts", *keep).withColumn("_b", F.date_trunc(bucket, "ts"))
    order = ["ts", *columns, "author"]
    last = F.struct(*order)
    w = Window.partitionBy("key", "_b").orderBy(*order)
    placed = rows.withColumn("_rn", F.row_number().over(w))
    for c in columns:
        placed = placed.withColumn(f"old_{c}", F.lag(c).over(w))
    later = placed.where("_rn > 1")
    ends = rows.groupBy("key", "_b").agg(F.max(last).alias("_end"))
    before = ends.select("key", "_b", F.lag("_end").over(Window.partitionBy("key").orderBy("_b")).alias("_prev")).where(
        "_prev is not null"
    )
    firsts = placed.where("_rn = 1").drop(*[f"old_{c}" for c in columns]).join(before, ["key", "_b"])
    for c in columns:
        firsts = firsts.withColumn(f"old_{c}", F.col(f"_prev.{c}"))
    out = ["key", "ts", "author"]
    named = [F.col(f"old_{c}") for c in columns] + [F.col(c).alias(f"new_{c}") for c in columns]
    return later.select(*out, *named).unionByName(firsts.select(*out, *named))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the lower-case word sets of two texts."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"(?U)\W+"), lambda w: w != ""))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def drift_events(pairs: DataFrame, similarity: Column | None = None, changes: DataFrame | None = None) -> DataFrame:
    """Changes between non-empty versions whose similarity is below the limit.

    ``similarity`` defaults to the token overlap of the descriptions; pass
    ``cosine("old_embedding", "new_embedding")`` when versions carry vectors. ``changes``
    may hold a scorer's verdicts ``(key, ts, change_type, impact_level)``.
    """
    old, new = F.col("old_description"), F.col("new_description")
    score = similarity if similarity is not None else token_overlap(old, new)
    filled = (F.length(old) > 0) & (F.length(new) > 0)
    events = (
        pairs.where(filled)
        .withColumn("similarity_score", score)
        .where(F.col("similarity_score") < DRIFT_BELOW)
        .select("key", "ts", F.col("author").alias("changed_by"), "similarity_score")
    )
    if changes is not None:
        events = events.join(changes.select("key", "ts", "change_type", "impact_level"), ["key", "ts"], "left")
    else:
        events = events.withColumn("change_type", F.lit(None).cast("string")).withColumn(
            "impact_level", F.lit(None).cast("string")
        )
    return events.withColumn("change_type", F.coalesce("change_type", F.lit("unknown"))).withColumn(
        "impact_level", F.coalesce("impact_level", F.lit("moderate"))
    )


def event_weight() -> Column:
    impact = cases([(F.col("impact_level") == k, v) for k, v in IMPACT_WEIGHTS.items()], 1.0)
    kind = cases([(F.col("change_type") == k, v) for k, v in TYPE_WEIGHTS.items()], 1.0)
    return (1.0 - F.col("similarity_score")) * impact * kind


def drift_score(events: DataFrame) -> DataFrame:
    """Mean weighted drift per key, at most 1."""
    return events.groupBy("key").agg(
        F.least(F.lit(1.0), F.avg(event_weight())).alias("overall_drift_score"), F.count("*").alias("drift_events")
    )


def scope_drift(history: DataFrame, events: DataFrame) -> DataFrame:
    """One row per key: versions, events, drift flag, score and analysis cost."""
    sizes = history.groupBy("key").agg(F.count("*").alias("total_changes"))
    return (
        sizes.join(drift_score(events), "key", "left")
        .withColumn("drift_events", F.coalesce("drift_events", F.lit(0)))
        .withColumn("overall_drift_score", F.coalesce("overall_drift_score", F.lit(0.0)))
        .withColumn("has_drift", F.col("drift_events") > 0)
        .withColumn("analysis_cost", F.when(F.col("total_changes") < 2, COST_WITHOUT).otherwise(COST_WITH_HISTORY))
    )


def scope_drift_batch(
    history: DataFrame,
    project: str | None = None,
    start: str | None = None,
    end: str | None = None,
    similarity: Column | None = None,
) -> DataFrame:
    """One row over all items of a project and period: items, drifting items, events, cost, failures.

    An analysis has failed where the similarity of two filled versions of the item is null.
    """
    rows = history
    if project:
        rows = rows.where(F.col("key").startswith(f"{project}-"))
    if start:
        rows = rows.where(F.col("ts") >= F.to_timestamp(F.lit(start)))
    if end:
        rows = rows.where(F.col("ts") <= F.to_timestamp(F.lit(end)))
    pairs = version_pairs(rows)
    old, new = F.col("old_description"), F.col("new_description")
    score = similarity if similarity is not None else token_overlap(old, new)
    failed = pairs.where((F.length(old) > 0) & (F.length(new) > 0) & score.isNull()).select("key", F.lit(1).alias("_failed"))
    per_key = scope_drift(rows, drift_events(pairs, similarity)).join(failed.distinct(), "key", "left")
    return per_key.agg(
        F.count("*").alias("total_items_processed"),
        F.count_if("has_drift").alias("items_with_drift"),
        F.coalesce(F.sum("drift_events"), F.lit(0)).alias("drift_events"),
        F.coalesce(F.sum("analysis_cost"), F.lit(0.0)).alias("total_cost"),
        F.count("_failed").alias("failed_analyses"),
    )


def epic_weeks(snapshots: DataFrame) -> DataFrame:
    """Coherence, size, items added and removed per epic and snapshot.

    ``snapshots`` has ``(epic_key, snap, key, embedding)`` with consecutive integers in
    ``snap``. Coherence is the mean cosine of the items to their centroid. Added and
    removed items are counted by equi-joins with the neighbour snapshot, so no item list
    is gathered.
    """
    unit = V.unit("embedding")
    sums = snapshots.groupBy("epic_key", "snap").agg(
        F.count("*").alias("n_items"), V.mean_vector("embedding").alias("c"), V.sum_vector(unit).alias("s")
    )
    coherence = sums.select(
        "epic_key", "snap", "n_items", (V.dot(V.unit("c"), F.col("s")) / F.col("n_items")).alias("coherence")
    )
    present = snapshots.select("epic_key", "snap", "key").distinct()
    shift = lambda d: present.select("epic_key", (F.col("snap") + d).alias("snap"), "key")
    count = lambda df, name: df.groupBy("epic_key", "snap").agg(F.count("*").alias(name))
    on = ["epic_key", "snap", "key"]
    first = snapshots.agg(F.min("snap").alias("_first"))
    fresh = count(present.join(shift(1), on, "left_anti"), "items_added")
    gone = count(shift(1).join(present, on, "left_anti"), "items_removed")
    zero = F.lit(0)
    return (
        with_totals(coherence, first)
        .join(fresh, ["epic_key", "snap"], "left")
        .join(gone, ["epic_key", "snap"], "left")
        .select(
            "epic_key",
            "snap",
            "n_items",
            "coherence",
            F.when(F.col("snap") == F.col("_first"), zero).otherwise(F.coalesce("items_added", zero)).alias("items_added"),
            F.coalesce("items_removed", zero).alias("items_removed"),
        )
    )


def epic_evolution(snapshots: DataFrame) -> DataFrame:
    """Per epic: first and last coherence, items added and removed, theme stability.

    Stability is 1 minus the population deviation of the coherence over the snapshots,
    clamped to 0..1.
    """
    weeks = epic_weeks(snapshots)
    out = weeks.groupBy("epic_key").agg(
        F.count("*").alias("snapshots"),
        F.min_by("coherence", "snap").alias("first_coherence"),
        F.max_by("coherence", "snap").alias("last_coherence"),
        F.sum("items_added").alias("items_added"),
        F.sum("items_removed").alias("items_removed"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.stddev_pop("coherence"))).alias("theme_stability"),
    )
    change = F.col("last_coherence") - F.col("first_coherence")
    return out.withColumn("coherence_trend", cases([(change > 0.05, "improving"), (change < -0.05, "declining")], "stable"))
