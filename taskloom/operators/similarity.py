"""Duplicates, group coherence and misplaced items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions import pairs as P
from taskloom.functions import vector as V
from taskloom.operators.neighbours import CELL_ROWS, self_top_k, top_k
from taskloom.operators.ranks import kth_smallest
from taskloom.session import cut_lineage

COST_PER_COMPARED_ITEM = 0.0001
PAIR_COLUMNS = ["summary", "issue_type", "status", "epic_key", "created", "components", "labels"]


def _self_hits(items: DataFrame, k: int, threshold: float | None, cell_rows: int) -> DataFrame:
    """Per item its best ``k`` items (the item itself counts); without the self hits."""
    if threshold is None:
        queries = items.select(F.col("key").alias("query_key"), "embedding")
        hits = top_k(queries, items, k, None, query_id="query_key", cell_rows=cell_rows)
    else:
        hits = self_top_k(items, k, threshold, cell_rows=cell_rows)
    return hits.where(F.col("query_key") != F.col("key"))


def similar_pairs(items: DataFrame, threshold: float = 0.7, k: int = 20, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Unordered pairs found from either side, named by the finder with the smallest key.

    Returns ``(original_key, similar_key, score)``.
    """
    hits = _self_hits(items, k, threshold, cell_rows)
    low, high = F.least("query_key", "key"), F.greatest("query_key", "key")
    once = hits.groupBy(low.alias("a"), high.alias("b")).agg(
        F.min("query_key").alias("original_key"), F.max("score").alias("score")
    )
    other = F.when(F.col("original_key") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    return once.select("original_key", other.alias("similar_key"), "score")


def duplicate_pairs(
    items: DataFrame,
    threshold: float = 0.7,
    k: int = 20,
    levels: dict[str, float] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Duplicate candidates with level, suggested action, review priority and reasons."""
    found = similar_pairs(items, threshold, k, cell_rows)
    side = lambda name, key: items.select(F.col("key").alias(key), F.struct(*PAIR_COLUMNS).alias(name))
    joined = found.join(side("o", "original_key"), "original_key").join(side("s", "similar_key"), "similar_key")
    level = P.similarity_level("score", levels)
    return (
        joined.withColumn("level", level)
        .where(F.col("level").isNotNull())
        .select(
            "original_key",
            "similar_key",
            "score",
            "level",
            P.suggested_action("level").alias("suggested_action"),
            P.review_priority().alias("review_priority"),
            P.similarity_reasons("score").alias("reasons"),
        )
    )


def duplicate_report(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """One row: candidates per level and in total, items analysed, cost."""
    rows = pairs.select("level", F.lit(0).alias("is_item")).unionByName(
        items.select(F.lit(None).cast("string").alias("level"), F.lit(1).alias("is_item"))
    )
    counts = [F.count_if(F.col("level") == lv).alias(f"{lv}_candidates") for lv in P.SIMILARITY_LEVELS]
    return rows.agg(
        F.count("level").alias("total_candidates"),
        *counts,
        F.sum("is_item").alias("items_analyzed"),
    ).withColumn("processing_cost", F.col("items_analyzed") * COST_PER_COMPARED_ITEM)


# ----------------------------------------------------------------- group themes


def epic_groups(items: DataFrame, min_items: int = 2) -> DataFrame:
    """Epics with at least ``min_items`` items: ``(epic_key, n_items)``."""
    sizes = items.where(F.col("epic_key").isNotNull()).groupBy("epic_key").agg(F.count("*").alias("n_items"))
    return sizes.where(F.col("n_items") >= min_items)


def centroids(items: DataFrame, by: str = "epic_key", min_items: int = 1) -> DataFrame:
    """Component-wise mean vector per group: ``(by, centroid, n_items)``."""
    with_vector = items.where(F.col(by).isNotNull() & F.col("embedding").isNotNull())
    out = with_vector.groupBy(by).agg(V.mean_vector("embedding").alias("centroid"), F.count("*").alias("n_items"))
    return out.where(F.col("n_items") >= min_items)


def coherence_to_theme(items: DataFrame, themes: DataFrame, by: str = "epic_key") -> DataFrame:
    """Mean cosine of a group's items to its theme; 0 for a theme without items.

    ``themes`` has ``(by, theme)``. The mean of ``cos(theme, x)`` is the theme's dot
    product with the summed unit vectors, so each group is one vector before the join.
    """
    sums = (
        items.where(F.col("embedding").isNotNull())
        .groupBy(by)
        .agg(V.sum_vector(V.unit("embedding")).alias("s"), F.count("*").alias("n"))
    )
    value = V.dot(V.unit("theme"), F.col("s")) / F.col("n")
    return themes.join(sums, by, "left").select(
        by, F.coalesce(value, F.lit(0.0)).alias("coherence"), F.coalesce("n", F.lit(0)).alias("n_items")
    )


def item_coherence(items: DataFrame) -> DataFrame:
    """Mean cosine of every item to the other items of its epic.

    ``sum_j cos(i, j)`` over the epic is the dot product of item i with the epic's summed
    unit vectors, so the pairs never have to be formed. Epics with one item have a null mean.
    """
    rows = items.where(F.col("epic_key").isNotNull() & F.col("embedding").isNotNull()).select(
        "key", "epic_key", V.unit("embedding").alias("u")
    )
    sums = rows.groupBy("epic_key").agg(V.sum_vector("u").alias("s"), F.count("*").alias("n"))
    own = V.dot(F.col("u"), F.col("u"))
    mean = (V.dot(F.col("u"), F.col("s")) - own) / (F.col("n") - 1)
    return rows.join(sums, "epic_key").select(
        "epic_key", "key", F.col("n").alias("n_items"), F.when(F.col("n") > 1, mean).alias("mean_similarity")
    )


def coherence_outliers(items: DataFrame, per_item: DataFrame | None = None) -> DataFrame:
    """Items whose mean similarity is below their epic's outlier threshold.

    Candidates are items below 0.5. The threshold is the candidate value at rank n // 5,
    at most 0.4, and 0.4 for fewer than five candidates; outliers lie strictly below it.
    """
    per_item = per_item if per_item is not None else item_coherence(items)
    candidates = per_item.where(F.col("mean_similarity") < 0.5).select("epic_key", "key", "mean_similarity")
    cut = kth_smallest(candidates, ["epic_key"], "mean_similarity", lambda n: F.floor(n / 5)).select(
        "epic_key", F.col("mean_similarity").alias("cut")
    )
    limit = F.least(F.lit(0.4), F.coalesce("cut", F.lit(0.4)))
    return (
        candidates.join(cut, "epic_key", "left").where(F.col("mean_similarity") < limit).drop("cut")
    )


def epic_coherence(items: DataFrame) -> DataFrame:
    """Coherence, theme consistency, outlier count and recommendations per epic.

    The outlier keys themselves are the rows of :func:`coherence_outliers`.
    """
    # read by the means and twice by the outlier threshold
    per_item = cut_lineage(item_coherence(items))
    means = per_item.groupBy("epic_key").agg(
        F.count("*").alias("work_items_count"), F.avg("mean_similarity").alias("raw")
    )
    outliers = coherence_outliers(items, per_item).groupBy("epic_key").agg(F.count("*").alias("outlier_count"))
    single = F.col("work_items_count") == 1
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    theme = F.when(single, F.lit(1.0)).otherwise((F.col("raw") + 0.2) / 1.2)
    rules = F.array_compact(
        F.array(
            F.when(F.col("raw") < 0.6, "Epic has low coherence - consider splitting or reorganizing"),
            F.when(
                F.col("outlier_count") > 0,
                F.format_string("Review %d outlier items for correct Epic assignment", "outlier_count"),
            ),
            F.when(theme < 0.5, "Epic theme is inconsistent - review work item alignment"),
        )
    )
    good = F.array(F.lit("Epic shows good coherence and theme consistency"))
    return (
        means.join(outliers, "epic_key", "left")
        .withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0)))
        .withColumn("raw_coherence", F.when(single, F.lit(1.0)).otherwise(F.col("raw")))
        .select(
            "epic_key",
            "work_items_count",
            "raw_coherence",
            clamp(F.col("raw_coherence")).alias("coherence_score"),
            clamp(theme).alias("theme_consistency"),
            "outlier_count",
            F.when(single, F.array().cast("array<string>"))
            .when(F.size(rules) == 0, good)
            .otherwise(rules)
            .alias("recommendations"),
        )
    )


# -------------------------------------------------------------- misplaced items


def cross_epic_matches(
    items: DataFrame, threshold: float = 0.65, k: int = 10, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Best ``k`` items per item, then only those of another, known epic.

    Returns ``(item_key, item_epic, match_key, match_epic, score)``.
    """
    hits = _self_hits(items.where(F.col("embedding").isNotNull()), k, threshold, cell_rows)
    epic_of = items.select("key", "epic_key")
    own = epic_of.select(F.col("key").alias("item_key"), F.col("epic_key").alias("item_epic"))
    other = epic_of.select(F.col("key").alias("match_key"), F.col("epic_key").alias("match_epic"))
    return (
        hits.select(F.col("query_key").alias("item_key"), F.col("key").alias("match_key"), "score")
        .join(other.where("match_epic is not null"), "match_key")
        .join(own.where("item_epic is not null"), "item_key")
        .where(F.col("item_epic") != F.col("match_epic"))
        .select("item_key", "item_epic", "match_key", "match_epic", "score")
    )


def misplaced(
    items: DataFrame,
    threshold: float = 0.65,
    k: int = 10,
    margin: float = 0.15,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Items that fit another epic clearly better than their own.

    Candidates are visited by score; the best epic changes only when a candidate beats the
    best so far by ``margin``, so the visiting order matters and a maximum would not do.
    """
    matches = cross_epic_matches(items, threshold, k, cell_rows)
    themes = centroids(items, min_items=2).select("epic_key", "centroid")
    vectors = items.select(F.col("key").alias("item_key"), "embedding")
    fit = V.cosine("embedding", "centroid")
    scored = (
        matches.join(vectors, "item_key")
        .join(themes.withColumnRenamed("epic_key", "match_epic"), "match_epic")
        .select("item_key", "item_epic", "match_key", "match_epic", "score", fit.alias("coherence"))
    )
    # at most k candidates per item
    candidate = F.struct((-F.col("score")).alias("by_score"), "match_key", "match_epic", "coherence")
    folded = scored.groupBy("item_key", "item_epic").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
    own = (
        items.join(themes, "epic_key")
        .select(F.col("key").alias("item_key"), fit.alias("current_coherence"))
    )
    start = F.struct(F.col("current_coherence").alias("best"), F.lit(None).cast("string").alias("epic"))
    step = lambda acc, c: F.when(
        c["coherence"] > acc["best"] + F.lit(margin),
        F.struct(c["coherence"].alias("best"), c["match_epic"].alias("epic")),
    ).otherwise(acc)
    result = folded.join(own, "item_key").withColumn("found", F.aggregate("candidates", start, step))
    return result.where(F.col("found.epic").isNotNull()).select(
        F.col("item_key").alias("work_item_key"),
        F.col("item_epic").alias("current_epic_key"),
        F.col("found.epic").alias("suggested_epic_key"),
        F.col("found.best").alias("confidence_score"),
        (F.col("found.best") - F.col("current_coherence")).alias("coherence_difference"),
        P.misplacement_reason("found.epic", "found.best", "current_coherence").alias("reasoning"),
    )
