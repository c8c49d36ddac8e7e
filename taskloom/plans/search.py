"""Search reports: answers with context, search in an epic, debt and dependency search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators import retrieval as R
from taskloom.operators.hierarchy import context_tree
from taskloom.operators.query_text import filter_text
from taskloom.session import cut_lineage

TREES_PER_ANSWER = 3


def _trees_of(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Context trees of the first hits of each query, in hit order."""
    first = hits.where(F.col("position") <= TREES_PER_ANSWER).select("query_id", F.col("position").alias("tree_no"), "key")
    trees = context_tree(first.select("key"), items)
    return first.join(trees, "key")


def _assembled(queries: DataFrame, hits: DataFrame, trees: DataFrame, max_tokens: int) -> DataFrame:
    final = cut_lineage(R.final_ranking(hits, queries))
    summary = R.context_summary(final, trees, queries)
    text = R.context_text(final, trees, queries, max_tokens)
    keys = final.select("query_id", "key").unionByName(trees.select("query_id", "key"))
    # a result page and three roots
    named = keys.groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    counts = final.groupBy("query_id").agg(F.count("*").alias("results_count"))
    return (
        summary.join(text, "query_id")
        .join(named, "query_id", "left")
        .join(counts, "query_id", "left")
        .withColumn("results_count", F.coalesce("results_count", F.lit(0)))
        .withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    )


def answer(
    queries: DataFrame,
    chunks: DataFrame,
    items: DataFrame,
    limit: int = 15,
    threshold: float | None = R.DEFAULT_THRESHOLD,
    include_hierarchy: bool = True,
    max_tokens: int = 8000,
) -> DataFrame:
    """One row per query: intent, filters, hits, summary, formatted context, keys."""
    hits = cut_lineage(R.semantic_search(queries, chunks, limit, threshold))
    trees = cut_lineage(_trees_of(hits, items)) if include_hierarchy else _no_trees(hits)
    asked = queries.select("query_id", "query_text", "intent", "expected_output", filter_text().alias("filters_applied"))
    return asked.join(_assembled(queries, hits, trees, max_tokens), "query_id")


def _no_trees(hits: DataFrame) -> DataFrame:
    return hits.limit(0).select(
        "key",
        "query_id",
        F.lit(1).alias("tree_no"),
        F.array().cast("array<string>").alias("child_keys"),
        F.lit(0).alias("total_items"),
    )


def search_tool(queries: DataFrame, chunks: DataFrame, items: DataFrame, limit: int = 15, threshold=R.DEFAULT_THRESHOLD) -> DataFrame:
    """Keys, totals and filters per query."""
    return answer(queries, chunks, items, limit, threshold).select(
        "query_id", "keys", "results_count", "total_items", "filters_applied"
    )


def answer_in_epic(
    queries: DataFrame,
    items: DataFrame,
    chunks: DataFrame | None = None,
    k: int = 10,
    threshold: float | None = R.DEFAULT_THRESHOLD,
    max_tokens: int = 8000,
) -> DataFrame:
    """The tree of each query's ``epic_key`` and, given chunks, the best hits inside it.

    Without chunks (a query without text) only the scope context is returned.
    """
    roots = queries.select("query_id", F.col("epic_key").alias("key")).withColumn("tree_no", F.lit(1))
    trees = cut_lineage(roots.join(context_tree(roots.select("key"), items), "key"))
    if chunks is None:
        hits = _no_hits(queries)
    else:
        hits = cut_lineage(R.search_in_epic(queries, chunks, k, threshold))
    out = _assembled(queries, hits, trees, max_tokens)
    size = trees.select("query_id", F.size("child_keys").alias("child_count"))
    return (
        queries.select("query_id", "epic_key")
        .join(out.drop("epic_key"), "query_id")
        .join(size, "query_id", "left")
        .withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    )


def _no_hits(queries: DataFrame) -> DataFrame:
    empty = queries.limit(0).select("query_id", F.lit("").alias("chunk_id"), F.lit("").alias("key"), F.lit(0.0).alias("score"))
    for name, kind in R._META.items():
        empty = empty.withColumn(name, F.lit(None).cast(kind))
    return empty.withColumn("position", F.lit(0))


def debt_search(
    queries: DataFrame, chunks: DataFrame, limit: int = 20, threshold: float | None = R.DEFAULT_THRESHOLD, max_tokens: int = 8000
) -> DataFrame:
    """Technical-debt hits per query: number, context, recommendations."""
    hits = cut_lineage(R.semantic_search(queries, chunks, limit, threshold))
    out = _assembled(queries, hits, _no_trees(hits), max_tokens)
    advice = R.debt_recommendations(R.debt_patterns(hits))
    return (
        queries.select("query_id", "query_text")
        .join(out, "query_id")
        .join(advice, "query_id", "left")
        .select(
            "query_id",
            "query_text",
            F.col("results_count").alias("debt_items_found"),
            "formatted_context",
            "token_count",
            F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"),
        )
    )


def dependency_search(
    queries: DataFrame, chunks: DataFrame, items: DataFrame, threshold: float | None = R.DEFAULT_THRESHOLD
) -> DataFrame:
    """Dependency map per query: context, keys and the filters the text implied."""
    return answer(queries, chunks, items, 15, threshold).select(
        "query_id", "query_text", "results_count", "formatted_context", "keys", "filters_applied"
    )
