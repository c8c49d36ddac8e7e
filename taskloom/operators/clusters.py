"""Density clusters on vectors and the technical-debt report built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.functions import debt
from taskloom.operators.neighbours import CELL_ROWS, linked_components, top_k
from taskloom.operators.ranks import percentile_linear, with_position
from taskloom.session import cut_lineage

DEFAULT_EPS = 0.3


def nearest_distance(items: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Cosine distance of every item to its nearest other item: ``(key, distance)``.

    The best two hits of an item hold the item itself or, for a vector with many copies,
    two other copies; the first hit that is another item gives the distance.
    """
    queries = items.select(F.col("key").alias("query_key"), "embedding")
    hits = top_k(queries, items, 2, None, query_id="query_key", cell_rows=cell_rows)
    others = hits.where(F.col("query_key") != F.col("key"))
    return others.groupBy(F.col("query_key").alias("key")).agg(
        F.round(F.lit(1.0) - F.max("score"), 12).alias("distance")
    )


def auto_eps(items: DataFrame, q: float = 0.75, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: the interpolated quantile of the nearest-neighbour distance, 0.3 without any."""
    eps = percentile_linear(nearest_distance(items, cell_rows), "distance", q)
    return eps.agg(F.coalesce(F.max("distance"), F.lit(DEFAULT_EPS)).alias("eps"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component: ``(node, root)`` for every node of ``edges``.

    Alternating star contraction: larger neighbours are linked to the smallest one around
    a node, then smaller ones; edges never grow and the loop ends after few rounds. Every
    round is written to the shared checkpoint folder.
    """
    current = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    previous = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b"))
        roots = least.select("a", F.col("m").alias("b"))
        current = cut_lineage(small.unionByName(roots).distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if previous == tuple(state):
            break
        previous = tuple(state)
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    centres = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.unionByName(centres)


def density_clusters(
    items: DataFrame, eps: float, metric: str = "cosine", min_samples: int = 2, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Density clusters with two samples as the minimum: ``(key, cluster_id)``.

    With ``min_samples`` 2 every point that has a neighbour is a core point, so clusters
    are the connected components of the graph ``distance <= eps``; lonely points are noise.
    Clusters are numbered by their smallest key. Copies of a vector are handled as one
    node; ``eps`` 0 joins copies only.
    """
    if min_samples != 2:
        raise ValueError("density_clusters is exact for min_samples=2 only")
    rows = items.where(F.col("embedding").isNotNull()).select("key", F.col("embedding").cast("array<double>").alias("v"))
    if metric == "cosine" and eps < 1:
        # a zero vector is at distance 1 from everything, its copies included
        rows = rows.where(F.exists("v", lambda x: x != 0))
    nodes = cut_lineage(rows.groupBy("v").agg(F.min("key").alias("id"), F.count("*").alias("copies")))
    if eps > 0:
        roots = connected_components(linked_components(nodes, eps, metric=metric, cell_rows=cell_rows))
        nodes = nodes.join(roots, nodes.id == roots.node, "left").drop("node")
    else:
        nodes = nodes.withColumn("root", F.lit(None).cast("string"))
    clustered = nodes.withColumn("root", F.coalesce("root", F.when(F.col("copies") > 1, F.col("id")))).where(
        "root is not null"
    )
    numbers = with_position(clustered.select("root").distinct(), ["root"], "n")
    numbered = clustered.join(numbers, "root").select("v", (F.col("n") - 1).alias("cluster_id"))
    return rows.join(numbered, "v").select("key", "cluster_id")


def debt_candidates(
    items: DataFrame,
    seeds: DataFrame,
    project: str | None = None,
    k: int = 50,
    threshold: float = 0.6,
    terms: list[str] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Items near a seed phrase that also look like technical debt, once each.

    ``seeds`` has ``(seed_id, embedding)``; the vectors stand for the seed phrases.
    """
    hits = top_k(seeds, items, k, threshold, query_id="seed_id", cell_rows=cell_rows)
    found = items.join(hits.select("key").distinct(), "key", "left_semi")
    if project:
        found = found.where(F.col("key").startswith(project))
    return found.where(debt.is_debt_b(terms=terms))


def debt_clusters(
    items: DataFrame,
    eps: float | None = None,
    priority=None,
    effort=None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Long cluster report: one row per clustered item with its cluster's theme and scores.

    Without a scorer the theme, impact and approach are the standard texts; priority is the
    mean and effort the most common value of the items of a cluster.
    """
    if eps is None:
        eps = auto_eps(items, cell_rows=cell_rows).first()[0]
    members = density_clusters(items, eps, cell_rows=cell_rows)
    priority = priority if priority is not None else debt.debt_priority_b()
    effort = effort if effort is not None else debt.effort_b("description")
    scored = members.join(items, "key").select("key", "cluster_id", priority.alias("p"), effort.alias("e"))
    by_effort = scored.groupBy("cluster_id", "e").agg(F.count("*").alias("n"), F.sum("p").alias("sp"))
    summary = by_effort.groupBy("cluster_id").agg(
        F.sum("n").alias("n_items"),
        (F.sum("sp") / F.sum("n")).alias("priority_score"),
        F.max_by("e", F.struct("n", "e")).alias("estimated_effort"),
    )
    return members.join(summary, "cluster_id").select(
        "cluster_id",
        "key",
        F.format_string("Tech Debt Cluster %d", "cluster_id").alias("theme"),
        "priority_score",
        "estimated_effort",
        F.lit("Medium impact if not addressed").alias("impact_assessment"),
        F.lit("Address items in order of priority").alias("recommended_approach"),
        "n_items",
    )
