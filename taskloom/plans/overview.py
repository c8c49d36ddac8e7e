"""Reports over projects and epics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators import similarity
from taskloom.operators.filters import for_projects
from taskloom.operators.neighbours import CELL_ROWS


def duplicates_of_projects(
    items: DataFrame,
    projects: list[str],
    threshold: float = 0.7,
    k: int = 20,
    levels: dict | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Duplicate report over chosen projects."""
    chosen = for_projects(items, projects)
    return similarity.duplicate_report(similarity.duplicate_pairs(chosen, threshold, k, levels, cell_rows), chosen)


def epic_overview(items: DataFrame, threshold: float = 0.65, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per epic: items, misplaced items, coherence and analysis cost."""
    quality = similarity.epic_coherence(items).select(
        "epic_key", F.col("work_items_count").alias("n_items"), "coherence_score"
    )
    moved = (
        similarity.misplaced(items, threshold, cell_rows=cell_rows)
        .groupBy(F.col("current_epic_key").alias("epic_key"))
        .agg(F.count("*").alias("misplaced_count"))
    )
    return quality.join(moved, "epic_key", "left").select(
        "epic_key",
        "n_items",
        F.coalesce("misplaced_count", F.lit(0)).alias("misplaced_count"),
        "coherence_score",
        (F.col("n_items") * similarity.COST_PER_COMPARED_ITEM).alias("cost"),
    )
