"""The full retrieval-quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators import evaluation as E
from taskloom.operators.neighbours import CELL_ROWS
from taskloom.operators.ranks import with_totals
from taskloom.session import cut_lineage


def quality_report(
    queries: DataFrame,
    expected: DataFrame,
    items: DataFrame,
    runs: DataFrame,
    earlier: DataFrame,
    category: str | None = None,
    reproducibility: float | None = None,
    threshold: float = E.SEARCH_THRESHOLD,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """One row: F1, consistency, change against the best earlier F1, health, recommendations.

    ``runs`` are repeated vectors ``(key, run, embedding)``, ``earlier`` the report history
    ``(ts, f1)``. ``category`` restricts the tests. A reproducibility score is used when
    the caller has measured one.
    """
    asked = queries.where(F.col("category") == category) if category else queries
    metrics = cut_lineage(E.retrieval_metrics(asked, expected, items, threshold, cell_rows))
    now = E.metrics_report(metrics).select(F.col("overall_f1_score").alias("f1"), "passed_tests", "total_tests")
    steady = E.consistency_report(E.consistency(runs)).select(F.col("overall_consistency").alias("consistency"))
    best = earlier.agg(F.max("f1").alias("baseline"))
    change = F.col("f1") - F.col("baseline")
    report = (
        with_totals(with_totals(now, steady), best)
        .withColumn("change", F.coalesce(change, F.lit(0.0)))
        .withColumn("has_regression", F.coalesce(change < E.REGRESSION_DROP, F.lit(False)))
        .withColumn("reproducibility", F.lit(reproducibility).cast("double"))
        .drop("baseline")
        .withColumn("health", E.health_a())
    )
    return E.quality_recommendations(report, E.failing_categories(metrics, asked))
