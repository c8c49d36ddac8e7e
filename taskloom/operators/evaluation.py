"""Retrieval quality: smoke test, precision and recall, regression, consistency, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions import vector as V
from taskloom.functions.pairs import cases
from taskloom.operators.labels import contains_pairs
from taskloom.operators.neighbours import CELL_ROWS, top_k
from taskloom.operators.ranks import with_max_before, with_totals

# Search limits, pass marks, weights.
SEARCH_THRESHOLD = 0.3
SHOWN, SEARCHED = 5, 10
PASS_F1 = 0.5
REGRESSION_DROP = -0.05
CONSISTENT_ABOVE = 0.99
WEIGHTS_A = {"f1": 0.6, "consistency": 0.2, "reproducibility": 0.1, "regression": 0.1}


def _join_rules(*rules: Column, otherwise: str) -> Column:
    out = F.array_compact(F.array(*rules))
    return F.when(F.size(out) == 0, F.array(F.lit(otherwise))).otherwise(out)


# -------------------------------------------------------------------- smoke test


def smoke_test(queries: DataFrame, items: DataFrame, threshold: float = SEARCH_THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per query: hits in the top 5, mean score, pass mark and the three best keys."""
    hits = top_k(queries, items, SHOWN, threshold, cell_rows=cell_rows)
    per = hits.groupBy("query_id").agg(
        F.count("*").alias("results_count"),
        F.avg("score").alias("avg_similarity"),
        # at most five hits per query
        F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("hs"),
    )
    out = queries.select("query_id").join(per, "query_id", "left")
    n = F.coalesce("results_count", F.lit(0))
    mean = F.coalesce("avg_similarity", F.lit(0.0))
    return out.select(
        "query_id",
        n.alias("results_count"),
        mean.alias("avg_similarity"),
        ((n > 0) & (mean > 0.3)).alias("passed"),
        F.coalesce(F.transform(F.slice("hs", 1, 3), lambda h: h["key"]), F.array().cast("array<string>")).alias("top_keys"),
    )


def smoke_report(results: DataFrame) -> DataFrame:
    """One row: tests, passes, score in percent, recommendations."""
    out = results.agg(
        F.count("*").alias("total_tests"),
        F.count_if("passed").alias("passed_tests"),
        F.count_if(F.col("results_count") == 0).alias("empty"),
        F.count_if(F.col("avg_similarity") < 0.3).alias("low"),
        F.sum("results_count").alias("found"),
    )
    score = F.when(F.col("total_tests") > 0, F.col("passed_tests") / F.col("total_tests") * 100).otherwise(0.0)
    rules = _join_rules(
        F.when(
            score < 50, "Overall quality is poor - consider re-generating embeddings with different parameters"
        ).when(score < 70, "Quality is moderate - some queries may need refinement"),
        F.when(
            F.col("empty") > 0,
            F.format_string("%d queries returned no results - consider adding more diverse work items", "empty"),
        ),
        F.when(
            F.col("low") > 0,
            F.format_string("%d queries had low similarity scores - embedding model may need tuning", "low"),
        ),
        F.when(
            F.col("found") < F.col("total_tests") * 2,
            "Limited search results suggest sparse data - consider adding more work items",
        ),
        otherwise="Embedding quality looks good - no specific improvements needed",
    )
    return out.select("total_tests", "passed_tests", score.alias("overall_score"), rules.alias("recommendations"))


# ------------------------------------------------------------ precision and recall


def retrieval_metrics(
    queries: DataFrame,
    expected: DataFrame,
    items: DataFrame,
    threshold: float = SEARCH_THRESHOLD,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Precision, recall and F1 per query.

    ``queries`` has ``(query_id, embedding, minimum_similarity)``, ``expected`` the pairs
    ``(query_id, key)``. Found are the distinct keys among the five best of ten hits.
    ``min_similarity_met`` asks every expected hit of the ten for the minimum, and is
    false when none of them is among the five.
    """
    hits = top_k(queries.select("query_id", "embedding"), items, SEARCHED, threshold, cell_rows=cell_rows)
    wanted = expected.select("query_id", "key").distinct().withColumn("is_expected", F.lit(True))
    minimum = queries.select("query_id", "minimum_similarity")
    marked = hits.join(wanted, ["query_id", "key"], "left").join(minimum, "query_id")
    hit = F.coalesce("is_expected", F.lit(False))
    top = F.col("rank") <= SHOWN
    found = marked.groupBy("query_id").agg(
        F.count("*").alias("total_results"),
        F.count_distinct(F.when(top, F.col("key"))).alias("found"),
        F.count_distinct(F.when(top & hit, F.col("key"))).alias("relevant_results"),
        F.coalesce(F.bool_and(F.when(hit, F.col("score") >= F.col("minimum_similarity"))), F.lit(False)).alias("all_met"),
    )
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = queries.select("query_id").join(found, "query_id", "left").join(sizes, "query_id", "left")
    out = out.select(
        "query_id",
        zero("total_results").alias("total_results"),
        zero("relevant_results").alias("relevant_results"),
        F.when(zero("found") > 0, zero("relevant_results") / F.col("found")).otherwise(0.0).alias("precision"),
        F.when(zero("n_expected") > 0, zero("relevant_results") / F.col("n_expected")).otherwise(0.0).alias("recall"),
        (F.coalesce("all_met", F.lit(False)) & (zero("relevant_results") > 0)).alias("min_similarity_met"),
    )
    both = F.col("precision") + F.col("recall")
    return out.withColumn(
        "f1_score", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    )


def metrics_report(metrics: DataFrame) -> DataFrame:
    """One row: mean F1, passed tests, number of tests, cost."""
    return metrics.agg(
        F.coalesce(F.avg("f1_score"), F.lit(0.0)).alias("overall_f1_score"),
        F.count_if(F.col("f1_score") > PASS_F1).alias("passed_tests"),
        F.count("*").alias("total_tests"),
        (F.count("*") * 0.01).alias("processing_cost"),
    )


# ------------------------------------------------------- regression, consistency, health


def regression(reports: DataFrame) -> DataFrame:
    """Each report against the best F1 of strictly earlier ones; ``reports`` has ``(ts, f1)``.

    A report history is one row per quality run; its prefix maximum is found range by range.
    """
    change = F.col("f1") - F.col("baseline_f1")
    timed = reports.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    return (
        with_max_before(timed, "_at", "f1", "baseline_f1")
        .drop("_at")
        .withColumn("change", F.coalesce(change, F.lit(0.0)))
        .withColumn("has_regression", F.coalesce(change < REGRESSION_DROP, F.lit(False)))
    )


def consistency(vectors: DataFrame) -> DataFrame:
    """Mean pairwise cosine of the vectors of a key over repeated runs.

    The sum over pairs follows from the squared length of the summed unit vectors, so the
    pairs are not formed. ``vectors`` has ``(key, run, embedding)``; keys with one run are absent.
    """
    u = V.unit("embedding")
    sums = vectors.groupBy("key").agg(
        V.sum_vector(u).alias("s"), F.count("*").alias("n"), F.sum(V.dot(u, u)).alias("own")
    )
    mean = (V.dot(F.col("s"), F.col("s")) - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return sums.where("n >= 2").select(
        "key", F.col("n").alias("runs"), mean.alias("average_similarity"), (mean > CONSISTENT_ABOVE).alias("is_consistent")
    )


def consistency_report(per_key: DataFrame) -> DataFrame:
    return per_key.agg(
        F.coalesce(F.avg("average_similarity"), F.lit(0.0)).alias("overall_consistency"),
        F.count_if("is_consistent").alias("consistent_items"),
        F.count("*").alias("total_items"),
    )


def regression_factor(change: Column, has_regression: Column) -> Column:
    return F.when(~has_regression, 1.0).otherwise(cases([(change < -0.2, 0.5), (change < -0.1, 0.7)], 0.9))


def health_a(
    f1="f1", consistency="consistency", reproducibility="reproducibility", change="change", has_regression="has_regression"
) -> Column:
    """Weighted health in percent over the parts that are present, rounded to 0.1."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    factor = F.when(c(has_regression).isNotNull(), regression_factor(c(change), c(has_regression)))
    parts = {"f1": c(f1), "consistency": c(consistency), "reproducibility": c(reproducibility), "regression": factor}
    total = sum(F.when(p.isNotNull(), WEIGHTS_A[n]).otherwise(0.0) for n, p in parts.items())
    score = sum(F.coalesce(p, F.lit(0.0)) * WEIGHTS_A[n] for n, p in parts.items())
    return F.round(F.when(total > 0, score / total * 100).otherwise(0.0), 1)


def health_b(f1="f1", consistency="consistency", has_regression="has_regression") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    raw = (c(f1) * 0.5 + c(consistency) * 0.3) * F.when(c(has_regression), 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def failing_categories(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """Categories with more than one test below the pass mark: ``(category, failing)``."""
    rows = metrics.join(queries.select("query_id", "category"), "query_id")
    out = rows.groupBy("category").agg(F.count_if(F.col("f1_score") < PASS_F1).alias("failing"))
    return out.where(F.col("failing") > 1)


def quality_recommendations(report: DataFrame, failing: DataFrame) -> DataFrame:
    """Report row ``(f1, consistency, reproducibility, change, has_regression, health)`` to advice.

    The category list is as long as the list of test categories.
    """
    text = F.format_string("Review %s category tests: %d tests failing with low F1 scores.", "category", "failing")
    listed = failing.agg(F.array_sort(F.collect_list(text)).alias("by_category"))
    one = lambda c: F.array_compact(F.array(c))
    rules = F.concat(
        one(
            F.when(
                F.col("f1") < 0.5,
                "Critical: RAG quality is poor (F1 < 0.5). Improve by re-training embeddings or improving test queries.",
            ).when(
                F.col("f1") < 0.7,
                "Moderate: RAG quality needs improvement (F1 < 0.7). Enhance semantic search implementation.",
            )
        ),
        F.col("by_category"),
        one(
            F.when(
                F.col("consistency") < 0.95,
                "Critical: Embedding consistency is poor. Check embedding service stability.",
            ).when(
                F.col("consistency") < 0.99,
                "Moderate: Embedding consistency needs improvement. Consider fixed seeds or model versioning.",
            )
        ),
        one(
            F.when(
                F.col("reproducibility") < 0.9,
                "Critical: Analysis results are not reproducible. Check for non-deterministic components.",
            )
        ),
        one(
            F.when(
                F.col("has_regression"),
                F.format_string(
                    "Regression detected: F1 score decreased by %.2f. Review recent changes.", F.abs(F.col("change"))
                ),
            )
        ),
        one(
            F.when(
                F.col("health") < 60,
                "General: System quality is poor. Consider a comprehensive review of embedding and RAG components.",
            ).when(
                F.col("health") < 75,
                "General: System quality is acceptable but could be improved. Focus on specific failing tests.",
            )
        ),
    )
    good = F.array(F.lit("System quality is good. No specific improvements needed."))
    return with_totals(report, listed).select(
        *report.columns, F.when(F.size(rules) == 0, good).otherwise(rules).alias("recommendations")
    )


def coverage(queries: DataFrame, categories: DataFrame) -> DataFrame:
    """Tests per category against the required number: ``(category, current, required, missing)``."""
    counts = queries.groupBy("category").agg(F.count("*").alias("current"))
    n = F.coalesce("current", F.lit(0))
    return categories.join(counts, "category", "left").select(
        "category",
        n.alias("current"),
        F.col("min_coverage").alias("required"),
        F.greatest(F.lit(0), F.col("min_coverage") - n).alias("missing"),
    )


def trend_b(series: DataFrame, value: str, order: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Mean of the last three values against that of the first three, per group."""
    by = by or []
    up = Window.partitionBy(*by).orderBy(F.col(order).asc())
    down = Window.partitionBy(*by).orderBy(F.col(order).desc())
    first = series.withColumn("_n", F.row_number().over(up)).where("_n <= 3").select(*by, "_n", F.col(value).alias("_first"))
    last = series.withColumn("_n", F.row_number().over(down)).where("_n <= 3").select(*by, F.col(value).alias("_last"))
    # each side has three rows a group, whatever the length of the series
    sides = first.unionByName(last, allowMissingColumns=True)
    change = F.avg("_last") - F.avg("_first")
    return sides.groupBy(*by).agg(
        cases([(F.count("_n") < 2, "stable"), (change > 0.05, "improving"), (change < -0.05, "declining")], "stable").alias(
            "trend"
        )
    )


def quality_trends(reports: DataFrame, keep: int = 10) -> DataFrame:
    """Trends of health, F1 and consistency over the last ``keep`` reports."""
    w = Window.orderBy(F.desc("ts"))
    last = reports.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")
    names = {"health": "health_score_trend", "f1": "f1_score_trend", "consistency": "consistency_trend"}
    long = last.select(
        "ts", F.explode(F.array(*[F.struct(F.lit(t).alias("metric"), F.col(c).alias("v")) for c, t in names.items()])).alias("x")
    ).select("ts", "x.metric", "x.v")
    return trend_b(long, "v", "ts", ["metric"])


# ----------------------------------------------------------------- expected results


def refresh_expected(queries: DataFrame, items: DataFrame, limit: int = 5) -> DataFrame:
    """Expected keys for queries that have none: ``(query_id, key)``.

    The first three words longer than three characters are searched, ignoring case, in
    summary and description; the newest ``limit`` items with any of them are expected.
    """
    words = F.filter(F.split(F.lower("query_text"), r"(?U)\s+"), lambda w: F.length(w) > 3)
    wanted = queries.select("query_id", F.explode(F.slice(words, 1, 3)).alias("needle")).distinct()
    needles = wanted.select(F.col("needle").alias("needle_id"), "needle").distinct()
    text = F.lower(F.concat_ws(" ", "summary", F.coalesce("description", F.lit(""))))
    found = contains_pairs(items.select(F.col("key").alias("text_id"), text.alias("text")), needles)
    pairs = (
        wanted.join(found.withColumnRenamed("needle_id", "needle"), "needle")
        .select("query_id", F.col("text_id").alias("key"))
        .distinct()
        .join(items.select("key", "created"), "key")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("created"), "key")
    return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("query_id", "key")


def eval_queries_from_epics(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One evaluation query per epic and its expected items: (queries, expected pairs).

    The query text is the epic's summary; a scorer may replace it (prompt kind epic_query).
    """
    query_id = F.concat(F.lit("epic_"), F.lower("key"))
    queries = items.where(F.col("issue_type") == "Epic").select(
        query_id.alias("query_id"),
        F.col("summary").alias("query_text"),
        F.lit(0.5).alias("minimum_similarity"),
        F.lit("generated").alias("category"),
        F.concat(F.lit("Generated from Epic "), F.col("key")).alias("description"),
        F.col("key").alias("epic_key"),
    )
    expected = items.select("key", "epic_key").join(queries.select("query_id", "epic_key"), "epic_key").select("query_id", "key")
    return queries, expected
