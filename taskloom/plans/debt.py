"""Technical debt as one flow: seed phrases, candidates, clusters, and a model's view of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.operators import clusters, prompts
from taskloom.operators.neighbours import CELL_ROWS
from taskloom.session import cut_lineage
from taskloom.sources import store

ANSWERS = T.StructType(
    [T.StructField("prompt_hash", T.StringType()), T.StructField("content", T.StringType()), T.StructField("cost", T.DoubleType())]
)


def answers(asked: DataFrame, scorer: prompts.PromptScorer, path: str, tries: int = 3) -> DataFrame:
    """Stored answers ``(prompt_hash, content, cost)`` to ``asked (prompt)``; only new prompts reach the scorer.

    Each distinct prompt is asked once, up to ``tries`` times. What is answered is kept below ``path``, so a
    repeated or continued run pays for the rest only; a prompt that fails every time is not stored.
    """
    spark = asked.sparkSession
    hashed = asked.select(F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"), "prompt").dropDuplicates(["prompt_hash"])
    known = store.load_table(spark, path, ANSWERS)
    fresh = hashed.join(known.select("prompt_hash"), "prompt_hash", "left_anti")
    scored = prompts.score_prompts(fresh, prompts.retrying(scorer, tries), key="prompt_hash").where(F.col("content").isNotNull())
    store.change_table(cut_lineage(scored), path, "prompt_hash", lambda old, new: old.unionByName(new), ANSWERS)
    return store.load_table(spark, path, ANSWERS).join(hashed.select("prompt_hash"), "prompt_hash", "left_semi")


def debt_report(
    items: DataFrame,
    seeds: DataFrame,
    scorer: prompts.PromptScorer | None = None,
    path: str | None = None,
    eps: float | None = None,
    project: str | None = None,
    k: int = 50,
    threshold: float = 0.6,
    terms: list[str] | None = None,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The cluster report of the debt candidates that ``seeds`` find, one row per clustered item.

    With a scorer and a folder for its answers, a cluster's theme, priority, effort, impact and approach come
    from the answer to its first prompt that is JSON, and its missing fields from the defaults of
    ``parse_cluster``; clusters without such an answer keep the values of the report without a scorer. Large
    clusters take several prompts, ``cost`` is the sum over them.
    """
    found = cut_lineage(clusters.debt_candidates(items, seeds, project, k, threshold, terms, cell_rows))
    report = cut_lineage(clusters.debt_clusters(found, eps, cell_rows=cell_rows))
    if scorer is None:
        return report.withColumn("cost", F.lit(0.0))
    asked = cut_lineage(prompts.cluster_prompts(report.select("cluster_id", "key"), found))
    named = asked.select("cluster_id", "part", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_hash"))
    replies = named.join(answers(asked.select("prompt"), scorer, path), "prompt_hash")
    spent = replies.groupBy("cluster_id").agg(F.sum("cost").alias("cost"))
    usable = replies.where(F.try_parse_json("content").isNotNull()).groupBy(F.col("cluster_id").alias("key"))
    parsed = prompts.parse_cluster(usable.agg(F.min_by("content", "part").alias("content"), F.sum("cost").alias("cost")))
    fields = ["theme", "priority_score", "estimated_effort", "impact_assessment", "recommended_approach"]
    parsed = parsed.select(F.col("key").alias("cluster_id"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = report.join(parsed, "cluster_id", "left").join(spent, "cluster_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return out.withColumn("cost", F.coalesce("cost", F.lit(0.0)))
