"""Debt candidates, clusters and model answers as one flow."""

import json

from pyspark.sql import functions as F

from taskloom.operators import clusters
from taskloom.plans import debt


def _items(spark):
    """Two tight groups of debt items, one lonely debt item, and items that are no debt."""
    rows = []
    for i in range(12):
        angle = [1.0, 0.0, 0.01 * i] if i < 6 else [0.0, 1.0, 0.01 * i]
        rows.append((f"P-{i:02d}", f"Refactor legacy module {i}", "technical debt", "Task", angle))
    rows += [("P-90", "Refactor legacy", "technical debt", "Task", [0.6, 0.6, -0.6]), ("P-91", "New colour", "nice", "Story", [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, summary string, description string, issue_type string, embedding array<double>")
    return df.withColumn("labels", F.array().cast("array<string>")).withColumn("components", F.array().cast("array<string>"))


def _seeds(spark):
    return spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0])], "seed_id string, embedding array<double>")


def test_flow_without_a_scorer_is_the_report_of_the_candidates(spark):
    items, seeds = _items(spark), _seeds(spark)
    got = debt.debt_report(items, seeds, eps=0.05)
    found = clusters.debt_candidates(items, seeds)
    assert "P-91" not in {r.key for r in found.collect()}
    want = clusters.debt_clusters(found, 0.05)
    plain = lambda df: sorted(tuple(r) for r in df.withColumn("priority_score", F.round("priority_score", 9)).select(want.columns).collect())
    assert plain(got) == plain(want)
    assert {r.cluster_id: r.n_items for r in got.collect()} == {0: 6, 1: 6}


def test_scored_flow_is_resumed_by_prompt(spark, tmp_path):
    items, seeds, path = _items(spark), _seeds(spark), str(tmp_path / "answers")
    calls = tmp_path / "calls"

    def scorer(texts):
        """Fails at first; answers the first group well and the second with prose."""
        with open(calls, "a") as f:
            f.write("x\n")
        if len(open(calls).readlines()) == 1:
            raise OSError("busy")
        good = json.dumps({"theme": "legacy modules", "priority_score": 0.9, "estimated_effort": "Large"})
        return [(good if "P-00" in t else "sorry", 0.25) for t in texts]

    got = {r.key: r for r in debt.debt_report(items, seeds, scorer, path, eps=0.05).collect()}
    assert len(got) == 12
    one, two = got["P-00"], got["P-06"]
    assert (one.theme, one.priority_score, one.estimated_effort, one.cost) == ("legacy modules", 0.9, "Large", 0.25)
    assert one.recommended_approach == "Review and prioritize items individually"
    assert two.theme == f"Tech Debt Cluster {two.cluster_id}" and two.cost == 0.25
    assert two.recommended_approach == "Address items in order of priority"

    def never(texts):
        raise AssertionError("asked again")

    again = {r.key: r for r in debt.debt_report(items, seeds, never, path, eps=0.05).collect()}
    assert again == got


def test_a_failing_scorer_leaves_the_plain_report(spark, tmp_path):
    def broken(texts):
        raise OSError("down")

    got = debt.debt_report(_items(spark), _seeds(spark), broken, str(tmp_path / "answers"), eps=0.05)
    assert {r.theme for r in got.collect()} == {"Tech Debt Cluster 0", "Tech Debt Cluster 1"} and got.agg(F.sum("cost")).first()[0] == 0.0
