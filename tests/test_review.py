"""Copies and mixed widths in vector search, ties in histories, whole prompts and templates."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from taskloom.operators import hierarchy, prompts, templates
from taskloom.operators.drift import version_pairs
from taskloom.operators.neighbours import top_k


@pytest.mark.parametrize("cell", [16, 64])
def test_top_k_among_copies(spark, cell):
    vectors = [[1.0, 0.0], [0.9, 0.1], [0.5, 0.5], [0.0, 1.0], [-1.0, 0.2]]
    rows = [(f"K{i:05d}", vectors[i % 5]) for i in range(3000)]
    items = spark.createDataFrame(rows, "key string, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = top_k(queries, items, 3, cell_rows=cell).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [("K00000", 1.0), ("K00005", 1.0), ("K00010", 1.0)]


def test_top_k_of_mixed_widths(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, None])]
    items = spark.createDataFrame(rows, "key string, embedding array<double>")
    got = top_k(items.withColumnRenamed("key", "query_id"), items, 4).collect()
    score = {(r["query_id"], r["key"]): r["score"] for r in got}
    assert score["a", "b"] == score["b", "c"] == 0.0 and score["b", "b"] == 1.0
    assert score["a", "d"] == 1.0 and score["c", "d"] == 0.0


@pytest.mark.parametrize("bucket", ["month", "year"])
def test_versions_of_one_instant(spark, bucket):
    at = datetime(2024, 1, 31, 23, 59)
    rows = [("k", at, "z", "aaa"), ("k", at, "a", "bbb"), ("k", datetime(2024, 2, 1), "m", "ccc")]
    got = version_pairs(spark.createDataFrame(rows, "key string, ts timestamp, author string, description string"), bucket)
    assert {(r["old_description"], r["new_description"]) for r in got.collect()} == {("aaa", "bbb"), ("bbb", "ccc")}


def test_prompts_show_every_member(spark, items):
    one = items.where("key = 'PROJ-1'")
    many = one.crossJoin(spark.range(60).select(F.format_string("P-%03d", "id").alias("k"))).drop("key").withColumnRenamed("k", "key")
    members = many.select(F.lit(1).alias("cluster_id"), "key")
    got = prompts.cluster_prompts(members, many).orderBy("part").collect()
    assert [r["part"] for r in got] == [0, 1] and all("60 related items" in r["prompt"] for r in got)
    text = "".join(r["prompt"] for r in got)
    assert all(f"P-{k:03d}" in text for k in range(60))
    assert prompts.template_prompts(many).count() == 12


def test_tree_counts_all_children(spark, items):
    rows = items.where("key = 'PROJ-E1'").unionByName(
        items.where("key = 'PROJ-1'").crossJoin(spark.range(70).select(F.format_string("P-%03d", "id").alias("k"))).drop("key").withColumnRenamed("k", "key")
    )
    tree = hierarchy.context_tree(spark.createDataFrame([("PROJ-E1",)], "key string"), rows).first()
    assert len(tree["child_keys"]) == 50 and tree["total_items"] == 71


def test_fallback_templates_are_the_fixed_ones():
    assert templates.DESCRIPTION_TEMPLATES["Task"].startswith("## Description\n{task_description}\n\n## Requirements\n- ")
    assert "\n\n{description}\n\n" in templates.OTHER_DESCRIPTION


def test_incremental_updates_of_the_snapshots(spark, tmp_path):
    """Filters that Spark infers from the snapshots' key numbers meet epic keys without a number."""
    import __spark_entry__ as entry

    sf = str(tmp_path)
    rows = [(n, f"text {n}", "en", "web" if n % 2 else "n", 6) for n in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    found = entry.queries()["J10_incremental_updates"](spark, sf).collect()
    assert {r["key"] for r in found} == {f"DOC-{n}" for n in range(360, 700)} and len(found) == 340
