"""Text rules, scores, chunks, prompts and responses on literal cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from taskloom.functions import debt, pairs, text
from taskloom.operators import chunking, labels, prompts, query_text, templates
from taskloom.operators.filters import validate_ranges, where_meta


def _one(spark, value, expr, name="t"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr).first()[0]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("{code:java}x{code} after", "[CODE BLOCK] after"),
        ("{quote}q\nq{quote}", "[QUOTE]"),
        ("{panel:title=a}p{panel}", "[PANEL]"),
        ("see [the docs|http://x.y] now", "see the docs now"),
        ("*bold* _it_ ^sup^ ~sub~", "bold it sup sub"),
        ("  a \n\t b  ", "a b"),
        (None, ""),
    ],
)
def test_clean_markup(spark, raw, clean):
    assert _one(spark, raw, text.clean_markup("t")) == clean


def test_embedding_text_skips_empty_parts(items):
    got = {r.key: r.e for r in items.select("key", text.embedding_text().alias("e")).collect()}
    assert got["PROJ-1"] == (
        "Title: Implement user login | Type: Story | Status: Open | Description: As a user, I want to log in | "
        "Components: auth | Labels: login | Epic: PROJ-E1"
    )
    assert got["PROJ-5"] == "Title: Sub task | Type: Sub-task | Status: Closed | Parent: PROJ-4"


def test_hash_changes_with_the_status_only_in_its_form(items):
    done = items.withColumn("status", F.lit("Done"))
    pick = lambda df, s: df.where("key = 'PROJ-1'").select(text.content_hash(s)).first()[0]
    assert pick(items, False) == pick(done, False) and pick(items, True) != pick(done, True)


def test_sentences_keep_abbreviations(spark):
    got = _one(spark, "Dr. Smith came. He saw Mr. Jones! Really? Yes. no split etc. And", text.split_sentences("t"))
    assert got == ["Dr. Smith came.", "He saw Mr. Jones!", "Really?", "Yes. no split etc. And"]


def _pack(sentences, limit, overlap):
    """Plain restatement of the packing rule."""
    out, cur = [], ""
    for s in sentences:
        if len(cur) + len(s) + 1 <= limit:
            cur = f"{cur} {s}" if cur else s
        elif cur:
            out.append(cur.strip())
            cur = f"{cur[-overlap:]} {s}" if len(cur) > overlap else s
        else:
            line = ""
            for w in s.split():
                if len(line) + len(w) + 1 <= limit:
                    line = f"{line} {w}" if line else w
                elif line:
                    out.append(line)
                    line = w
                else:
                    out.append(w[: limit - 3] + "...")
            if line:
                out.append(line)
    return out + ([cur.strip()] if cur.strip() else [])


def test_packing_equals_the_plain_rule(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgé") for _ in range(rnd.choice([1, 3, 8, 60])))
    texts = [". ".join(" ".join(word() for _ in range(rnd.choice([1, 5, 20]))).capitalize() for _ in range(12)) for _ in range(25)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", text.split_sentences("t").alias("s"), chunking.pack(text.split_sentences("t"), 50, 10).alias("p")).collect()
    for r in got:
        assert r.p == _pack(r.s, 50, 10)


def test_chunk_types_order_and_ids(spark, items):
    rows = [
        ("E", "Sum", "Goals: win big\n\nSuccess criteria: done\n\nMore text", "Epic"),
        ("S", "Sum", "As a user I want x\nAcceptance Criteria: works\n\nTail", "Story"),
        ("B", "Sum", "Symptoms: bad\n\nSteps to reproduce: click\n\nExpected behavior: good\n\nFix: patch", "Bug"),
        ("T", "Sum", "plain", "Task"),
        ("N", "", None, "Task"),
    ]
    df = spark.createDataFrame(rows, "key string, summary string, description string, issue_type string")
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    none = F.array().cast("array<string>")
    df = df.select(
        "*", F.lit("Open").alias("status"), F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("epic_key"),
        at.alias("created"), at.alias("updated"), none.alias("components"), none.alias("labels"),
    )
    got = chunking.chunk_items(df).orderBy("source_key", "chunk_index").collect()
    by = lambda k: [(r.chunk_type, r.text) for r in got if r.source_key == k]
    assert by("E") == [("epic_summary", "Sum"), ("goals", "Epic Goals: win big"), ("success_criteria", "Success Criteria: done"), ("description", "More text")]
    assert [t for t, _ in by("S")] == ["story_summary", "acceptance_criteria", "user_story", "description"]
    assert ("user_story", "User Story: As a user I want x") in by("S")
    assert [t for t, _ in by("B")] == ["bug_summary", "symptoms", "reproduction", "expected", "solution"]
    assert by("T") == [("task_summary", "Sum"), ("description", "plain")]
    assert by("N") == []
    assert all(re.fullmatch("[0-9a-f]{12}", r.chunk_id) for r in got) and len({r.chunk_id for r in got}) == len(got)
    assert {r.priority for r in got} == {"Medium"} and {r.created_month for r in got} == {"2024-01"}


def test_debt_detection_priority_and_effort(items):
    a = {r.key for r in items.where(debt.is_debt_a()).collect()}
    assert {"PROJ-3", "PROJ-4"} <= a and "PROJ-1" not in a
    b = {r.key for r in items.where(debt.is_debt_b()).collect()}
    assert b == {"PROJ-3", "PROJ-4"}
    p = {r.key: (round(r.a, 6), round(r.b, 6)) for r in items.select("key", debt.debt_priority_a().alias("a"), debt.debt_priority_b().alias("b")).collect()}
    assert p["PROJ-3"] == (0.6, 1.0) and p["PROJ-1"] == (0.0, 0.3)


@pytest.mark.parametrize(
    "description,a,b",
    [
        ("", "Unknown", "Small"),
        ("Fix typo", "Small", "Small"),
        ("Complete overhaul of the entire system architecture across multiple modules and everything", "Large", "Large"),
        ("x" * 200, "Medium", "Small"),
    ],
)
def test_effort(spark, description, a, b):
    assert _one(spark, description, debt.effort_a("t")) == a
    assert _one(spark, description, debt.effort_b("t")) == b


@pytest.mark.parametrize("score,level", [(0.95, "exact"), (0.949, "high"), (0.85, "high"), (0.7, "medium"), (0.55, "low"), (0.54, None)])
def test_levels_and_actions(spark, score, level):
    row = spark.createDataFrame([(score,)], "s double").select(
        pairs.similarity_level("s").alias("l"), pairs.suggested_action(pairs.similarity_level("s")).alias("a")
    ).first()
    assert row.l == level
    assert ("duplicate" in row.a) == (level == "exact")


def test_pair_priority_and_reasons(items):
    side = lambda key, name: items.where(F.col("key") == key).select(
        F.struct("summary", "issue_type", "status", "epic_key", "created", "components", "labels").alias(name), F.lit(1).alias("j")
    )
    both = side("PROJ-1", "o").join(side("PROJ-2", "s"), "j")
    r = both.select(pairs.review_priority().alias("p"), pairs.similarity_reasons(F.lit(0.9)).alias("why")).first()
    assert r.p == 5
    assert r.why == ["Similar titles/keywords", "Same Epic", "Shared components", "Shared labels", "High semantic similarity"]
    # two missing epics are the same epic as a reason, but give no priority point
    both = side("PROJ-4", "o").join(side("PROJ-E2", "s"), "j")
    r = both.select(pairs.review_priority().alias("p"), pairs.similarity_reasons(F.lit(0.1)).alias("why")).first()
    assert r.p == 2 and r.why == ["Same Epic"]


def test_similar_labels(spark):
    names = ["Front", "frontend", "tech debt", "debt old", "a b c d e f", "f e d", "c x", "ui", "UI kit", "zz"]
    items = spark.createDataFrame([([n],) for n in names], "labels array<string>")
    got = {(r.label_a, r.label_b) for r in labels.similar_labels(items).collect()}
    want = set()
    for a in names:
        for b in names:
            if a < b:
                x, y = a.lower(), b.lower()
                common = set(x.split()) & set(y.split())
                if x in y or y in x or (common and len(common) >= len(x.split()) // 2):
                    want.add((a, b))
    assert got == want


def test_contains_pairs_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 4])))
    texts = [" ".join(word() for _ in range(8)) for _ in range(40)]
    needles = sorted({" ".join(word() for _ in range(n)) for n in (1, 1, 1, 2, 2, 3, 4, 3, 2, 1)} | {texts[0][2:-2], "ab\ncd"})
    got = labels.contains_pairs(
        spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"),
        spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string"),
    )
    want = {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n in t}
    assert {(r.needle_id, r.text_id) for r in got.collect()} == want


def test_label_report_without_components(spark):
    items = spark.createDataFrame([(["big"], [])] * 3 + [(["once"], [])], "labels array<string>, components array<string>")
    got = {(r.kind, r.subject) for r in labels.label_report(items).collect()}
    assert got == {("cleanup", "once"), ("optimization", "components"), ("optimization", "big")}


def test_query_features(spark):
    q = spark.createDataFrame([("Show me high priority bugs from last week assigned to Bob in PROJ-9, sprint 12 and next sprint",)], "query_text string")
    r = query_text.query_features(q, "2024-03-10 00:00:00").first()
    assert (r.item_types, r.priorities, r.assignees, r.epic_keys) == (["Bug"], ["High"], ["Bob"], ["PROJ-9"])
    assert r.sprints == ["sprint 12", "next"] and str(r.date_start) == "2024-03-03 00:00:00"
    assert r.intent == "search" and r.expected_output == "list"
    assert r.full_text.startswith(r.query_text) and r.full_text.endswith("defect problem failure broken")


def test_quality_responses(spark):
    rows = [
        ("a", json.dumps({"clarity_score": 5, "completeness_score": 4, "risk_level": "Low"}), 0.1),
        ("b", "not json, HIGH RISK here", 0.2),
        ("c", json.dumps({"overall_score": 2.5}), 0.3),
    ]
    df = spark.createDataFrame(rows, "key string, content string, cost double")
    got = {r.key: r for r in prompts.parse_quality(df).collect()}
    assert got["a"].overall_score == 15 / 4 and got["a"].risk_level == "Low"
    assert got["b"].overall_score == 3 and got["b"].risk_level == "High" and got["b"].used_fallback
    assert got["c"].overall_score == 2.5 and got["c"].clarity_score == 3
    r = prompts.quality_rollup(prompts.parse_quality(df)).first()
    assert (r.processed, r.failed) == (3, 1) and r.total_cost == pytest.approx(0.6)


def test_json_in_prose(spark):
    x = lambda t: _one(spark, t, prompts.extract_json("t"))
    assert x('Sure {"a": {"b": 1}} ok').json == '{"a": {"b": 1}}'
    assert x("none").reasoning == "Failed to parse structured response"
    assert x("{broken").reasoning == "Invalid JSON response" and x("{broken").confidence == 0.5


def test_scored_prompts_and_clusters(items):
    p = prompts.build_prompts(items, "quality")
    got = prompts.score_prompts(p, lambda ps: [(str(len(t)), 0.5) for t in ps], batch=3).collect()
    assert len(got) == 8 and {r.cost for r in got} == {0.5}
    members = items.select("key", F.lit(1).alias("cluster_id"))
    text_ = prompts.cluster_prompts(members, items).first().prompt
    assert "8 related items" in text_ and "Item 8:" in text_
    assert prompts.template_prompts(items).count() == 0


def test_templates(items, spark):
    more = items.unionByName(items.withColumn("key", F.concat("key", F.lit("x"))))
    got = {r.issue_type: r for r in templates.validate_templates(templates.template_fallback(more)).collect()}
    assert set(got) == {"Story", "Task", "Epic"}
    assert got["Story"].common_labels == ["login"] and got["Story"].is_valid
    assert got["Story"].suggestions == ["Low confidence score - consider adding more samples"]


def test_validation_and_filters(spark, items):
    df = spark.createDataFrame([("a", 0.5), ("b", 1.5), (None, 0.1)], "key string, score double")
    ok, bad = validate_ranges(df, {"key": ("required",), "score": ("range", 0, 1)})
    assert [r.key for r in ok.collect()] == ["a"] and bad.count() == 2
    got = where_meta(items, {"issue_type": ["Story", "Task"], "labels": ["login", "refactor"], "status": None})
    assert {r.key for r in got.collect()} == {"PROJ-1", "PROJ-2", "PROJ-4"}
    assert where_meta(items, {}).count() == 8


def test_contains_pairs_without_needles(spark):
    texts = spark.createDataFrame([(1, "a b c")], "text_id int, text string")
    empty = spark.createDataFrame([("x", "")], "needle_id string, needle string")
    got = labels.contains_pairs(texts, empty)
    assert got.columns == ["needle_id", "text_id"] and got.count() == 0
