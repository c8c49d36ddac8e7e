"""Cost formulas, drift and retrieval quality on literal cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.functions.vector import cosine
from taskloom.operators import cost as C
from taskloom.operators import drift as D
from taskloom.operators import evaluation as E
from taskloom.operators import retrieval as R
from taskloom.operators.query_text import query_features
from taskloom.plans import search

T0 = dt.datetime(2024, 1, 10, 9, 59, 50)


def _log(spark, rows):
    """Rows (service, operation, seconds after T0, input, output, cost)."""
    data = [(s, o, T0 + dt.timedelta(seconds=t), i, u, c) for s, o, t, i, u, c in rows]
    return spark.createDataFrame(data, "service string, operation string, ts timestamp, input_tokens long, output_tokens long, cost double")


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(cosine("a", "b")).first()[0] == pytest.approx(want)


def test_bursts_cross_bucket_borders_and_merge_at_the_exact_gap(spark):
    # 9:59:50, :55, 10:00:00, then 6 s later, then an hour of silence
    times = [0, 5, 10, 16, 21, 4000]
    log = _log(spark, [("llm", "op", t, 1, 1, 1.0) for t in times] + [("llm", "other", 2, 1, 1, 1.0)])
    got = sorted((r.operation, (r.start - T0).seconds, r.calls) for r in C.bursts(log, 5.0, "hour").collect())
    assert got == [("op", 0, 3), ("op", 16, 2), ("op", 4000, 1), ("other", 2, 1)]
    got = {r.calls for r in C.bursts(log, 5.0, "minute").where("operation = 'op'").collect()}
    assert got == {3, 2, 1}
    r = C.batchable_calls(log).first()
    assert (r.operation, r.n, r.batchable, r.batches, r.suggested_batch_size) == ("op", 6, 5, 2, 3)
    assert r.potential_savings == pytest.approx((5 - 2 * 2.5 * 0.7) / 1 * 30)


def test_prompt_efficiency_and_suggestions(spark):
    rows = [("llm", "dup.a", i, 100, 10, 1.0) for i in range(9)] + [("llm", "dup.b", 10, 100, 10, 50.0)]
    log = _log(spark, rows)
    p = C.prompt_efficiency(log).first()
    assert (p.category, p.total_calls, p.expensive_calls) == ("dup", 10, 1)
    assert p.optimization_potential == pytest.approx(50 * 0.2 * 30) and p.overall_efficiency_score == pytest.approx(0.9)
    kinds = {r.type for r in C.cost_optimisations(log).collect()}
    assert kinds == {"embedding_batch_increase", "dup.a_batch_processing", "prompt_optimization", "model_downgrade"}
    assert {r.type for r in C.batch_opportunities(log).collect()} == {"dup.a_batch_optimization"}
    e = C.efficiency(log).first()
    assert e.highest_cost_operation == "dup.b" and e.token_efficiency_score == pytest.approx(100 / 1001)
    assert C.efficiency(log.limit(0)).first().highest_cost_operation == ""


def test_daily_series_is_zero_filled(spark):
    log = _log(spark, [("llm", "a", 0, 1, 1, 3.0), ("llm", "a", 86400, 1, 1, 5.0)])
    s = C.cost_series(log, "2024-01-12", 7)
    assert [r.cost for r in s.orderBy("day").collect()] == [0, 0, 0, 0, 0, 3.0, 5.0, 0]
    assert [r.total_cost for r in C.weekly_costs(s).orderBy("week_starting").collect()] == [8.0, 0.0]
    assert C.cost_anomaly(s).first().is_anomaly is False
    assert C.cost_anomaly(C.cost_series(log, "2024-01-12", 5)).count() == 0


@pytest.mark.parametrize("values,want", [([1.0, 1.0], "insufficient_data"), ([1.0, 1.0, 1.0], "stable"), ([1.0, 2.0, 3.0], "sharply_increasing"), ([100.0, 103.0, 106.0], "increasing"), ([3.0, 2.0, 1.0], "sharply_decreasing")])
def test_trend_classes(spark, values, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "day int, cost double")
    assert C.trend_a(df).first().trend == want


def test_alerts_once_per_period(spark):
    log = _log(spark, [("llm", "a", 0, 1, 1, 46.0)])
    alerts = C.budget_alerts(log, "2024-01-10 12:00:00")
    assert [(r.threshold, r.severity) for r in alerts.where("type = 'daily_budget'").orderBy("threshold").collect()] == [(0.5, "low"), (0.75, "medium"), (0.9, "high")]
    assert alerts.first().message == "Daily budget 50.0% reached: $46.00 of $50.00"
    assert C.new_alerts(alerts, alerts).count() == 0
    assert C.budget_alerts(log, "2024-01-11 12:00:00").count() == 0
    st = C.budget_status(log, "2024-01-10 12:00:00", monthly=92.0).first()
    assert st.monthly_percentage == 50.0 and st.days_until_budget_exhausted == 10


def test_budget_cut_off_takes_the_crossing_row(spark):
    df = spark.createDataFrame([(f"k{i}", 1.0) for i in range(10)], "key string, cost double")
    assert sorted(r.key for r in C.within_budget(df, 2.5).collect()) == ["k0", "k1", "k2"]


def test_forecast_needs_a_week(spark):
    df = lambda n: spark.createDataFrame([(i, 2.0) for i in range(n)], "day int, cost double")
    r = C.forecast(df(9), 0.4).first()
    assert (r.next_week, r.next_month, r.confidence) == (pytest.approx(15.4), pytest.approx(84.0), pytest.approx(0.3))
    r = C.forecast(df(3), 0.4).first()
    assert (r.next_week, r.next_month, r.confidence) == (14.0, 60.0, 0.5)


def test_versions_across_buckets_and_drift_score(spark):
    at = [dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 1), dt.datetime(2024, 5, 1)]
    rows = [("A", t, d, "ann") for t, d in zip(at, ["a b c", "a b d", "", "x y"])] + [("B", at[0], "one", "bob")]
    h = spark.createDataFrame(rows, "key string, ts timestamp, description string, author string")
    for bucket in ("day", "month", "year"):
        got = [(r.old_description, r.new_description) for r in D.version_pairs(h, bucket).orderBy("ts").collect()]
        assert got == [("a b c", "a b d"), ("a b d", ""), ("", "x y")]
    events = D.drift_events(D.version_pairs(h))
    assert [r.similarity_score for r in events.collect()] == [0.5]
    out = {r.key: r for r in D.scope_drift(h, events).collect()}
    assert out["A"].has_drift and out["A"].overall_drift_score == 0.5 and not out["B"].has_drift
    verdict = h.select("key", "ts", F.lit("pivot").alias("change_type"), F.lit("major").alias("impact_level"))
    scored = D.drift_score(D.drift_events(D.version_pairs(h), changes=verdict)).first()
    assert scored.overall_drift_score == 1.0


def test_metrics_and_regression(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "key string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0], 0.95), ("none", [0.0, -1.0], 0.5)], "query_id string, embedding array<double>, minimum_similarity double")
    expected = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, key string")
    m = {r.query_id: r for r in E.retrieval_metrics(q, expected, items).collect()}
    assert (m["q"].precision, m["q"].recall, m["q"].f1_score, m["q"].min_similarity_met) == (0.5, 0.5, 0.5, True)
    assert (m["none"].total_results, m["none"].f1_score, m["none"].min_similarity_met) == (0, 0.0, False)
    rep = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.88), (4, 0.95)], "ts int, f1 double")
    assert [r.has_regression for r in E.regression(rep).orderBy("ts").collect()] == [False, True, False, False]


def test_consistency_and_health(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("a", 3, [0.0, 1.0]), ("b", 1, [1.0, 0.0])], "key string, run int, embedding array<double>")
    r = E.consistency(v).collect()
    assert [(x.key, round(x.average_similarity, 9), x.is_consistent) for x in r] == [("a", round(1 / 3, 9), False)]
    row = spark.createDataFrame([(0.5, 1.0, None, 0.0, False)], "f1 double, consistency double, reproducibility double, change double, has_regression boolean")
    assert row.select(E.health_a()).first()[0] == pytest.approx(round((0.3 + 0.2 + 0.1) / 0.9 * 100, 1))
    assert row.select(E.health_b()).first()[0] == pytest.approx(0.55)


def test_answer_boosts_summary_and_text(spark):
    chunks = spark.createDataFrame(
        [
            ("c1", "K1", "Story", "Open", "Low", "t" * 600, [1.0, 0.0]),
            ("c2", "K2", "Bug", "Blocked", "High", "short", [0.95, 0.05]),
            ("c3", "K3", "Bug", "Open", "Low", "", [0.0, 1.0]),
        ],
        "chunk_id string, key string, item_type string, status string, priority string, text string, embedding array<double>",
    )
    items = spark.createDataFrame(
        [("K1", "Story", None, "E"), ("K2", "Bug", None, None), ("E", "Epic", None, None)],
        "key string, issue_type string, parent_key string, epic_key string",
    )
    q = query_features(spark.createDataFrame([("q1", "what is urgent and blocked?", [1.0, 0.0])], "query_id string, query_text string, embedding array<double>"), "2024-01-01 00:00:00")
    # the words imply filters; without them both near chunks are found
    got = search.answer(q, chunks, items, threshold=0.5).first()
    assert got.keys == ["K2"] and got.filters_applied == '{"status":["Blocked"],"priority":["High"]}'
    free = q.withColumn("statuses", F.array().cast("array<string>")).withColumn("priorities", F.array().cast("array<string>"))
    hits = R.semantic_search(free, chunks, threshold=0.5)
    assert [r.key for r in R.final_ranking(hits, free).orderBy("final_position").collect()] == ["K2", "K1"]
    got = search.answer(free, chunks, items, threshold=0.5).first()
    assert got.summary.startswith("Context Summary: 4 items | Types: Bug(1), Story(1) | Status: Blocked(1), Open(1)")
    assert "t" * 500 + "..." in got.formatted_context and "t" * 501 not in got.formatted_context
    assert got.formatted_context.startswith("Query: what is urgent and blocked?\nIntent: search\n\n## Relevant Items:\n\n### K2 - Bug\n**Status: Blocked | Priority: High**\nshort")
    assert got.token_count == len(got.formatted_context) // 4
    assert search.answer(free, chunks, items, threshold=0.99999999).first().results_count == 1


def test_regression_is_against_strictly_earlier_reports(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), float(f)) for t, f in zip(rng.integers(0, 150, 400), rng.random(400))]
    reports = spark.createDataFrame(rows, "day int, f1 double").withColumn("ts", F.timestamp_seconds(F.col("day") * 86400))
    for r in E.regression(reports).collect():
        before = [f for t, f in rows if t < r.day]
        assert r.baseline_f1 == (max(before) if before else None)
        assert r.change == pytest.approx(r.f1 - max(before) if before else 0.0)
