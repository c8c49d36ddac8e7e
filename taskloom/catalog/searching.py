"""Queries on search, context, drift and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.functions import lexicons as L
from taskloom.operators import drift as D
from taskloom.operators import evaluation as E
from taskloom.operators import retrieval as R
from taskloom.operators.embeddings import DIMS, fit_idf, hashed_tfidf
from taskloom.operators.labels import contains_pairs
from taskloom.operators.query_text import FILTER_COLUMNS, filter_text, query_features
from taskloom.plans import quality, search
from taskloom.session import cut_lineage
from taskloom.sources.driver_tables import document_items, eval_queries, history, table, vector_items

NOW = "2024-02-01 12:00:00"
# Query phrases; every benchmark item gets one of them in turn, so queries grow with the table.
PHRASES = [
    "Show me high priority bugs from last week",
    "What stories are blocked in the current sprint",
    "Analyze technical debt patterns for the backend team",
    "Find open tasks assigned to maria in PROJ-12",
    "List epics and defects created this month, urgent",
    "Summary report of done work in sprint 7 for mobile",
    "slow performance issues on the API, @kim please",
    "stories in progress for the frontend team",
    "recent low priority items",
    "trends of important user story work, last sprint and next sprint",
]


def _r(c, n=6):
    return F.round(c, n)


def _texts(spark, sf):
    b = table(spark, sf, "benchmark")
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    return b.select(
        F.concat(F.lit("Q-"), F.col("item_id").cast("string")).alias("query_id"),
        F.element_at(phrases, (F.col("item_id") % len(PHRASES) + 1).cast("int")).alias("query_text"),
    )


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _asked(spark, sf, asks):
    """(queries, chunks): both with the hashed TF-IDF of their text, weighed by the chunks."""
    idf = fit_idf(table(spark, sf, "documents"), "text")
    chunks = cut_lineage(hashed_tfidf(_chunks(spark, sf), "text", idf=idf))
    return hashed_tfidf(query_features(asks, NOW), "full_text", idf=idf), chunks


def _search(spark, sf):
    return _asked(spark, sf, _texts(spark, sf))


def _pick(names, c):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (c + 1).cast("int"))


def _chunks(spark, sf):
    """One chunk per document with search metadata."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    return d.select(
        F.concat(F.lit("CH-"), n.cast("string")).alias("chunk_id"),
        F.concat(F.lit("DOC-"), n.cast("string")).alias("key"),
        _pick(["Epic", "Story", "Task", "Bug"], n % 4).alias("item_type"),
        _pick(["Open", "In Progress", "Done", "Blocked"], F.floor(n / 4) % 4).alias("status"),
        _pick(["High", "Medium", "Low"], n % 3).alias("priority"),
        _pick(["Platform", "Frontend", "Backend", "Mobile"], n % 4).alias("team"),
        F.array(_pick(["platform", "frontend", "backend", "mobile"], n % 4), F.col("lang")).alias("components"),
        F.concat(F.lit("PROJ-"), (n % 20).cast("string")).alias("epic_key"),
        F.when(n % 2 == 0, "2024-01").otherwise("2023-12").alias("created_month"),
        (n % 3 == 0).alias("has_children"),
        (n % 5).alias("dependency_count"),
        F.col("text"),
        F.timestamp_seconds(F.lit(1704067200) + n * 3600).alias("created"),
    )


def _scope(spark, sf):
    """Items behind the chunks: every twentieth document is an epic named PROJ-n."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    return d.select(
        F.concat(F.lit("DOC-"), n.cast("string")).alias("key"),
        _pick(["Epic", "Story", "Task", "Bug"], n % 4).alias("issue_type"),
        F.when(n >= 20, F.concat(F.lit("DOC-"), (n % 20).cast("string"))).alias("epic_key"),
        F.lit(None).cast("string").alias("parent_key"),
    )


def features(spark, sf):
    q = query_features(_texts(spark, sf), NOW)
    j = lambda c: F.array_join(c, ",").alias(c)
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return q.select(
        "query_id", j("item_types"), j("statuses"), j("priorities"), j("component_names"), j("teams"), j("sprints"),
        j("assignees"), j("epic_keys"), "intent", "expected_output", "priority_boost", "status_boost",
        j("expanded_terms"), j("variants"), t("date_start"), t("date_end"), "full_text",
    )


def filters(spark, sf):
    return query_features(_texts(spark, sf), NOW).withColumn("filters", filter_text()).select("query_id", "filters")


def semantic(spark, sf):
    h = R.semantic_search(*_search(spark, sf), 15, 0.0)
    return h.select("query_id", "chunk_id", _r("score").alias("score"), F.col("position").cast("bigint").alias("position"))


def semantic_dates(spark, sf):
    h = R.semantic_search(*_search(spark, sf), 15, 0.0, apply_date_range=True)
    return h.select("query_id", "chunk_id", _r("score").alias("score"), F.col("position").cast("bigint").alias("position"))


def final(spark, sf):
    _, _, h = _final(spark, sf)
    return h.select(
        "query_id", "chunk_id", _r("score").alias("score"), F.col("final_position").cast("bigint").alias("final_position")
    )


def _final(spark, sf):
    q, chunks = _search(spark, sf)
    hits = R.semantic_search(q, chunks, 15, 0.0)
    return q, hits, R.final_ranking(hits, q)


def summary(spark, sf):
    q, hits, ranked = _final(spark, sf)
    trees = search._trees_of(hits, _scope(spark, sf))
    return R.context_summary(ranked, trees, q).select("query_id", F.col("total_items").cast("bigint").alias("total_items"), "summary")


def patterns(spark, sf):
    _, hits, _ = _final(spark, sf)
    return R.debt_patterns(hits)


def recommendations(spark, sf):
    _, hits, _ = _final(spark, sf)
    return R.debt_recommendations(R.debt_patterns(hits)).select(
        "query_id", F.array_join("recommendations", "; ").alias("recommendations")
    )


def answers(spark, sf):
    a = search.answer(*_search(spark, sf), _scope(spark, sf), 15, 0.0)
    return a.select(
        "query_id", "intent", "expected_output", F.col("results_count").cast("bigint").alias("results_count"),
        F.col("total_items").cast("bigint").alias("total_items"), F.md5("formatted_context").alias("context_md5"),
        "token_count", F.array_join("keys", ",").alias("keys"),
    )


def small_context(spark, sf):
    """Context under a small token budget, so that the cut-off is reached."""
    a = search.answer(*_search(spark, sf), _scope(spark, sf), 15, 0.0, max_tokens=800)
    return a.select("query_id", "token_count", F.md5("formatted_context").alias("context_md5"))


def tool(spark, sf):
    a = search.search_tool(*_search(spark, sf), _scope(spark, sf), 15, 0.0)
    return a.select(
        "query_id", F.array_join("keys", ",").alias("keys"), F.col("results_count").cast("bigint").alias("results_count"),
        F.col("total_items").cast("bigint").alias("total_items"), "filters_applied",
    )


def _epic_asks(spark, sf):
    """One search per document that is an epic."""
    epics = _scope(spark, sf).where(F.col("issue_type") == "Epic")
    n = F.substring("key", 5, 20).cast("bigint")
    return R.epic_queries(epics.select(
        F.concat(F.lit("E-"), n.cast("string")).alias("query_id"),
        F.col("key").alias("epic_key"),
        F.lit("").alias("query_text"),
    ))


def in_epic(spark, sf):
    q, chunks = _asked(spark, sf, _epic_asks(spark, sf))
    chunks = chunks.drop("epic_key").join(_scope(spark, sf).select("key", "epic_key"), "key")
    a = search.answer_in_epic(q, _scope(spark, sf), chunks, 10, 0.0)
    return a.select(
        "query_id", "epic_key", F.col("child_count").cast("bigint").alias("child_count"),
        F.col("results_count").cast("bigint").alias("results_count"), F.md5("formatted_context").alias("context_md5"),
    )


def epic_scope(spark, sf):
    a = search.answer_in_epic(query_features(_epic_asks(spark, sf), NOW), _scope(spark, sf))
    return a.select(
        "query_id", "epic_key", F.col("child_count").cast("bigint").alias("child_count"),
        F.md5("formatted_context").alias("context_md5"),
    )


def debt(spark, sf):
    """The debt search for every team that the chunks name, and for all of them."""
    rows = _chunks(spark, sf)
    teams = rows.select("team").distinct().unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("team")))
    asks = teams.select(F.coalesce("team", F.lit("all")).alias("query_id"), "team")
    a = search.debt_search(*_asked(spark, sf, R.debt_queries(asks)), 20, 0.0)
    return a.select(
        "query_id", "query_text", F.col("debt_items_found").cast("bigint").alias("debt_items_found"),
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


def dependencies(spark, sf):
    asks = _chunks(spark, sf).select("team", "epic_key").distinct().select(
        F.concat_ws("/", "team", "epic_key").alias("query_id"), "team", F.col("epic_key").alias("epic")
    )
    a = search.dependency_search(*_asked(spark, sf, R.dependency_queries(asks)), _scope(spark, sf), 0.0)
    return a.select(
        "query_id", "query_text", F.col("results_count").cast("bigint").alias("results_count"),
        F.array_join("keys", ",").alias("keys"), "filters_applied",
    )


# ------------------------------------------------------------------------- drift


def version_pairs(spark, sf):
    p = D.version_pairs(history(spark, sf), "week")
    return p.select(
        "key", F.date_format("ts", "yyyy-MM-dd").alias("day"), "author",
        F.md5("old_description").alias("old_md5"), F.md5("new_description").alias("new_md5"),
    )


def _overlap(a, b):
    """Similarity of the sets of blank-separated words."""
    x, y = (F.array_distinct(F.split(c, " ")) for c in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _events(spark, sf):
    h = history(spark, sf)
    sim = _overlap(F.col("old_description"), F.col("new_description"))
    return D.drift_events(D.version_pairs(h), sim, _changes(h))


def _changes(h):
    """A scorer's verdicts: the kind follows the length of the new text."""
    n = F.length("description")
    return h.select(
        "key", "ts", _pick(["expansion", "reduction", "pivot", "clarification", "refactor"], n % 5).alias("change_type"),
        F.when(n % 3 == 0, "minor").when(n % 3 == 1, "major").alias("impact_level"),
    )


def drift_events(spark, sf):
    return _events(spark, sf).select(
        "key", F.date_format("ts", "yyyy-MM-dd").alias("day"), "changed_by", _r("similarity_score").alias("similarity_score"),
        "change_type", "impact_level",
    )


def drift_scores(spark, sf):
    return D.drift_score(_events(spark, sf)).select("key", _r("overall_drift_score").alias("overall_drift_score"), "drift_events")


def scope_drift(spark, sf):
    out = D.scope_drift(history(spark, sf), _events(spark, sf))
    return out.withColumn("overall_drift_score", _r("overall_drift_score"))


def drift_batch(spark, sf):
    out = D.scope_drift_batch(history(spark, sf), "CONV", "2024-01-01 00:00:00", "2024-01-05 00:00:00")
    return out.withColumn("total_cost", _r("total_cost"))


def _snaps(spark, sf):
    """Three weekly snapshots of the vector items; each lacks another quarter of them."""
    v = vector_items(spark, sf).withColumn("n", F.substring("key", 3, 20).cast("bigint"))
    s = v.select("epic_key", "key", "embedding", "n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("snap"))
    return s.where("(n + snap) % 4 <> 0").drop("n")


def epic_weeks(spark, sf):
    out = D.epic_weeks(_snaps(spark, sf))
    return out.select(
        "epic_key", F.col("snap").cast("bigint").alias("snap"), "n_items", _r("coherence").alias("coherence"),
        F.col("items_added").cast("bigint").alias("items_added"), F.col("items_removed").cast("bigint").alias("items_removed"),
    )


def epic_evolution(spark, sf):
    out = D.epic_evolution(_snaps(spark, sf))
    for c in ("first_coherence", "last_coherence", "theme_stability"):
        out = out.withColumn(c, _r(c))
    return out


# -------------------------------------------------------------------- evaluation


def _eval(spark, sf):
    q = eval_queries(spark, sf)
    v = _vectors(spark, sf).withColumnRenamed("vec_id", "item_id")
    return q.join(v, "item_id").select(
        F.col("id").alias("query_id"), "query_text", "category", "embedding", F.lit(0.35).alias("minimum_similarity"), "item_id"
    )


def _expected(spark, sf):
    """Expected are the items of the query vector's own group with a key ending like the query's."""
    v = vector_items(spark, sf).select("key", "epic_key")
    lab = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.concat(F.lit("E-"), F.col("label").cast("string")).alias("epic_key"))
    q = _eval(spark, sf).select("query_id", "item_id").join(lab, "item_id")
    return q.join(v, "epic_key").select("query_id", "key")


def smoke(spark, sf):
    out = E.smoke_test(_eval(spark, sf).select("query_id", "embedding"), vector_items(spark, sf))
    return out.select(
        "query_id", "results_count", _r("avg_similarity").alias("avg_similarity"), "passed",
        F.array_join("top_keys", ",").alias("top_keys"),
    )


def smoke_report(spark, sf):
    out = E.smoke_report(E.smoke_test(_eval(spark, sf).select("query_id", "embedding"), vector_items(spark, sf)))
    return out.select(
        "total_tests", "passed_tests", _r("overall_score").alias("overall_score"),
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


def _metrics(spark, sf):
    return E.retrieval_metrics(_eval(spark, sf), _expected(spark, sf), vector_items(spark, sf))


def metrics(spark, sf):
    out = _metrics(spark, sf)
    for c in ("precision", "recall", "f1_score"):
        out = out.withColumn(c, _r(c))
    return out


def metrics_report(spark, sf):
    out = E.metrics_report(_metrics(spark, sf))
    return out.withColumn("overall_f1_score", _r("overall_f1_score")).withColumn("processing_cost", _r("processing_cost"))


def _reports(spark, sf):
    """A report history: per day of the call log one run whose figures follow the day's mean values."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy(F.col("day").alias("ts")).agg(
        (F.avg("value") / 60).alias("f1"), (F.avg("value") / 100 + 0.5).alias("consistency"),
        (F.avg("value") / 55).alias("health"),
    )


def regression(spark, sf):
    out = E.regression(_reports(spark, sf).select("ts", "f1"))
    return out.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), _r("f1").alias("f1"), _r("baseline_f1").alias("baseline_f1"),
        _r("change").alias("change"), "has_regression",
    )


def trends(spark, sf):
    return E.quality_trends(_reports(spark, sf))


def _runs(spark, sf):
    """Three runs per item: the vector, the vector again, and one with its first component moved."""
    v = vector_items(spark, sf)
    moved = F.transform("embedding", lambda x, i: F.when(i == 0, x + 0.3).otherwise(x))
    run = lambda n, e: v.select("key", F.lit(n).alias("run"), e.alias("embedding"))
    return run(1, F.col("embedding")).unionByName(run(2, F.col("embedding"))).unionByName(run(3, moved))


def consistency(spark, sf):
    return E.consistency(_runs(spark, sf)).withColumn("average_similarity", _r("average_similarity"))


def consistency_report(spark, sf):
    out = E.consistency_report(E.consistency(_runs(spark, sf)))
    return out.withColumn("overall_consistency", _r("overall_consistency"))


def health(spark, sf):
    r = E.regression(_reports(spark, sf)).withColumn("reproducibility", F.lit(0.95))
    return r.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), E.health_a().alias("health_a"), F.round(E.health_b(), 6).alias("health_b")
    )


def failing(spark, sf):
    return E.failing_categories(_metrics(spark, sf), _eval(spark, sf))


def advice(spark, sf):
    out = quality.quality_report(
        _eval(spark, sf), _expected(spark, sf), vector_items(spark, sf), _runs(spark, sf), _reports(spark, sf).select("ts", "f1")
    )
    for c in ("f1", "consistency", "change", "health"):
        out = out.withColumn(c, _r(c))
    return out.withColumn("recommendations", F.array_join("recommendations", "; "))


def coverage(spark, sf):
    q = eval_queries(spark, sf).unionByName(
        document_items(spark, sf).select(
            F.col("key").alias("id"), F.lit(0).cast("bigint").alias("item_id"), F.col("summary").alias("query_text"),
            F.col("epic_key").alias("category"),
        )
    )
    cats = q.select("category").distinct().withColumn("min_coverage", F.lit(45))
    return E.coverage(q, cats).withColumn("required", F.col("required").cast("bigint"))


def passages(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text")
    needles = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return contains_pairs(docs, needles).select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"))


def refreshed(spark, sf):
    q = eval_queries(spark, sf).select(F.col("id").alias("query_id"), "query_text")
    return E.refresh_expected(q, document_items(spark, sf))


def epic_queries(spark, sf):
    q, e = E.eval_queries_from_epics(_scope(spark, sf).withColumn("summary", F.col("key")))
    n = e.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    return q.join(n, "query_id", "left").select(
        "query_id", "query_text", "minimum_similarity", "category", "description",
        F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
    )


QUERIES = {
    "Q01_query_features": features,
    "Q16_query_filters": filters,
    "J05_semantic_search": semantic,
    "J05_semantic_search_dates": semantic_dates,
    "J07_final_ranking": final,
    "A12_context_summary": summary,
    "A13_debt_patterns": patterns,
    "A14_debt_recommendations": recommendations,
    "R01_answers": answers,
    "R05_small_context": small_context,
    "R07_search_tool": tool,
    "R02_answer_in_epic": in_epic,
    "R06_epic_scope": epic_scope,
    "R03_debt_search": debt,
    "R04_dependency_search": dependencies,
    "W04_version_pairs": version_pairs,
    "A26_drift_events": drift_events,
    "A25_drift_score": drift_scores,
    "A26_scope_drift": scope_drift,
    "A27_scope_drift_batch": drift_batch,
    "A28_epic_weeks": epic_weeks,
    "A28_epic_evolution": epic_evolution,
    "A16_smoke_test": smoke,
    "A16_smoke_report": smoke_report,
    "A17_retrieval_metrics": metrics,
    "A17_metrics_report": metrics_report,
    "A18_regression": regression,
    "W09_quality_trends": trends,
    "A19_consistency": consistency,
    "A19_consistency_report": consistency_report,
    "A20_health": health,
    "A22_failing_categories": failing,
    "A24_quality_report": advice,
    "A23_coverage": coverage,
    "J20_expected_passages": passages,
    "J21_refresh_expected": refreshed,
    "J22_eval_queries_from_epics": epic_queries,
}

# ------------------------------------------------------------------------- SQL


def _quote(text):
    return "'" + text.replace("'", "''") + "'"


def _when_matches(table_, q):
    parts = [f"CASE WHEN regexp_matches({q}, '(?i){p}') THEN '{n}' END" for n, p in table_.items()]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def _flat_lists(pairs):
    """Concatenation of the word lists whose condition holds."""
    parts = [f"CASE WHEN {c} THEN {[*words]!r} ELSE []::VARCHAR[] END" for c, words in pairs]
    return f"flatten([{', '.join(parts)}])"


def _has(words):
    return "(" + " OR ".join(f"contains(lower(query_text), '{w}')" for w in words) + ")"


def _feature_sql(texts):
    """CTE ``feat`` with the features of ``texts(query_id, query_text, ...)``."""
    q = "query_text"
    days = " ".join(f"WHEN regexp_matches({q}, '(?i)\\b{p}\\b') THEN {n}" for p, n in L.TIME_PHRASES.items())
    named = lambda p, n: f"list_transform(regexp_extract_all({q}, '(?i){p}'), lambda x: '{n}')"
    synonyms = _flat_lists([(f"contains(lower({q}), '{t}')", w) for t, w in L.SYNONYMS.items()])
    variants = _flat_lists([(_has(t), w) for t, w in L.VARIANTS])
    return rf"""feat AS (
  SELECT *, {_when_matches(L.ITEM_TYPES, q)} AS item_types, {_when_matches(L.STATUSES, q)} AS statuses,
    {_when_matches(L.PRIORITIES, q)} AS priorities, {_when_matches(L.COMPONENTS, q)} AS component_names,
    {_when_matches(L.TEAMS, q)} AS teams, CASE {days} END AS days_back,
    flatten([regexp_extract_all({q}, '(?i)sprint \d+'), {named('current sprint', 'current')},
      {named('last sprint', 'previous')}, {named('next sprint', 'next')}]) AS sprints,
    flatten([regexp_extract_all({q}, '(?i)assigned to (\w+)', 1), regexp_extract_all({q}, '(?i)assignee (\w+)', 1),
      regexp_extract_all({q}, '(?i)@(\w+)', 1)]) AS assignees,
    regexp_extract_all({q}, '\b([A-Z]+-\d+)\b', 1) AS epic_keys,
    CASE WHEN {_has(L.ANALYSIS_WORDS)} THEN 'analysis' ELSE 'search' END AS intent,
    CASE WHEN {_has(L.SUMMARY_WORDS)} THEN 'summary' ELSE 'list' END AS expected_output,
    CASE WHEN {_has(L.URGENT_WORDS)} THEN 1.5::DOUBLE END AS priority_boost,
    CASE WHEN contains(lower({q}), 'blocked') THEN 2.0::DOUBLE END AS status_boost,
    {synonyms} AS expanded_terms, {variants} AS variants
  FROM {texts}),
featured AS (
  SELECT *, TIMESTAMP '{NOW}' - to_days(days_back) AS date_start,
    CASE WHEN days_back IS NOT NULL THEN TIMESTAMP '{NOW}' END AS date_end,
    array_to_string(flatten([[query_text], expanded_terms, variants]), ' ') AS full_text,
    '{{' || array_to_string(list_filter([{", ".join(
      f"CASE WHEN len({c}) > 0 THEN '" + f'"{n}":["' + f"' || array_to_string({c}, '" + '","' + "') || '" + '"]' + "' END"
      for n, c in FILTER_COLUMNS.items())}], lambda x: x IS NOT NULL), ',') || '}}' AS filters
  FROM feat)"""


TEXTS = f"""texts AS (
  SELECT 'Q-' || item_id AS query_id, [{", ".join(map(_quote, PHRASES))}][item_id % {len(PHRASES)} + 1] AS query_text
    FROM benchmark)"""
FEATURES = f"{TEXTS}, {_feature_sql('texts')}"


def vectors_sql(rows, key, text, weights=True):
    """CTE ``<rows>_v (key, v)``: hashed TF-IDF, weighed by the documents."""
    n = f"{rows}_n"
    idf = f"""weights AS (
  SELECT b, ln(((SELECT count(*) FROM documents) + 1) / (count({key}) + 1)) AS idf
  FROM (SELECT unnest(range({DIMS})) AS b) LEFT JOIN {n} USING (b) GROUP BY 1),"""
    return f"""{n} AS (
  SELECT {key}, ('0x' || left(md5(w), 4))::INT % {DIMS} AS b, count(*) AS n FROM (
    SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM {rows})
  WHERE w <> '' GROUP BY 1, 2),
{idf if weights else ""}
{rows}_v AS (
  SELECT {key}, list(coalesce(n, 0) * idf ORDER BY b) AS v
  FROM (SELECT DISTINCT {key} FROM {rows}) CROSS JOIN weights LEFT JOIN {n} USING ({key}, b) GROUP BY 1)"""


QUERY_VECTORS = vectors_sql("featured", "query_id", "full_text", weights=False)
SCORE = """CASE WHEN list_sum(e.v) > 0 AND list_sum(c.v) > 0 THEN round(list_cosine_similarity(e.v, c.v), 12) ELSE 0 END"""
CHUNKS = f"""{vectors_sql("documents", "doc_id", "text")}, chunks AS (
  SELECT 'CH-' || doc_id AS chunk_id, 'DOC-' || doc_id AS key, ['Epic', 'Story', 'Task', 'Bug'][doc_id % 4 + 1] AS item_type,
    ['Open', 'In Progress', 'Done', 'Blocked'][(doc_id // 4) % 4 + 1] AS status,
    ['High', 'Medium', 'Low'][doc_id % 3 + 1] AS priority,
    ['Platform', 'Frontend', 'Backend', 'Mobile'][doc_id % 4 + 1] AS team,
    ['platform', 'frontend', 'backend', 'mobile'][doc_id % 4 + 1] AS component, lang, 'PROJ-' || (doc_id % 20) AS epic_key,
    CASE WHEN doc_id % 2 = 0 THEN '2024-01' ELSE '2023-12' END AS created_month, doc_id % 3 = 0 AS has_children,
    doc_id % 5 AS dependency_count, text, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created, v
  FROM documents JOIN documents_v USING (doc_id))"""
SCOPE = """scope AS (
  SELECT 'DOC-' || doc_id AS key, ['Epic', 'Story', 'Task', 'Bug'][doc_id % 4 + 1] AS issue_type,
    CASE WHEN doc_id >= 20 THEN 'DOC-' || (doc_id % 20) END AS epic_key FROM documents),
kids AS (
  SELECT c.epic_key AS root, c.key AS child, row_number() OVER (PARTITION BY c.epic_key ORDER BY c.key) AS i
  FROM scope c JOIN scope p ON p.key = c.epic_key AND p.issue_type = 'Epic' QUALIFY i <= 50),
ctx AS (
  SELECT s.key, coalesce(list(child ORDER BY i) FILTER (child IS NOT NULL), []) AS child_keys, count(child) + 1 AS total_items
  FROM scope s LEFT JOIN kids k ON k.root = s.key GROUP BY 1)"""


def _search_sql(limit=15, extra="TRUE"):
    """CTEs ``found`` (first re-ranking) and ``final`` (second re-ranking)."""
    return f"""{QUERY_VECTORS}, scored AS (
  SELECT q.query_id, c.chunk_id, {SCORE} AS s
  FROM featured q JOIN featured_v e USING (query_id), chunks c
  WHERE (len(item_types) = 0 OR list_contains(item_types, c.item_type))
    AND (len(statuses) = 0 OR list_contains(statuses, c.status))
    AND (len(priorities) = 0 OR list_contains(priorities, c.priority))
    AND (len(component_names) = 0 OR list_contains(component_names, c.component) OR list_contains(component_names, c.lang))
    AND (len(teams) = 0 OR list_contains(teams, c.team)) AND (len(epic_keys) = 0 OR list_contains(epic_keys, c.epic_key))
    AND len(assignees) = 0 AND len(sprints) = 0 AND {extra}),
cut AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM scored WHERE s >= 0
  QUALIFY rank <= {2 * limit}),
first_pass AS (
  SELECT c.query_id, c.chunk_id, rank, s * CASE WHEN list_contains(item_types, h.item_type) THEN 1.2::DOUBLE ELSE 1 END
    * CASE WHEN h.priority = 'High' THEN 1.1::DOUBLE ELSE 1 END
    * CASE WHEN contains(h.created_month, '2024') THEN 1.05::DOUBLE ELSE 1 END AS score
  FROM cut c JOIN featured USING (query_id) JOIN chunks h USING (chunk_id)),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS position FROM first_pass
  QUALIFY position <= {limit}),
second_pass AS (
  SELECT f.query_id, f.position, h.*, f.score
    * CASE WHEN intent = 'analysis' AND h.dependency_count > 0 THEN 1.3::DOUBLE ELSE 1 END
    * CASE WHEN intent = 'analysis' AND h.has_children THEN 1.2::DOUBLE ELSE 1 END
    * CASE WHEN list_contains(item_types, h.item_type) THEN 1.4::DOUBLE ELSE 1 END
    * CASE WHEN list_contains(priorities, h.priority) THEN 1.3::DOUBLE ELSE 1 END
    * CASE WHEN h.priority = 'High' THEN coalesce(priority_boost, 1) ELSE 1 END
    * CASE WHEN h.status = 'Blocked' THEN coalesce(status_boost, 1) ELSE 1 END AS score
  FROM found f JOIN featured USING (query_id) JOIN chunks h USING (chunk_id)),
final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS fp FROM second_pass)"""


TREES = """trees AS (
  SELECT query_id, position AS tree_no, ctx.key, child_keys, total_items
  FROM final JOIN ctx USING (key) WHERE position <= 3)"""
NO_TREES = """trees AS (
  SELECT query_id, position AS tree_no, ctx.key, child_keys, total_items FROM final JOIN ctx USING (key) WHERE FALSE)"""

_COUNTS = """{0}s AS (
  SELECT query_id, string_agg(v || '(' || n || ')', ', ' ORDER BY f) AS {0}s FROM (
    SELECT query_id, {0} AS v, count(*) AS n, min(fp) AS f FROM final GROUP BY 1, 2) GROUP BY 1)"""
SUMMARY = f"""{_COUNTS.format("item_type")}, {_COUNTS.format("status")},
covered AS (
  SELECT query_id, list_sort(list_distinct(list(e))) AS epics FROM (
    SELECT query_id, epic_key AS e FROM final WHERE epic_key IS NOT NULL UNION ALL SELECT query_id, key FROM trees) GROUP BY 1),
involved AS (SELECT query_id, list_sort(list_distinct(list(team))) AS ts FROM final GROUP BY 1),
hit_counts AS (SELECT query_id, count(*) AS n FROM final GROUP BY 1),
tree_counts AS (SELECT query_id, sum(total_items)::BIGINT AS n FROM trees GROUP BY 1),
summaries AS (
  SELECT query_id, coalesce(h.n, 0) AS results_count, coalesce(h.n, 0) + coalesce(t.n, 0) AS total_items,
    'Context Summary: ' || (coalesce(h.n, 0) + coalesce(t.n, 0)) || ' items | Types: ' || coalesce(item_types, '') ||
    ' | Status: ' || coalesce(statuss, '') ||
    CASE WHEN len(epics) > 0 THEN ' | Epics: ' || array_to_string(epics[1:3], ', ') ELSE '' END ||
    CASE WHEN len(ts) > 0 THEN ' | Teams: ' || array_to_string(ts[1:3], ', ') ELSE '' END AS summary
  FROM (SELECT query_id FROM featured) LEFT JOIN hit_counts h USING (query_id) LEFT JOIN tree_counts t USING (query_id)
    LEFT JOIN item_types USING (query_id) LEFT JOIN statuss USING (query_id) LEFT JOIN covered USING (query_id)
    LEFT JOIN involved USING (query_id))"""


def _context_sql(max_tokens=8000):
    """CTE ``contexts(query_id, text)``: the sections folded under the token budget."""

    def step(back, limit):
        parts = "list_concat(a.parts, x.parts)"
        tokens = f"a.tokens + length(array_to_string(({parts})[-{back}:], chr(10))) // 4"
        return f"""CASE WHEN a.stop THEN a ELSE {{'parts': {parts}, 'tokens': {tokens}, 'stop': {tokens} > {limit}}} END"""

    return f"""hit_parts AS (
  SELECT query_id, list({{'parts': list_filter([chr(10) || '### ' || key || ' - ' || item_type,
      '**Status: ' || status || ' | Priority: ' || priority ||
        CASE WHEN epic_key <> '' THEN ' | Epic: ' || epic_key ELSE '' END || '**',
      CASE WHEN length(text) > 500 THEN left(text, 500) || '...' WHEN text <> '' THEN text END], lambda z: z IS NOT NULL),
    'tokens': 0::BIGINT, 'stop': FALSE}} ORDER BY fp) AS hs FROM final WHERE fp <= 10 GROUP BY 1),
tree_parts AS (
  SELECT query_id, list({{'parts': list_filter([chr(10) || '### Epic: ' || key,
      CASE WHEN len(child_keys) > 0 THEN 'Child Items: ' || array_to_string(child_keys[1:5], ', ') END],
      lambda z: z IS NOT NULL), 'tokens': 0::BIGINT, 'stop': FALSE}} ORDER BY tree_no) AS ts
  FROM trees WHERE tree_no <= 3 GROUP BY 1),
folded AS (
  SELECT query_id, ts, list_reduce(coalesce(hs, []), lambda a, x: {step(4, max_tokens * 0.8)},
    {{'parts': list_concat(['Query: ' || query_text, 'Intent: ' || intent],
      CASE WHEN hs IS NOT NULL THEN [chr(10) || '## Relevant Items:'] ELSE [] END), 'tokens': 20::BIGINT, 'stop': FALSE}}) AS st
  FROM featured LEFT JOIN hit_parts USING (query_id) LEFT JOIN tree_parts USING (query_id)),
contexts AS (
  SELECT query_id, array_to_string(CASE WHEN ts IS NOT NULL AND st.tokens < {max_tokens * 0.6} THEN
    (list_reduce(ts, lambda a, x: {step(2, max_tokens * 0.9)},
      {{'parts': list_append(st.parts, chr(10) || '## Epic Context:'), 'tokens': st.tokens, 'stop': FALSE}})).parts
    ELSE st.parts END, chr(10)) AS text FROM folded)"""


KEYS = """named AS (
  SELECT query_id, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM (
    SELECT query_id, key FROM final UNION ALL SELECT query_id, key FROM trees) GROUP BY 1)"""
BASE = f"WITH {FEATURES}, {CHUNKS}, {_search_sql()}"
PATTERNS = """patterns AS (
  SELECT query_id, kind, value, count(*) AS n FROM (
    SELECT query_id, unnest(['priority', 'status', 'total', 'component', 'component']) AS kind,
      unnest([priority, status, 'all', component, lang]) AS value FROM final) GROUP BY 1, 2, 3)"""
ADVICE = """tops AS (
  SELECT query_id, value, n FROM patterns WHERE kind = 'component'
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, value) = 1),
advice AS (
  SELECT p.query_id, concat_ws('; ',
    (SELECT 'Focus on ' || value || ' component with ' || n || ' debt items' FROM tops t WHERE t.query_id = p.query_id),
    CASE WHEN max(n) FILTER (kind = 'priority' AND value = 'High') > 0 THEN
      'Address ' || max(n) FILTER (kind = 'priority' AND value = 'High') || ' high-priority debt items first' END,
    CASE WHEN max(n) FILTER (kind = 'status' AND value = 'Open') > 0 THEN
      'Prioritize ' || max(n) FILTER (kind = 'status' AND value = 'Open') || ' open debt items for sprint planning' END)
    AS recommendations FROM patterns p GROUP BY 1)"""
EPIC_ASKS = """asks AS (
  SELECT 'E-' || doc_id AS query_id, 'DOC-' || doc_id AS asked_epic, 'Epic DOC-' || doc_id AS query_text
  FROM documents WHERE doc_id % 4 = 0)"""
IN_EPIC = f"""{EPIC_ASKS}, {_feature_sql('asks')}, {CHUNKS}, {SCOPE}, {QUERY_VECTORS},
scored AS (
  SELECT q.query_id, c.chunk_id, {SCORE} AS s
  FROM featured q JOIN featured_v e USING (query_id) JOIN scope x ON x.epic_key = q.asked_epic JOIN chunks c ON c.key = x.key),
found AS (
  SELECT query_id, chunk_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS position
  FROM scored WHERE s >= 0 QUALIFY position <= 10),
second_pass AS (
  SELECT f.query_id, f.position, h.* REPLACE (x.epic_key AS epic_key), f.score
    * CASE WHEN list_contains(item_types, h.item_type) THEN 1.4::DOUBLE ELSE 1 END AS score
  FROM found f JOIN featured USING (query_id) JOIN chunks h USING (chunk_id) JOIN scope x ON x.key = h.key),
final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS fp FROM second_pass),
trees AS (
  SELECT query_id, 1 AS tree_no, ctx.key, child_keys, total_items FROM featured JOIN ctx ON ctx.key = asked_epic)"""

HIST = """hist AS (
  SELECT 'CONV-' || conv_id AS key, TIMESTAMP '2024-01-01' + to_days(turn::INT) AS ts, text AS new_d, role AS author,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old_d FROM conversations)"""
EVENTS = f"""{HIST},
sims AS (
  SELECT *, len(list_intersect(list_distinct(string_split(old_d, ' ')), list_distinct(string_split(new_d, ' '))))
    / len(list_distinct(list_concat(string_split(old_d, ' '), string_split(new_d, ' '))))::DOUBLE AS sim
  FROM hist WHERE old_d <> '' AND new_d <> ''),
events_ AS (
  SELECT key, ts, author AS changed_by, sim,
    ['expansion', 'reduction', 'pivot', 'clarification', 'refactor'][length(new_d) % 5 + 1] AS change_type,
    CASE length(new_d) % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'major' ELSE 'moderate' END AS impact_level
  FROM sims WHERE sim < 0.7),
scores AS (
  SELECT key, count(*) AS n, least(1.0, avg((1 - sim)
    * CASE impact_level WHEN 'minor' THEN 0.5::DOUBLE WHEN 'major' THEN 2 ELSE 1 END
    * CASE change_type WHEN 'expansion' THEN 1.2::DOUBLE WHEN 'pivot' THEN 2 WHEN 'clarification' THEN 0.3::DOUBLE
      WHEN 'refactor' THEN 0.5::DOUBLE ELSE 1 END)) AS score FROM events_ GROUP BY 1)"""
SNAPS = """snaps AS (
  SELECT 'E-' || label AS epic_key, vec_id, snap, embedding::DOUBLE[] AS v
  FROM embeddings, (SELECT unnest([0, 1, 2]) AS snap) WHERE (vec_id + snap) % 4 <> 0),
cent AS (
  SELECT epic_key, snap, list(x ORDER BY pos) AS c FROM (
    SELECT epic_key, snap, pos, avg(x) AS x FROM (
      SELECT epic_key, snap, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM snaps) GROUP BY 1, 2, 3) GROUP BY 1, 2),
weeks AS (
  SELECT s.epic_key, s.snap, count(*) AS n_items, avg(list_cosine_similarity(v, c)) AS coherence,
    count(*) FILTER (s.snap > 0 AND NOT EXISTS (SELECT 1 FROM snaps p WHERE p.vec_id = s.vec_id AND p.snap = s.snap - 1)) AS added
  FROM snaps s JOIN cent c ON c.epic_key = s.epic_key AND c.snap = s.snap GROUP BY 1, 2),
gone AS (
  SELECT epic_key, snap + 1 AS snap, count(*) AS removed FROM snaps s
  WHERE NOT EXISTS (SELECT 1 FROM snaps n WHERE n.vec_id = s.vec_id AND n.snap = s.snap + 1) GROUP BY 1, 2),
weeks2 AS (SELECT w.*, coalesce(removed, 0) AS removed FROM weeks w LEFT JOIN gone g USING (epic_key, snap))"""

SMOKE = """qv AS (
  SELECT 'Q-' || item_id AS query_id, item_id, ['functional', 'technical', 'business'][item_id % 3 + 1] AS category,
    embedding::DOUBLE[] AS v, label FROM benchmark JOIN embeddings ON vec_id = item_id),
sims AS (
  SELECT q.query_id, 'V-' || e.vec_id AS key, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 12) AS s
  FROM qv q, embeddings e),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM sims WHERE s >= 0.3 QUALIFY rank <= 10),
smoke AS (
  SELECT query_id, count(key) FILTER (rank <= 5) AS n, coalesce(avg(s) FILTER (rank <= 5), 0) AS m,
    coalesce(string_agg(key, ',' ORDER BY rank) FILTER (rank <= 3), '') AS top_keys
  FROM qv LEFT JOIN hits USING (query_id) GROUP BY 1)"""
METRICS = f"""{SMOKE},
expected AS (SELECT q.query_id, 'V-' || e.vec_id AS key FROM qv q JOIN embeddings e ON e.label = q.label),
marked AS (SELECT h.*, x.key IS NOT NULL AS hit FROM hits h LEFT JOIN expected x USING (query_id, key)),
base AS (
  SELECT q.query_id, q.category, count(m.key) AS total_results, count(m.key) FILTER (rank <= 5) AS found,
    count(m.key) FILTER (rank <= 5 AND hit) AS relevant, coalesce(bool_and(s >= 0.35) FILTER (hit), FALSE) AS met,
    (SELECT count(*) FROM expected x WHERE x.query_id = q.query_id) AS wanted
  FROM qv q LEFT JOIN marked m USING (query_id) GROUP BY 1, 2),
pr AS (
  SELECT *, CASE WHEN found > 0 THEN relevant / found ELSE 0 END AS p, CASE WHEN wanted > 0 THEN relevant / wanted ELSE 0 END AS r
  FROM base),
metrics AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr)"""
REPORTS = """reports AS (
  SELECT ts::DATE AS ts, avg(value) / 60 AS f1, avg(value) / 100 + 0.5 AS consistency, avg(value) / 55 AS health
  FROM events GROUP BY 1),
reg AS (
  SELECT *, max(f1) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM reports)"""
RUNS = """runs AS (
  SELECT 'V-' || vec_id AS key, embedding::DOUBLE[] AS v,
    list_prepend(embedding[1]::DOUBLE + 0.3::DOUBLE, (embedding::DOUBLE[])[2:]) AS w FROM embeddings),
steady AS (
  SELECT key, (1.0::DOUBLE + 2 * list_cosine_similarity(v, w)) / 3 AS m FROM runs)"""

ORACLES = {
    "Q01_query_features": f"""WITH {FEATURES} SELECT query_id,
        {", ".join(f"array_to_string({c}, ',') AS {c}" for c in
                   ("item_types", "statuses", "priorities", "component_names", "teams", "sprints", "assignees", "epic_keys",
                    "expanded_terms", "variants"))},
        intent, expected_output, priority_boost, status_boost, strftime(date_start, '%Y-%m-%d %H:%M') AS date_start,
        strftime(date_end, '%Y-%m-%d %H:%M') AS date_end, full_text FROM featured""",
    "Q16_query_filters": f"WITH {FEATURES} SELECT query_id, filters FROM featured",
    "J05_semantic_search": f"{BASE} SELECT query_id, chunk_id, round(score, 6) AS score, position FROM found",
    "J05_semantic_search_dates": f"""WITH {FEATURES}, {CHUNKS},
        {_search_sql(15, "(days_back IS NULL OR c.created BETWEEN date_start AND date_end)")}
        SELECT query_id, chunk_id, round(score, 6) AS score, position FROM found""",
    "J07_final_ranking": f"{BASE} SELECT query_id, chunk_id, round(score, 6) AS score, fp AS final_position FROM final",
    "A12_context_summary": f"{BASE}, {SCOPE}, {TREES}, {SUMMARY} SELECT query_id, total_items, summary FROM summaries",
    "A13_debt_patterns": f"{BASE}, {PATTERNS} SELECT query_id, kind, value, n FROM patterns",
    "A14_debt_recommendations": f"{BASE}, {PATTERNS}, {ADVICE} SELECT query_id, recommendations FROM advice",
    "R01_answers": f"""{BASE}, {SCOPE}, {TREES}, {SUMMARY}, {_context_sql()}, {KEYS}
        SELECT query_id, intent, expected_output, results_count, total_items, md5(text) AS context_md5,
          length(text) // 4 AS token_count, coalesce(keys, '') AS keys
        FROM featured JOIN summaries USING (query_id) JOIN contexts USING (query_id) LEFT JOIN named USING (query_id)""",
    "R05_small_context": f"""{BASE}, {SCOPE}, {TREES}, {_context_sql(800)}
        SELECT query_id, length(text) // 4 AS token_count, md5(text) AS context_md5 FROM contexts""",
    "R07_search_tool": f"""{BASE}, {SCOPE}, {TREES}, {SUMMARY}, {KEYS}
        SELECT query_id, coalesce(keys, '') AS keys, results_count, total_items, filters AS filters_applied
        FROM featured JOIN summaries USING (query_id) LEFT JOIN named USING (query_id)""",
    "R02_answer_in_epic": f"""WITH {IN_EPIC}, {_context_sql()}
        SELECT query_id, asked_epic AS epic_key, (SELECT len(child_keys) FROM ctx WHERE ctx.key = asked_epic) AS child_count,
          (SELECT count(*) FROM final WHERE final.query_id = featured.query_id) AS results_count, md5(text) AS context_md5
        FROM featured JOIN contexts USING (query_id)""",
    "R06_epic_scope": f"""WITH {IN_EPIC.replace("WHERE s >= 0 QUALIFY", "WHERE FALSE QUALIFY")}, {_context_sql()}
        SELECT query_id, asked_epic AS epic_key, (SELECT len(child_keys) FROM ctx WHERE ctx.key = asked_epic) AS child_count,
          md5(text) AS context_md5 FROM featured JOIN contexts USING (query_id)""",
    "R03_debt_search": f"""WITH texts AS (
          SELECT q AS query_id, 'technical debt refactoring cleanup code quality maintenance' || t AS query_text
            FROM (SELECT DISTINCT ['Platform', 'Frontend', 'Backend', 'Mobile'][doc_id % 4 + 1] AS q,
              ' team:' || q AS t FROM documents UNION ALL SELECT 'all', '')),
        {_feature_sql('texts')}, {CHUNKS}, {_search_sql(20)}, {PATTERNS}, {ADVICE}
        SELECT query_id, query_text, (SELECT count(*) FROM final WHERE final.query_id = f.query_id) AS debt_items_found,
          coalesce(recommendations, '') AS recommendations FROM featured f LEFT JOIN advice USING (query_id)""",
    "R04_dependency_search": f"""WITH {CHUNKS}, texts AS (
          SELECT DISTINCT team || '/' || epic_key AS query_id,
            'blocked depends dependency waiting blocker ' || epic_key || ' ' || team AS query_text
            FROM chunks),
        {_feature_sql('texts')}, {_search_sql()}, {SCOPE}, {TREES}, {KEYS}
        SELECT query_id, query_text, (SELECT count(*) FROM final WHERE final.query_id = f.query_id) AS results_count,
          coalesce(keys, '') AS keys, filters AS filters_applied FROM featured f LEFT JOIN named USING (query_id)""",
    "W04_version_pairs": f"""WITH {HIST} SELECT key, strftime(ts, '%Y-%m-%d') AS day, author, md5(old_d) AS old_md5,
        md5(new_d) AS new_md5 FROM hist WHERE old_d IS NOT NULL""",
    "A26_drift_events": f"""WITH {EVENTS} SELECT key, strftime(ts, '%Y-%m-%d') AS day, changed_by,
        round(sim, 6) AS similarity_score, change_type, impact_level FROM events_""",
    "A25_drift_score": f"""WITH {EVENTS} SELECT key, round(score, 6) AS overall_drift_score, n AS drift_events
        FROM scores""",
    "A26_scope_drift": f"""WITH {EVENTS}, h AS (SELECT key, count(*) AS c FROM hist GROUP BY 1)
        SELECT key, c AS total_changes, round(coalesce(score, 0), 6) AS overall_drift_score, coalesce(n, 0) AS drift_events,
          coalesce(n, 0) > 0 AS has_drift, CASE WHEN c < 2 THEN 0.01::DOUBLE ELSE 0.05 END AS analysis_cost
        FROM h LEFT JOIN scores USING (key)""",
    "A28_epic_weeks": f"""WITH {SNAPS} SELECT epic_key, snap, n_items, round(coherence, 6) AS coherence,
        added AS items_added, removed AS items_removed FROM weeks2""",
    "A28_epic_evolution": f"""WITH {SNAPS}, e AS (SELECT epic_key, count(*) AS snapshots, arg_min(coherence, snap) AS f,
          arg_max(coherence, snap) AS l, sum(added)::BIGINT AS a, sum(removed)::BIGINT AS r, stddev_pop(coherence) AS sd
          FROM weeks2 GROUP BY 1)
        SELECT epic_key, snapshots, round(f, 6) AS first_coherence, round(l, 6) AS last_coherence, a AS items_added,
          r AS items_removed, round(greatest(0, least(1, 1 - sd)), 6) AS theme_stability,
          CASE WHEN l - f > 0.05 THEN 'improving' WHEN l - f < -0.05 THEN 'declining' ELSE 'stable' END AS coherence_trend
        FROM e""",
    "A16_smoke_test": f"""WITH {SMOKE} SELECT query_id, n AS results_count, round(m, 6) AS avg_similarity,
        n > 0 AND m > 0.3 AS passed, top_keys FROM smoke""",
    "A16_smoke_report": f"""WITH {SMOKE}, t AS (SELECT count(*) AS total, count(*) FILTER (n > 0 AND m > 0.3) AS passed,
          count(*) FILTER (n = 0) AS none, count(*) FILTER (m < 0.3) AS low, sum(n) AS found FROM smoke)
        SELECT total AS total_tests, passed AS passed_tests, round(passed / total * 100, 6) AS overall_score,
          coalesce(nullif(concat_ws('; ',
            CASE WHEN passed / total < 0.5
                THEN 'Overall quality is poor - consider re-generating embeddings with different parameters'
              WHEN passed / total < 0.7 THEN 'Quality is moderate - some queries may need refinement' END,
            CASE WHEN none > 0 THEN none || ' queries returned no results - consider adding more diverse work items' END,
            CASE WHEN low > 0 THEN low || ' queries had low similarity scores - embedding model may need tuning' END,
            CASE WHEN found < total * 2
              THEN 'Limited search results suggest sparse data - consider adding more work items' END), ''),
            'Embedding quality looks good - no specific improvements needed') AS recommendations FROM t""",
    "A17_retrieval_metrics": f"""WITH {METRICS} SELECT query_id, total_results, relevant AS relevant_results,
        round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, met AND relevant > 0 AS min_similarity_met,
        round(f1, 6)::DOUBLE AS f1_score FROM metrics""",
    "A17_metrics_report": f"""WITH {METRICS} SELECT round(avg(f1), 6) AS overall_f1_score,
        count(*) FILTER (f1 > 0.5) AS passed_tests, count(*) AS total_tests, round(count(*) * 0.01, 6)::DOUBLE AS processing_cost
        FROM metrics""",
    "A18_regression": f"""WITH {REPORTS} SELECT strftime(ts, '%Y-%m-%d') AS day, round(f1, 6) AS f1,
        round(baseline, 6) AS baseline_f1, round(coalesce(f1 - baseline, 0), 6) AS change,
        coalesce(f1 - baseline < -0.05, FALSE) AS has_regression FROM reg""",
    "W09_quality_trends": f"""WITH {REPORTS}, k AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS d FROM reports QUALIFY d <= 10),
        x AS (SELECT d, unnest(['health_score_trend', 'f1_score_trend', 'consistency_trend']) AS metric,
          unnest([health, f1, consistency]) AS v FROM k),
        c AS (SELECT metric, avg(v) FILTER (d <= 3) - avg(v) FILTER (d >= 8) AS c FROM x GROUP BY 1)
        SELECT metric, CASE WHEN c > 0.05 THEN 'improving' WHEN c < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM c""",
    "A19_consistency": f"""WITH {RUNS} SELECT key, 3 AS runs, round(m, 6) AS average_similarity, m > 0.99 AS is_consistent
        FROM steady""",
    "A19_consistency_report": f"""WITH {RUNS} SELECT round(avg(m), 6) AS overall_consistency,
        count(*) FILTER (m > 0.99) AS consistent_items, count(*) AS total_items FROM steady""",
    "A20_health": f"""WITH {REPORTS}, c AS (SELECT *, coalesce(f1 - baseline, 0) AS change FROM reg)
        SELECT strftime(ts, '%Y-%m-%d') AS day,
          round((f1 * 0.6 + consistency * 0.2 + 0.95 * 0.1 + 0.1 * CASE WHEN change >= -0.05 THEN 1 WHEN change < -0.2 THEN 0.5
            WHEN change < -0.1 THEN 0.7 ELSE 0.9 END) * 100, 1) AS health_a,
          round(greatest(0, least(1, (f1 * 0.5 + consistency * 0.3) * CASE WHEN change < -0.05 THEN 0.7 ELSE 1 END)), 6)
            AS health_b FROM c""",
    "A22_failing_categories": f"""WITH {METRICS} SELECT category, count(*) FILTER (f1 < 0.5) AS failing FROM metrics
        GROUP BY 1 HAVING count(*) FILTER (f1 < 0.5) > 1""",
    "A24_quality_report": f"""WITH {METRICS}, {REPORTS}, {RUNS},
        a AS (SELECT avg(f1) AS f1, count(*) FILTER (f1 > 0.5) AS passed_tests, count(*) AS total_tests,
          (SELECT avg(m) FROM steady) AS consistency, avg(f1) - (SELECT max(f1) FROM reports) AS change FROM metrics),
        h AS (SELECT *, round((f1 * 0.6 + consistency * 0.2 + 0.1 * CASE WHEN change >= -0.05 THEN 1 WHEN change < -0.2 THEN 0.5
          WHEN change < -0.1 THEN 0.7 ELSE 0.9 END) / 0.9 * 100, 1) AS health FROM a)
        SELECT round(f1, 6) AS f1, passed_tests, total_tests, round(consistency, 6) AS consistency, round(change, 6) AS change,
          change < -0.05 AS has_regression, NULL::DOUBLE AS reproducibility, health,
          concat_ws('; ',
            CASE WHEN f1 < 0.5 THEN 'Critical: RAG quality is poor (F1 < 0.5). Improve by re-training embeddings or improving test queries.'
              WHEN f1 < 0.7 THEN 'Moderate: RAG quality needs improvement (F1 < 0.7). Enhance semantic search implementation.' END,
            (SELECT string_agg('Review ' || category || ' category tests: ' || n || ' tests failing with low F1 scores.', '; '
               ORDER BY category) FROM (SELECT category, count(*) FILTER (f1 < 0.5) AS n FROM metrics GROUP BY 1) WHERE n > 1),
            CASE WHEN consistency < 0.95 THEN 'Critical: Embedding consistency is poor. Check embedding service stability.'
              WHEN consistency < 0.99 THEN 'Moderate: Embedding consistency needs improvement. Consider fixed seeds or model versioning.' END,
            CASE WHEN change < -0.05 THEN printf('Regression detected: F1 score decreased by %.2f. Review recent changes.', abs(change)) END,
            CASE WHEN health < 60 THEN 'General: System quality is poor. Consider a comprehensive review of embedding and RAG components.'
              WHEN health < 75 THEN 'General: System quality is acceptable but could be improved. Focus on specific failing tests.' END)
            AS recommendations FROM h""",
    "A23_coverage": """WITH q AS (SELECT ['functional', 'technical', 'business'][item_id % 3 + 1] AS category FROM benchmark
          UNION ALL SELECT source FROM documents)
        SELECT category, count(*) AS current, 45 AS required, greatest(0, 45 - count(*)) AS missing FROM q GROUP BY 1""",
    "J20_expected_passages": """SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    "J21_refresh_expected": """WITH w AS (
          SELECT 'Q-' || item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'),
            lambda x: length(x) > 3)[1:3]) AS word FROM benchmark),
        f AS (SELECT DISTINCT query_id, doc_id FROM w JOIN documents d
              ON contains(lower(split_part(text, chr(10), 1) || ' ' || text), word))
        SELECT query_id, 'DOC-' || doc_id AS key FROM f
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) <= 5""",
    "J22_eval_queries_from_epics": f"""WITH {SCOPE} SELECT 'epic_' || lower(s.key) AS query_id, s.key AS query_text,
          0.5::DOUBLE AS minimum_similarity, 'generated' AS category, 'Generated from Epic ' || s.key AS description,
          (SELECT count(*) FROM scope c WHERE c.epic_key = s.key) AS n_expected FROM scope s WHERE issue_type = 'Epic'""",
    "A27_scope_drift_batch": f"""WITH h AS (SELECT * FROM conversations WHERE turn <= 4), {HIST.replace("FROM conversations", "FROM h")},
        w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(old_d), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '')) AS a,
          list_distinct(list_filter(regexp_split_to_array(lower(new_d), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '')) AS b FROM hist),
        e AS (SELECT key, count(*) AS n FROM w WHERE old_d <> '' AND new_d <> ''
          AND CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0
            ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END < 0.7 GROUP BY 1),
        k AS (SELECT key, count(*) AS c FROM hist GROUP BY 1)
        SELECT count(*) AS total_items_processed, count(n) AS items_with_drift, coalesce(sum(n), 0)::BIGINT AS drift_events,
          round(sum(CASE WHEN c < 2 THEN 0.01 ELSE 0.05 END), 6)::DOUBLE AS total_cost, 0 AS failed_analyses
        FROM k LEFT JOIN e USING (key)""",
}
