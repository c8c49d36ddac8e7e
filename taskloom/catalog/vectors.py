"""Queries on vector items: search, duplicates, coherence, misplaced items, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.functions import vector as V
from taskloom.operators import clusters, neighbours, similarity
from taskloom.operators.filters import for_project, where_meta
from taskloom.plans import overview
from taskloom.sources.driver_tables import vector_items

# The generated vectors are nearly orthogonal (best pair about 0.5), so the levels and
# thresholds of the registered queries are lower than the library defaults.
LEVELS = {"exact": 0.45, "high": 0.40, "medium": 0.35, "low": 0.30}
LOW = 0.30
CROSS = 0.25


def _r(c, n=6):
    return F.round(c, n)


def _as_queries(items):
    return items.select(F.col("key").alias("query_id"), "embedding", "epic_key")


def _hits(df):
    return df.select("query_id", "key", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


def scan(spark, sf):
    return vector_items(spark, sf).select("key", "epic_key", "issue_type", "status")


def project_filter(spark, sf):
    items = vector_items(spark, sf)
    return for_project(items, "V").select("key", F.size("embedding").cast("bigint").alias("width"))


def meta_filter(spark, sf):
    items = vector_items(spark, sf)
    wanted = {"issue_type": ["Story", "Bug"], "status": "Open", "components": ["part-1", "part-3"], "labels": []}
    return where_meta(items, wanted).select("key", "issue_type", "status")


def type_filter(spark, sf):
    return where_meta(vector_items(spark, sf), {"issue_type": ["Task"]}).select("key", "epic_key")


def cosine_neighbours(spark, sf):
    items = vector_items(spark, sf).withColumn("n", F.substring("key", 3, 20).cast("bigint"))
    after = items.select((F.col("n") - 1).alias("n"), F.col("key").alias("next_key"), F.col("embedding").alias("b"))
    return items.join(after, "n").select("key", "next_key", _r(V.cosine("embedding", "b")).alias("similarity"))


def top_k(spark, sf):
    items = vector_items(spark, sf)
    return _hits(neighbours.top_k(_as_queries(items), items, 10, LOW))


def top_k_unbounded(spark, sf):
    items = vector_items(spark, sf)
    return _hits(neighbours.top_k(_as_queries(items), items, 5, None))


def top_k_filtered(spark, sf):
    items = vector_items(spark, sf)
    kept = where_meta(items, {"issue_type": ["Story", "Task"], "status": "Open"})
    return _hits(neighbours.top_k(_as_queries(items), kept, 10, 0.2))


def top_k_in_group(spark, sf):
    items = vector_items(spark, sf)
    return _hits(neighbours.top_k(_as_queries(items), items, 10, None, group="epic_key"))


def duplicate_pairs(spark, sf):
    pairs = similarity.duplicate_pairs(vector_items(spark, sf), LOW, 20, LEVELS)
    return pairs.select(
        "original_key",
        "similar_key",
        _r("score").alias("score"),
        "level",
        "suggested_action",
        F.col("review_priority").cast("bigint").alias("review_priority"),
        F.array_join("reasons", "; ").alias("reasons"),
    )


def duplicate_report(spark, sf):
    items = vector_items(spark, sf)
    report = similarity.duplicate_report(similarity.duplicate_pairs(items, LOW, 20, LEVELS), items)
    return report.withColumn("processing_cost", _r("processing_cost"))


def pair_stats(spark, sf):
    rows = similarity.item_coherence(vector_items(spark, sf))
    return rows.select("epic_key", "key", "n_items", _r("mean_similarity").alias("mean_similarity"))


def epic_groups(spark, sf):
    return similarity.epic_groups(vector_items(spark, sf))


def centroids(spark, sf):
    c = similarity.centroids(vector_items(spark, sf))
    return c.select("epic_key", "n_items", F.posexplode("centroid").alias("pos", "x")).select(
        "epic_key", "n_items", F.col("pos").cast("bigint").alias("pos"), _r("x").alias("x")
    )


def theme_coherence(spark, sf):
    items = vector_items(spark, sf)
    themes = similarity.centroids(items).select("epic_key", F.col("centroid").alias("theme"))
    out = similarity.coherence_to_theme(items, themes)
    return out.select("epic_key", "n_items", _r("coherence").alias("coherence"))


def epic_coherence(spark, sf):
    out = similarity.epic_coherence(vector_items(spark, sf))
    return out.select(
        "epic_key",
        "work_items_count",
        _r("raw_coherence").alias("raw_coherence"),
        _r("coherence_score").alias("coherence_score"),
        _r("theme_consistency").alias("theme_consistency"),
        "outlier_count",
        F.array_join("recommendations", "; ").alias("recommendations"),
    )


def coherence_outliers(spark, sf):
    out = similarity.coherence_outliers(vector_items(spark, sf))
    return out.select("epic_key", "key", _r("mean_similarity").alias("mean_similarity"))


def cross_epic(spark, sf):
    out = similarity.cross_epic_matches(vector_items(spark, sf), CROSS)
    return out.withColumn("score", _r("score"))


def misplaced(spark, sf):
    out = similarity.misplaced(vector_items(spark, sf), CROSS)
    return out.withColumn("confidence_score", _r("confidence_score")).withColumn(
        "coherence_difference", _r("coherence_difference")
    )


def auto_eps(spark, sf):
    return clusters.auto_eps(vector_items(spark, sf)).select(_r("eps").alias("eps"))


def nearest_distance(spark, sf):
    return clusters.nearest_distance(vector_items(spark, sf)).select("key", _r("distance").alias("distance"))


def density_clusters(spark, sf):
    return clusters.density_clusters(vector_items(spark, sf), 0.605)


def density_clusters_euclidean(spark, sf):
    return clusters.density_clusters(vector_items(spark, sf), 1.12, metric="euclidean")


def debt_candidates(spark, sf):
    items = vector_items(spark, sf)
    seeds = similarity.centroids(items).select(F.col("epic_key").alias("seed_id"), F.col("centroid").alias("embedding"))
    found = clusters.debt_candidates(items, seeds, "V", 50, 0.15, terms=["item 1", "item 2", "tag-3"])
    return found.select("key", "epic_key", "issue_type")


def debt_clusters(spark, sf):
    items = vector_items(spark, sf)
    out = clusters.debt_clusters(items)
    return out.withColumn("priority_score", _r("priority_score"))


def project_duplicates(spark, sf):
    report = overview.duplicates_of_projects(vector_items(spark, sf), ["V"], LOW, 20, LEVELS)
    return report.withColumn("processing_cost", _r("processing_cost"))


def epic_overview(spark, sf):
    out = overview.epic_overview(vector_items(spark, sf), CROSS)
    return out.withColumn("coherence_score", _r("coherence_score")).withColumn("cost", _r("cost"))


QUERIES = {
    "S07_scan": scan,
    "P01_project_filter": project_filter,
    "P02_meta_filter": meta_filter,
    "P03_type_filter": type_filter,
    "J01_cosine": cosine_neighbours,
    "J02_top_k": top_k,
    "J02_top_k_no_threshold": top_k_unbounded,
    "J03_top_k_filtered": top_k_filtered,
    "J04_top_k_in_group": top_k_in_group,
    "J14_duplicate_pairs": duplicate_pairs,
    "A11_duplicate_report": duplicate_report,
    "J17_epic_pair_means": pair_stats,
    "A03_epic_groups": epic_groups,
    "A04_centroids": centroids,
    "A05_coherence_to_theme": theme_coherence,
    "A06_epic_coherence": epic_coherence,
    "A06_coherence_outliers": coherence_outliers,
    "J15_cross_epic_matches": cross_epic,
    "J16_misplaced": misplaced,
    "A31_auto_eps": auto_eps,
    "W05_nearest_distance": nearest_distance,
    "A32_density_clusters": density_clusters,
    "A32_density_clusters_euclidean": density_clusters_euclidean,
    "J19_debt_candidates": debt_candidates,
    "A33_debt_clusters": debt_clusters,
    "R08_project_duplicates": project_duplicates,
    "R10_epic_overview": epic_overview,
}

# ------------------------------------------------------------------------- SQL

ITEMS = """items AS (
  SELECT 'V-' || vec_id AS key, 'Vector item ' || vec_id AS summary, 'E-' || label AS epic_key, vec_id,
         ['Story', 'Task', 'Bug'][vec_id % 3 + 1] AS issue_type, ['Open', 'Done'][vec_id % 2 + 1] AS status,
         'part-' || (vec_id % 5) AS component, 'tag-' || (vec_id % 7) AS tag,
         TIMESTAMP '2024-01-01' + vec_id * INTERVAL 1 MINUTE AS created, embedding::DOUBLE[] AS v
  FROM embeddings)"""


def _hits_sql(k, threshold, where="TRUE"):
    return f"""pairs AS (
  SELECT a.key AS query_id, b.key AS key, round(list_cosine_similarity(a.v, b.v), 12) AS s
  FROM items a, items b WHERE {where}),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, key) AS rank FROM pairs
  WHERE s >= {threshold} QUALIFY rank <= {k})"""


def _top_sql(k, threshold, where="TRUE"):
    return f"WITH {ITEMS}, {_hits_sql(k, threshold, where)} SELECT query_id, key, round(s, 6) AS score, rank FROM hits"


DUPLICATES = f"""{ITEMS}, {_hits_sql(20, LOW)},
firsts AS (
  SELECT least(query_id, key) AS a, greatest(query_id, key) AS b, min(query_id) AS original_key, max(s) AS s
  FROM hits WHERE query_id <> key GROUP BY 1, 2),
named AS (
  SELECT original_key, CASE WHEN original_key = a THEN b ELSE a END AS similar_key, s,
         CASE WHEN s >= 0.45 THEN 'exact' WHEN s >= 0.40 THEN 'high' WHEN s >= 0.35 THEN 'medium' ELSE 'low' END AS level
  FROM firsts),
dups AS (
  SELECT n.original_key, n.similar_key, round(n.s, 6) AS score, n.level,
    CASE n.level WHEN 'exact' THEN 'Immediate review - likely exact duplicate'
      WHEN 'high' THEN 'High priority review - consider merging'
      WHEN 'medium' THEN 'Investigate potential relationship - compare for related work'
      ELSE 'Low priority - monitor for patterns' END AS suggested_action,
    least(5, 1 + (o.issue_type = t.issue_type)::INT + (o.status = t.status)::INT + (o.epic_key = t.epic_key)::INT
      + (floor((epoch(o.created) - epoch(t.created)) / 86400) < 30)::INT)::BIGINT AS review_priority,
    concat_ws('; ', 'Similar titles/keywords', CASE WHEN o.epic_key = t.epic_key THEN 'Same Epic' END,
      CASE WHEN o.component = t.component THEN 'Shared components' END,
      CASE WHEN o.tag = t.tag THEN 'Shared labels' END,
      CASE WHEN n.s > 0.8 THEN 'High semantic similarity' END) AS reasons
  FROM named n JOIN items o ON o.key = n.original_key JOIN items t ON t.key = n.similar_key)"""

REPORT = """SELECT (SELECT count(*) FROM dups) AS total_candidates,
  (SELECT count(*) FROM dups WHERE level = 'exact') AS exact_candidates,
  (SELECT count(*) FROM dups WHERE level = 'high') AS high_candidates,
  (SELECT count(*) FROM dups WHERE level = 'medium') AS medium_candidates,
  (SELECT count(*) FROM dups WHERE level = 'low') AS low_candidates,
  (SELECT count(*) FROM items) AS items_analyzed,
  round((SELECT count(*) FROM items) * 0.0001, 6)::DOUBLE AS processing_cost"""

MEANS = f"""{ITEMS},
means AS (
  SELECT a.epic_key, a.key, count(*) + 1 AS n_items, avg(list_cosine_similarity(a.v, b.v)) AS m
  FROM items a JOIN items b ON a.epic_key = b.epic_key AND a.key <> b.key GROUP BY 1, 2)"""

OUTLIERS = f"""{MEANS},
cand AS (SELECT *, row_number() OVER (PARTITION BY epic_key ORDER BY m) AS rn,
           count(*) OVER (PARTITION BY epic_key) AS n FROM means WHERE m < 0.5),
cuts AS (SELECT epic_key, least(0.4, coalesce(max(m) FILTER (rn = n // 5), 0.4)) AS cut FROM cand GROUP BY 1),
outliers AS (SELECT c.epic_key, c.key, c.m FROM cand c JOIN cuts USING (epic_key) WHERE c.m < cut)"""

COHERENCE = f"""{OUTLIERS},
base AS (
  SELECT epic_key, count(*) AS work_items_count, avg(m) AS raw,
         (SELECT count(*) FROM outliers o WHERE o.epic_key = means.epic_key) AS outlier_count
  FROM means GROUP BY 1),
coherence AS (
  SELECT epic_key, work_items_count, round(raw, 6) AS raw_coherence,
    round(greatest(0, least(1, raw)), 6) AS coherence_score,
    round(greatest(0, least(1, (raw + 0.2) / 1.2)), 6) AS theme_consistency, outlier_count,
    CASE WHEN raw >= 0.6 AND outlier_count = 0 AND (raw + 0.2) / 1.2 >= 0.5
      THEN 'Epic shows good coherence and theme consistency' ELSE
    concat_ws('; ',
      CASE WHEN raw < 0.6 THEN 'Epic has low coherence - consider splitting or reorganizing' END,
      CASE WHEN outlier_count > 0 THEN 'Review ' || outlier_count || ' outlier items for correct Epic assignment' END,
      CASE WHEN (raw + 0.2) / 1.2 < 0.5 THEN 'Epic theme is inconsistent - review work item alignment' END)
    END AS recommendations
  FROM base)"""

CENTROIDS = """cent AS (
  SELECT epic_key, list(x ORDER BY pos) AS c, any_value(n) AS n FROM (
    SELECT epic_key, pos, avg(x) AS x, count(*) AS n FROM (
      SELECT epic_key, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM items) GROUP BY 1, 2)
  GROUP BY 1)"""

MATCHES = f"""{_hits_sql(10, CROSS)},
matches AS (
  SELECT h.query_id AS item_key, a.epic_key AS item_epic, h.key AS match_key, b.epic_key AS match_epic, h.s
  FROM hits h JOIN items a ON a.key = h.query_id JOIN items b ON b.key = h.key WHERE a.epic_key <> b.epic_key)"""

# The fold over candidates is unrolled by rank with a recursive table.
MISPLACED = f"""{ITEMS}, {CENTROIDS}, {MATCHES},
fits AS (
  SELECT m.item_key, m.item_epic, m.match_epic, list_cosine_similarity(i.v, c.c) AS fit,
         row_number() OVER (PARTITION BY m.item_key ORDER BY m.s DESC, m.match_key) AS step
  FROM matches m JOIN items i ON i.key = m.item_key JOIN cent c ON c.epic_key = m.match_epic),
fold AS (
  SELECT i.key AS item_key, 0::BIGINT AS step, list_cosine_similarity(i.v, c.c) AS best, NULL::VARCHAR AS epic,
         list_cosine_similarity(i.v, c.c) AS own
  FROM items i JOIN cent c ON c.epic_key = i.epic_key
  UNION ALL
  SELECT f.item_key, x.step, CASE WHEN x.fit > f.best + 0.15 THEN x.fit ELSE f.best END,
         CASE WHEN x.fit > f.best + 0.15 THEN x.match_epic ELSE f.epic END, f.own
  FROM fold f JOIN fits x ON x.item_key = f.item_key AND x.step = f.step + 1),
misplaced AS (
  SELECT f.item_key AS work_item_key, i.epic_key AS current_epic_key, f.epic AS suggested_epic_key,
         f.best, f.own FROM fold f JOIN items i ON i.key = f.item_key
  WHERE f.epic IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY f.item_key ORDER BY f.step DESC) = 1)"""

NEAREST = f"""{ITEMS},
near AS (
  SELECT a.key, round(1 - max(round(list_cosine_similarity(a.v, b.v), 12)), 12) AS d
  FROM items a JOIN items b ON a.key <> b.key GROUP BY 1)"""


def _cluster_sql(distance, eps):
    """Connected components by spreading the smallest key."""
    return f"""edges AS MATERIALIZED (
  SELECT a.key AS a, b.key AS b FROM items a JOIN items b ON a.key <> b.key
  WHERE round({distance}, 12) <= {eps}),
reach AS (
  SELECT a AS node, a AS root FROM edges
  UNION
  SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b),
comp AS (SELECT node AS key, min(root) AS root FROM reach GROUP BY 1),
clusters AS (SELECT key, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM comp)"""


COS_D = "1 - list_cosine_similarity(a.v, b.v)"
EFFORT_SIMPLE = "'Small'"

ORACLES = {
    "S07_scan": f"WITH {ITEMS} SELECT key, epic_key, issue_type, status FROM items",
    "P01_project_filter": f"WITH {ITEMS} SELECT key, len(v) AS width FROM items WHERE key LIKE 'V-%'",
    "P02_meta_filter": f"""WITH {ITEMS} SELECT key, issue_type, status FROM items
        WHERE issue_type IN ('Story', 'Bug') AND status = 'Open' AND component IN ('part-1', 'part-3')""",
    "P03_type_filter": f"WITH {ITEMS} SELECT key, epic_key FROM items WHERE issue_type = 'Task'",
    "J01_cosine": f"""WITH {ITEMS} SELECT a.key, b.key AS next_key,
        round(list_cosine_similarity(a.v, b.v), 6) AS similarity
        FROM items a JOIN items b ON b.vec_id = a.vec_id + 1""",
    "J02_top_k": _top_sql(10, LOW),
    "J02_top_k_no_threshold": _top_sql(5, -2),
    "J03_top_k_filtered": _top_sql(10, 0.2, "b.issue_type IN ('Story', 'Task') AND b.status = 'Open'"),
    "J04_top_k_in_group": _top_sql(10, -2, "a.epic_key = b.epic_key"),
    "J14_duplicate_pairs": f"WITH {DUPLICATES} SELECT * FROM dups",
    "A11_duplicate_report": f"WITH {DUPLICATES} {REPORT}",
    "R08_project_duplicates": f"WITH {DUPLICATES} {REPORT}",
    "J17_epic_pair_means": f"""WITH {MEANS}
        SELECT epic_key, key, n_items, round(m, 6) AS mean_similarity FROM means""",
    "A03_epic_groups": f"""WITH {ITEMS}
        SELECT epic_key, count(*) AS n_items FROM items GROUP BY 1 HAVING count(*) >= 2""",
    "A04_centroids": f"""WITH {ITEMS}, {CENTROIDS}
        SELECT epic_key, n AS n_items, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 6) AS x FROM cent""",
    "A05_coherence_to_theme": f"""WITH {ITEMS}, {CENTROIDS}
        SELECT epic_key, count(*) AS n_items, round(avg(list_cosine_similarity(v, c)), 6) AS coherence
        FROM items JOIN cent USING (epic_key) GROUP BY 1""",
    "A06_epic_coherence": f"WITH {COHERENCE} SELECT * FROM coherence",
    "A06_coherence_outliers": f"""WITH {OUTLIERS}
        SELECT epic_key, key, round(m, 6) AS mean_similarity FROM outliers""",
    "J15_cross_epic_matches": f"""WITH {ITEMS}, {MATCHES}
        SELECT item_key, item_epic, match_key, match_epic, round(s, 6) AS score FROM matches""",
    "J16_misplaced": f"""WITH RECURSIVE {MISPLACED}
        SELECT work_item_key, current_epic_key, suggested_epic_key, round(best, 6) AS confidence_score,
          round(best - own, 6) AS coherence_difference,
          'Work item shows ' || CASE WHEN best - own > 0.3 THEN 'significantly ' WHEN best - own > 0.15
            THEN 'notably ' ELSE '' END || 'higher semantic similarity, with Epic ' || suggested_epic_key || ' (' ||
          CASE WHEN best > 0.8 THEN 'high' WHEN best > 0.6 THEN 'moderate' ELSE 'low' END ||
          printf(' confidence). Current Epic coherence: %.2f, Suggested Epic coherence: %.2f.', own, best) AS reasoning
        FROM misplaced""",
    "A31_auto_eps": f"WITH {NEAREST} SELECT round(quantile_cont(d, 0.75), 6) AS eps FROM near",
    "W05_nearest_distance": f"WITH {NEAREST} SELECT key, round(d, 6) AS distance FROM near",
    "A32_density_clusters": f"""WITH RECURSIVE {ITEMS}, {_cluster_sql(COS_D, 0.605)}
        SELECT key, cluster_id FROM clusters""",
    "A32_density_clusters_euclidean": f"""WITH RECURSIVE {ITEMS}, {_cluster_sql("list_distance(a.v, b.v)", 1.12)}
        SELECT key, cluster_id FROM clusters""",
    "J19_debt_candidates": f"""WITH {ITEMS}, {CENTROIDS},
        pairs AS (SELECT c.epic_key AS seed, i.key, round(list_cosine_similarity(c.c, i.v), 12) AS s
                  FROM cent c, items i),
        hits AS (SELECT * FROM pairs WHERE s >= 0.15
                 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY s DESC, key) <= 50)
        SELECT key, epic_key, issue_type FROM items
        WHERE key IN (SELECT key FROM hits) AND (lower(summary) LIKE '%item 1%' OR lower(summary) LIKE '%item 2%'
          OR (issue_type = 'Task' AND tag = 'tag-3'))""",
    "A33_debt_clusters": f"""WITH RECURSIVE {NEAREST},
        eps AS (SELECT quantile_cont(d, 0.75) AS e FROM near), {_cluster_sql(COS_D, "(SELECT e FROM eps)")}
        SELECT cluster_id, key, 'Tech Debt Cluster ' || cluster_id AS theme, 0.3::DOUBLE AS priority_score,
          'Small' AS estimated_effort, 'Medium impact if not addressed' AS impact_assessment,
          'Address items in order of priority' AS recommended_approach,
          count(*) OVER (PARTITION BY cluster_id) AS n_items FROM clusters""",
    "R10_epic_overview": f"""WITH RECURSIVE {MISPLACED}, m AS (
          SELECT current_epic_key AS epic_key, count(*) AS n FROM misplaced GROUP BY 1),
        means AS (
          SELECT a.epic_key, a.key, avg(list_cosine_similarity(a.v, b.v)) AS m
          FROM items a JOIN items b ON a.epic_key = b.epic_key AND a.key <> b.key GROUP BY 1, 2)
        SELECT epic_key, count(*) AS n_items, coalesce(any_value(m.n), 0) AS misplaced_count,
          round(greatest(0, least(1, avg(means.m))), 6) AS coherence_score, round(count(*) * 0.0001, 6)::DOUBLE AS cost
        FROM means LEFT JOIN m USING (epic_key) GROUP BY 1""",
}
