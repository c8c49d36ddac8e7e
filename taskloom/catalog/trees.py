"""Queries on the customer > order > line tree: children, trees, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.operators import hierarchy as H
from taskloom.sources import store
from taskloom.sources.driver_tables import table, tree_items


def _epics(items):
    return items.where(F.col("issue_type") == "Epic")


def active_epics(spark, sf):
    return H.active_epics(tree_items(spark, sf), "C").select("key", "status")


def epic_children(spark, sf):
    items = tree_items(spark, sf)
    return H.ordered_children(items, _epics(items)).select("epic", "key", F.date_format("created", "yyyy-MM-dd").alias("day"))


def story_children(spark, sf):
    items = tree_items(spark, sf)
    stories = items.where(F.col("issue_type") == "Story")
    return H.epic_children(items, stories).select("epic", "key")


def child_edges(spark, sf):
    return H.child_edges(tree_items(spark, sf))


def descendants(spark, sf):
    items = tree_items(spark, sf)
    return H.descendants(items, _epics(items)).withColumn("level", F.col("level").cast("bigint"))


def completion(spark, sf):
    items = tree_items(spark, sf)
    tree = H.descendants(items, _epics(items))
    out = H.completion(tree, items, _epics(items))
    return out.select("root", F.round("completion_percentage", 6).alias("completion_percentage"))


def depth(spark, sf):
    items = tree_items(spark, sf)
    out = H.depth(H.descendants(items, _epics(items), ["parent_key"]), items)
    return out.withColumn("hierarchy_depth", F.col("hierarchy_depth").cast("bigint"))


def epic_tree(spark, sf):
    items = tree_items(spark, sf)
    out = H.epic_tree(items, _epics(items))
    return out.withColumn("completion_percentage", F.round("completion_percentage", 6)).withColumn(
        "hierarchy_depth", F.col("hierarchy_depth").cast("bigint")
    )


def epic_hierarchy(spark, sf):
    items = tree_items(spark, sf)
    return H.epic_hierarchy(items, _epics(items))


def hierarchy_edges(spark, sf):
    items = tree_items(spark, sf)
    return H.hierarchy_edges(items, _epics(items))


def context_tree(spark, sf):
    items = tree_items(spark, sf)
    out = H.context_tree(items.select("key"), items)
    return out.select(
        "key", "parent_context", F.array_join("child_keys", ",").alias("child_keys"),
        F.col("total_items").cast("bigint").alias("total_items"),
    )


def projects(spark, sf):
    return store.projects(tree_items(spark, sf))


def extraction_cost(spark, sf):
    """Every order is one call that fetched its lines; the seconds stand in for its price."""
    orders, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    counts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    calls = orders.join(counts, "o_orderkey").select("items", (F.col("o_totalprice") / 1000).alias("seconds"))
    out = store.extraction_cost(calls)
    return out.withColumn("processing_seconds", F.round("processing_seconds", 3)).withColumn(
        "estimated_cost", F.round("estimated_cost", 6)
    )


def table_stats(spark, sf):
    return store.table_stats(table(spark, sf, "lineitem"))


QUERIES = {
    "J11_active_epics": active_epics,
    "J12_epic_children": epic_children,
    "J12_story_children": story_children,
    "J12_child_edges": child_edges,
    "J13_descendants": descendants,
    "A08_completion": completion,
    "A09_depth": depth,
    "A10_epic_tree": epic_tree,
    "A07_epic_hierarchy": epic_hierarchy,
    "A07_hierarchy_edges": hierarchy_edges,
    "J08_context_tree": context_tree,
    "S16_projects": projects,
    "S17_extraction_cost": extraction_cost,
    "S08_table_stats": table_stats,
}

LINE_KEY = "concat_ws('-', 'L', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"
TREE = f"""items AS (
  SELECT 'C-' || c_custkey AS key, 'Epic' AS issue_type, CASE WHEN c_acctbal < 0 THEN 'Closed' ELSE 'Open' END AS status,
    NULL::VARCHAR AS parent_key, NULL::VARCHAR AS epic_key, TIMESTAMP '2024-01-01' AS created FROM customer
  UNION ALL SELECT 'O-' || o_orderkey, 'Story',
    CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' ELSE 'In Progress' END, NULL, 'C-' || o_custkey,
    o_orderdate FROM orders
  UNION ALL SELECT {LINE_KEY}, 'Sub-task', CASE l_linestatus WHEN 'F' THEN 'Closed' ELSE 'Open' END, 'O-' || l_orderkey,
    NULL, l_shipdate FROM lineitem),
edges AS (
  SELECT parent_key AS parent, key AS child FROM items WHERE parent_key IS NOT NULL
  UNION SELECT epic_key, key FROM items WHERE epic_key IS NOT NULL),
tree AS (
  SELECT 'C-' || c_custkey AS root, 'C-' || c_custkey AS key, 0 AS level FROM customer
  UNION ALL SELECT t.root, e.child, t.level + 1 FROM tree t JOIN edges e ON e.parent = t.key)"""
MEMBERS = "SELECT t.root, t.level, i.* FROM tree t JOIN items i USING (key)"

ORACLES = {
    "J11_active_epics": f"""WITH RECURSIVE {TREE} SELECT key, status FROM items
        WHERE issue_type = 'Epic' AND status <> 'Closed' AND key IN (SELECT parent FROM edges)""",
    "J12_epic_children": """SELECT 'C-' || o_custkey AS epic, 'O-' || o_orderkey AS key,
        strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
    "J12_story_children": f"""SELECT 'O-' || l_orderkey AS epic, {LINE_KEY} AS key FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "J12_child_edges": f"WITH RECURSIVE {TREE} SELECT parent, child FROM edges",
    "J13_descendants": f"WITH RECURSIVE {TREE} SELECT root, key, level FROM tree WHERE level > 0",
    "A08_completion": f"""WITH RECURSIVE {TREE}, m AS ({MEMBERS})
        SELECT root, round(100.0 * count(*) FILTER (lower(status) IN ('done', 'closed', 'resolved', 'completed'))
          / count(*), 6) AS completion_percentage FROM m GROUP BY 1""",
    "A09_depth": f"""WITH RECURSIVE {TREE} SELECT root, max(level) AS hierarchy_depth FROM tree
        WHERE level > 0 GROUP BY 1""",
    "A10_epic_tree": f"""WITH RECURSIVE {TREE}, m AS ({MEMBERS})
        SELECT root, count(*) FILTER (level = 1) AS direct_children, count(*) - 1 AS all_descendants,
          count(*) AS total_items, greatest(1, max(level)) AS hierarchy_depth,
          round(100.0 * count(*) FILTER (lower(status) IN ('done', 'closed', 'resolved', 'completed'))
          / count(*), 6) AS completion_percentage FROM m GROUP BY 1""",
    "A07_epic_hierarchy": """SELECT 'C-' || c_custkey AS epic, count(o_orderkey) AS stories, 0 AS tasks, 0 AS subtasks,
        count(o_orderkey) AS total_items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "A07_hierarchy_edges": """SELECT 'C-' || o_custkey AS epic, 'O-' || o_orderkey AS key, 'story' AS role
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "J08_context_tree": f"""WITH RECURSIVE {TREE}, c AS (
          SELECT epic_key AS root, key, row_number() OVER (PARTITION BY epic_key ORDER BY key) AS i
          FROM items WHERE epic_key IS NOT NULL),
        k AS (SELECT root, string_agg(key, ',' ORDER BY i) AS ks, count(*) AS n FROM c WHERE i <= 50 GROUP BY 1)
        SELECT i.key, p.key AS parent_context, coalesce(ks, '') AS child_keys, coalesce(n, 0) + 1 AS total_items
        FROM items i LEFT JOIN items p ON p.key = coalesce(i.epic_key, i.parent_key) LEFT JOIN k ON k.root = i.key""",
    "S16_projects": "SELECT unnest(['C', 'O', 'L']) AS project",
    "S17_extraction_cost": """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT count(*) AS api_calls, sum(n)::BIGINT AS items_processed, round(sum(o_totalprice / 1000), 3) AS processing_seconds,
          round(count(*) * 0.01, 6)::DOUBLE AS estimated_cost FROM orders JOIN c ON l_orderkey = o_orderkey""",
    "S08_table_stats": "SELECT count(*) AS points_count, 1 AS segments_count, 'green' AS status FROM lineitem",
}
