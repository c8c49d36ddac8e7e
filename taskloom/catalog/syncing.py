"""Queries on change detection, tracking state, upserts and issue exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.operators import sync as S
from taskloom.sources import issues
from taskloom.sources.driver_tables import cost_log, document_items, snapshots, table
from taskloom.sources.store import read_calls

NOW = "2024-02-01 00:00:00"
SYNCED = "2024-01-01 06:00:00"
COLUMNS = ["key", "summary", "description", "issue_type", "status", "parent_key", "epic_key", "created", "updated"]


def _snap(spark, sf):
    old, new = snapshots(spark, sf)
    return old.select(COLUMNS), new.select(COLUMNS)


def _tracked(spark, sf):
    """Tracking state of the old snapshot, processed one second apart."""
    old, _ = _snap(spark, sf)
    n = F.substring("key", 5, 20).cast("bigint")
    return S.tracking_rows(old, NOW).withColumn("last_processed", F.timestamp_seconds(F.lit(1706745600) - n * 86400 / 20))



def changed_only(spark, sf):
    old, new = _snap(spark, sf)
    return S.changed_only(new, S.with_hash(old)).select("key", "content_hash")


def to_process(spark, sf):
    old, new = _snap(spark, sf)
    state = S.with_hash(old)
    fresh = new.join(old, "key", "left_anti")
    known = new.join(old, "key", "left_semi")
    return S.to_process(fresh, known, state).select("key", "content_hash")


def incremental_updates(spark, sf):
    _, new = _snap(spark, sf)
    return S.incremental_updates(new, _tracked(spark, sf), "DOC", SYNCED).select("key", "issue_type")


def tracked_epics(spark, sf):
    return S.tracked_epics(_tracked(spark, sf), "DOC")


def tracked_keys(spark, sf):
    return S.tracked_keys(_tracked(spark, sf), "DOC")


def project_stats(spark, sf):
    out = S.project_stats(_tracked(spark, sf))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("project_key", "items_count", fmt("first_seen"), fmt("last_sync"))


def state_stats(spark, sf):
    out = S.state_stats(_tracked(spark, sf))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("tracked_items", "projects_tracked", fmt("first_processed"), fmt("last_processed"))


def expire(spark, sf):
    return S.expire(_tracked(spark, sf), NOW, 20).select("key", "project_key")


def track(spark, sf):
    """State after processing the changes of the new snapshot."""
    old, new = _snap(spark, sf)
    out = S.track(_tracked(spark, sf), S.changed_only(new, S.with_hash(old)), "2024-02-02 00:00:00")
    return out.select("key", "content_hash", F.date_format("last_processed", "yyyy-MM-dd HH:mm:ss").alias("last_processed"))


def mark_synced(spark, sf):
    sync = S.project_stats(_tracked(spark, sf)).select("project_key", "last_sync", "items_count", "first_seen")
    out = S.mark_synced(S.mark_synced(sync, "DOC", NOW), "NEW", NOW)
    return out.select("project_key", F.date_format("last_sync", "yyyy-MM-dd HH:mm:ss").alias("last_sync"), "items_count")


def upsert(spark, sf):
    old, new = _snap(spark, sf)
    changes = new.withColumn("updated", F.timestamp_seconds(F.unix_timestamp("updated") + 3600))
    out = S.upsert(old, changes)
    return out.select("key", F.md5("description").alias("text_md5"), F.date_format("updated", "yyyy-MM-dd HH:mm").alias("updated"))


def upsert_chunks(spark, sf):
    """Turns as chunks: conversations with an even id were cut again into their odd turns."""
    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("CONV-"), F.col("conv_id").cast("string")).alias("source_key"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"),
        "text",
        F.timestamp_seconds("turn").alias("updated"),
        "conv_id",
        "turn",
    )
    again = c.where("conv_id % 2 = 0 and turn % 2 = 1").withColumn("text", F.concat("text", F.lit("!")))
    return S.upsert_chunks(c, again).select("source_key", "chunk_id", F.md5("text").alias("text_md5"))


def delete_keys(spark, sf):
    old, new = _snap(spark, sf)
    return S.delete_keys(new, old).select("key", "status")


def missing_vectors(spark, sf):
    items = document_items(spark, sf, ["key"])
    v = table(spark, sf, "embeddings").select(
        F.concat(F.lit("DOC-"), F.col("vec_id").cast("string")).alias("key"), "embedding"
    )
    return S.missing_vectors(items, v)


def _patches(spark, sf):
    """Patches from the quality labels: bad texts are closed, toxic ones get a priority."""
    lb = table(spark, sf, "labels")
    return lb.select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"),
        F.when(F.col("quality") == 0, "Done").alias("status"),
        F.when(F.col("toxic") == 1, "High").alias("priority"),
    )


def patch_preview(spark, sf):
    items = document_items(spark, sf, ["key", "status", "priority"])
    return S.apply_patches(items, _patches(spark, sf))


def patch_apply(spark, sf):
    items = document_items(spark, sf, ["key", "status", "priority"])
    return S.apply_patches(items, _patches(spark, sf), dry_run=False)


def get_by_key(spark, sf):
    return S.get_by_key(document_items(spark, sf), "DOC-7").select("key", "status", F.md5("description").alias("text_md5"))


def _issue_json(spark, sf):
    """Issue exports made of documents; optional parts are missing for some of them."""
    d = table(spark, sf, "documents")
    named = lambda c: F.struct(c.alias("name"))
    n = F.col("doc_id")
    fields = F.struct(
        F.when(n % 9 != 0, F.substring_index("text", "\n", 1)).alias("summary"),
        F.when(n % 6 != 0, F.col("text")).alias("description"),
        named(F.lit("Story")).alias("issuetype"),
        F.when(n % 5 != 0, named(F.lit("Open"))).alias("status"),
        F.when(n % 4 == 0, F.struct(F.concat(F.lit("PROJ-"), (n + 1).cast("string")).alias("key"))).alias("parent"),
        F.when(n % 3 == 0, "").otherwise(F.col("source")).alias("customfield_10014"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + n * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + n * 61), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated"),
        F.when(n % 2 == 0, F.struct(F.lit("Ann").alias("displayName"))).alias("assignee"),
        F.struct(F.col("lang").alias("displayName")).alias("reporter"),
        F.array(named(F.col("lang")), named(F.when(n % 2 == 0, F.col("source")))).alias("components"),
        F.when(n % 7 != 0, F.array("lang", "source")).alias("labels"),
    )
    return d.select(
        "doc_id", F.struct(F.concat(F.lit("PROJ-"), n.cast("string")).alias("key"), fields.alias("fields")).alias("issue")
    )


def _flat(items):
    return items.select(
        "key", "summary", F.md5("description").alias("text_md5"), "issue_type", "status", "parent_key", "epic_key",
        F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"),
        "assignee", "reporter", F.array_join("components", ",").alias("components"), F.array_join("labels", ",").alias("labels"),
    )


def parse_issues(spark, sf):
    return _flat(issues.parse_issues(_issue_json(spark, sf).select(F.to_json("issue").alias("value"))))


def search_pages(spark, sf):
    pages = (
        _issue_json(spark, sf)
        .groupBy(F.floor(F.col("doc_id") / 100).alias("page"))
        .agg(F.to_json(F.struct(F.collect_list("issue").alias("issues"))).alias("value"))
    )
    return _flat(issues.parse_search_pages(pages))


def typed_calls(spark, sf):
    log = cost_log(spark, sf)
    raw = log.select(
        "service",
        F.when(F.col("call_id") % 10 != 0, F.col("operation")).alias("operation"),
        "ts",
        F.when(F.col("call_id") % 4 != 0, F.to_json(F.struct("input_tokens", "output_tokens"))).alias("details"),
        "cost",
        "call_id",
    )
    out = read_calls(raw.drop("call_id"))
    return out.groupBy("service", "operation").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 4).alias("cost"),
    )


QUERIES = {
    "J09_changed_only": changed_only,
    "U03_to_process": to_process,
    "J10_incremental_updates": incremental_updates,
    "U01_tracked_epics": tracked_epics,
    "U02_tracked_keys": tracked_keys,
    "A15_project_stats": project_stats,
    "A54_state_stats": state_stats,
    "U07_expire": expire,
    "S10_track": track,
    "U08_mark_synced": mark_synced,
    "S04_upsert": upsert,
    "S05_upsert_chunks": upsert_chunks,
    "S06_delete_keys": delete_keys,
    "S04_missing_vectors": missing_vectors,
    "S09_patch_preview": patch_preview,
    "S09_patch_apply": patch_apply,
    "S03_get_by_key": get_by_key,
    "S01_parse_issues": parse_issues,
    "S02_search_pages": search_pages,
    "S18_typed_calls": typed_calls,
}

SNAP = """newer AS (
  SELECT 'DOC-' || doc_id AS key, doc_id, split_part(text, chr(10), 1) AS summary,
    CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS description, text, source AS epic_key,
    ['Epic', 'Story', 'Task', 'Bug'][doc_id % 4 + 1] AS issue_type,
    ['Open', 'In Progress', 'Done'][doc_id % 3 + 1] AS status,
    TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS updated FROM documents),
hashed AS (
  SELECT *, md5(key || '|' || summary || '|' || description || '|' || strftime(updated, '%Y-%m-%dT%H:%M:%S')) AS h,
    md5(key || '|' || summary || '|' || text || '|' || strftime(updated, '%Y-%m-%dT%H:%M:%S')) AS old_h FROM newer),
tracked AS (
  SELECT *, TIMESTAMP '2024-02-01' - to_seconds(doc_id * 4320) AS processed FROM hashed WHERE doc_id % 10 <> 0)"""
CHANGED = f"WITH {SNAP} SELECT key, h AS content_hash FROM hashed WHERE doc_id % 10 = 0 OR doc_id % 7 = 0"
FLAT = """SELECT 'PROJ-' || doc_id AS key, CASE WHEN doc_id % 9 <> 0 THEN split_part(text, chr(10), 1) ELSE '' END AS summary,
  CASE WHEN doc_id % 6 <> 0 THEN md5(text) END AS text_md5, 'Story' AS issue_type,
  CASE WHEN doc_id % 5 <> 0 THEN 'Open' ELSE '' END AS status,
  CASE WHEN doc_id % 4 = 0 THEN 'PROJ-' || (doc_id + 1) END AS parent_key,
  CASE WHEN doc_id % 3 <> 0 THEN source END AS epic_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60), '%Y-%m-%d %H:%M:%S') AS created,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 61), '%Y-%m-%d %H:%M:%S') AS updated,
  CASE WHEN doc_id % 2 = 0 THEN 'Ann' END AS assignee, lang AS reporter,
  lang || ',' || CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS components,
  CASE WHEN doc_id % 7 <> 0 THEN lang || ',' || source ELSE '' END AS labels FROM documents"""
DAY = "'%Y-%m-%d %H:%M:%S'"
PATCHED = """p AS (
  SELECT 'DOC-' || d.doc_id AS key, ['Open', 'In Progress', 'Done'][d.doc_id % 3 + 1] AS status,
    CASE l.quality WHEN 1 THEN 'High' WHEN 0 THEN 'Low' ELSE 'Medium' END AS priority,
    CASE WHEN l.quality = 0 THEN 'Done' END AS new_status, CASE WHEN l.toxic = 1 THEN 'High' END AS new_priority
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

ORACLES = {
    "J09_changed_only": CHANGED,
    "U03_to_process": CHANGED,
    "J10_incremental_updates": f"""WITH {SNAP} SELECT key, issue_type FROM newer
        WHERE updated >= TIMESTAMP '{SYNCED}'
          AND (issue_type = 'Epic' OR epic_key IN (SELECT epic_key FROM tracked)
               OR epic_key IN (SELECT key FROM tracked WHERE issue_type = 'Epic'))""",
    "U01_tracked_epics": f"""WITH {SNAP} SELECT key FROM tracked WHERE issue_type = 'Epic'
        UNION SELECT epic_key FROM tracked""",
    "U02_tracked_keys": f"WITH {SNAP} SELECT key FROM tracked",
    "A15_project_stats": f"""WITH {SNAP} SELECT 'DOC' AS project_key, count(*) AS items_count,
        strftime(min(processed), {DAY}) AS first_seen, strftime(max(processed), {DAY}) AS last_sync FROM tracked""",
    "A54_state_stats": f"""WITH {SNAP} SELECT count(*) AS tracked_items, 1 AS projects_tracked,
        strftime(min(processed), {DAY}) AS first_processed, strftime(max(processed), {DAY}) AS last_processed
        FROM tracked""",
    "U07_expire": f"""WITH {SNAP} SELECT key, 'DOC' AS project_key FROM tracked
        WHERE processed >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAYS""",
    "S10_track": f"""WITH {SNAP} SELECT key, h AS content_hash,
        strftime(CASE WHEN doc_id % 10 = 0 OR doc_id % 7 = 0 THEN TIMESTAMP '2024-02-02'
          ELSE TIMESTAMP '2024-02-01' - to_seconds(doc_id * 4320) END, {DAY}) AS last_processed FROM hashed""",
    "U08_mark_synced": f"""WITH {SNAP} SELECT 'DOC' AS project_key, '2024-02-01 00:00:00' AS last_sync,
        count(*) AS items_count FROM tracked UNION ALL SELECT 'NEW', '2024-02-01 00:00:00', 0""",
    "S04_upsert": f"""WITH {SNAP} SELECT key, md5(description) AS text_md5,
        strftime(updated + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS updated FROM newer""",
    "S05_upsert_chunks": """SELECT 'CONV-' || conv_id AS source_key, conv_id || '_' || turn AS chunk_id,
          md5(text || '!') AS text_md5 FROM conversations WHERE conv_id % 2 = 0 AND turn % 2 = 1
        UNION ALL SELECT 'CONV-' || conv_id, conv_id || '_' || turn, md5(text) FROM conversations
        WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 2 = 0 AND turn % 2 = 1)""",
    "S06_delete_keys": f"WITH {SNAP} SELECT key, status FROM newer WHERE doc_id % 10 = 0",
    "S04_missing_vectors": """SELECT 'DOC-' || doc_id AS key FROM documents
        WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "S09_patch_preview": f"""WITH {PATCHED} SELECT key, 'status' AS field, status AS old, new_status AS new FROM p
          WHERE new_status <> status
        UNION ALL SELECT key, 'priority', priority, new_priority FROM p WHERE new_priority <> priority""",
    "S09_patch_apply": f"""WITH {PATCHED} SELECT key, coalesce(new_status, status) AS status,
        coalesce(new_priority, priority) AS priority FROM p""",
    "S03_get_by_key": """SELECT 'DOC-7' AS key, 'In Progress' AS status, md5(text) AS text_md5
        FROM documents WHERE doc_id = 7""",
    "S01_parse_issues": FLAT,
    "S02_search_pages": FLAT,
    "S18_typed_calls": """SELECT event_type AS service,
        CASE WHEN event_id % 10 <> 0 THEN event_type || '.' || (user_id % 5) ELSE 'unknown' END AS operation,
        count(*) AS calls, sum(CASE WHEN event_id % 4 <> 0 THEN (props->>'k')::BIGINT ELSE 0 END)::BIGINT AS input_tokens,
        sum(CASE WHEN event_id % 4 <> 0 THEN (props->>'k')::BIGINT // 2 ELSE 0 END)::BIGINT AS output_tokens,
        round(sum(value / 100), 4) AS cost FROM events GROUP BY 1, 2""",
}
