"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import (
    decontamination,
    factors,
    filter_audit,
    language,
    packing,
    pii,
    quality,
    secrets,
    simhash,
    substrings,
    toxicity,
    turn_repair,
    warc,
)
from taskloom.llm.common import crc_fold, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(packing.pack(table(spark, sf_dir, "documents")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_fold("doc_id", 3) != 1))
    held_out = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return language.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_fold("doc_id", 5) != 0)
    held_out = F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", held_out, "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(docs, quality.fit(docs, trusted))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.digest(factors.remove_passages(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return turn_repair.repair(given, turn_repair.damaged(given))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP3_SQL = """
WITH texts AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS t FROM documents),
places AS (SELECT doc_id, t, unnest(range(1, length(t) // 2 - 98)) AS p FROM texts WHERE length(t) >= 200),
windows AS (SELECT doc_id, p, substr(t, 2 * p - 1, 200) AS w FROM places),
firsts AS (SELECT w, min((doc_id, p)) AS f FROM windows GROUP BY w HAVING count(*) > 1),
repeats AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE (doc_id, p) <> f),
marked AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) AS step FROM repeats),
runs AS (SELECT doc_id, p, sum((step > 100)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM marked),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + 99 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, r, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY r), 0) AS before FROM spans),
gone AS (
  SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, max(b) AS last, list(struct_pack(x := before, y := a) ORDER BY r) AS kept
  FROM gaps GROUP BY doc_id)
SELECT texts.doc_id, (length(t) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN kept IS NULL THEN t
    ELSE array_to_string(list_transform(kept, lambda k: substr(t, 2 * k.x + 1, 2 * (k.y - 1 - k.x))), '') || substr(t, 2 * last + 1) END))
    AS kept_sha256
FROM texts LEFT JOIN gone ON texts.doc_id = gone.doc_id
"""

OP8_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
large AS (SELECT html, max(page_id) AS original FROM payloads WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN original <> page_id THEN original END AS refers_to
FROM payloads LEFT JOIN large USING (html)
"""

OP9_SQL = """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM texts WHERE len(ws) >= 50),
windows AS (SELECT doc_id, p, md5_number(array_to_string(ws[p:p + 49], ' ')) AS w FROM places),
firsts AS (SELECT w, min(doc_id) AS f FROM windows GROUP BY w),
repeats AS (SELECT doc_id, p FROM windows JOIN firsts USING (w) WHERE doc_id > f),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM repeats) GROUP BY doc_id)
SELECT texts.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN ws
    ELSE list_filter(ws, lambda w, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN gone ON texts.doc_id = gone.doc_id
"""

OP12_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM texts LEFT JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
masks AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masked GROUP BY part, mask),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, unnest([
    {'step': 1, 'bit': a.bit, 'seen': 0},
    {'step': 2, 'bit': b.bit, 'seen': a.bit},
    {'step': 3, 'bit': c.bit, 'seen': a.bit + b.bit},
    {'step': 4, 'bit': d.bit, 'seen': a.bit + b.bit + c.bit},
    {'step': 5, 'bit': e.bit, 'seen': a.bit + b.bit + c.bit + d.bit}], recursive := true)
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (seen | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & seen = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & seen > 0 AND mask & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & seen = 0 AND mask & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & seen = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM masks CROSS JOIN orders GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM steps
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_language": op2_language,
        "op3_substrings": op3_substrings,
        "op4_toxicity": op4_toxicity,
        "op5_quality": op5_quality,
        "op6_simhash": op6_simhash,
        "op7_decontamination": op7_decontamination,
        "op8_warc": op8_warc,
        "op9_passages": op9_passages,
        "op10_pii": op10_pii,
        "op11_secrets": op11_secrets,
        "op12_filter_audit": op12_filter_audit,
        "op13_turn_repair": op13_turn_repair,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substrings": OP3_SQL, "op8_warc": OP8_SQL, "op9_passages": OP9_SQL, "op12_filter_audit": OP12_SQL}
