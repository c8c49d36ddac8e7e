"""Queries on text items: cleaning, hashes, debt scores, chunks, labels, prompts, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.functions import debt, text
from taskloom.operators import chunking, cost, labels, metadata, prompts, templates
from taskloom.operators.filters import validation_errors
from taskloom.sources.driver_tables import document_items, table, tree_items

# The generated prose is invented, so the registered queries use word lists made of
# syllables that do occur in it; the library defaults are the fixed lists.
KW = ["tion", "heon", "eaux", "inha", "ungen"]
PRIO = {"high": ["heon", "eaux", "ungen"], "medium": ["tion", "that"], "low": ["the", "que"], "labels": ["en", "fr"]}
EFFORT = {
    "complex": ["heon", "eaux", "ungen", "keit"],
    "simple": ["the", "que", "der"],
    "medium": ["tion", "that", "schen"],
}


def _items(spark, sf, columns=None):
    """Document items whose labels are language and source."""
    items = document_items(spark, sf).withColumn("labels", F.array(F.col("components")[0], F.col("epic_key")))
    return items.select(*columns) if columns else items


def project_keys(spark, sf):
    return document_items(spark, sf).select("key", text.project_key().alias("project"))


def item_metadata(spark, sf):
    links = table(spark, sf, "lineitem").select(
        F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("key"), F.col("l_partkey").alias("depends_on")
    )
    return metadata.with_metadata(tree_items(spark, sf), links).select(
        "key", "priority", "created_month", "has_children", "dependency_count"
    )


def markup(spark, sf):
    return document_items(spark, sf).select("key", F.md5(text.clean_markup("description")).alias("clean_md5"))


def embedding_text(spark, sf):
    return _items(spark, sf).select("key", text.embedding_text().alias("embedding_text"))


def model_input(spark, sf):
    return _items(spark, sf).select(
        "key", text.model_input("description", "Represent this work item: ").alias("model_input")
    )


def content_hashes(spark, sf):
    return document_items(spark, sf).select("key", text.content_hash().alias("content_hash"))


def content_hashes_status(spark, sf):
    return document_items(spark, sf).select("key", text.content_hash(True).alias("content_hash"))


def chunk_ids(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("O-"), F.col("l_orderkey").cast("string")).alias("source_key"),
        F.col("l_returnflag").alias("chunk_type"),
        F.col("l_linenumber").alias("chunk_index"),
    )
    return li.select(text.chunk_name().alias("chunk_name"), text.chunk_id().alias("chunk_id"))


def debt_a(spark, sf):
    return _items(spark, sf).where(debt.is_debt_a(KW)).select("key", "issue_type")


def debt_b(spark, sf):
    return _items(spark, sf).where(debt.is_debt_b(KW + ["fr"])).select("key", "issue_type")


def priority_a(spark, sf):
    return _items(spark, sf).select("key", F.round(debt.debt_priority_a(PRIO), 6).alias("priority_score"))


def priority_b(spark, sf):
    return _items(spark, sf).select("key", F.round(debt.debt_priority_b(PRIO), 6).alias("priority_score"))


def effort_a(spark, sf):
    return _items(spark, sf).select("key", debt.effort_a("description", EFFORT).alias("effort"))


def effort_b(spark, sf):
    return _items(spark, sf).select("key", debt.effort_b("description", EFFORT).alias("effort"))


def points_bucket(spark, sf):
    return _items(spark, sf).select("key", debt.story_points_bucket().alias("story_points"))


def sentences(spark, sf):
    d = document_items(spark, sf).select("key", F.posexplode(text.split_sentences("description")).alias("pos", "sentence"))
    return d.select("key", F.col("pos").cast("bigint").alias("pos"), "sentence")


def chunks(spark, sf):
    c = chunking.chunk_items(_items(spark, sf))
    return c.select(
        "chunk_id", "source_key", "chunk_type", F.col("chunk_index").cast("bigint").alias("chunk_index"), "text",
        "status", "priority", "created_month", "content_hash",
    )


def packed(spark, sf):
    pages = table(spark, sf, "pages")
    body = F.regexp_replace("html", r"<[^>]*>", "")
    return pages.select("page_id", F.posexplode(chunking.chunk_text(body, 300, 30)).alias("pos", "chunk")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "chunk"
    )


def packed_words(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.posexplode(chunking.pack_words(F.col("html"), 40)).alias("pos", "chunk")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "chunk"
    )


def _tagged(spark, sf):
    """Tree items plus parts that carry name, brand and type as labels."""
    parts = table(spark, sf, "part").select(
        F.array("p_name", "p_brand", "p_type").alias("labels"), F.array("p_brand").alias("components")
    )
    return tree_items(spark, sf).select("labels", "components").unionByName(parts)


def label_usage(spark, sf):
    return labels.label_usage(_tagged(spark, sf))


def component_usage(spark, sf):
    return labels.component_usage(_tagged(spark, sf))


def top_labels(spark, sf):
    return labels.top_labels(_tagged(spark, sf))


def similar_labels(spark, sf):
    return labels.similar_labels(_tagged(spark, sf))


def label_report(spark, sf):
    return labels.label_report(_tagged(spark, sf))


def quality_prompts(spark, sf):
    p = prompts.build_prompts(_items(spark, sf), "quality")
    return p.select("key", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_chars"))


def split_prompts(spark, sf):
    p = prompts.build_prompts(_items(spark, sf), "split")
    return p.select("key", F.length("prompt").cast("bigint").alias("prompt_chars"))


def batches(spark, sf):
    return prompts.with_batch(document_items(spark, sf, ["key"]), 5).select(
        "key", "batch_id", F.col("in_batch").cast("bigint").alias("in_batch")
    )


def batch_prompts(spark, sf):
    p = prompts.batch_prompts(_items(spark, sf))
    return p.select("batch_id", F.array_join("keys", ",").alias("keys"), F.md5("prompt").alias("prompt_md5"))


def _responses(spark, sf):
    """Model responses derived from the documents: every fifth one is malformed prose."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    score = lambda k: F.when(F.col("doc_id") % 7 != k, ((F.col("doc_id") + k) % 5 + 1).cast("double"))
    body = F.to_json(
        F.struct(
            score(0).alias("clarity_score"),
            score(1).alias("completeness_score"),
            score(2).alias("actionability_score"),
            score(3).alias("testability_score"),
            F.when(F.col("doc_id") % 4 == 0, 4.5).alias("overall_score"),
            F.when(F.col("doc_id") % 3 == 0, F.array("text")).alias("improvement_suggestions"),
            F.when(F.col("doc_id") % 6 == 0, "High").alias("risk_level"),
            F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") > 1000).alias("should_split"),
            F.when(F.col("doc_id") % 2 == 0, 0.75).alias("complexity_score"),
            F.when(
                F.col("doc_id") % 8 == 0,
                F.array(F.struct(F.col("text").alias("title")), F.struct(F.lit("rest").alias("title"))),
            ).alias("suggested_splits"),
            F.when(F.col("doc_id") % 2 == 0, "pivot").alias("change_type"),
            F.when(F.col("doc_id") % 3 == 0, "theme A").alias("theme"),
            F.when(F.col("doc_id") % 3 == 1, 0.9).alias("confidence"),
        )
    )
    prose = F.concat(
        F.when(F.col("doc_id") % 10 == 0, "I recommend a split, high risk: ").otherwise("This is LOW RISK "), "text"
    )
    return d.select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"),
        F.when(F.col("doc_id") % 5 == 0, prose).otherwise(body).alias("content"),
        (F.col("doc_id") % 100 / 1000.0).alias("cost"),
        "doc_id",
    )


def parse_quality(spark, sf):
    p = prompts.parse_quality(_responses(spark, sf))
    return p.select(
        "key", "clarity_score", "completeness_score", "actionability_score", "testability_score",
        F.round("overall_score", 6).alias("overall_score"),
        F.array_join("improvement_suggestions", "; ").alias("improvement_suggestions"),
        "risk_level", "used_fallback", F.round("cost", 6).alias("cost"),
    )


def parse_split(spark, sf):
    p = prompts.parse_split(_responses(spark, sf))
    return p.select(
        "key", "should_split", "complexity_score", "reasoning",
        F.size("suggested_splits").cast("bigint").alias("n_splits"),
        F.array_join(F.transform("suggested_splits", lambda s: s["title"]), "; ").alias("titles"),
    )


def _batch_responses(spark, sf):
    """Responses for batches of documents; every third batch is malformed."""
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 5).alias("batch_id"),
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("key"),
        (F.col("doc_id") % 5 + 1).cast("double").alias("s"),
    )
    one = F.struct(F.col("key").alias("work_item_key"), F.col("s").alias("clarity_score"))
    grouped = d.groupBy("batch_id").agg(F.array_sort(F.collect_list(one)).alias("analyses"))
    content = F.when(F.col("batch_id") % 3 == 0, "no list here").otherwise(F.to_json(F.struct("analyses")))
    return grouped.select("batch_id", content.alias("content")), d.select("batch_id", "key")


def parse_batch(spark, sf):
    responses, members = _batch_responses(spark, sf)
    return prompts.parse_batch_quality(responses, members).select(
        "batch_id", "key", "clarity_score", "overall_score",
        F.array_join("improvement_suggestions", "; ").alias("improvement_suggestions"), "risk_level",
    )


def json_in_prose(spark, sf):
    """A JSON object per document, some wrapped in prose, some cut, some missing."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    body = F.format_string('{"id": %d, "size": {"chars": %d}}', "doc_id", "n_chars")
    c = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Sure:\n"), body, F.lit("\nThanks"))).otherwise(body)
    c = F.when(F.col("doc_id") % 7 == 0, F.substring(c, 1, 12)).when(F.col("doc_id") % 11 == 0, F.col("text")).otherwise(c)
    x = d.select("doc_id", prompts.extract_json(c).alias("x"))
    return x.select("doc_id", "x.json", "x.raw_response", "x.confidence", "x.reasoning")


def parse_others(spark, sf):
    r = _responses(spark, sf)
    a = prompts.parse_cluster(r).select("key", "theme", "priority_score", "estimated_effort", "recommended_approach")
    b = prompts.parse_drift(r).select("key", "change_type", "impact_level", "summary")
    c = prompts.parse_misplacement(r).select("key", "reasoning", "confidence")
    return a.join(b, "key").join(c, "key")


def quality_rollup(spark, sf):
    q = prompts.quality_rollup(prompts.parse_quality(_responses(spark, sf)))
    return q.withColumn("total_cost", F.round("total_cost", 6)).withColumn(
        "average_overall_score", F.round("average_overall_score", 6)
    )


BUDGET = 10.0


def within_budget(spark, sf):
    r = cost.within_budget(_responses(spark, sf).select("key", "cost"), BUDGET)
    return r.select("key", F.round("spent_before", 6).alias("spent_before"))


def budget_quality(spark, sf):
    q = prompts.quality_rollup(prompts.parse_quality(cost.within_budget(_responses(spark, sf), BUDGET)))
    return q.withColumn("total_cost", F.round("total_cost", 6)).withColumn(
        "average_overall_score", F.round("average_overall_score", 6)
    )


def range_errors(spark, sf):
    r = prompts.parse_quality(_responses(spark, sf))
    spec = {"clarity_score": ("range", 2, 4), "overall_score": ("range", 1, 4), "risk_level": ("required",)}
    bad = r.select("key", validation_errors(spec).alias("errors")).where(F.size("errors") > 0)
    return bad.select("key", F.array_join("errors", "; ").alias("errors"))


def template_stats(spark, sf):
    t = templates.template_stats(_items(spark, sf))
    return t.select(
        "issue_type", "sample_count", F.array_join("common_components", ",").alias("common_components"),
        F.array_join("common_labels", ",").alias("common_labels"), "confidence_score",
    )


def template_fallback(spark, sf):
    t = templates.template_fallback(_items(spark, sf))
    return t.select(
        "issue_type", "sample_count", "title_template", F.substring_index("description_template", "\n", 1).alias("head"),
        F.md5(F.col("description_template").cast("binary")).alias("body_md5"), "confidence_score",
    )


def template_checks(spark, sf):
    """Templates made of each document's text, some without a placeholder or a body."""
    d = table(spark, sf, "documents")
    t = d.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("{x} "), "text")).otherwise(F.col("text")).alias("title_template"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).alias("description_template"),
        F.array_repeat(F.lit("f"), (F.col("doc_id") % 4).cast("int")).alias("required_fields"),
        (F.col("doc_id") % 10 / 10.0).alias("confidence_score"),
    )
    v = templates.validate_templates(t)
    return v.select(
        "doc_id", "is_valid", F.array_join("issues", "; ").alias("issues"),
        F.array_join("suggestions", "; ").alias("suggestions"),
    )


QUERIES = {
    "P04_project_key": project_keys,
    "P05_item_metadata": item_metadata,
    "P06_clean_markup": markup,
    "P07_embedding_text": embedding_text,
    "P08_model_input": model_input,
    "P09_content_hash": content_hashes,
    "P10_content_hash_status": content_hashes_status,
    "P11_chunk_id": chunk_ids,
    "P12_is_debt_a": debt_a,
    "P13_is_debt_b": debt_b,
    "P14_debt_priority_a": priority_a,
    "P15_debt_priority_b": priority_b,
    "P16_effort_a": effort_a,
    "P17_effort_b": effort_b,
    "P24_story_points": points_bucket,
    "C06_sentences": sentences,
    "C01_chunk_items": chunks,
    "C07_pack_sentences": packed,
    "C08_pack_words": packed_words,
    "A01_label_usage": label_usage,
    "A02_component_usage": component_usage,
    "L04_top_labels": top_labels,
    "J18_similar_labels": similar_labels,
    "A34_label_report": label_report,
    "P25_quality_prompts": quality_prompts,
    "P25_split_prompts": split_prompts,
    "W03_batches": batches,
    "P26_batch_prompts": batch_prompts,
    "P27_parse_quality": parse_quality,
    "P28_parse_split": parse_split,
    "P29_parse_batch_quality": parse_batch,
    "P30_extract_json": json_in_prose,
    "P31_parse_cluster_drift_misplacement": parse_others,
    "A29_quality_rollup": quality_rollup,
    "W11_within_budget": within_budget,
    "R09_budget_quality": budget_quality,
    "P23_range_errors": range_errors,
    "A30_template_stats": template_stats,
    "P32_template_fallback": template_fallback,
    "P33_template_checks": template_checks,
}

# ------------------------------------------------------------------------- SQL

DOCS = r"""docs AS (
  SELECT 'DOC-' || d.doc_id AS key, d.doc_id, split_part(d.text, chr(10), 1) AS summary, d.text AS description,
    ['Epic', 'Story', 'Task', 'Bug'][d.doc_id % 4 + 1] AS issue_type,
    ['Open', 'In Progress', 'Done'][d.doc_id % 3 + 1] AS status, d.source AS epic_key, d.lang, d.n_chars,
    TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 MINUTE AS updated,
    CASE l.quality WHEN 1 THEN 'High' WHEN 0 THEN 'Low' ELSE 'Medium' END AS priority
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
ISO = "strftime(updated, '%Y-%m-%dT%H:%M:%S')"


def _clean(c):
    for p, r in [
        (r"\{code[^}]*\}.*?\{code\}", "[CODE BLOCK]"),
        (r"\{quote\}.*?\{quote\}", "[QUOTE]"),
        (r"\{panel[^}]*\}.*?\{panel\}", "[PANEL]"),
        (r"\[([^|\]]+)\|[^\]]+\]", r"\1"),
        (r"\*([^*]+)\*", r"\1"),
        (r"_([^_]+)_", r"\1"),
        (r"\^([^\^]+)\^", r"\1"),
        (r"~([^~]+)~", r"\1"),
        (r"\s+", " "),
    ]:
        c = f"regexp_replace({c}, '{p}', '{r}', 'gs')"
    return f"trim({c})"


def _any(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _count(c, words):
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


LOW_TEXT = "lower(summary || ' ' || description)"
LOW_LABELS = "lower(lang || ' ' || epic_key)"


def _both(words):
    return "(" + " + ".join(f"(contains({LOW_TEXT}, '{w}') OR contains({LOW_LABELS}, '{w}'))::INT" for w in words) + ")"


ALL_TEXT = f"({LOW_TEXT} || ' ' || {LOW_LABELS})"

TAGGED = """tagged AS (
  SELECT []::VARCHAR[] AS labels, [c_mktsegment] AS components FROM customer
  UNION ALL SELECT [o_orderpriority, o_orderstatus], [] FROM orders
  UNION ALL SELECT [l_returnflag], [] FROM lineitem
  UNION ALL SELECT [p_name, p_brand, p_type], [p_brand] FROM part),
counts AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM tagged) GROUP BY 1)"""

WORDS = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> '')"
SIMILAR = f"""alike AS (
  SELECT a.label AS label_a, b.label AS label_b FROM counts a JOIN counts b ON a.label < b.label
  WHERE contains(lower(a.label), lower(b.label)) OR contains(lower(b.label), lower(a.label))
    OR len(list_intersect(list_distinct({WORDS.format('a.label')}), list_distinct({WORDS.format('b.label')})))
       >= greatest(1, len({WORDS.format('a.label')}) // 2))"""

ABBREV = "Dr|Mr|Mrs|Ms|Prof|Sr|Jr|vs|etc|Inc|Ltd|Co|Corp|St|Ave|Rd|Blvd"


def _sentences_sql(c):
    """RE2 has no look-behind: mark the ends of sentences, then split at the mark."""
    guarded = f"regexp_replace({c}, '({ABBREV})\\.', '\\1###DOT###', 'g')"
    # two passes, since neighbouring matches share the capital letter
    marked = f"regexp_replace({guarded}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    marked = f"regexp_replace({marked}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
    return f"""list_filter(list_transform(string_split({marked}, chr(1)),
      lambda s: trim(replace(s, '###DOT###', '.'), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))),
      lambda s: s <> '')"""


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
EMPTY = "{'done': []::VARCHAR[], 'cur': ''}"


def _fold_sql(values, step):
    """Left fold over strings with a (done, cur) state, closed at the end."""
    return f"""list_reduce(list_transform({values}, lambda item_: {{'done': []::VARCHAR[], 'cur': item_}}),
      lambda a, x: {step}, {EMPTY})"""


def _close_sql(state):
    return f"(CASE WHEN trim({state}.cur, {WS}) = '' THEN {state}.done ELSE list_append({state}.done, trim({state}.cur, {WS})) END)"


def _words_state_sql(sentence, n):
    words = f"list_filter(regexp_split_to_array({sentence}, '\\s+'), lambda w: w <> '')"
    step = f"""CASE WHEN length(a.cur) + length(x.cur) + 1 > {n} AND a.cur <> ''
        THEN {{'done': list_append(a.done, trim(a.cur, {WS})), 'cur': x.cur}}
      WHEN length(a.cur) + length(x.cur) + 1 > {n}
        THEN {{'done': list_append(a.done, left(x.cur, {n} - 3) || '...'), 'cur': ''}}
      WHEN a.cur <> '' THEN {{'done': a.done, 'cur': a.cur || ' ' || x.cur}}
      ELSE {{'done': a.done, 'cur': x.cur}} END"""
    return _fold_sql(words, step)


def _pack_step_sql(n, overlap):
    """The word lists of long sentences are prepared in ``x.done``."""
    return f"""CASE WHEN length(a.cur) + length(x.cur) + 1 > {n} AND a.cur <> ''
        THEN {{'done': list_append(a.done, trim(a.cur, {WS})),
               'cur': CASE WHEN length(a.cur) > {overlap} THEN right(a.cur, {overlap}) || ' ' || x.cur ELSE x.cur END}}
      WHEN length(a.cur) + length(x.cur) + 1 > {n} THEN {{'done': list_concat(a.done, x.done), 'cur': ''}}
      WHEN a.cur <> '' THEN {{'done': a.done, 'cur': a.cur || ' ' || x.cur}}
      ELSE {{'done': a.done, 'cur': x.cur}} END"""


def _pack_sql(source, idc, textc, n, overlap):
    """CTEs that give ``packed(id, chunks)`` for ``source(id, text)``."""
    return f"""sents AS (
  SELECT {idc} AS id, {textc} AS t, unnest({_sentences_sql(textc)}) AS s, generate_subscripts({_sentences_sql(textc)}, 1) AS p
  FROM {source} WHERE length({textc}) > {n}),
long AS (SELECT id, p, s, {_words_state_sql('s', n)} AS w FROM sents WHERE length(s) + 1 > {n}),
prepared AS (
  SELECT id, p, {{'done': {_close_sql('w')}, 'cur': s}} AS x FROM long
  UNION ALL SELECT id, p, {{'done': []::VARCHAR[], 'cur': s}} FROM sents WHERE length(s) + 1 <= {n}),
listed AS (SELECT id, list(x ORDER BY p) AS xs FROM prepared GROUP BY 1),
folded AS (SELECT id, list_reduce(xs, lambda a, x: {_pack_step_sql(n, overlap)}, {EMPTY}) AS st FROM listed),
packed AS (
  SELECT id, {_close_sql('st')} AS chunks FROM folded
  UNION ALL SELECT {idc}, [{textc}] FROM {source} WHERE length({textc}) <= {n})"""


# ascii white space only: the generated texts hold no other
END = r"(?:\n\n|\n[A-Z]|$)"
SECTION_SQL = {
    "Epic": [
        ("Epic Goals", "goals", rf"(?is)(?:goals?|objectives?|outcomes?):\s*(.+?){END}", 1),
        ("Success Criteria", "success_criteria", rf"(?is)(?:success criteria|definition of done):\s*(.+?){END}", 1),
    ],
    "Story": [
        ("Acceptance Criteria", "acceptance_criteria", rf"(?is)(?:acceptance criteria|ac):\s*(.+?){END}", 1),
        ("User Story", "user_story", r"(?i)(?:as a|as an)\s+(.+?)(?:\n|$)", 0),
    ],
    "Bug": [
        ("Symptoms", "symptoms", rf"(?is)(?:symptoms?|observed behavior):\s*(.+?){END}", 1),
        ("Reproduction", "reproduction", rf"(?is)(?:steps to reproduce|repro steps?):\s*(.+?){END}", 1),
        ("Expected", "expected", rf"(?is)(?:expected behavior|expected result):\s*(.+?){END}", 1),
        ("Solution", "solution", rf"(?is)(?:solution|fix|resolution):\s*(.+?){END}", 1),
    ],
}


def _section_sql():
    parts, rests = [], []
    for kind, sections in SECTION_SQL.items():
        rest, found = "description", []
        for label, name, pattern, group in sections:
            whole = f"regexp_extract(description, '{pattern}', 0)"
            kept = f"trim(regexp_extract(description, '{pattern}', {group}), {WS})"
            found.append(f"CASE WHEN {whole} <> '' THEN {{'k': '{name}', 't': '{label}: ' || {kept}}} END")
            inner = rest if kind == "Bug" else "description"
            g0 = f"regexp_extract({inner}, '{pattern}', 0)"
            rest = f"(CASE WHEN {g0} = '' THEN {rest} ELSE replace({rest}, {g0}, '') END)"
        parts.append(f"WHEN '{kind}' THEN list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)")
        rests.append(f"WHEN '{kind}' THEN trim({rest}, {WS})")
    return (
        f"CASE issue_type {' '.join(parts)} ELSE [] END",
        f"CASE issue_type {' '.join(rests)} ELSE description END",
    )


_PARTS, _REST = _section_sql()


def chunks_sql(n=800, docs=DOCS):
    """Query with one row per chunk of the items in ``docs``."""
    return f"""WITH {docs},
cut AS (SELECT *, {_PARTS} AS parts, {_REST} AS rest FROM docs),
{_pack_sql("cut", "key", "rest", n, 50)},
all_parts AS (
  SELECT c.*, list_concat(
      CASE WHEN summary <> '' THEN [{{'k': lower(issue_type) || '_summary', 't': summary}}] ELSE [] END,
      parts, CASE WHEN rest = '' THEN [] ELSE list_transform(p.chunks, lambda x: {{'k': 'description', 't': x}}) END) AS xs
  FROM cut c LEFT JOIN packed p ON p.id = c.key),
flat AS (SELECT *, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS chunk_index FROM all_parts)
SELECT left(md5(key || '_' || x.k || '_' || chunk_index), 12) AS chunk_id, key AS source_key, x.k AS chunk_type,
  chunk_index, x.t AS text, status, priority, strftime(updated, '%Y-%m') AS created_month,
  md5(summary || '|' || description || '|' || status || '|' || {ISO}) AS content_hash FROM flat"""


_ALPHA = "CASE WHEN doc_id % 7 <> {k} THEN ((doc_id + {k}) % 5 + 1)::DOUBLE ELSE 3.0 END"
_S = [_ALPHA.format(k=k) for k in range(4)]
QUALITY = f"""quality AS (
  SELECT key, doc_id, doc_id % 5 = 0 AS bad, (doc_id % 100) / 1000.0 AS cost,
    {", ".join(f"CASE WHEN doc_id % 5 = 0 THEN 3.0 ELSE {s} END AS {n}"
               for s, n in zip(_S, ["clarity_score", "completeness_score", "actionability_score", "testability_score"]))},
    CASE WHEN doc_id % 5 = 0 THEN 3.0 WHEN doc_id % 4 = 0 THEN 4.5 ELSE ({" + ".join(_S)}) / 4 END AS overall,
    CASE WHEN doc_id % 5 = 0 THEN 'Review and clarify requirements' WHEN doc_id % 3 = 0 THEN description ELSE '' END AS sugg,
    CASE WHEN doc_id % 10 = 0 THEN (CASE WHEN contains(lower(description), 'low risk') THEN 'Low' ELSE 'High' END)
         WHEN doc_id % 5 = 0 THEN 'Low' WHEN doc_id % 6 = 0 THEN 'High' ELSE 'Medium' END AS risk_level
  FROM docs)"""
ROLLUP = """SELECT count(*) AS processed, count(*) FILTER (NOT bad) AS successful, count(*) FILTER (bad) AS failed,
    round(sum(cost), 6) AS total_cost, round(avg(overall), 6) AS average_overall_score FROM {0}"""
SPENT = """spent AS (
  SELECT *, coalesce(sum(cost) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before
  FROM quality QUALIFY spent_before < 10.0)"""

ORACLES = {
    "P04_project_key": f"WITH {DOCS} SELECT key, 'DOC' AS project FROM docs",
    "P05_item_metadata": """SELECT 'C-' || c_custkey AS key, 'Medium' AS priority, '2024-01' AS created_month,
          c_custkey IN (SELECT o_custkey FROM orders) AS has_children, 0 AS dependency_count FROM customer
        UNION ALL SELECT 'O-' || o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m'),
          o_orderkey IN (SELECT l_orderkey FROM lineitem), coalesce(d.n, 0)
        FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) d
          ON d.l_orderkey = o_orderkey
        UNION ALL SELECT concat_ws('-', 'L', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')), 'Medium', strftime(l_shipdate, '%Y-%m'), FALSE, 0
        FROM lineitem""",
    "P06_clean_markup": f"WITH {DOCS} SELECT key, md5({_clean('description')}) AS clean_md5 FROM docs",
    "P07_embedding_text": f"""WITH {DOCS}, c AS (SELECT *, {_clean('description')} AS d FROM docs), t AS (
          SELECT key, 'Title: ' || summary || ' | Type: ' || issue_type || ' | Status: ' || status ||
            CASE WHEN description <> '' THEN ' | Description: ' || left(d, 300) ||
              CASE WHEN length(d) > 300 THEN '...' ELSE '' END ELSE '' END ||
            ' | Components: ' || lang || ' | Labels: ' || lang || ', ' || epic_key || ' | Epic: ' || epic_key AS x FROM c)
        SELECT key, CASE WHEN length(x) > 2048 THEN left(x, 2048) || '...' ELSE x END AS embedding_text FROM t""",
    "P08_model_input": f"""WITH {DOCS}
        SELECT key, 'Represent this work item: ' || left(description, 512) AS model_input FROM docs""",
    "P09_content_hash": f"""WITH {DOCS}
        SELECT key, md5(key || '|' || summary || '|' || description || '|' || {ISO}) AS content_hash FROM docs""",
    "P10_content_hash_status": f"""WITH {DOCS}
        SELECT key, md5(summary || '|' || description || '|' || status || '|' || {ISO}) AS content_hash FROM docs""",
    "P11_chunk_id": """SELECT n AS chunk_name, left(md5(n), 12) AS chunk_id FROM (
        SELECT 'O-' || l_orderkey || '_' || l_returnflag || '_' || l_linenumber AS n FROM lineitem)""",
    "P12_is_debt_a": f"""WITH {DOCS} SELECT key, issue_type FROM docs
        WHERE {_any('lower(summary)', KW)} OR {_any('lower(description)', KW)}
          OR {_any('lower(lang)', KW)} OR {_any('lower(epic_key)', KW)}""",
    "P13_is_debt_b": f"""WITH {DOCS} SELECT key, issue_type FROM docs
        WHERE {_any(LOW_TEXT, KW + ['fr'])}
          OR (lower(issue_type) IN ('improvement', 'enhancement', 'task') AND {_any(LOW_LABELS, KW + ['fr'])})""",
    "P14_debt_priority_a": f"""WITH {DOCS} SELECT key,
        round(least(1.0, {_both(PRIO['high'])} * 0.3 + {_both(PRIO['medium'])} * 0.2), 6)::DOUBLE AS priority_score
        FROM docs""",
    "P15_debt_priority_b": f"""WITH {DOCS} SELECT key, round(greatest(0.0, least(1.0,
          {_count(ALL_TEXT, PRIO['high'])} * 0.3 + {_count(ALL_TEXT, PRIO['medium'])} * 0.2
          - {_count(ALL_TEXT, PRIO['low'])} * 0.1 + 0.3 + {_any(LOW_LABELS, PRIO['labels'])}::INT * 0.2)), 6)::DOUBLE
          AS priority_score FROM docs""",
    "P16_effort_a": f"""WITH {DOCS}, c AS (SELECT key, description AS d,
          {_count('lower(description)', EFFORT['complex'])} + (length(description) > 300)::INT AS l,
          {_count('lower(description)', EFFORT['simple'])} + (length(description) < 50)::INT AS s,
          {_count('lower(description)', EFFORT['medium'])} + (length(description) BETWEEN 50 AND 150)::INT AS m FROM docs)
        SELECT key, CASE WHEN d = '' THEN 'Unknown' WHEN greatest(l, s, m) = 0 THEN 'Medium'
          WHEN l = greatest(l, s, m) THEN 'Large' WHEN s = greatest(l, s, m) THEN 'Small' ELSE 'Medium' END AS effort
        FROM c""",
    "P17_effort_b": f"""WITH {DOCS}, c AS (SELECT key, description AS d,
          len(list_filter(regexp_split_to_array(description, '\\s+'), lambda w: w <> '')) AS w,
          len(string_split(description, chr(10))) AS n, len(string_split(description, chr(10) || '-')) - 1 AS b,
          {_count('lower(description)', EFFORT['complex'])} AS x, {_count('lower(description)', EFFORT['simple'])} AS y
          FROM docs),
        p AS (SELECT *, CASE WHEN w > 100 THEN 2 WHEN w > 50 THEN 1 ELSE 0 END
          + CASE WHEN n > 10 THEN 2 WHEN n > 5 THEN 1 ELSE 0 END + 2 * x - y
          + 2 * (contains(d, '- ') OR contains(d, '* ') OR b > 2)::INT AS pts FROM c)
        SELECT key, CASE WHEN d = '' THEN 'Small' WHEN pts >= 5 THEN 'Large' WHEN pts >= 2 THEN 'Medium' ELSE 'Small' END
          AS effort FROM p""",
    "P24_story_points": f"""WITH {DOCS} SELECT key, CASE WHEN length(description) > 1000 THEN '8-13 (Large)'
        WHEN length(description) > 500 THEN '5-8 (Medium)' WHEN description <> '' THEN '1-3 (Small)' ELSE 'Unknown' END
        AS story_points FROM docs""",
    "C06_sentences": f"""WITH {DOCS}, s AS (SELECT key, {_sentences_sql('description')} AS xs FROM docs)
        SELECT key, generate_subscripts(xs, 1) - 1 AS pos, unnest(xs) AS sentence FROM s""",
    "C01_chunk_items": chunks_sql(),
    "C07_pack_sentences": f"""WITH body AS (SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages),
        {_pack_sql("body", "page_id", "t", 300, 30)}
        SELECT id AS page_id, generate_subscripts(chunks, 1) - 1 AS pos, unnest(chunks) AS chunk FROM packed""",
    "C08_pack_words": f"""WITH st AS (SELECT page_id, {_words_state_sql('html', 40)} AS w FROM pages),
        c AS (SELECT page_id, {_close_sql('w')} AS chunks FROM st)
        SELECT page_id, generate_subscripts(chunks, 1) - 1 AS pos, unnest(chunks) AS chunk FROM c""",
    "A01_label_usage": f"WITH {TAGGED} SELECT label, n FROM counts",
    "A02_component_usage": f"""WITH {TAGGED}
        SELECT component, count(*) AS n FROM (SELECT unnest(components) AS component FROM tagged) GROUP BY 1""",
    "L04_top_labels": f"WITH {TAGGED} SELECT label, n FROM counts ORDER BY n DESC, label LIMIT 5",
    "J18_similar_labels": f"WITH {TAGGED}, {SIMILAR} SELECT * FROM alike",
    "A34_label_report": f"""WITH {TAGGED}, {SIMILAR}, t AS (SELECT sum(n) AS total, count(*) AS k FROM counts)
        SELECT 'cleanup' AS kind, label AS subject, CASE WHEN n = 1 THEN '''' || label || ''' (used only once)'
          ELSE '''' || label || ''' (rarely used: ' || n || ' times)' END AS message
        FROM counts, t WHERE n = 1 OR n / total < 0.01
        UNION ALL SELECT 'inconsistency', label_a,
          'Similar labels: ''' || label_a || ''' and ''' || label_b || ''' - consider consolidating' FROM alike
        UNION ALL SELECT 'optimization', 'labels', 'Large number of labels - consider label taxonomy review' FROM t
          WHERE k > 50
        UNION ALL SELECT 'optimization', label, 'Label ''' || label || ''' is overused - consider more specific labels'
          FROM counts, t WHERE n > total * 0.5""",
    "P25_quality_prompts": f"""WITH {DOCS}, p AS (SELECT key,
          'Rate this work item from 1 to 5 for clarity, completeness, actionability and testability.' || chr(10) ||
          'Title: ' || summary || chr(10) || 'Type: ' || issue_type || chr(10) || 'Description: ' ||
          CASE WHEN description = '' THEN 'No description provided' ELSE description END || chr(10) ||
          'Answer as JSON with the four scores, overall_score, improvement_suggestions and risk_level.' AS x FROM docs)
        SELECT key, md5(x) AS prompt_md5, length(x) AS prompt_chars FROM p""",
    "P25_split_prompts": f"""WITH {DOCS} SELECT key, length('Should this work item be split?' || chr(10) ||
          'Title: ' || summary || chr(10) || 'Description: ' ||
          CASE WHEN description = '' THEN 'No description provided' ELSE description END || chr(10) || 'Estimated size: ' ||
          CASE WHEN length(description) > 1000 THEN '8-13 (Large)' WHEN length(description) > 500 THEN '5-8 (Medium)'
            WHEN description <> '' THEN '1-3 (Small)' ELSE 'Unknown' END || chr(10) ||
          'Answer as JSON with should_split, complexity_score, suggested_splits and reasoning.') AS prompt_chars
        FROM docs""",
    "W03_batches": f"""WITH {DOCS}, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS n FROM docs)
        SELECT key, n // 5 AS batch_id, n % 5 + 1 AS in_batch FROM r""",
    "P26_batch_prompts": f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS n FROM docs),
        b AS (SELECT n // 5 AS batch_id, key, n, 'Item ' || (n % 5 + 1) || ':' || chr(10) || 'Key: ' || key || chr(10) ||
          'Title: ' || summary || chr(10) || 'Type: ' || issue_type || chr(10) || 'Description: ' ||
          CASE WHEN description = '' THEN 'No description provided' ELSE description END AS x FROM r)
        SELECT batch_id, string_agg(key, ',' ORDER BY n) AS keys,
          md5('Rate each work item; answer as JSON with a list named analyses.' || chr(10) || chr(10) ||
            string_agg(x, chr(10) || chr(10) ORDER BY n)) AS prompt_md5 FROM b GROUP BY 1""",
    "P27_parse_quality": f"""WITH {DOCS}, {QUALITY} SELECT key, clarity_score, completeness_score, actionability_score,
          testability_score, round(overall, 6) AS overall_score, sugg AS improvement_suggestions, risk_level,
          bad AS used_fallback, round(cost, 6) AS cost FROM quality""",
    "P28_parse_split": f"""WITH {DOCS} SELECT key,
          CASE WHEN doc_id % 10 = 0 THEN TRUE
            WHEN doc_id % 5 = 0 THEN contains(lower(description), 'split') AND contains(lower(description), 'recommend')
            WHEN doc_id % 2 = 0 THEN n_chars > 1000 ELSE FALSE END AS should_split,
          CASE WHEN doc_id % 5 <> 0 AND doc_id % 2 = 0 THEN 0.75::DOUBLE ELSE 0.5 END AS complexity_score,
          CASE WHEN doc_id % 5 = 0 THEN 'Unable to parse detailed analysis' ELSE 'No reasoning provided' END AS reasoning,
          CASE WHEN doc_id % 5 <> 0 AND doc_id % 8 = 0 THEN 2 ELSE 0 END AS n_splits,
          CASE WHEN doc_id % 5 <> 0 AND doc_id % 8 = 0 THEN description || '; rest' ELSE '' END AS titles FROM docs""",
    "P29_parse_batch_quality": f"""WITH {DOCS} SELECT doc_id // 5 AS batch_id, key,
          CASE WHEN (doc_id // 5) % 3 = 0 THEN 3.0 ELSE (doc_id % 5 + 1)::DOUBLE END AS clarity_score,
          3.0::DOUBLE AS overall_score,
          CASE WHEN (doc_id // 5) % 3 = 0 THEN 'Batch analysis parsing failed' ELSE '' END AS improvement_suggestions,
          'Medium' AS risk_level FROM docs""",
    "P30_extract_json": f"""WITH {DOCS}, b AS (SELECT *, '{{"id": ' || doc_id || ', "size": {{"chars": ' || n_chars || '}}}}'
          AS body FROM docs),
        w AS (SELECT doc_id, description, CASE WHEN doc_id % 3 = 0 THEN 'Sure:' || chr(10) || body || chr(10) || 'Thanks'
          ELSE body END AS c FROM b),
        c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN left(c, 12) WHEN doc_id % 11 = 0 THEN description ELSE c END AS c
          FROM w),
        e AS (SELECT *, regexp_extract(c, '(?s)\\{{.*\\}}') AS j FROM c)
        SELECT doc_id, CASE WHEN j <> '' THEN j END AS json, CASE WHEN j = '' THEN c END AS raw_response,
          CASE WHEN j = '' THEN 0.5::DOUBLE END AS confidence,
          CASE WHEN j <> '' THEN NULL WHEN contains(c, '{{') THEN 'Invalid JSON response'
            ELSE 'Failed to parse structured response' END AS reasoning FROM e""",
    "P31_parse_cluster_drift_misplacement": f"""WITH {DOCS}, r AS (SELECT *, doc_id % 5 <> 0 AS ok FROM docs)
        SELECT key, CASE WHEN ok AND doc_id % 3 = 0 THEN 'theme A' ELSE 'Technical Debt Cluster ' || key END AS theme,
          0.5::DOUBLE AS priority_score, 'Medium' AS estimated_effort,
          'Review and prioritize items individually' AS recommended_approach,
          CASE WHEN ok AND doc_id % 2 = 0 THEN 'pivot' ELSE 'unknown' END AS change_type, 'moderate' AS impact_level,
          'Unable to analyze change details' AS summary,
          'Unable to analyze misplacement due to analysis error' AS reasoning,
          CASE WHEN ok AND doc_id % 3 = 1 THEN 0.9::DOUBLE ELSE 0.5 END AS confidence FROM r""",
    "A29_quality_rollup": f"WITH {DOCS}, {QUALITY} {ROLLUP.format('quality')}",
    "W11_within_budget": f"""WITH {DOCS}, {QUALITY}, {SPENT}
        SELECT key, round(spent_before, 6) AS spent_before FROM spent""",
    "R09_budget_quality": f"WITH {DOCS}, {QUALITY}, {SPENT} {ROLLUP.format('spent')}",
    "P23_range_errors": f"""WITH {DOCS}, {QUALITY}, e AS (SELECT key, concat_ws('; ',
          CASE WHEN clarity_score < 2 OR clarity_score > 4 THEN 'clarity_score is not in 2..4' END,
          CASE WHEN overall < 1 OR overall > 4 THEN 'overall_score is not in 1..4' END) AS errors FROM quality)
        SELECT key, errors FROM e WHERE errors <> ''""",
    "A30_template_stats": f"""WITH {DOCS},
        l AS (SELECT issue_type, unnest([lang, epic_key]) AS x FROM docs),
        c AS (SELECT issue_type, lang AS x FROM docs),
        lt AS (SELECT issue_type, x, count(*) AS n FROM l GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY issue_type ORDER BY n DESC, x) <= 5),
        ct AS (SELECT issue_type, x, count(*) AS n FROM c GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY issue_type ORDER BY n DESC, x) <= 5)
        SELECT d.issue_type, count(*) AS sample_count,
          (SELECT string_agg(x, ',' ORDER BY n DESC, x) FROM ct WHERE ct.issue_type = d.issue_type) AS common_components,
          (SELECT string_agg(x, ',' ORDER BY n DESC, x) FROM lt WHERE lt.issue_type = d.issue_type) AS common_labels,
          0.7::DOUBLE AS confidence_score FROM docs d GROUP BY 1 HAVING count(*) >= 3""",
    "P32_template_fallback": f"""WITH {DOCS} SELECT issue_type, count(*) AS sample_count,
          CASE issue_type WHEN 'Story' THEN 'User Story: {{feature_description}}' WHEN 'Task' THEN 'Task: {{task_description}}'
            WHEN 'Bug' THEN 'Bug: {{issue_description}}' ELSE 'Epic: {{epic_theme}}' END AS title_template,
          CASE issue_type WHEN 'Story' THEN '## User Story' WHEN 'Task' THEN '## Description'
            WHEN 'Bug' THEN '## Summary' ELSE '## Epic Description' END AS head,
          md5(CASE issue_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in templates.DESCRIPTION_TEMPLATES.items())} END) AS body_md5,
          0.5::DOUBLE AS confidence_score FROM docs GROUP BY 1 HAVING count(*) >= 3""",
    "P33_template_checks": f"""WITH {DOCS}, t AS (SELECT doc_id,
          CASE WHEN doc_id % 3 <> 0 THEN '{{x}} ' || description ELSE description END AS title,
          CASE WHEN doc_id % 11 = 0 THEN '' ELSE description END AS body FROM docs)
        SELECT doc_id, contains(title, '{{') AND body <> '' AS is_valid,
          concat_ws('; ', CASE WHEN NOT contains(title, '{{') THEN 'Title template missing placeholders' END,
            CASE WHEN body = '' THEN 'Description template is empty' END) AS issues,
          concat_ws('; ', CASE WHEN body <> '' AND length(body) < 50 THEN 'Description template might be too brief' END,
            CASE WHEN doc_id % 4 < 2 THEN 'Consider more required fields for completeness' END,
            CASE WHEN (doc_id % 10) / 10.0 < 0.6 THEN 'Low confidence score - consider adding more samples' END)
            AS suggestions FROM t""",
}
