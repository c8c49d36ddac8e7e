"""Filtered semantic search, re-ranking and context summaries.

Queries are rows of :func:`taskloom.operators.query_text.query_features` with
``query_id`` and ``embedding``; chunks carry their metadata and ``embedding``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions import lexicons as L
from taskloom.operators.neighbours import CELL_ROWS, Between, Match, top_k
from taskloom.operators.query_text import FILTER_COLUMNS

DEFAULT_THRESHOLD = 0.8
# Re-rank factors.
BOOST_YEAR = "2024"
TYPE_A, HIGH_A, RECENT_A = 1.2, 1.1, 1.05
DEPENDS_B, PARENT_B, TYPE_B, PRIORITY_B = 1.3, 1.2, 1.4, 1.3

_META = {
    "item_type": "string",
    "status": "string",
    "priority": "string",
    "team": "string",
    "epic_key": "string",
    "created_month": "string",
    "text": "string",
    "components": "array<string>",
    "has_children": "boolean",
    "dependency_count": "bigint",
}
_FILTER_TYPES = {"components": "array<string>", "sprint_names": "array<string>"}


def _with_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add missing metadata columns as nulls."""
    for name, kind in types.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def rerank_a() -> Column:
    """Score after the first re-ranking: preferred type, high priority, recent month."""
    return (
        F.col("score")
        * F.when(F.array_contains("item_types", F.col("item_type")), TYPE_A).otherwise(1.0)
        * F.when(F.col("priority") == "High", HIGH_A).otherwise(1.0)
        * F.when(F.contains("created_month", F.lit(BOOST_YEAR)), RECENT_A).otherwise(1.0)
    )


def rerank_b() -> Column:
    """Score after the second re-ranking, on top of the first one."""
    analysis = F.col("intent") == "analysis"
    return (
        F.col("score")
        * F.when(analysis & (F.col("dependency_count") > 0), DEPENDS_B).otherwise(1.0)
        * F.when(analysis & F.col("has_children"), PARENT_B).otherwise(1.0)
        * F.when(F.array_contains("item_types", F.col("item_type")), TYPE_B).otherwise(1.0)
        * F.when(F.array_contains("priorities", F.col("priority")), PRIORITY_B).otherwise(1.0)
        * F.when(F.col("priority") == "High", F.coalesce("priority_boost", F.lit(1.0))).otherwise(1.0)
        * F.when(F.col("status") == "Blocked", F.coalesce("status_boost", F.lit(1.0))).otherwise(1.0)
    )


def ranked(hits: DataFrame, score: Column, before: str, name: str) -> DataFrame:
    """Replace the score and number the hits of a query again; ties keep the earlier order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), before)
    return hits.withColumn("score", score).withColumn(name, F.row_number().over(w))


def semantic_search(
    queries: DataFrame,
    chunks: DataFrame,
    limit: int = 15,
    threshold: float | None = DEFAULT_THRESHOLD,
    apply_date_range: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Filtered top ``2 * limit`` chunks per query, re-ranked and cut to ``limit``.

    The filters of a query apply before its top list is taken. ``apply_date_range`` also
    applies the extracted date range to ``created``. Returns the hits with the chunk's
    metadata, ``score`` and ``position`` (1 = best).
    """
    chunks = _with_columns(chunks, _META)
    match = [Match(lists, field) for field, lists in FILTER_COLUMNS.items()]
    searchable = _with_columns(chunks, {f: _FILTER_TYPES.get(f, "string") for f in FILTER_COLUMNS})
    asked = queries
    if apply_date_range:
        asked = asked.withColumn("_low", F.unix_timestamp("date_start")).withColumn("_high", F.unix_timestamp("date_end"))
        searchable = searchable.withColumn("_at", F.unix_timestamp("created"))
        match = [*match, Between("_low", "_high", "_at")]
    found = top_k(asked, searchable, 2 * limit, threshold, item_id="chunk_id", match=match, cell_rows=cell_rows)
    meta = chunks.select("chunk_id", "key", *_META)
    wanted = queries.select("query_id", "item_types")
    hits = found.join(meta, "chunk_id").join(wanted, "query_id")
    out = ranked(hits, rerank_a(), "rank", "position").where(F.col("position") <= limit)
    return out.drop("rank", "item_types")


def search_in_epic(queries: DataFrame, chunks: DataFrame, k: int = 10, threshold: float | None = DEFAULT_THRESHOLD) -> DataFrame:
    """Best chunks inside the epic each query names in ``epic_key``."""
    chunks = _with_columns(chunks, _META)
    found = top_k(queries, chunks, k, threshold, item_id="chunk_id", group="epic_key")
    return found.join(chunks.select("chunk_id", "key", *_META), "chunk_id").withColumnRenamed("rank", "position")


def final_ranking(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Second re-ranking: adds ``final_position``."""
    wanted = queries.select("query_id", "intent", "item_types", "priorities", "priority_boost", "status_boost")
    out = ranked(hits.join(wanted, "query_id"), rerank_b(), "position", "final_position")
    return out.drop("intent", "item_types", "priorities", "priority_boost", "status_boost")


# ------------------------------------------------------------------------ summaries


def _counted(hits: DataFrame) -> DataFrame:
    """Counts per query, field and value, with the first position of the value."""
    fields = ["item_type", "status", "priority"]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("Unknown")).alias("value")) for f in fields])
    rows = hits.select("query_id", "final_position", F.explode(pairs).alias("p")).select(
        "query_id", "final_position", "p.field", "p.value"
    )
    return rows.groupBy("query_id", "field", "value").agg(F.count("*").alias("n"), F.min("final_position").alias("first"))


def context_summary(hits: DataFrame, trees: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: counts by type, status and priority, epics, teams, items in total.

    ``trees`` has ``(query_id, tree_no, key, total_items)``. All lists are as short as a
    result page. Counts are maps; ``summary`` is the one-line text with values in order of
    first appearance and names sorted.
    """
    counts = _counted(hits).groupBy("query_id", "field").agg(
        F.array_sort(F.collect_list(F.struct("first", "value", "n"))).alias("cs")
    )
    of = lambda f: F.first(F.when(F.col("field") == f, F.col("cs")), ignorenulls=True)
    wide = counts.groupBy("query_id").agg(of("item_type").alias("t"), of("status").alias("s"), of("priority").alias("p"))
    sets = hits.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.collect_set("epic_key").alias("hit_epics"), F.collect_set("team").alias("teams")
    )
    tree = trees.groupBy("query_id").agg(F.sum("total_items").alias("tree_items"), F.collect_set("key").alias("roots"))
    none = F.array().cast("array<string>")
    to_map = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["value"], x["n"])))
    listed = lambda c: F.array_join(
        F.transform(c, lambda x: F.concat(x["value"], F.lit("("), x["n"].cast("string"), F.lit(")"))), ", "
    )
    first3 = lambda c: F.array_join(F.slice(c, 1, 3), ", ")
    filled = lambda c: F.filter(c, lambda x: x != "")
    out = (
        queries.select("query_id")
        .join(wide, "query_id", "left")
        .join(sets, "query_id", "left")
        .join(tree, "query_id", "left")
        .withColumn(
            "epics_covered",
            F.array_sort(F.array_union(filled(F.coalesce("hit_epics", none)), F.coalesce("roots", none))),
        )
        .withColumn("teams_involved", F.array_sort(filled(F.coalesce("teams", none))))
        .withColumn("total_items", F.coalesce("hits", F.lit(0)) + F.coalesce("tree_items", F.lit(0)))
    )
    text = F.concat_ws(
        " | ",
        F.concat(F.lit("Context Summary: "), F.col("total_items").cast("string"), F.lit(" items")),
        F.concat(F.lit("Types: "), F.coalesce(listed("t"), F.lit(""))),
        F.concat(F.lit("Status: "), F.coalesce(listed("s"), F.lit(""))),
        F.when(F.size("epics_covered") > 0, F.concat(F.lit("Epics: "), first3("epics_covered"))),
        F.when(F.size("teams_involved") > 0, F.concat(F.lit("Teams: "), first3("teams_involved"))),
    )
    return out.select(
        "query_id",
        "total_items",
        to_map("t").alias("item_types"),
        to_map("s").alias("status_distribution"),
        to_map("p").alias("priority_distribution"),
        "epics_covered",
        "teams_involved",
        text.alias("summary"),
    )


def debt_patterns(hits: DataFrame) -> DataFrame:
    """Counts per query by component, priority and status, and in total: ``(query_id, kind, value, n)``."""
    kv = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    single = F.array(
        kv("priority", F.coalesce("priority", F.lit("Unknown"))),
        kv("status", F.coalesce("status", F.lit("Unknown"))),
        kv("total", F.lit("all")),
    )
    components = F.transform(
        F.coalesce("components", F.array().cast("array<string>")), lambda c: kv("component", c)
    )
    return (
        hits.select("query_id", F.explode(F.concat(single, components)).alias("x"))
        .groupBy("query_id", "x.kind", "x.value")
        .agg(F.count("*").alias("n"))
    )


def debt_recommendations(patterns: DataFrame) -> DataFrame:
    """Up to three sentences per query from its patterns; the top component by count, then name."""
    is_component = F.col("kind") == "component"
    count_of = lambda kind, value: F.coalesce(
        F.sum(F.when((F.col("kind") == kind) & (F.col("value") == value), F.col("n"))), F.lit(0)
    )
    top = F.min(F.when(is_component, F.struct((-F.col("n")).alias("minus_n"), "value")))
    out = patterns.groupBy("query_id").agg(
        top.alias("top"), count_of("priority", "High").alias("high"), count_of("status", "Open").alias("open")
    )
    return out.select(
        "query_id",
        F.array_compact(
            F.array(
                F.when(
                    F.col("top").isNotNull(),
                    F.format_string("Focus on %s component with %d debt items", "top.value", -F.col("top.minus_n")),
                ),
                F.when(F.col("high") > 0, F.format_string("Address %d high-priority debt items first", "high")),
                F.when(F.col("open") > 0, F.format_string("Prioritize %d open debt items for sprint planning", "open")),
            )
        ).alias("recommendations"),
    )


# --------------------------------------------------------------------- context text

_STATE = "struct<parts:array<string>,tokens:bigint,stop:boolean>"


def _add(acc: Column, new: Column, look_back: int, limit: Column) -> Column:
    """Append sections, add the token estimate of the last ones, stop above the limit."""
    parts = F.concat(acc["parts"], new)
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - look_back + 1), look_back), "\n")
    tokens = acc["tokens"] + F.floor(F.length(tail) / 4)
    return F.when(acc["stop"], acc).otherwise(
        F.struct(parts.alias("parts"), tokens.alias("tokens"), (tokens > limit).alias("stop")).cast(_STATE)
    )


def context_text(hits: DataFrame, trees: DataFrame, queries: DataFrame, max_tokens: int = 8000) -> DataFrame:
    """Formatted context and its token count per query, within a token budget.

    At most 10 hits and 3 trees are shown, so the gathered lists are short.
    ``trees`` has ``(query_id, tree_no, key, child_keys)``.
    """
    shown = (
        hits.where(F.col("final_position") <= 10)
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("final_position", "key", "item_type", "status", "priority", "epic_key", "text"))
            ).alias("hs")
        )
    )
    tree = (
        trees.where(F.col("tree_no") <= 3)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("tree_no", "key", "child_keys"))).alias("ts"))
    )
    base = (
        queries.select("query_id", "query_text", "intent")
        .join(shown, "query_id", "left")
        .join(tree, "query_id", "left")
    )
    head = F.array(F.concat(F.lit("Query: "), F.col("query_text")), F.concat(F.lit("Intent: "), F.col("intent")))
    has_hits = F.size(F.coalesce("hs", F.array())) > 0
    parts = F.when(has_hits, F.concat(head, F.array(F.lit("\n## Relevant Items:")))).otherwise(head)
    start = F.struct(parts.alias("parts"), F.lit(20).cast("bigint").alias("tokens"), F.lit(False).alias("stop"))

    def hit_step(acc, h):
        label = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c))
        meta = F.concat_ws(
            " | ", label("Status", h["status"]), label("Priority", h["priority"]), label("Epic", h["epic_key"])
        )
        text = h["text"]
        short = F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
        unknown = lambda c: F.coalesce(c, F.lit("Unknown"))
        new = F.array_compact(
            F.array(
                F.concat(F.lit("\n### "), unknown(h["key"]), F.lit(" - "), unknown(h["item_type"])),
                F.when(meta != "", F.concat(F.lit("**"), meta, F.lit("**"))),
                F.when(F.length(text) > 0, short),
            )
        )
        return _add(acc, new, 4, F.lit(max_tokens * 0.8))

    def tree_step(acc, t):
        new = F.array_compact(
            F.array(
                F.concat(F.lit("\n### Epic: "), t["key"]),
                F.when(
                    F.size(t["child_keys"]) > 0,
                    F.concat(F.lit("Child Items: "), F.array_join(F.slice(t["child_keys"], 1, 5), ", ")),
                ),
            )
        )
        return _add(acc, new, 2, F.lit(max_tokens * 0.9))

    filled = base.withColumn("_a", F.when(has_hits, F.aggregate("hs", start.cast(_STATE), hit_step)).otherwise(start.cast(_STATE)))
    room = (F.size(F.coalesce("ts", F.array())) > 0) & (F.col("_a.tokens") < max_tokens * 0.6)
    second = F.struct(
        F.concat(F.col("_a.parts"), F.array(F.lit("\n## Epic Context:"))).alias("parts"),
        F.col("_a.tokens").alias("tokens"),
        F.lit(False).alias("stop"),
    ).cast(_STATE)
    done = filled.withColumn("_b", F.when(room, F.aggregate("ts", second, tree_step)).otherwise(F.col("_a")))
    text = F.array_join("_b.parts", "\n")
    return done.select(
        "query_id",
        text.alias("formatted_context"),
        F.floor(F.length(text) / 4).cast("bigint").alias("token_count"),
    )


def debt_queries(teams: DataFrame) -> DataFrame:
    """Query texts of the debt search, one per ``(query_id, team)``; a null team searches all."""
    text = F.concat(F.lit(L.DEBT_SEARCH_TEXT), F.coalesce(F.concat(F.lit(" team:"), F.col("team")), F.lit("")))
    return teams.withColumn("query_text", text)


def dependency_queries(rows: DataFrame) -> DataFrame:
    """Query texts of the dependency search, one per ``(query_id, epic, team)``; both may be null."""
    return rows.withColumn("query_text", F.concat_ws(" ", F.lit(L.DEPENDENCY_SEARCH_TEXT), "epic", "team"))


def epic_queries(rows: DataFrame) -> DataFrame:
    """Query text of a search in an epic; without a text the epic is named."""
    text = F.when(F.length("query_text") > 0, F.col("query_text")).otherwise(F.concat(F.lit("Epic "), F.col("epic_key")))
    return rows.withColumn("query_text", text)

