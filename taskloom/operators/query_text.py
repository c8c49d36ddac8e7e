"""Features of free-text queries: filters, time range, intent, expansions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.functions import lexicons as L
from taskloom.functions.debt import has_any
from taskloom.functions.pairs import cases


def _names(q: Column, table: dict[str, str]) -> Column:
    """Names whose pattern occurs in the query, in table order."""
    return F.array_compact(F.array(*[F.when(F.rlike(q, F.lit(f"(?iU){p}")), F.lit(n)) for n, p in table.items()]))


def _all(q: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(q, F.lit(pattern), group)


def _repeat(q: Column, phrase: str, name: str) -> Column:
    return F.transform(_all(q, f"(?iU)({phrase})"), lambda _: F.lit(name))


def _lists(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def query_features(queries: DataFrame, now: str, text: str = "query_text") -> DataFrame:
    """Add one column per feature to a table of query texts.

    ``now`` is a timestamp literal, so that results repeat. Filter columns hold empty
    lists when the query does not name them; the date range is only reported.
    """
    q = F.col(text)
    low = F.lower(q)
    at = F.to_timestamp(F.lit(now))
    days = cases([(F.rlike(q, F.lit(rf"(?iU)\b{p}\b")), n) for p, n in L.TIME_PHRASES.items()])
    synonyms = F.flatten(
        F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), _lists(s)) for t, s in L.SYNONYMS.items()]))
    )
    variants = F.flatten(F.array_compact(F.array(*[F.when(has_any(low, t), _lists(v)) for t, v in L.VARIANTS])))
    out = queries.select(
        "*",
        _names(q, L.ITEM_TYPES).alias("item_types"),
        _names(q, L.STATUSES).alias("statuses"),
        _names(q, L.PRIORITIES).alias("priorities"),
        _names(q, L.COMPONENTS).alias("component_names"),
        _names(q, L.TEAMS).alias("teams"),
        days.alias("days_back"),
        F.concat(
            _all(q, r"(?iU)(sprint \d+)"),
            _repeat(q, "current sprint", "current"),
            _repeat(q, "last sprint", "previous"),
            _repeat(q, "next sprint", "next"),
        ).alias("sprints"),
        F.concat(
            _all(q, r"(?iU)assigned to (\w+)"), _all(q, r"(?iU)assignee (\w+)"), _all(q, r"(?iU)@(\w+)")
        ).alias("assignees"),
        _all(q, r"(?U)\b([A-Z]+-\d+)\b").alias("epic_keys"),
        F.when(has_any(low, L.ANALYSIS_WORDS), "analysis").otherwise("search").alias("intent"),
        F.when(has_any(low, L.SUMMARY_WORDS), "summary").otherwise("list").alias("expected_output"),
        F.when(has_any(low, L.URGENT_WORDS), 1.5).alias("priority_boost"),
        F.when(F.contains(low, F.lit("blocked")), 2.0).alias("status_boost"),
        synonyms.alias("expanded_terms"),
        variants.alias("variants"),
    )
    seconds = F.col("days_back").cast("bigint") * 86400
    return (
        out.withColumn("date_start", F.timestamp_seconds(F.unix_timestamp(at) - seconds))
        .withColumn("date_end", F.when(F.col("days_back").isNotNull(), at))
        .withColumn(
            "full_text", F.array_join(F.concat(F.array(q), F.col("expanded_terms"), F.col("variants")), " ")
        )
    )


FILTER_COLUMNS = {
    "item_type": "item_types",
    "status": "statuses",
    "priority": "priorities",
    "components": "component_names",
    "team": "teams",
    "epic_key": "epic_keys",
    "assignee": "assignees",
    "sprint_names": "sprints",
}


def filter_text() -> Column:
    """The non-empty filters of a query as one JSON text, fields in table order."""
    filled = [F.when(F.size(c) > 0, F.col(c)).alias(name) for name, c in FILTER_COLUMNS.items()]
    return F.to_json(F.struct(*filled))
