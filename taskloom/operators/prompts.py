"""Prompt tables for an external scorer, and parsing of its responses.

A prompt table is ``(key, prompt)``; a scorer turns it into ``(key, content, cost)``.
The engine itself never calls a model: :func:`score_prompts` runs a user function over
Arrow batches where one is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.debt import story_points_bucket
from taskloom.operators.ranks import with_position

NO_DESCRIPTION = "No description provided"


#: Answers ``(content, cost)`` to a list of prompts.
PromptScorer = Callable[[list[str]], list[tuple[str, float]]]


def _described(c: str = "description") -> Column:
    return F.when(F.length(c) > 0, F.col(c)).otherwise(NO_DESCRIPTION)


def _item(prefix: str = "") -> Column:
    p = prefix
    return F.format_string("%s: %s\n%s", f"{p}key", f"{p}summary", _described(f"{p}description"))


def _context(items: str = "context") -> Column:
    return F.array_join(F.slice(F.col(items), 1, 3), "\n---\n")


# Own wording; only the inputs of each kind matter to a scorer.
_KINDS: dict[str, Callable[[], Column]] = {
    "quality": lambda: F.format_string(
        "Rate this work item from 1 to 5 for clarity, completeness, actionability and testability.\n"
        "Title: %s\nType: %s\nDescription: %s\nAnswer as JSON with the four scores, overall_score, "
        "improvement_suggestions and risk_level.",
        "summary",
        "issue_type",
        _described(),
    ),
    "split": lambda: F.format_string(
        "Should this work item be split?\nTitle: %s\nDescription: %s\nEstimated size: %s\n"
        "Answer as JSON with should_split, complexity_score, suggested_splits and reasoning.",
        "summary",
        _described(),
        story_points_bucket(),
    ),
    "drift": lambda: F.format_string(
        "How did the scope change?\nBefore:\n%s\nAfter:\n%s\n"
        "Answer as JSON with change_type, impact_level and summary.",
        "old_description",
        "new_description",
    ),
    "misplacement": lambda: F.format_string(
        "Does this item belong to another epic?\nItem %s\nCurrent epic %s\nSuggested epic %s\n"
        "Answer as JSON with reasoning and confidence.",
        _item(),
        "epic_key",
        "suggested_epic_key",
    ),
    "complexity": lambda: F.format_string("Judge the complexity of %s\nRelated items:\n%s", _item(), _context()),
    "similarity": lambda: F.format_string("Compare %s\nwith these items:\n%s", _item(), _context()),
    "general": lambda: F.format_string("Analyse %s\nRelated items:\n%s", _item(), _context()),
    "epic_query": lambda: F.format_string(
        "Write a search query of 2 to 8 words for this epic.\nEpic: %s\nDescription: %s", "summary", _described()
    ),
}


def build_prompts(items: DataFrame, kind: str) -> DataFrame:
    """One prompt per row: ``(key, prompt)``."""
    return items.select("key", _KINDS[kind]().alias("prompt"))


def cluster_prompts(members: DataFrame, items: DataFrame, show: int = 50) -> DataFrame:
    """Prompts ``(cluster_id, part, prompt)`` that show all members of each cluster by key.

    A prompt shows ``show`` members; larger clusters get several, ``part`` from 0, and each names
    the full size. Members are numbered before they are gathered, so a gathered list is short.
    """
    w = Window.partitionBy("cluster_id").orderBy("key")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    lines = (
        members.withColumn("i", F.row_number().over(w))
        .withColumn("part", F.floor((F.col("i") - 1) / show).cast("int"))
        .join(items.select("key", "summary", "issue_type", "description", "labels"), "key")
        .select(
            "cluster_id",
            "part",
            "i",
            F.format_string(
                "Item %d:\nKey: %s\nTitle: %s\nType: %s\nDescription: %s\nLabels: %s",
                "i",
                "key",
                "summary",
                "issue_type",
                F.substring(_described(), 1, 200),
                F.array_join("labels", ", "),
            ).alias("line"),
        )
    )
    return (
        lines.groupBy("cluster_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))
        .join(sizes, "cluster_id")
        .select(
            "cluster_id",
            "part",
            F.format_string(
                "Find the theme, priority, effort, dependencies, impact and approach of %d related items.\n%s",
                "size",
                F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"),
            ).alias("prompt"),
        )
    )


def template_prompts(samples: DataFrame, show: int = 5) -> DataFrame:
    """Prompts ``(issue_type, part, prompt)`` that show all samples of each issue type with at least three.

    A prompt shows ``show`` samples by key; more samples take several prompts, ``part`` from 0.
    """
    w = Window.partitionBy("issue_type").orderBy("key")
    sizes = samples.groupBy("issue_type").agg(F.count("*").alias("n")).where("n >= 3")
    return (
        samples.withColumn("i", F.row_number().over(w))
        .withColumn("part", F.floor((F.col("i") - 1) / show).cast("int"))
        .groupBy("issue_type", "part")
        .agg(F.array_sort(F.collect_list(F.struct("i", _item().alias("text")))).alias("shown"))
        .join(sizes, "issue_type")
        .select(
            "issue_type",
            "part",
            F.format_string(
                "Infer a title and description template for %s items from these samples.\n%s",
                "issue_type",
                F.array_join(F.transform("shown", lambda x: x["text"]), "\n---\n"),
            ).alias("prompt"),
        )
    )


def with_batch(items: DataFrame, size: int, order: list[str] | None = None) -> DataFrame:
    """Add ``batch_id`` (from 0) and ``in_batch`` (from 1) for groups of ``size`` rows.

    ``order`` has to be unique. Only its columns are sorted and numbered; the rest of the
    row joins the number afterwards.
    """
    order = order or ["key"]
    placed = with_position(items.select(*order), order, "_pos")
    n = F.col("_pos") - 1
    numbers = placed.select(
        *order, F.floor(n / size).cast("bigint").alias("batch_id"), (n % size + 1).cast("int").alias("in_batch")
    )
    return items.join(numbers, order)


def batch_prompts(items: DataFrame, size: int = 5) -> DataFrame:
    """One quality prompt per ``size`` items: ``(batch_id, keys, prompt)``."""
    block = F.format_string(
        "Item %d:\nKey: %s\nTitle: %s\nType: %s\nDescription: %s",
        "in_batch",
        "key",
        "summary",
        "issue_type",
        _described(),
    )
    rows = with_batch(items, size).select("batch_id", F.struct("in_batch", "key", block.alias("text")).alias("b"))
    # a batch holds at most `size` rows
    return (
        rows.groupBy("batch_id")
        .agg(F.array_sort(F.collect_list("b")).alias("bs"))
        .select(
            "batch_id",
            F.transform("bs", lambda b: b["key"]).alias("keys"),
            F.concat(
                F.lit("Rate each work item; answer as JSON with a list named analyses.\n\n"),
                F.array_join(F.transform("bs", lambda b: b["text"]), "\n\n"),
            ).alias("prompt"),
        )
    )


def retrying(scorer: PromptScorer, tries: int = 3) -> PromptScorer:
    """A scorer that is asked again when it fails, and at last answers null at no cost."""

    def run(texts: list[str]) -> list[tuple[str | None, float]]:
        for _ in range(tries):
            try:
                return scorer(texts)
            except Exception:  # noqa: BLE001 - any failure of a model call
                continue
        return [(None, 0.0)] * len(texts)

    return run


def score_prompts(prompts: DataFrame, scorer: PromptScorer, key: str = "key", batch: int = 32) -> DataFrame:
    """Run ``scorer`` over groups of ``batch`` prompts inside Arrow tasks: ``(key, content, cost)``."""
    key_type = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                answers = scorer(part.column("prompt").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array([a[0] for a in answers], pa.string()), pa.array([float(a[1]) for a in answers])],
                    names=[key, "content", "cost"],
                )

    return prompts.select(key, "prompt").mapInArrow(run, f"{key} {key_type}, content string, cost double")


# ------------------------------------------------------------------- responses

_QUALITY = (
    "clarity_score double, completeness_score double, actionability_score double, testability_score double, "
    "overall_score double, improvement_suggestions array<string>, risk_level string"
)
_SPLITS = "array<struct<title:string,description:string,estimated_effort:string,dependencies:array<string>>>"
_SCORES = ["clarity_score", "completeness_score", "actionability_score", "testability_score"]


def _parsed(content: str, schema: str) -> Column:
    return F.from_json(content, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})


def _is_bad(parsed: str) -> Column:
    return F.col(parsed).isNull() | F.col(f"{parsed}._bad").isNotNull()


def _quality_columns(p: str, bad: Column, text: str) -> list[Column]:
    low = F.lower(text)
    scores = {s: F.coalesce(F.when(~bad, F.col(f"{p}.{s}")), F.lit(3.0)) for s in _SCORES}
    mean = sum(scores.values()) / 4
    risk_in_text = F.when(F.contains(low, F.lit("low risk")), "Low").when(F.contains(low, F.lit("high risk")), "High")
    return [
        *[c.alias(s) for s, c in scores.items()],
        F.when(bad, F.lit(3.0)).otherwise(F.coalesce(f"{p}.overall_score", mean)).alias("overall_score"),
        F.when(bad, F.array(F.lit("Review and clarify requirements")))
        .otherwise(F.coalesce(f"{p}.improvement_suggestions", F.array().cast("array<string>")))
        .alias("improvement_suggestions"),
        F.coalesce(F.when(bad, risk_in_text).otherwise(F.col(f"{p}.risk_level")), F.lit("Medium")).alias("risk_level"),
        bad.alias("used_fallback"),
    ]


def parse_quality(responses: DataFrame) -> DataFrame:
    """Quality responses to typed rows; missing scores are 3, malformed text falls back."""
    p = responses.withColumn("_p", _parsed("content", _QUALITY))
    return p.select("key", *_quality_columns("_p", _is_bad("_p"), "content"), "cost")


def parse_split(responses: DataFrame) -> DataFrame:
    """Split responses; malformed text recommends a split when it says so."""
    schema = f"should_split boolean, complexity_score double, reasoning string, suggested_splits {_SPLITS}"
    p = responses.withColumn("_p", _parsed("content", schema))
    bad, low = _is_bad("_p"), F.lower("content")
    says_so = F.contains(low, F.lit("split")) & F.contains(low, F.lit("recommend"))
    splits = F.when(~bad, F.col("_p.suggested_splits"))
    return p.select(
        "key",
        F.when(bad, says_so).otherwise(F.coalesce("_p.should_split", F.lit(False))).alias("should_split"),
        F.coalesce(F.when(~bad, F.col("_p.complexity_score")), F.lit(0.5)).alias("complexity_score"),
        F.when(bad, "Unable to parse detailed analysis")
        .otherwise(F.coalesce("_p.reasoning", F.lit("No reasoning provided")))
        .alias("reasoning"),
        F.coalesce(splits, F.array().cast(_SPLITS)).alias("suggested_splits"),
        "cost",
    )


def parse_batch_quality(responses: DataFrame, items: DataFrame) -> DataFrame:
    """Batch responses ``(batch_id, content)``; a malformed batch gives neutral rows for its items.

    ``items`` has ``(batch_id, key)``.
    """
    entry = _QUALITY.replace(" double", ":double").replace(" array", ":array").replace(" string", ":string")
    p = responses.withColumn("_p", _parsed("content", f"analyses array<struct<work_item_key:string,{entry}>>"))
    bad = _is_bad("_p")
    good = p.where(~bad).select("batch_id", F.explode("_p.analyses").alias("a"))
    typed = good.select(
        "batch_id",
        F.col("a.work_item_key").alias("key"),
        *[F.coalesce(f"a.{s}", F.lit(3.0)).alias(s) for s in _SCORES],
        F.coalesce("a.overall_score", F.lit(3.0)).alias("overall_score"),
        F.coalesce("a.improvement_suggestions", F.array().cast("array<string>")).alias("improvement_suggestions"),
        F.coalesce("a.risk_level", F.lit("Medium")).alias("risk_level"),
    )
    neutral = (
        p.where(bad)
        .select("batch_id")
        .join(items.select("batch_id", "key"), "batch_id")
        .select(
            "batch_id",
            "key",
            *[F.lit(3.0).alias(s) for s in _SCORES],
            F.lit(3.0).alias("overall_score"),
            F.array(F.lit("Batch analysis parsing failed")).alias("improvement_suggestions"),
            F.lit("Medium").alias("risk_level"),
        )
    )
    return typed.unionByName(neutral)


def extract_json(content="content") -> Column:
    """Struct of the JSON object inside prose, or the raw text with confidence 0.5."""
    c = F.col(content) if isinstance(content, str) else content
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    valid = (inner != "") & F.try_parse_json(inner).isNotNull()
    reason = F.when(F.contains(c, F.lit("{")), "Invalid JSON response").otherwise("Failed to parse structured response")
    return F.struct(
        F.when(valid, inner).alias("json"),
        F.when(~valid, c).alias("raw_response"),
        F.when(~valid, F.lit(0.5)).alias("confidence"),
        F.when(~valid, reason).alias("reasoning"),
    )


def _parse_with_defaults(responses: DataFrame, schema: str, defaults: dict) -> DataFrame:
    p = responses.withColumn("_p", _parsed("content", schema))
    ok = ~_is_bad("_p")
    return p.select(
        "key", *[F.coalesce(F.when(ok, F.col(f"_p.{n}")), d).alias(n) for n, d in defaults.items()], "cost"
    )


def parse_cluster(responses: DataFrame) -> DataFrame:
    return _parse_with_defaults(
        responses,
        "theme string, priority_score double, estimated_effort string, dependencies array<string>, "
        "impact_assessment string, recommended_approach string",
        {
            "theme": F.concat(F.lit("Technical Debt Cluster "), F.col("key").cast("string")),
            "priority_score": F.lit(0.5),
            "estimated_effort": F.lit("Medium"),
            "dependencies": F.array().cast("array<string>"),
            "impact_assessment": F.lit("Medium impact if not addressed"),
            "recommended_approach": F.lit("Review and prioritize items individually"),
        },
    )


def parse_drift(responses: DataFrame) -> DataFrame:
    return _parse_with_defaults(
        responses,
        "change_type string, impact_level string, summary string",
        {
            "change_type": F.lit("unknown"),
            "impact_level": F.lit("moderate"),
            "summary": F.lit("Unable to analyze change details"),
        },
    )


def parse_misplacement(responses: DataFrame) -> DataFrame:
    return _parse_with_defaults(
        responses,
        "reasoning string, confidence double",
        {
            "reasoning": F.lit("Unable to analyze misplacement due to analysis error"),
            "confidence": F.lit(0.5),
        },
    )


def quality_rollup(parsed: DataFrame) -> DataFrame:
    """One row: items, successes, failures, cost and mean overall score."""
    return parsed.agg(
        F.count("*").alias("processed"),
        F.count_if(~F.col("used_fallback")).alias("successful"),
        F.count_if("used_fallback").alias("failed"),
        F.sum("cost").alias("total_cost"),
        F.avg("overall_score").alias("average_overall_score"),
    )
