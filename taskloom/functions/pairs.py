"""Expressions on a pair of similar work items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarity levels, highest first, inclusive lower bounds.
SIMILARITY_LEVELS = {"exact": 0.95, "high": 0.85, "medium": 0.70, "low": 0.55}

# Suggested action per level; anything else gets the last one.
ACTIONS = {
    "exact": "Immediate review - likely exact duplicate",
    "high": "High priority review - consider merging",
    "medium": "Investigate potential relationship - compare for related work",
}
DEFAULT_ACTION = "Low priority - monitor for patterns"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cases(pairs, otherwise=None) -> Column:
    """``CASE WHEN`` over (condition, value) pairs."""
    expr = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    if otherwise is None:
        return expr
    return expr.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def similarity_level(score, levels: dict[str, float] | None = None) -> Column:
    s = _col(score)
    ordered = sorted((levels or SIMILARITY_LEVELS).items(), key=lambda kv: -kv[1])
    return cases([(s >= bound, name) for name, bound in ordered])


def suggested_action(level) -> Column:
    lv = _col(level)
    return cases([(lv == name, text) for name, text in ACTIONS.items()], DEFAULT_ACTION)


def review_priority(a: str = "o", b: str = "s") -> Column:
    """1 plus one point each for same type, status, non-null epic and recency; 5 at most.

    ``a`` and ``b`` name struct columns of the original and the similar item. An original
    that is older than the similar item always counts as recent.
    """
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    days = F.floor((F.unix_timestamp(f"{a}.created") - F.unix_timestamp(f"{b}.created")) / 86400)
    points = (
        F.lit(1)
        + one(F.col(f"{a}.issue_type") == F.col(f"{b}.issue_type"))
        + one(F.col(f"{a}.status") == F.col(f"{b}.status"))
        + one(F.col(f"{a}.epic_key") == F.col(f"{b}.epic_key"))
        + one(days < 30)
    )
    return F.least(points, F.lit(5))


def similarity_reasons(score, a: str = "o", b: str = "s") -> Column:
    """Ordered list of reasons; two missing epics count as the same epic."""
    words = F.split(F.trim(F.lower(F.col(f"{a}.summary"))), r"\s+")
    other = F.lower(F.col(f"{b}.summary"))
    reasons = F.array_compact(
        F.array(
            F.when(F.exists(words, lambda w: (F.length(w) > 3) & F.contains(other, w)), "Similar titles/keywords"),
            F.when(F.col(f"{a}.epic_key").eqNullSafe(F.col(f"{b}.epic_key")), "Same Epic"),
            F.when(F.arrays_overlap(f"{a}.components", f"{b}.components"), "Shared components"),
            F.when(F.arrays_overlap(f"{a}.labels", f"{b}.labels"), "Shared labels"),
            F.when(_col(score) > 0.8, "High semantic similarity"),
        )
    )
    return F.when(F.size(reasons) == 0, F.array(F.lit("Semantic content similarity"))).otherwise(reasons)


def misplacement_reason(epic, best, current) -> Column:
    """Sentence that explains why another epic fits an item better."""
    epic, best, current = _col(epic), _col(best), _col(current)
    gain = best - current
    degree = cases([(gain > 0.3, "significantly "), (gain > 0.15, "notably ")], "")
    trust = cases([(best > 0.8, "high"), (best > 0.6, "moderate")], "low")
    return F.format_string(
        "Work item shows %shigher semantic similarity, with Epic %s (%s confidence). "
        "Current Epic coherence: %.2f, Suggested Epic coherence: %.2f.",
        degree,
        epic,
        trust,
        current,
        best,
    )
