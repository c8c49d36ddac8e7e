"""Technical-debt predicates, priority and effort as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.functions import lexicons as L
from taskloom.functions.pairs import cases


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_any(text, terms: list[str]) -> Column:
    """True when any term is a substring of the text."""
    text = _col(text)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def count_of(text, terms: list[str]) -> Column:
    """How many of the terms are substrings of the text."""
    text = _col(text)
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def _text(summary="summary", description="description") -> Column:
    return F.lower(F.concat_ws(" ", _col(summary), F.coalesce(_col(description), F.lit(""))))


def _labels() -> Column:
    return F.lower(F.array_join("labels", " "))


def is_debt_a(keywords: list[str] | None = None) -> Column:
    """Any keyword in the summary, the description or a single label."""
    kw = keywords or L.DEBT_KEYWORDS_A
    return (
        has_any(F.lower("summary"), kw)
        | has_any(F.lower(F.coalesce("description", F.lit(""))), kw)
        | F.exists("labels", lambda lb: has_any(F.lower(lb), kw))
    )


def is_debt_b(terms: list[str] | None = None) -> Column:
    """Any term in the text, or in the joined labels of an improvement-like item."""
    terms = terms or L.DEBT_TERMS_B
    return has_any(_text(), terms) | (F.lower("issue_type").isin(L.IMPROVEMENT_TYPES) & has_any(_labels(), terms))


def debt_priority_a(lexicon: dict | None = None) -> Column:
    lx = lexicon or L.PRIORITY_A
    text, labels = _text(), _labels()
    hits = lambda words: reduce(
        lambda a, b: a + b, [(F.contains(text, F.lit(w)) | F.contains(labels, F.lit(w))).cast("int") for w in words]
    )
    return F.least(F.lit(1.0), hits(lx["high"]) * 0.3 + hits(lx["medium"]) * 0.2)


def debt_priority_b(lexicon: dict | None = None) -> Column:
    lx = lexicon or L.PRIORITY_B
    labels = _labels()
    text = F.concat_ws(" ", _text(), labels)
    score = (
        count_of(text, lx["high"]) * 0.3
        + count_of(text, lx["medium"]) * 0.2
        - count_of(text, lx["low"]) * 0.1
        + F.lit(0.3)
        + has_any(labels, lx["labels"]).cast("int") * 0.2
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def effort_a(description="description", lexicon: dict | None = None) -> Column:
    """Large, Small or Medium by the highest indicator count; ties in that order."""
    lx = lexicon or L.EFFORT_A
    d = F.coalesce(_col(description), F.lit(""))
    low, n = F.lower(d), F.length(d)
    large = count_of(low, lx["complex"]) + (n > 300).cast("int")
    small = count_of(low, lx["simple"]) + (n < 50).cast("int")
    medium = count_of(low, lx["medium"]) + n.between(50, 150).cast("int")
    top = F.greatest(large, small, medium)
    return cases([(d == "", "Unknown"), (top == 0, "Medium"), (large == top, "Large"), (small == top, "Small")], "Medium")


def effort_b(description="description", lexicon: dict | None = None) -> Column:
    """Large, Medium or Small by length, line, term and bullet points."""
    lx = lexicon or L.EFFORT_B
    d = F.coalesce(_col(description), F.lit(""))
    low = F.lower(d)
    words = F.size(F.filter(F.split(d, r"(?U)\s+"), lambda w: w != ""))
    lines = F.length(d) - F.length(F.replace(d, F.lit("\n"))) + 1
    dashes = (F.length(d) - F.length(F.replace(d, F.lit("\n-")))) / 2
    bullets = F.contains(d, F.lit("- ")) | F.contains(d, F.lit("* ")) | (dashes > 2)
    points = (
        cases([(words > 100, 2), (words > 50, 1)], 0)
        + cases([(lines > 10, 2), (lines > 5, 1)], 0)
        + count_of(low, lx["complex"]) * 2
        - count_of(low, lx["simple"])
        + bullets.cast("int") * 2
    )
    return cases([(d == "", "Small"), (points >= 5, "Large"), (points >= 2, "Medium")], "Small")


def story_points_bucket(description="description") -> Column:
    d = F.coalesce(_col(description), F.lit(""))
    n = F.length(d)
    return cases([(n > 1000, "8-13 (Large)"), (n > 500, "5-8 (Medium)"), (n > 0, "1-3 (Small)")], "Unknown")
