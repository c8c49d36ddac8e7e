"""The full cost report as one long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators import cost as C
from taskloom.session import cut_lineage


def _section(df: DataFrame, name: str, item, value) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(F.lit(name).alias("section"), c(item).cast("string").alias("item"), c(value).cast("double").alias("value"))


def cost_report(
    log: DataFrame,
    period: str,
    now: str,
    llm: str = "llm",
    embeddings: str = "embeddings",
    monthly: float = C.MONTHLY_BUDGET,
    embedding_batch: int = 32,
    gap: float = 5.0,
) -> DataFrame:
    """Rows ``(section, item, value)``: services, daily series, categories, savings, forecast, efficiency, budget."""
    days = C.PERIOD_DAYS.get(period, 30)
    # a period ends with its last day and covers days + 1 calendar days
    first = F.date_sub(F.to_date(F.lit(now)), days)
    rows = log.where((F.to_date("ts") >= first) & (F.col("ts") <= F.to_timestamp(F.lit(now))))
    # most sections need no more than daily sums per operation, so the log is reduced to them once
    cube = cut_lineage(
        rows.groupBy("service", "operation", F.date_trunc("day", "ts").alias("ts")).agg(
            F.sum("cost").alias("cost"), F.count("*").alias("n")
        )
    )
    breakdown = C.service_breakdown(cube, llm, embeddings)
    series = C.cost_series(cube, now, days)
    suggestions = C.cost_optimisations(rows, llm, gap=gap, embedding_batch=embedding_batch)
    risk = C.efficiency_risk(suggestions, breakdown, monthly)
    outlook = C.forecast(series)
    budget = C.budget_status(cube, now, monthly=monthly)
    parts = [
        _section(breakdown, "service", "service", "cost"),
        _section(series, "daily", "day", "cost"),
        _section(C.cost_per_category(cube.where(F.col("service") == llm)), "category", "category", "cost"),
        _section(suggestions, "saving", "type", "potential_savings"),
        _section(outlook, "forecast", F.lit("next_month"), "next_month"),
        _section(outlook, "forecast", F.lit("next_week"), "next_week"),
        _section(risk, "efficiency", F.lit("score"), "efficiency_score"),
        _section(budget, "budget", F.lit("monthly_percentage"), "monthly_percentage"),
        _section(cube.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "calls", F.lit("analyzed"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
