"""Cost analytics on a call log ``(service, operation, ts, input_tokens, output_tokens, cost)``.

Logs are reduced by key before anything else; windows run only on what is left, one row
per day, month or time bucket. ``now`` is always a parameter, so results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskloom.functions.pairs import cases
from taskloom.functions.text import op_category
from taskloom.operators.ranks import with_total_before, with_totals

# Prices per token, savings shares, limits and thresholds.
INPUT_PRICE, OUTPUT_PRICE = 0.000003, 0.000015
BATCH_SAVING, CACHE_SHARE, PROMPT_SAVING, DOWNGRADE_SAVING = 0.3, 0.1, 0.2, 0.4
EMBEDDING_BATCH_TARGET = 64
ALERT_THRESHOLDS = [0.5, 0.75, 0.9, 1.0]
DAILY_BUDGET, MONTHLY_BUDGET = 50.0, 1000.0
PERIOD_DAYS = {"week": 7, "month": 30, "quarter": 90}


def _at(now: str) -> Column:
    return F.to_timestamp(F.lit(now))


def call_cost(input_tokens="input_tokens", output_tokens="output_tokens", in_price=INPUT_PRICE, out_price=OUTPUT_PRICE):
    """Price of a call from its token counts."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(input_tokens) * F.lit(in_price) + c(output_tokens) * F.lit(out_price)


def alert_severity(threshold) -> Column:
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    return cases([(t >= 1.0, "critical"), (t >= 0.9, "high"), (t >= 0.75, "medium")], "low")


# ------------------------------------------------------------------------ totals


def cost_summary(log: DataFrame) -> DataFrame:
    """Cost, calls and time span per service and for all services."""
    return (
        log.rollup("service")
        .agg(
            F.grouping_id().alias("_g"),
            F.sum("cost").alias("total_cost"),
            F.count("*").alias("calls"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .withColumn("service", F.when(F.col("_g") == 1, "all").otherwise(F.col("service")))
        .withColumn("duration_seconds", F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts"))
        .drop("_g")
    )


def service_breakdown(log: DataFrame, llm: str = "llm", embeddings: str = "embeddings") -> DataFrame:
    """Cost of the four cost centres; vector storage is estimated, the tracker is free."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("service") == s, F.col("cost"))), F.lit(0.0))
    one = log.agg(of(llm).alias("a"), of(embeddings).alias("b"))
    rows = F.array(
        F.struct(F.lit("llm_api").alias("service"), F.col("a").alias("cost")),
        F.struct(F.lit("embedding_processing").alias("service"), F.col("b").alias("cost")),
        F.struct(F.lit("vector_storage").alias("service"), (F.col("b") * 0.1).alias("cost")),
        F.struct(F.lit("tracker_api").alias("service"), F.lit(0.0).alias("cost")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def cost_per_category(log: DataFrame) -> DataFrame:
    return log.groupBy(op_category().alias("category")).agg(F.sum("cost").alias("cost"))


def efficiency(log: DataFrame) -> DataFrame:
    """One row: cost per call and token, output share, the most expensive operation."""
    by_op = log.groupBy(F.coalesce("operation", F.lit("unknown")).alias("operation")).agg(
        F.sum("cost").alias("cost"),
        F.count("*").alias("n"),
        F.sum("input_tokens").alias("i"),
        F.sum("output_tokens").alias("o"),
    )
    tokens = F.sum("i") + F.sum("o")
    return by_op.agg(
        F.coalesce(F.sum("cost") / F.sum("n"), F.lit(0.0)).alias("avg_cost_per_call"),
        F.coalesce(F.when(tokens > 0, F.sum("cost") / tokens), F.lit(0.0)).alias("cost_per_token"),
        F.coalesce(F.when(tokens > 0, F.sum("o") / (F.sum("i") + 1)), F.lit(0.0)).alias("token_efficiency_score"),
        F.coalesce(F.max_by("operation", F.struct("cost", "operation")), F.lit("")).alias("highest_cost_operation"),
        F.coalesce(F.max("cost"), F.lit(0.0)).alias("highest_cost_value"),
    )


def prompt_efficiency(log: DataFrame) -> DataFrame:
    """Per category: averages, calls above 1.5 times the average, monthly saving; overall score."""
    calls = log.select(op_category().alias("category"), "input_tokens", "output_tokens", "cost")
    means = calls.groupBy("category").agg(
        F.count("*").alias("total_calls"),
        F.avg("input_tokens").alias("avg_input_tokens"),
        F.avg("output_tokens").alias("avg_output_tokens"),
        F.avg("cost").alias("avg_cost"),
    )
    costly = F.col("cost") > F.col("avg_cost") * 1.5
    expensive = (
        calls.select("category", "cost")
        .join(means.select("category", "avg_cost"), "category")
        .groupBy("category")
        .agg(
            F.count_if(costly).alias("expensive_calls"),
            (F.coalesce(F.sum(F.when(costly, F.col("cost") * PROMPT_SAVING)), F.lit(0.0)) * 30).alias(
                "optimization_potential"
            ),
        )
    )
    out = means.join(expensive, "category")
    overall = out.agg((1.0 - F.sum("expensive_calls") / F.sum("total_calls")).alias("overall_efficiency_score"))
    return with_totals(out, overall)


# ------------------------------------------------------------- saving suggestions


def _suggestion(kind, current, suggested, savings, risk, text) -> list[Column]:
    return [
        kind.alias("type"),
        current.cast("string").alias("current_value"),
        suggested.cast("string").alias("suggested_value"),
        savings.cast("double").alias("potential_savings"),
        F.lit(risk).alias("risk_level"),
        text.alias("description"),
    ]


def _embedding_batch(log: DataFrame, batch: int, saving: float, only_if_logged: str | None) -> DataFrame:
    """The suggestion to use larger embedding batches: one row or none."""
    logged = F.lit(True) if only_if_logged is None else F.count_if(F.col("service") == only_if_logged) > 0
    return (
        log.agg(logged.alias("ok"))
        .where(F.col("ok") & F.lit(batch < EMBEDDING_BATCH_TARGET))
        .select(
            *_suggestion(
                F.lit("embedding_batch_increase"),
                F.lit(batch),
                F.lit(EMBEDDING_BATCH_TARGET),
                F.lit(saving),
                "low",
                F.lit("Increase embedding batch size for better throughput"),
            )
        )
    )


def batch_opportunities(log: DataFrame, embeddings: str = "embeddings", embedding_batch: int = 32) -> DataFrame:
    """Operations with at least three calls whose batching saves at least 1.0 a month."""
    ops = log.groupBy("operation").agg(
        F.count("*").alias("n"), F.sum("cost").alias("cost"), F.count_distinct(F.to_date("ts")).alias("days")
    )
    saving = (F.col("cost") - F.col("cost") * (1 - BATCH_SAVING)) / F.col("days") * 30
    rows = (
        ops.where("n >= 3")
        .withColumn("saving", saving)
        .where("saving >= 1.0")
        .select(
            *_suggestion(
                F.format_string("%s_batch_optimization", "operation"),
                F.lit(1),
                F.least(F.lit(10), F.col("n")),
                F.col("saving"),
                "low",
                F.format_string("Batch %s operations for cost savings", "operation"),
            )
        )
    )
    return rows.unionByName(_embedding_batch(log, embedding_batch, 5.0, embeddings))


def caching_opportunities(log: DataFrame) -> DataFrame:
    """Per operation: calls that could be answered from a cache and their monthly saving."""
    ops = log.groupBy("operation").agg(F.count("*").alias("calls"), F.avg("cost").alias("avg_cost"))
    repeats = F.when(F.col("calls") > 1, F.floor(F.col("calls") * CACHE_SHARE)).otherwise(0)
    return ops.select(
        "operation",
        "calls",
        repeats.cast("bigint").alias("duplicate_calls"),
        (repeats * F.col("avg_cost") * (30 / 7)).alias("potential_savings"),
        (F.col("calls") > 5).alias("cacheable"),
    )


def caching_summary(opportunities: DataFrame) -> DataFrame:
    out = opportunities.agg(
        F.sum("duplicate_calls").alias("duplicate_call_count"),
        F.sum("potential_savings").alias("potential_savings"),
        F.count_if("cacheable").alias("cacheable_operations"),
    )
    worth = F.col("potential_savings") > 5.0
    return out.withColumn(
        "recommendation",
        F.when(worth, "Implement results caching").otherwise("No significant caching opportunity"),
    )


def bursts(log: DataFrame, gap: float = 5.0, bucket: str = "minute") -> DataFrame:
    """Runs of calls of one operation at most ``gap`` seconds apart: ``(operation, start, end, calls, cost)``.

    Runs are first built inside (operation, time bucket), so a hot operation is split over
    its buckets. Only the first and last run of a bucket can continue in a neighbour bucket;
    just those are looked at again per operation.
    """
    secs = lambda c: F.unix_micros(c) / 1e6
    calls = log.select("operation", "ts", "cost").withColumn("_b", F.date_trunc(bucket, "ts"))
    in_bucket = Window.partitionBy("operation", "_b").orderBy("ts")
    fresh = (secs(F.col("ts")) - secs(F.lag("ts").over(in_bucket))) > gap
    runs = (
        calls.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("operation", "_b", "_run")
        .agg(
            F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("calls"), F.sum("cost").alias("cost")
        )
    )
    last_run = F.max("_run").over(Window.partitionBy("operation", "_b"))
    placed = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last_run))
    inner = placed.where(~F.col("_edge")).select("operation", "start", "end", "calls", "cost")
    per_op = Window.partitionBy("operation").orderBy("start")
    # an inner run between two edge runs keeps them apart by more than the gap anyway
    fresh = (secs(F.col("start")) - secs(F.lag("end").over(per_op))) > gap
    edges = (
        placed.where("_edge")
        .withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(per_op.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("operation", "_run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("calls").alias("calls"),
            F.sum("cost").alias("cost"),
        )
        .drop("_run")
    )
    return inner.unionByName(edges)


def batchable_calls(log: DataFrame, gap: float = 5.0) -> DataFrame:
    """Per operation with at least five calls: calls in bursts, monthly saving, batch size."""
    runs = bursts(log, gap)
    ops = runs.groupBy("operation").agg(
        F.sum("calls").alias("n"),
        (F.sum("cost") / F.sum("calls")).alias("avg_cost"),
        F.coalesce(F.sum(F.when(F.col("calls") > 1, F.col("calls"))), F.lit(0)).alias("batchable"),
        F.count_if(F.col("calls") > 1).alias("batches"),
        F.min("start").alias("first_ts"),
        F.max("end").alias("last_ts"),
    )
    mean_size = F.col("batchable") / F.col("batches")
    single = F.col("batchable") * F.col("avg_cost")
    batched = F.col("batches") * (F.col("avg_cost") * mean_size * (1 - BATCH_SAVING))
    days = F.floor((F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 86400e6) + 1
    found = F.col("batches") > 0
    return ops.where("n >= 5").select(
        "operation",
        "n",
        "avg_cost",
        "batchable",
        "batches",
        F.when(found, (single - batched) / days * 30).otherwise(0.0).alias("potential_savings"),
        F.when(found, F.least(F.lit(10), F.floor(mean_size * 1.5))).otherwise(0).cast("bigint").alias("suggested_batch_size"),
    )


def batching_suggestions(log: DataFrame, gap: float = 5.0, embedding_batch: int = 32, calls: DataFrame | None = None) -> DataFrame:
    """Suggestions from bursts worth at least 5.0 a month, and the embedding batch size."""
    rows = (
        batchable_calls(calls if calls is not None else log, gap)
        .where("potential_savings >= 5.0")
        .select(
            *_suggestion(
                F.format_string("%s_batch_processing", "operation"),
                F.lit(1),
                F.col("suggested_batch_size"),
                F.col("potential_savings"),
                "medium",
                F.format_string("Batch %s operations in a single API call", "operation"),
            )
        )
    )
    return rows.unionByName(_embedding_batch(log, embedding_batch, 10.0, None))


def cost_optimisations(
    log: DataFrame,
    llm: str = "llm",
    model: str = "current model",
    cheaper_model: str = "cheaper model",
    gap: float = 5.0,
    embedding_batch: int = 32,
) -> DataFrame:
    """All saving suggestions for the calls of the ``llm`` service."""
    calls = log.where(F.col("service") == llm)
    prompts = (
        prompt_efficiency(calls)
        .where("optimization_potential > 5.0")
        .select(
            *_suggestion(
                F.lit("prompt_optimization"),
                F.concat(F.bround("avg_input_tokens").cast("bigint").cast("string"), F.lit(" tokens")),
                F.concat(F.floor(F.col("avg_input_tokens") * 0.8).cast("string"), F.lit(" tokens")),
                F.col("optimization_potential"),
                "low",
                F.format_string("Optimize prompts for %s to reduce token usage", "category"),
            )
        )
    )
    caching = (
        caching_summary(caching_opportunities(calls))
        .where("potential_savings > 5.0")
        .select(
            *_suggestion(
                F.lit("implement_caching"),
                F.lit("disabled"),
                F.lit("enabled"),
                F.col("potential_savings"),
                "low",
                F.lit("Implement result caching for common queries"),
            )
        )
    )
    downgrade = (
        calls.agg(F.sum("cost").alias("cost"))
        .where("cost > 50.0")
        .select(
            *_suggestion(
                F.lit("model_downgrade"),
                F.lit(model),
                F.lit(cheaper_model),
                F.col("cost") * DOWNGRADE_SAVING,
                "medium",
                F.lit("Consider a cheaper model for non-critical analyses"),
            )
        )
    )
    out = batching_suggestions(log, gap, embedding_batch, calls)
    for part in (prompts, caching, downgrade):
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------------- time series


def daily_costs(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost").alias("cost"))


def cost_series(log: DataFrame, end: str, days: int, by: list[str] | None = None) -> DataFrame:
    """Cost of every day of ``end - days .. end`` (``days + 1`` rows), zero where nothing was logged.

    With ``by`` the series is per group that occurs in the log.
    """
    by = by or []
    last = F.to_date(F.lit(end))
    first, after = (F.date_add(last, d).cast("timestamp") for d in (-days, 1))
    logged = log.where((F.col("ts") >= first) & (F.col("ts") < after))
    costs = logged.groupBy(*by, F.to_date("ts").alias("day")).agg(F.sum("cost").alias("cost"))
    keys = log.select(*by).distinct() if by else log.sparkSession.range(1).select()
    calendar = keys.select(*by, F.explode(F.sequence(F.date_sub(last, days), last)).alias("day"))
    return calendar.join(costs, [*by, "day"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def weekly_costs(series: DataFrame) -> DataFrame:
    """Seven-day chunks counted from the first day of a series."""
    start = with_totals(series, series.agg(F.min("day").alias("_first")))
    week = F.floor(F.datediff("day", "_first") / 7)
    return (
        start.groupBy(week.alias("_w"))
        .agg(F.min("day").alias("week_starting"), F.avg("cost").alias("avg_cost"), F.sum("cost").alias("total_cost"))
        .drop("_w")
    )


def monthly_costs(series: DataFrame) -> DataFrame:
    return series.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.avg("cost").alias("avg_cost"), F.sum("cost").alias("total_cost")
    )


def trend_class(n: Column, first: Column, last: Column, mean: Column) -> Column:
    """Class of a series by its mean step relative to its mean, in percent.

    The mean of consecutive differences is (last - first) / (n - 1).
    """
    rel = F.when(mean > 0, (last - first) / (n - 1) / mean * 100).otherwise(0.0)
    return cases(
        [
            (n < 3, "insufficient_data"),
            (rel > 5, "sharply_increasing"),
            (rel > 2, "increasing"),
            (rel < -5, "sharply_decreasing"),
            (rel < -2, "decreasing"),
        ],
        "stable",
    )


def trend_a(series: DataFrame, order: str = "day", value: str = "cost", by: list[str] | None = None) -> DataFrame:
    return series.groupBy(*(by or [])).agg(
        trend_class(F.count("*"), F.min_by(value, order), F.max_by(value, order), F.avg(value)).alias("trend")
    )


def growth(monthly: DataFrame, order: str = "month", value: str = "total_cost") -> DataFrame:
    """Growth of each month over the one before and its direction (one row per month)."""
    prev = F.lag(value).over(Window.orderBy(order))
    rate = F.when(prev > 0, (F.col(value) - prev) / prev).otherwise(0.0)
    return monthly.withColumn("growth_rate", F.coalesce(rate, F.lit(0.0))).withColumn(
        "trend_direction",
        cases([(F.col("growth_rate") > 0.1, "increasing"), (F.col("growth_rate") < -0.1, "decreasing")], "stable"),
    )


def cost_anomaly(daily: DataFrame) -> DataFrame:
    """Last day against mean and population deviation of the earlier ones; needs 7 days."""
    rows = with_totals(daily, daily.agg(F.max("day").alias("_last"), F.count("*").alias("points")))
    early = F.col("day") < F.col("_last")
    out = rows.groupBy("points").agg(
        F.avg(F.when(early, F.col("cost"))).alias("baseline_avg_cost"),
        F.stddev_pop(F.when(early, F.col("cost"))).alias("_std"),
        F.max(F.when(~early, F.col("cost"))).alias("latest_cost"),
    )
    z = F.when(F.col("_std") > 0, (F.col("latest_cost") - F.col("baseline_avg_cost")) / F.col("_std")).otherwise(0.0)
    base = F.col("baseline_avg_cost")
    return (
        out.where("points >= 7")
        .withColumn("z_score", z)
        .select(
            "baseline_avg_cost",
            "latest_cost",
            "z_score",
            (F.abs("z_score") > 2.0).alias("is_anomaly"),
            cases([(F.col("z_score") > 0, "high"), (F.col("z_score") < 0, "low")], "none").alias("anomaly_direction"),
            F.when(base > 0, (F.col("latest_cost") - base) / base * 100).otherwise(0.0).alias("percent_difference"),
        )
    )


def service_comparison(log: DataFrame, end: str, days: int = 30) -> DataFrame:
    """Per service: cost, share, whether it is the most expensive, trend over the last days."""
    costs = log.groupBy("service").agg(F.sum("cost").alias("cost"))
    totals = costs.agg(
        F.sum("cost").alias("total_cost"), F.max_by("service", F.struct("cost", "service")).alias("highest_cost_service")
    )
    trends = trend_a(cost_series(log, end, days, ["service"]), by=["service"])
    return (
        with_totals(costs, totals)
        .join(trends, "service")
        .withColumn("percentage", F.when(F.col("total_cost") > 0, F.col("cost") / F.col("total_cost") * 100).otherwise(0.0))
    )


def cost_ratio(log: DataFrame, a: str, b: str) -> DataFrame:
    """Cost of service ``a`` over that of ``b``; 0 when ``b`` costs nothing."""
    of = lambda s: F.coalesce(F.sum(F.when(F.col("service") == s, F.col("cost"))), F.lit(0.0))
    return log.agg(of(a).alias("a"), of(b).alias("b")).select(
        F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("cost_ratio")
    )


def usage_breakdown(log: DataFrame) -> DataFrame:
    """Cost and calls per service and operation, with the operation's rank by cost."""
    ops = log.groupBy("service", "operation").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))
    w = Window.partitionBy("service").orderBy(F.desc("cost"), "operation")
    return ops.withColumn("rank_in_service", F.row_number().over(w))


def top_operations(log: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most expensive operations overall."""
    ops = log.groupBy("operation").agg(F.sum("cost").alias("cost"))
    return ops.orderBy(F.desc("cost"), "operation").limit(k)


def usage_trends(log: DataFrame, end: str, weeks: int = 4) -> DataFrame:
    """Cost of the last weeks per service: first, last, change in percent, direction."""
    series = cost_series(log, end, weeks * 7 - 1, ["service"])
    week = F.floor(F.datediff(F.to_date(F.lit(end)), "day") / 7)
    w = series.groupBy("service", week.alias("back")).agg(F.sum("cost").alias("cost"))
    out = w.groupBy("service").agg(F.max_by("cost", "back").alias("first_week"), F.min_by("cost", "back").alias("last_week"))
    change = F.when(F.col("first_week") > 0, (F.col("last_week") - F.col("first_week")) / F.col("first_week") * 100).otherwise(0.0)
    return out.withColumn("percentage_change", change).withColumn(
        "trend_direction",
        cases([(F.col("percentage_change") > 10, "increasing"), (F.col("percentage_change") < -10, "decreasing")], "stable"),
    )


# --------------------------------------------------------------- budgets, forecast


def _period_costs(log: DataFrame, now: str) -> DataFrame:
    """One row: cost of the day and of the month up to ``now``, and of the last 8 days."""
    at = _at(now)
    up_to_now = log.where(F.col("ts") <= at)
    day, today = F.to_date("ts"), F.to_date(at)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cost"))), F.lit(0.0))
    return up_to_now.where((F.col("ts") >= F.date_trunc("month", at)) | (day >= F.date_sub(today, 7))).agg(
        part(day == today).alias("day_cost"),
        part(F.col("ts") >= F.date_trunc("month", at)).alias("month_cost"),
        part(day >= F.date_sub(today, 7)).alias("recent_cost"),
    )


def daily_summary(log: DataFrame, now: str, budget: float = DAILY_BUDGET) -> DataFrame:
    """Today against budget and the mean of the last 8 days, projected to the end of the day."""
    at = _at(now)
    hours = F.hour(at) + F.minute(at) / 60
    mean = F.col("recent_cost") / 8
    cost = F.col("day_cost")
    return _period_costs(log, now).select(
        F.date_format(at, "yyyy-MM-dd").alias("date"),
        cost.alias("current_cost"),
        mean.alias("average_daily_cost"),
        (cost / F.lit(budget) * 100 if budget > 0 else F.lit(0.0)).alias("budget_percentage"),
        F.when(hours > 0, cost * (24 / hours)).otherwise(cost).alias("projected_eod_cost"),
        F.when(cost > budget, "over_budget").otherwise("under_budget").alias("budget_status"),
        F.when(mean > 0, (cost - mean) / mean * 100).otherwise(0.0).alias("vs_average"),
    )


def monthly_projection(log: DataFrame, now: str, budget: float = MONTHLY_BUDGET) -> DataFrame:
    """Month to date plus the daily rate over the remaining days, with the 31-day trend."""
    at = _at(now)
    passed = F.dayofmonth(at)
    left = F.dayofmonth(F.last_day(at)) - passed
    cost = F.col("month_cost")
    total = cost + cost / passed * left
    trend = trend_a(cost_series(log.where(F.col("ts") <= at), now, 30))
    base = _period_costs(log, now).select(
        F.date_format(at, "yyyy-MM").alias("month"),
        passed.alias("days_passed"),
        left.alias("days_remaining"),
        cost.alias("mtd_cost"),
        total.alias("projected_month_total"),
        (total / F.lit(budget) * 100 if budget > 0 else F.lit(0.0)).alias("budget_percentage"),
        (cost / passed).alias("daily_rate"),
        (total > budget).alias("is_projected_over_budget"),
    )
    return with_totals(base, trend)


def budget_alerts(log: DataFrame, now: str, daily: float = DAILY_BUDGET, monthly: float = MONTHLY_BUDGET) -> DataFrame:
    """One row per budget and reached threshold, with the period it belongs to."""
    at = _at(now)
    kinds = F.array(
        F.struct(
            F.lit("daily_budget").alias("type"),
            F.date_format(at, "yyyy-MM-dd").alias("period"),
            F.lit("Daily").alias("name"),
            F.col("day_cost").alias("cost"),
            F.lit(daily).alias("budget"),
        ),
        F.struct(
            F.lit("monthly_budget").alias("type"),
            F.date_format(at, "yyyy-MM").alias("period"),
            F.lit("Monthly").alias("name"),
            F.col("month_cost").alias("cost"),
            F.lit(monthly).alias("budget"),
        ),
    )
    rows = _period_costs(log, now).select(F.explode(kinds).alias("b")).select("b.*")
    limits = F.explode(F.array(*[F.lit(t) for t in ALERT_THRESHOLDS]))
    usage = F.when(F.col("budget") > 0, F.col("cost") / F.col("budget")).otherwise(0.0)
    return (
        rows.withColumn("current_usage", usage)
        .withColumn("threshold", limits)
        .where(F.col("current_usage") >= F.col("threshold"))
        .select(
            "type",
            "period",
            "threshold",
            "current_usage",
            alert_severity("threshold").alias("severity"),
            F.format_string("%s budget %.1f%% reached: $%.2f of $%.2f", "name", F.col("threshold") * 100, "cost", "budget").alias(
                "message"
            ),
        )
    )


def new_alerts(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts not sent yet in their period; a new day or month starts over by itself."""
    return alerts.join(sent.select("type", "threshold", "period").distinct(), ["type", "threshold", "period"], "left_anti")


def budget_status(log: DataFrame, now: str, daily: float = DAILY_BUDGET, monthly: float = MONTHLY_BUDGET) -> DataFrame:
    """Day and month against their budgets and the days until the month's budget is used up."""
    at = _at(now)
    pct = lambda c, b: c / F.lit(b) * 100 if b > 0 else F.lit(0.0)
    state = lambda c, b: F.when(F.col(c) > b, "over_budget").otherwise("under_budget")
    month_pct = pct(F.col("month_cost"), monthly)
    elapsed = F.dayofmonth(at)
    left = F.dayofmonth(F.last_day(at)) - elapsed
    rest = (100 - month_pct) / (month_pct / elapsed)
    exhausted = F.when(month_pct >= 100, 0).when(month_pct <= 0, 30).otherwise(F.floor(F.least(rest, left)))
    return _period_costs(log, now).select(
        F.col("day_cost").alias("daily_current"),
        pct(F.col("day_cost"), daily).alias("daily_percentage"),
        state("day_cost", daily).alias("daily_status"),
        F.col("month_cost").alias("monthly_current"),
        month_pct.alias("monthly_percentage"),
        state("month_cost", monthly).alias("monthly_status"),
        exhausted.cast("bigint").alias("days_until_budget_exhausted"),
    )


def forecast(daily: DataFrame, growth_rate: float = 0.0) -> DataFrame:
    """Next week and month from the mean of the last 7 days and a monthly growth rate."""
    # the series has one row per day, and only its last seven rows are averaged
    last7 = daily.orderBy(F.desc("day")).limit(7).agg(F.avg("cost").alias("recent_avg"))
    sizes = daily.agg(F.count("*").alias("points"))
    g = F.when(F.col("points") >= 7, F.lit(float(growth_rate))).otherwise(0.0)
    return with_totals(sizes, last7).select(
        (F.col("recent_avg") * 7 * (1 + g / 4)).alias("next_week"),
        (F.col("recent_avg") * 30 * (1 + g)).alias("next_month"),
        F.when(F.col("points") >= 7, F.least(F.lit(0.9), F.col("points") / 30)).otherwise(0.5).alias("confidence"),
        F.lit(float(growth_rate)).alias("growth_rate"),
    )


def within_budget(df: DataFrame, budget: float, key: str = "key", cost: str = "cost") -> DataFrame:
    """Rows taken in key order until the budget is spent; adds ``spent_before``.

    The row that crosses the budget is still taken. Only key and cost are sorted.
    """
    taken = with_total_before(df.select(key, cost), [key], cost).where(F.col("spent_before") < budget)
    return df.join(taken.select(key, "spent_before"), key)


def efficiency_risk(suggestions: DataFrame, breakdown: DataFrame, monthly: float = MONTHLY_BUDGET) -> DataFrame:
    """Efficiency score and risk flags from suggestions and the service breakdown."""
    savings = suggestions.agg(F.coalesce(F.sum("potential_savings"), F.lit(0.0)).alias("potential_savings"))
    costs = breakdown.agg(
        F.sum("cost").alias("total"), F.max_by("service", F.struct("cost", "service")).alias("largest_cost_factor")
    )
    total = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total"))
    over = F.least(F.lit(100.0), total / F.lit(monthly) * 100) if monthly > 0 else F.lit(0.0)
    s = F.col("potential_savings")
    return with_totals(costs, savings).select(
        (100 * (1 - F.least(F.lit(0.5), s / total))).alias("efficiency_score"),
        "potential_savings",
        (total > monthly * 0.8).alias("high_cost_risk"),
        over.alias("budget_overrun_probability"),
        "largest_cost_factor",
        cases([(s > 50, "high"), (s > 20, "medium")], "low").alias("optimization_priority"),
    )
