"""Queries on the call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskloom.functions.text import op_category
from taskloom.operators import cost as C
from taskloom.plans.cost_report import cost_report as full_report
from taskloom.sources.driver_tables import cost_log

NOW = "2024-01-30 18:30:00"
END = "2024-01-30"
LLM, EMB = "click", "view"
DAY_BUDGET, MONTH_BUDGET = 20.0, 4000.0


def _r(df, *columns, n=4):
    for c in columns:
        df = df.withColumn(c, F.round(c, n))
    return df


def _day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def summary(spark, sf):
    out = C.cost_summary(cost_log(spark, sf)).select("service", "total_cost", "calls", "duration_seconds")
    return _r(out, "total_cost")


def breakdown(spark, sf):
    return _r(C.service_breakdown(cost_log(spark, sf), LLM, EMB), "cost")


def category(spark, sf):
    return _r(C.cost_per_category(cost_log(spark, sf)), "cost")


def op_categories(spark, sf):
    return cost_log(spark, sf).select("operation", op_category().alias("category")).distinct()


def call_costs(spark, sf):
    return cost_log(spark, sf).select("call_id", F.round(C.call_cost(), 9).alias("call_cost"))


def severities(spark, sf):
    return cost_log(spark, sf).select("call_id", C.alert_severity(F.col("cost")).alias("severity"))


def efficiency(spark, sf):
    out = C.efficiency(cost_log(spark, sf))
    return _r(out, "avg_cost_per_call", "cost_per_token", "token_efficiency_score", "highest_cost_value")


def prompt_efficiency(spark, sf):
    out = C.prompt_efficiency(cost_log(spark, sf))
    return _r(
        out, "avg_input_tokens", "avg_output_tokens", "avg_cost", "optimization_potential", "overall_efficiency_score"
    )


def batch_opportunities(spark, sf):
    return _r(C.batch_opportunities(cost_log(spark, sf), EMB), "potential_savings")


def caching(spark, sf):
    return _r(C.caching_opportunities(cost_log(spark, sf)), "potential_savings")


def caching_summary(spark, sf):
    return _r(C.caching_summary(C.caching_opportunities(cost_log(spark, sf))), "potential_savings")


def bursts(spark, sf):
    out = C.bursts(cost_log(spark, sf), 60.0)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return _r(out.select("operation", fmt("start"), fmt("end"), "calls", "cost"), "cost")


def batchable(spark, sf):
    return _r(C.batchable_calls(cost_log(spark, sf), 60.0), "avg_cost", "potential_savings")


def optimisations(spark, sf):
    return _r(C.cost_optimisations(cost_log(spark, sf), LLM, gap=60.0), "potential_savings")


def series(spark, sf):
    return _r(C.cost_series(cost_log(spark, sf), END, 40), "cost").select(_day("day"), "cost")


def weekly(spark, sf):
    w = C.weekly_costs(C.cost_series(cost_log(spark, sf), END, 40))
    return _r(w, "avg_cost", "total_cost").select(_day("week_starting"), "avg_cost", "total_cost")


def monthly(spark, sf):
    return _r(C.monthly_costs(C.cost_series(cost_log(spark, sf), END, 40)), "avg_cost", "total_cost")


def trends(spark, sf):
    return C.trend_a(C.cost_series(cost_log(spark, sf), END, 10, ["service"]), by=["service"])


def growth(spark, sf):
    m = C.monthly_costs(C.cost_series(cost_log(spark, sf), END, 40))
    return _r(C.growth(m), "growth_rate").select("month", "growth_rate", "trend_direction")


def anomaly(spark, sf):
    out = C.cost_anomaly(C.cost_series(cost_log(spark, sf), END, 29))
    return _r(out, "baseline_avg_cost", "latest_cost", "z_score", "percent_difference")


def comparison(spark, sf):
    return _r(C.service_comparison(cost_log(spark, sf), END), "cost", "total_cost", "percentage")


def ratio(spark, sf):
    return _r(C.cost_ratio(cost_log(spark, sf), LLM, EMB), "cost_ratio")


def usage(spark, sf):
    out = _r(C.usage_breakdown(cost_log(spark, sf)), "cost")
    return out.withColumn("rank_in_service", F.col("rank_in_service").cast("bigint"))


def usage_trends(spark, sf):
    return _r(C.usage_trends(cost_log(spark, sf), END), "first_week", "last_week", "percentage_change")


def top_operations(spark, sf):
    return _r(C.top_operations(cost_log(spark, sf), 3), "cost")


def daily_summary(spark, sf):
    out = C.daily_summary(cost_log(spark, sf), NOW, DAY_BUDGET)
    return _r(out, "current_cost", "average_daily_cost", "budget_percentage", "projected_eod_cost", "vs_average")


def projection(spark, sf):
    out = C.monthly_projection(cost_log(spark, sf), NOW, MONTH_BUDGET)
    out = _r(out, "mtd_cost", "projected_month_total", "budget_percentage", "daily_rate")
    return out.withColumn("days_passed", F.col("days_passed").cast("bigint")).withColumn(
        "days_remaining", F.col("days_remaining").cast("bigint")
    )


def budget_status(spark, sf):
    out = C.budget_status(cost_log(spark, sf), NOW, DAY_BUDGET, MONTH_BUDGET)
    return _r(out, "daily_current", "daily_percentage", "monthly_current", "monthly_percentage")


def alerts(spark, sf):
    return _r(C.budget_alerts(cost_log(spark, sf), NOW, DAY_BUDGET, MONTH_BUDGET), "current_usage")


def new_alerts(spark, sf):
    """Alerts that were not yet sent ten days before."""
    log = cost_log(spark, sf)
    sent = C.budget_alerts(log, "2024-01-20 12:00:00", DAY_BUDGET, MONTH_BUDGET)
    return C.new_alerts(C.budget_alerts(log, NOW, DAY_BUDGET, MONTH_BUDGET), sent).select("type", "threshold", "period")


def forecast(spark, sf):
    return _r(C.forecast(C.cost_series(cost_log(spark, sf), END, 29), 0.2), "next_week", "next_month", "confidence")


def risk(spark, sf):
    log = cost_log(spark, sf)
    s = C.batch_opportunities(log, EMB)
    out = C.efficiency_risk(s, C.service_breakdown(log, LLM, EMB), MONTH_BUDGET)
    return _r(out, "efficiency_score", "potential_savings", "budget_overrun_probability")


def report(spark, sf):
    out = full_report(cost_log(spark, sf), "month", NOW, LLM, EMB, MONTH_BUDGET, gap=60.0)
    return _r(out, "value", n=4)


QUERIES = {
    "A35_cost_summary": summary,
    "A36_service_breakdown": breakdown,
    "A37_cost_per_category": category,
    "P36_op_category": op_categories,
    "P34_call_cost": call_costs,
    "P35_alert_severity": severities,
    "A38_efficiency": efficiency,
    "A39_prompt_efficiency": prompt_efficiency,
    "A40_batch_opportunities": batch_opportunities,
    "A41_caching_opportunities": caching,
    "A41_caching_summary": caching_summary,
    "W06_bursts": bursts,
    "A42_batchable_calls": batchable,
    "A43_cost_optimisations": optimisations,
    "A44_daily_series": series,
    "A44_weekly_costs": weekly,
    "A44_monthly_costs": monthly,
    "W08_trends": trends,
    "W07_growth": growth,
    "A45_cost_anomaly": anomaly,
    "A46_service_comparison": comparison,
    "A46_cost_ratio": ratio,
    "A47_usage_breakdown": usage,
    "A47_usage_trends": usage_trends,
    "L03_top_operations": top_operations,
    "A48_daily_summary": daily_summary,
    "A49_monthly_projection": projection,
    "A50_budget_status": budget_status,
    "A50_budget_alerts": alerts,
    "W10_new_alerts": new_alerts,
    "A51_forecast": forecast,
    "A52_efficiency_risk": risk,
    "A53_cost_report": report,
}

LOG = """log AS (
  SELECT event_id AS call_id, event_type AS service, event_type || '.' || (user_id % 5) AS operation, ts,
    (props->>'k')::BIGINT AS i, (props->>'k')::BIGINT // 2 AS o, value / 100 AS cost FROM events)"""


def _series(days, by=""):
    groups = f"(SELECT DISTINCT {by} FROM log)" if by else "(SELECT 1)"
    on = f"AND l.{by} = g.{by}" if by else ""
    col = f"g.{by}, " if by else ""
    return f"""series AS (
  SELECT {col}d.day, coalesce(sum(l.cost), 0) AS cost
  FROM (SELECT (DATE '{END}' - n::INT)::DATE AS day FROM range({days} + 1) t(n)) d CROSS JOIN {groups} g
  LEFT JOIN log l ON l.ts::DATE = d.day {on} GROUP BY {col.replace(', ', '') + ', ' if col else ''}d.day)"""


def _trend(n, first, last, mean):
    rel = f"(CASE WHEN {mean} > 0 THEN ({last} - {first}) / ({n} - 1) / {mean} * 100 ELSE 0 END)"
    return f"""CASE WHEN {n} < 3 THEN 'insufficient_data' WHEN {rel} > 5 THEN 'sharply_increasing'
    WHEN {rel} > 2 THEN 'increasing' WHEN {rel} < -5 THEN 'sharply_decreasing' WHEN {rel} < -2 THEN 'decreasing'
    ELSE 'stable' END"""


TREND = _trend("count(*)", "arg_min(cost, day)", "arg_max(cost, day)", "avg(cost)")

RUNS = """marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 60000000 THEN 0 ELSE 1 END AS fresh FROM log
  WINDOW w AS (PARTITION BY operation ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY operation ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT operation, run, min(ts) AS s, max(ts) AS e, count(*) AS calls, sum(cost) AS cost FROM numbered
  GROUP BY 1, 2)"""
BATCHABLE = f"""{RUNS},
ops AS (
  SELECT operation, sum(calls)::BIGINT AS n, sum(cost) / sum(calls) AS avg_cost,
    coalesce(sum(calls) FILTER (calls > 1), 0)::BIGINT AS batchable, count(*) FILTER (calls > 1) AS batches,
    floor((epoch_us(max(e)) - epoch_us(min(s))) / 86400e6) + 1 AS days FROM runs GROUP BY 1 HAVING sum(calls) >= 5),
saved AS (
  SELECT *, CASE WHEN batches > 0 THEN (batchable * avg_cost - batches * (avg_cost * (batchable / batches) * 0.7)) / days * 30
    ELSE 0 END AS saving,
    CASE WHEN batches > 0 THEN least(10, floor(batchable / batches * 1.5)) ELSE 0 END::BIGINT AS size FROM ops)"""

PROMPTS = """cats AS (
  SELECT split_part(operation, '.', 1) AS category, count(*) AS total_calls, avg(i) AS ai, avg(o) AS ao, avg(cost) AS ac
  FROM log GROUP BY 1),
prom AS (
  SELECT c.category, any_value(total_calls) AS total_calls, any_value(ai) AS ai, any_value(ao) AS ao, any_value(ac) AS ac,
    count(*) FILTER (l.cost > ac * 1.5) AS expensive,
    coalesce(sum(l.cost * 0.2) FILTER (l.cost > ac * 1.5), 0) * 30 AS potential
  FROM cats c JOIN log l ON split_part(l.operation, '.', 1) = c.category GROUP BY 1)"""

PERIOD = f"""period AS (
  SELECT coalesce(sum(cost) FILTER (ts::DATE = DATE '{END}'), 0) AS day_cost,
    coalesce(sum(cost) FILTER (ts >= DATE '2024-01-01'), 0) AS month_cost,
    coalesce(sum(cost) FILTER (ts::DATE >= DATE '{END}' - 7), 0) AS recent_cost
  FROM log WHERE ts <= TIMESTAMP '{NOW}')"""


def _alerts(now, name, day=END):
    return f"""{name}_p AS (
  SELECT 'daily_budget' AS type, '{day}' AS period, 'Daily' AS name, 20.0 AS budget,
    coalesce(sum(cost) FILTER (ts::DATE = DATE '{day}'), 0) AS cost FROM log WHERE ts <= TIMESTAMP '{now}'
  UNION ALL SELECT 'monthly_budget', '2024-01', 'Monthly', 4000.0, coalesce(sum(cost), 0) FROM log
    WHERE ts <= TIMESTAMP '{now}' AND ts >= DATE '2024-01-01'),
{name} AS (
  SELECT type, period, threshold, cost / budget AS current_usage,
    CASE WHEN threshold >= 1.0 THEN 'critical' WHEN threshold >= 0.9 THEN 'high' WHEN threshold >= 0.75 THEN 'medium'
      ELSE 'low' END AS severity,
    printf('%s budget %.1f%% reached: $%.2f of $%.2f', name, (threshold * 100)::DOUBLE, cost, budget::DOUBLE) AS message
  FROM {name}_p, (SELECT unnest([0.5::DOUBLE, 0.75, 0.9, 1.0]) AS threshold) WHERE cost / budget >= threshold)"""


BATCH_OPP = """opp AS (
  SELECT operation || '_batch_optimization' AS type, '1' AS current_value, least(10, n)::VARCHAR AS suggested_value,
    saving AS potential_savings, 'low' AS risk_level, 'Batch ' || operation || ' operations for cost savings' AS description
  FROM (SELECT operation, count(*) AS n, (sum(cost) - sum(cost) * 0.7) / count(DISTINCT ts::DATE) * 30 AS saving
        FROM log GROUP BY 1) WHERE n >= 3 AND saving >= 1.0
  UNION ALL SELECT 'embedding_batch_increase', '32', '64', 5.0, 'low',
    'Increase embedding batch size for better throughput')"""


def _cache(log="log"):
    return f"""cache AS (
  SELECT operation, count(*) AS calls, CASE WHEN count(*) > 1 THEN floor(count(*) * 0.1) ELSE 0 END::BIGINT AS dup,
    avg(cost) AS ac FROM {log} GROUP BY 1),
cache_sum AS (
  SELECT sum(dup)::BIGINT AS duplicate_call_count, sum(dup * ac * (30 / 7)) AS s, count(*) FILTER (calls > 5) AS k FROM cache)"""


BREAK = """brk AS (
  SELECT 'llm_api' AS service, coalesce(sum(cost) FILTER (service = 'click'), 0) AS cost FROM log
  UNION ALL SELECT 'embedding_processing', coalesce(sum(cost) FILTER (service = 'view'), 0) FROM log
  UNION ALL SELECT 'vector_storage', coalesce(sum(cost) FILTER (service = 'view'), 0) * 0.1 FROM log
  UNION ALL SELECT 'tracker_api', 0.0)"""
OPT = f"""{PROMPTS}, {BATCHABLE}, {_cache()},
opt AS (
  SELECT operation || '_batch_processing' AS type, '1' AS current_value, size::VARCHAR AS suggested_value,
    saving AS potential_savings, 'medium' AS risk_level, 'Batch ' || operation || ' operations in a single API call' AS description
  FROM saved WHERE saving >= 5.0
  UNION ALL SELECT 'embedding_batch_increase', '32', '64', 10.0, 'low', 'Increase embedding batch size for better throughput'
  UNION ALL SELECT 'prompt_optimization', round_even(ai, 0)::BIGINT || ' tokens', floor(ai * 0.8)::BIGINT || ' tokens',
    potential, 'low', 'Optimize prompts for ' || category || ' to reduce token usage' FROM prom WHERE potential > 5.0
  UNION ALL SELECT 'implement_caching', 'disabled', 'enabled', s, 'low', 'Implement result caching for common queries'
    FROM cache_sum WHERE s > 5.0
  UNION ALL SELECT 'model_downgrade', 'current model', 'cheaper model', c * 0.4, 'medium',
    'Consider a cheaper model for non-critical analyses' FROM (SELECT sum(cost) AS c FROM log) WHERE c > 50)"""
CLICK_LOG = LOG.replace("FROM events)", "FROM events WHERE event_type = 'click')")

ORACLES = {
    "A35_cost_summary": f"""WITH {LOG} SELECT coalesce(service, 'all') AS service, round(sum(cost), 4) AS total_cost,
        count(*) AS calls, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS duration_seconds FROM log
        GROUP BY ROLLUP (service)""",
    "A36_service_breakdown": f"WITH {LOG}, {BREAK} SELECT service, round(cost, 4) AS cost FROM brk",
    "A37_cost_per_category": f"""WITH {LOG} SELECT split_part(operation, '.', 1) AS category,
        round(sum(cost), 4) AS cost FROM log GROUP BY 1""",
    "P36_op_category": f"WITH {LOG} SELECT DISTINCT operation, service AS category FROM log",
    "P34_call_cost": f"WITH {LOG} SELECT call_id, round(i * 0.000003 + o * 0.000015, 9)::DOUBLE AS call_cost FROM log",
    "P35_alert_severity": f"""WITH {LOG} SELECT call_id, CASE WHEN cost >= 1.0 THEN 'critical' WHEN cost >= 0.9 THEN 'high'
        WHEN cost >= 0.75 THEN 'medium' ELSE 'low' END AS severity FROM log""",
    "A38_efficiency": f"""WITH {LOG}, ops AS (SELECT operation, sum(cost) AS c FROM log GROUP BY 1)
        SELECT round(avg(cost), 4) AS avg_cost_per_call, round(sum(cost) / (sum(i) + sum(o)), 4) AS cost_per_token,
          round(sum(o) / (sum(i) + 1), 4) AS token_efficiency_score,
          (SELECT operation FROM ops ORDER BY c DESC LIMIT 1) AS highest_cost_operation,
          (SELECT round(max(c), 4) FROM ops) AS highest_cost_value FROM log""",
    "A39_prompt_efficiency": f"""WITH {LOG}, {PROMPTS} SELECT category, total_calls, round(ai, 4) AS avg_input_tokens,
        round(ao, 4) AS avg_output_tokens, round(ac, 4) AS avg_cost, expensive AS expensive_calls,
        round(potential, 4) AS optimization_potential,
        round(1 - sum(expensive) OVER () / sum(total_calls) OVER (), 4) AS overall_efficiency_score FROM prom""",
    "A40_batch_opportunities": f"""WITH {LOG}, {BATCH_OPP}
        SELECT * REPLACE (round(potential_savings, 4) AS potential_savings) FROM opp""",
    "A41_caching_opportunities": f"""WITH {LOG}, {_cache()} SELECT operation, calls, dup AS duplicate_calls,
        round(dup * ac * (30 / 7), 4) AS potential_savings, calls > 5 AS cacheable FROM cache""",
    "A41_caching_summary": f"""WITH {LOG}, {_cache()} SELECT duplicate_call_count, round(s, 4) AS potential_savings,
        k AS cacheable_operations, CASE WHEN s > 5 THEN 'Implement results caching'
          ELSE 'No significant caching opportunity' END AS recommendation FROM cache_sum""",
    "W06_bursts": f"""WITH {LOG}, {RUNS} SELECT operation, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start,
        strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS "end", calls, round(cost, 4) AS cost FROM runs""",
    "A42_batchable_calls": f"""WITH {LOG}, {BATCHABLE} SELECT operation, n, round(avg_cost, 4) AS avg_cost, batchable, batches,
        round(saving, 4) AS potential_savings, size AS suggested_batch_size FROM saved""",
    "A43_cost_optimisations": f"""WITH {CLICK_LOG}, {OPT}
        SELECT * REPLACE (round(potential_savings, 4) AS potential_savings) FROM opt""",
    "A44_daily_series": f"""WITH {LOG}, {_series(40)} SELECT strftime(day, '%Y-%m-%d') AS day, round(cost, 4) AS cost
        FROM series""",
    "A44_weekly_costs": f"""WITH {LOG}, {_series(40)} SELECT strftime(min(day), '%Y-%m-%d') AS week_starting,
        round(avg(cost), 4) AS avg_cost, round(sum(cost), 4) AS total_cost FROM series
        GROUP BY (day - (DATE '{END}' - 40)) // 7""",
    "A44_monthly_costs": f"""WITH {LOG}, {_series(40)} SELECT strftime(day, '%Y-%m') AS month,
        round(avg(cost), 4) AS avg_cost, round(sum(cost), 4) AS total_cost FROM series GROUP BY 1""",
    "W08_trends": f"WITH {LOG}, {_series(10, 'service')} SELECT service, {TREND} AS trend FROM series GROUP BY 1",
    "W07_growth": f"""WITH {LOG}, {_series(40)}, m AS (SELECT strftime(day, '%Y-%m') AS month, sum(cost) AS c FROM series
          GROUP BY 1), g AS (SELECT month, coalesce(CASE WHEN lag(c) OVER (ORDER BY month) > 0
            THEN c / lag(c) OVER (ORDER BY month) - 1 ELSE 0 END, 0) AS r FROM m)
        SELECT month, round(r, 4) AS growth_rate, CASE WHEN r > 0.1 THEN 'increasing' WHEN r < -0.1 THEN 'decreasing'
          ELSE 'stable' END AS trend_direction FROM g""",
    "A45_cost_anomaly": f"""WITH {LOG}, {_series(29)}, b AS (
          SELECT avg(cost) FILTER (day < DATE '{END}') AS m, stddev_pop(cost) FILTER (day < DATE '{END}') AS sd,
            max(cost) FILTER (day = DATE '{END}') AS latest FROM series)
        SELECT round(m, 4) AS baseline_avg_cost, round(latest, 4) AS latest_cost, round((latest - m) / sd, 4) AS z_score,
          abs((latest - m) / sd) > 2 AS is_anomaly,
          CASE WHEN latest > m THEN 'high' WHEN latest < m THEN 'low' ELSE 'none' END AS anomaly_direction,
          round((latest - m) / m * 100, 4) AS percent_difference FROM b""",
    "A46_service_comparison": f"""WITH {LOG}, {_series(30, 'service')},
        t AS (SELECT service, {TREND} AS trend FROM series GROUP BY 1),
        c AS (SELECT service, sum(cost) AS c FROM log GROUP BY 1)
        SELECT service, round(c, 4) AS cost, round(sum(c) OVER (), 4) AS total_cost,
          (SELECT service FROM c ORDER BY c DESC LIMIT 1) AS highest_cost_service, trend,
          round(c / sum(c) OVER () * 100, 4) AS percentage FROM c JOIN t USING (service)""",
    "A46_cost_ratio": f"""WITH {LOG} SELECT round(sum(cost) FILTER (service = 'click') / sum(cost) FILTER (service = 'view'), 4)
        AS cost_ratio FROM log""",
    "A47_usage_breakdown": f"""WITH {LOG}, o AS (SELECT service, operation, sum(cost) AS c, count(*) AS calls FROM log
          GROUP BY 1, 2)
        SELECT service, operation, round(c, 4) AS cost, calls,
          row_number() OVER (PARTITION BY service ORDER BY c DESC, operation) AS rank_in_service FROM o""",
    "A47_usage_trends": f"""WITH {LOG}, w AS (SELECT service, sum(cost) FILTER (DATE '{END}' - ts::DATE BETWEEN 21 AND 27) AS f,
          sum(cost) FILTER (DATE '{END}' - ts::DATE BETWEEN 0 AND 6) AS l FROM log GROUP BY 1)
        SELECT service, round(f, 4) AS first_week, round(l, 4) AS last_week,
          round((l - f) / f * 100, 4) AS percentage_change, CASE WHEN (l - f) / f > 0.1 THEN 'increasing'
          WHEN (l - f) / f < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend_direction FROM w""",
    "L03_top_operations": f"""WITH {LOG} SELECT operation, round(sum(cost), 4) AS cost FROM log GROUP BY 1
        ORDER BY sum(cost) DESC, operation LIMIT 3""",
    "A48_daily_summary": f"""WITH {LOG}, {PERIOD} SELECT '{END}' AS date, round(day_cost, 4) AS current_cost,
        round(recent_cost / 8, 4) AS average_daily_cost, round(day_cost / 20 * 100, 4) AS budget_percentage,
        round(day_cost * (24 / 18.5), 4) AS projected_eod_cost,
        CASE WHEN day_cost > 20 THEN 'over_budget' ELSE 'under_budget' END AS budget_status,
        round((day_cost - recent_cost / 8) / (recent_cost / 8) * 100, 4) AS vs_average FROM period""",
    "A49_monthly_projection": f"""WITH {LOG.replace("FROM events)", f"FROM events WHERE ts <= TIMESTAMP '{NOW}')")}, {PERIOD},
        {_series(30)}
        SELECT '2024-01' AS month, 30 AS days_passed, 1 AS days_remaining, round(month_cost, 4) AS mtd_cost,
          round(month_cost + month_cost / 30, 4) AS projected_month_total,
          round((month_cost + month_cost / 30) / 4000 * 100, 4) AS budget_percentage, round(month_cost / 30, 4) AS daily_rate,
          month_cost + month_cost / 30 > 4000 AS is_projected_over_budget,
          (SELECT {TREND} FROM series) AS trend FROM period""",
    "A50_budget_status": f"""WITH {LOG}, {PERIOD} SELECT round(day_cost, 4) AS daily_current,
        round(day_cost / 20 * 100, 4) AS daily_percentage,
        CASE WHEN day_cost > 20 THEN 'over_budget' ELSE 'under_budget' END AS daily_status,
        round(month_cost, 4) AS monthly_current, round(month_cost / 4000 * 100, 4) AS monthly_percentage,
        CASE WHEN month_cost > 4000 THEN 'over_budget' ELSE 'under_budget' END AS monthly_status,
        CASE WHEN month_cost >= 4000 THEN 0 WHEN month_cost <= 0 THEN 30
          ELSE floor(least((100 - month_cost / 40) / (month_cost / 40 / 30), 1)) END::BIGINT AS days_until_budget_exhausted
        FROM period""",
    "A50_budget_alerts": f"""WITH {LOG}, {_alerts(NOW, 'al')}
        SELECT * REPLACE (round(current_usage, 4) AS current_usage) FROM al""",
    "W10_new_alerts": f"""WITH {LOG}, {_alerts(NOW, 'al')}, {_alerts('2024-01-20 12:00:00', 'noon', '2024-01-20')}
        SELECT type, threshold, period FROM al EXCEPT SELECT type, threshold, period FROM noon""",
    "A51_forecast": f"""WITH {LOG}, {_series(29)}, r AS (SELECT avg(cost) AS a FROM (
          SELECT cost FROM series ORDER BY day DESC LIMIT 7))
        SELECT round(a * 7 * (1 + 0.2 / 4), 4) AS next_week, round(a * 30 * 1.2, 4) AS next_month, 0.9::DOUBLE AS confidence,
          0.2::DOUBLE AS growth_rate FROM r""",
    "A52_efficiency_risk": f"""WITH {LOG}, {BREAK}, {BATCH_OPP}, s AS (SELECT sum(potential_savings) AS s FROM opp),
        t AS (SELECT sum(cost) AS t FROM brk)
        SELECT round(100 * (1 - least(0.5, s / t)), 4) AS efficiency_score, round(s, 4) AS potential_savings,
          t > 3200 AS high_cost_risk, round(least(100.0, t / 4000 * 100), 4)::DOUBLE AS budget_overrun_probability,
          (SELECT service FROM brk ORDER BY cost DESC LIMIT 1) AS largest_cost_factor,
          CASE WHEN s > 50 THEN 'high' WHEN s > 20 THEN 'medium' ELSE 'low' END AS optimization_priority FROM s, t""",
}

_SEEN = LOG.replace("FROM events)", f"FROM events WHERE ts <= TIMESTAMP '{NOW}')")
_ON_CLICK = OPT.replace("FROM log", "FROM clog").replace("JOIN log", "JOIN clog")
ORACLES["A53_cost_report"] = f"""WITH {_SEEN}, clog AS (SELECT * FROM log WHERE service = 'click'), {BREAK}, {_series(30)},
  {PERIOD}, {_ON_CLICK}, f AS (SELECT avg(cost) AS a FROM (SELECT cost FROM series ORDER BY day DESC LIMIT 7)),
  rows_ AS (
    SELECT 'service' AS section, service AS item, cost AS value FROM brk
    UNION ALL SELECT 'daily', strftime(day, '%Y-%m-%d'), cost FROM series
    UNION ALL SELECT 'category', split_part(operation, '.', 1), sum(cost) FROM clog GROUP BY 2
    UNION ALL SELECT 'saving', type, potential_savings FROM opt
    UNION ALL SELECT 'forecast', 'next_month', a * 30 FROM f
    UNION ALL SELECT 'forecast', 'next_week', a * 7 FROM f
    UNION ALL SELECT 'efficiency', 'score', 100 * (1 - least(0.5, (SELECT sum(potential_savings) FROM opt)
      / (SELECT sum(cost) FROM brk)))
    UNION ALL SELECT 'budget', 'monthly_percentage', month_cost / 4000 * 100 FROM period
    UNION ALL SELECT 'calls', 'analyzed', count(*) FROM log)
  SELECT section, item, round(value, 4) AS value FROM rows_"""
