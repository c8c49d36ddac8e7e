"""Continuous versions of the sync and cost operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from taskloom import schema
from taskloom.operators import cost, sync
from taskloom.sources import store


def stream_ingest(changes: DataFrame, root: str, checkpoint: str, now: str | None = None, **trigger) -> StreamingQuery:
    """Change feed of work items into the item and tracking tables below ``root``.

    Each micro-batch keeps the newest row per key, drops rows older than or equal in
    content to what is tracked, and upserts the rest into the buckets of their keys. There is no watermark, so nothing is
    dropped for being late; a replayed batch finds equal hashes and changes nothing.
    """
    items_path, tracked_path = f"{root}/items", f"{root}/tracked"

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tracked = store.load_state(spark, tracked_path, schema.TRACKED)
        newest = sync.newest(batch, "key", [F.desc("updated")])
        seen = tracked.select("key", F.col("last_updated").alias("_seen"))
        current = (
            newest.join(seen, "key", "left")
            .where(F.col("_seen").isNull() | (F.col("updated") >= F.col("_seen")))
            .drop("_seen")
        )
        changed = sync.changed_only(current, tracked).persist()
        try:
            if changed.isEmpty():
                return
            store.change_table(changed.drop("content_hash"), items_path, "key", sync.upsert, batch.schema)
            stamp = now or str(spark.sql("select current_timestamp()").first()[0])
            merge = lambda old, new: sync.upsert(old, new, "key", "last_processed")
            store.change_table(sync.tracking_rows(changed, stamp), tracked_path, "key", merge, schema.TRACKED)
        finally:
            changed.unpersist()

    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def stream_cost(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cost and calls per service in day windows."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "service")
        .agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))
        .select(F.to_date("w.start").alias("day"), "service", "cost", "calls")
    )


def stream_rolling(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean daily cost over sliding windows of seven days, one per day."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", "7 days", "1 day").alias("w"))
        .agg((F.sum("cost") / 7).alias("mean_daily_cost"))
        .select(F.to_date("w.end").alias("until"), "mean_daily_cost")
    )


def stream_bursts(log: DataFrame, gap: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Runs of calls of one operation with gaps up to ``gap``."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "operation")
        .agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"), F.min("ts").alias("start"), F.max("ts").alias("end"))
        .select("operation", "start", "end", "calls", "cost")
    )


def _spent(log: DataFrame, daily: float, monthly: float) -> DataFrame:
    """Each call once for its day and once for its month, with the budget and the end of the period."""

    def period(kind: str, fmt: str, unit: str, budget: float):
        return F.struct(
            F.lit(kind).alias("type"),
            F.date_format("ts", fmt).alias("period"),
            F.lit(float(budget)).alias("budget"),
            F.unix_millis(F.date_trunc(unit, "ts") + F.expr(f"INTERVAL 1 {unit}")).alias("until"),
        )

    both = F.array(period("daily_budget", "yyyy-MM-dd", "DAY", daily), period("monthly_budget", "yyyy-MM", "MONTH", monthly))
    return log.select(F.explode(both).alias("p"), "ts", "cost").select("p.*", "ts", F.coalesce("cost", F.lit(0.0)).alias("cost"))


class BudgetAlerts(StatefulProcessor):
    """The cost of a period so far and how many of its thresholds are announced.

    A timer at the end of the period drops both once the watermark is past it; rows that come
    later are behind the watermark and are not seen.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "cost double, announced int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.spent.exists()
        total, announced = self.spent.get() if known else (0.0, 0)
        budget = until = None
        for part in rows:
            total += float(part["cost"].sum())
            budget, until = float(part["budget"].iloc[0]), int(part["until"].iloc[0])
        if not known:
            self.handle.registerTimer(until)
        usage = total / budget
        reached = [t for t in cost.ALERT_THRESHOLDS if usage >= t]
        self.spent.update((total, len(reached)))
        fresh = reached[announced:]
        if fresh:
            kind, period = key
            yield pd.DataFrame({"type": kind, "period": period, "threshold": fresh, "usage": usage})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        return iter(())

    def close(self) -> None:
        pass


def alerts(log: DataFrame, daily: float = cost.DAILY_BUDGET, monthly: float = cost.MONTHLY_BUDGET, delay: str = "1 day") -> DataFrame:
    """Budget alerts, each threshold once per day or month, as an append-mode stream.

    ``log`` has ``ts`` and ``cost``. The state is one row per open period, kept by Spark with the stream's
    checkpoint, so a replayed batch starts from the state before it. ``usage`` is the share
    of the budget when the threshold was passed. Needs the RocksDB state store (``keyed_state``).
    """
    spent = _spent(log.withWatermark("ts", delay), daily, monthly)
    found = spent.groupBy("type", "period").transformWithStateInPandas(
        BudgetAlerts(), "type string, period string, threshold double, usage double", "Append", "EventTime"
    )
    return found.withColumn("severity", cost.alert_severity("threshold"))


def keyed_state(spark: SparkSession) -> None:
    """Use the state store that keyed state needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the finished rows of a stream to a Parquet table; each batch is committed once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
