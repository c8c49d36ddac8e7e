"""Streams against their batch counterparts, late and repeated input included."""

import datetime as dt

from pyspark.sql import functions as F

from taskloom import schema
from taskloom.operators import sync
from taskloom.sources import store
from taskloom.streaming import jobs

ITEM = "key string, summary string, description string, issue_type string, status string, parent_key string, epic_key string, updated timestamp"


def _item(key, text, day):
    return (key, text, text, "Task", "Open", None, None, dt.datetime(2024, 1, day))


def test_ingest_ignores_old_and_repeated_rows(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "store")

    def push(rows):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(spark.createDataFrame([], ITEM).schema).parquet(feed)
        jobs.stream_ingest(stream, root, str(tmp_path / "cp"), "2024-02-01 00:00:00", availableNow=True).awaitTermination()
        return {r.key: r.summary for r in store.load_table(spark, f"{root}/items").collect()}

    assert push([_item("a", "one", 2), _item("a", "zero", 1), _item("b", "x", 1)]) == {"a": "one", "b": "x"}
    assert push([_item("a", "late", 1), _item("b", "x", 1), _item("c", "new", 3)]) == {"a": "one", "b": "x", "c": "new"}
    assert push([_item("a", "two", 4)])["a"] == "two"
    assert store.load_state(spark, f"{root}/tracked", schema.TRACKED).count() == 3


def _alerts(spark, tmp_path):
    """A function that appends calls (day, cost) and returns the daily alerts so far, and the last run."""
    log, out = str(tmp_path / "log"), str(tmp_path / "alerts")
    kind = "ts timestamp, cost double"
    jobs.keyed_state(spark)

    def push(*calls):
        if calls:
            rows = [(dt.datetime(2024, 1, day, 10, i), c) for i, (day, c) in enumerate(calls)]
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(log)
        stream = jobs.alerts(spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(log), 10.0, 1000.0)
        run = jobs.append_to(stream, out, str(tmp_path / "cp"), availableNow=True)
        run.awaitTermination()
        rows = spark.read.schema(stream.schema).parquet(out).where("type = 'daily_budget'").collect()
        return sorted((int(r.period[-2:]), r.threshold, round(r.usage, 6), r.severity) for r in rows), run

    return push


def test_alerts_are_sent_once(spark, tmp_path):
    push = _alerts(spark, tmp_path)
    first = [(5, 0.5, 0.6, "low")]
    assert push((5, 6.0))[0] == first
    assert push((5, 0.5))[0] == first
    # a run without new calls, as after a restart, announces nothing again
    assert push()[0] == first
    rest = [(5, t, 1.05, s) for t, s in ((0.75, "medium"), (0.9, "high"), (1.0, "critical"))]
    assert push((5, 2.0), (5, 2.0))[0] == first + rest


def test_alert_state_ends_with_the_period(spark, tmp_path):
    """Once the watermark is past a day its state goes, and its late calls are not counted."""
    push = _alerts(spark, tmp_path)
    push((2, 4.0), (3, 4.0))
    found, run = push((9, 6.0))
    assert found == [(9, 0.5, 0.6, "low")]
    # two days are over; the ninth and the month are open
    assert [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress][-1] <= 4
    assert push((2, 9.0))[0] == found


def test_windows_drop_rows_behind_the_watermark(spark, tmp_path):
    log = str(tmp_path / "log")
    kind = "service string, ts timestamp, cost double"
    schema_ = spark.createDataFrame([], kind).schema

    def push(rows):
        spark.createDataFrame([("s", dt.datetime(2024, 1, d), c) for d, c in rows], kind).coalesce(1).write.mode("append").parquet(log)
        stream = jobs.stream_cost(spark.readStream.schema(schema_).parquet(log))
        q = (
            stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        q.awaitTermination()

    push([(1, 1.0), (2, 2.0)])
    push([(1, 0.5), (9, 1.0)])  # not yet late
    push([(1, 9.0), (20, 1.0)])  # behind the watermark
    got = {r.day.day: r.cost for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == 1.5 and got[2] == 2.0 and got[9] == 1.0 and 20 not in got


def test_session_gap_is_inclusive(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("op", t0 + dt.timedelta(seconds=s), 1.0) for s in (0, 5, 11)]
    df = spark.createDataFrame(rows, "operation string, ts timestamp, cost double")
    assert sorted(r.calls for r in jobs.stream_bursts(df).collect()) == [1, 2]
    assert jobs.stream_rolling(df.withColumn("cost", F.lit(7.0))).where("mean_daily_cost = 3.0").count() == 7


def test_state_falls_behind_the_watermark(spark, tmp_path):
    """Windows are appended once when they close, and their state is dropped."""
    log = str(tmp_path / "log")
    kind = "service string, ts timestamp, cost double"

    def push(days):
        rows = [("s", dt.datetime(2024, 1, d), 1.0) for d in days]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(log)
        stream = jobs.stream_cost(spark.readStream.schema(spark.createDataFrame([], kind).schema).parquet(log))
        run = jobs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
        run.awaitTermination()
        return run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    assert push(range(1, 11)) <= 2 and push(range(11, 29)) <= 2
    got = [r.day.day for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == list(range(1, 27))


def test_changes_rewrite_their_buckets_only(spark, tmp_path):
    """A small second batch leaves the files of all other buckets as they are."""
    path = str(tmp_path / "table")
    rows = [_item(f"k{i}", "one", 1) for i in range(200)]
    items = spark.createDataFrame(rows, ITEM)

    def files():
        return {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}

    store.change_table(items, path, "key", sync.upsert, buckets=16)
    before = files()
    store.change_table(spark.createDataFrame([_item("k7", "two", 2), _item("new", "x", 2)], ITEM), path, "key", sync.upsert, buckets=16)
    after = files()
    folder = lambda f: f.split(store.BUCKET + "=")[1].split("/")[0]
    changed = {folder(f) for f in before if f not in after}
    want = {str(r[0]) for r in spark.createDataFrame([("k7",), ("new",)], "key string").select(store.bucket_of("key", 16)).collect()}
    assert changed == want and {folder(f) for f in before} | want == {folder(f) for f in after}
    assert all(after[f] == t for f, t in before.items() if folder(f) not in want)
    got = {r.key: r.summary for r in store.load_table(spark, path).collect()}
    assert len(got) == 201 and got["k7"] == "two" and got["k8"] == "one"
    store.change_table(items.limit(0), path, "key", sync.upsert, buckets=16)
    assert files() == after


def test_a_new_table_is_written_once_and_rows_move_once_by_bucket(spark, tmp_path, monkeypatch):
    """No copy aside while there are no old rows; an upsert of bucketed rows has one shuffle."""
    monkeypatch.setattr(store, "cut_lineage", None)
    monkeypatch.setattr(store, "stored", None, raising=False)
    items = spark.createDataFrame([_item(f"k{i % 9}", f"text {i}", 1) for i in range(20)], ITEM)
    store.change_table(items, str(tmp_path / "t"), "key", sync.upsert, buckets=4)
    assert store.load_table(spark, str(tmp_path / "t")).count() == 9
    both = items.withColumn(store.BUCKET, store.bucket_of("key", 4))
    plan = sync.upsert(both, both)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
