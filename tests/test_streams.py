"""The stream functions over real streams, with rows that come late, against their batch forms."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from fathomline import streaming
from fathomline.streaming import tracker
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows(minutes, first=0):
    return [(first + i, START + timedelta(minutes=m), i % 3, "view" if i % 2 else "click", float(i)) for i, m in enumerate(minutes)]


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that streams read, and a function that puts one more file into it."""
    folder = tmp_path / "in"
    folder.mkdir()

    def add(name, some):
        frame = spark.createDataFrame(some, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(str(folder))
        return name

    return str(folder), add


def run(query):
    query.processAllAvailable()
    query.stop()


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows_without_late_rows_match_the_batch(spark, feed, tmp_path):
    folder, add = feed
    add("a", rows(range(0, 300, 7)))
    run(streaming.hourly(stream(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start())
    want = {tuple(r) for r in streaming.hourly(spark.read.schema(SCHEMA).parquet(folder)).collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == want


def test_rows_behind_the_watermark_are_dropped(spark, feed, tmp_path):
    folder, add = feed
    query = streaming.windowed(stream(spark, folder), "1 hour", late="30 minutes").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        add("a", rows([5, 10, 20]))
        query.processAllAvailable()
        add("b", rows([400], 100))  # moves the watermark past the first hour
        query.processAllAvailable()
        add("c", rows([15, 380], 200))  # one late row and one in time
        query.processAllAvailable()
        add("d", rows([900], 300))
        query.processAllAvailable()
    finally:
        query.stop()
    found = spark.table("late").groupBy("start").agg(F.sum("n").alias("n")).collect()
    assert {(r.start, r.n) for r in found} == {(START, 3), (START + timedelta(hours=6), 2)}


def test_sliding_windows_and_sessions(spark):
    events = spark.createDataFrame(rows([0, 10, 20, 200, 205]), SCHEMA)
    slid = streaming.windowed(events, "1 hour", "30 minutes")
    assert slid.agg(F.sum("n")).first()[0] == 10
    assert sorted(r.n for r in streaming.sessions(events, "30 minutes").collect()) == [1, 1, 1, 1, 1]
    one = events.withColumn("user_id", F.lit(1).cast("long"))
    assert sorted(r.n for r in streaming.sessions(one, "30 minutes").collect()) == [2, 3]
    assert streaming.first_seen(one.union(one), "event_id").count() == 5


def test_change_logs_keep_each_batch_once(spark, feed, tmp_path):
    folder, add = feed
    out = str(tmp_path / "log")
    add("a", rows([1, 2, 3]))
    changes = stream(spark, folder).groupBy("user_id").agg(F.max("value").alias("value"))
    query = tracker.log_changes(changes, out, str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        first = {p: p.stat().st_mtime_ns for p in Path(out).glob("batch=0/*.parquet")}
        add("b", [(9, START + timedelta(hours=1), 2, "view", 99.0), (10, START, 7, "view", 7.0)])
        query.processAllAvailable()
    finally:
        query.stop()
    assert first == {p: p.stat().st_mtime_ns for p in Path(out).glob("batch=0/*.parquet")}  # nothing is written again
    latest = tracker.latest_changes(spark.read.parquet(out), "user_id")
    assert {(r.user_id, r.value) for r in latest.collect()} == {(0, 0.0), (1, 1.0), (2, 99.0), (7, 7.0)}
    changed = spark.read.parquet(out).where("batch > 0").select("user_id").collect()
    assert {r.user_id for r in changed} == {2, 7}


DAY = timedelta(days=1)


def signal_events():
    """Signals that repeat, lose, win, are void, stay open or silent; results before signals; every event twice, out of order."""
    rng, out = random.Random(6), []
    for s in range(40):
        for _ in range(rng.randrange(0, 5)):
            out.append((f"s{s}", START + rng.random() * 3 * DAY, "signal", round(rng.uniform(1.2, 4), 2), float(rng.choice([0, 1, 2])), None))
        for _ in range(rng.randrange(0, 3)):
            out.append((f"s{s}", START + rng.random() * 3 * DAY, "closing", round(rng.uniform(1.2, 4), 2), None, None))
        for _ in range(rng.choice([0, 0, 1, 2])):
            out.append((f"s{s}", START + rng.random() * 3 * DAY, "result", None, None, rng.choice(["win", "loss", "void"])))
    out = [(r[0], i, *r[1:]) for i, r in enumerate(out)] * 2
    rng.shuffle(out)
    return out


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def run_tracker(spark, tmp_path, batches, **settings):
    folder, out = tmp_path / "events", str(tmp_path / "tracked")
    folder.mkdir()
    events = spark.readStream.schema(tracker.EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = tracker.log_changes(tracker.track(events, **settings), out, str(tmp_path / "c")).start()
    try:
        for some in batches:
            spark.createDataFrame(some, tracker.EVENT).coalesce(1).write.mode("append").parquet(str(folder))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out)


def as_rows(df):
    cell = lambda v: round(v, 2) if isinstance(v, float) else v
    return sorted(tuple(cell(r[c]) for c in ("signal_id", "first_seen", "last_seen", "first_odds", "latest_odds", "stake", "closing_odds", "result", "profit", "clv_pct", "status")) for r in df.collect())


def test_the_tracked_stream_equals_the_batch(spark, tmp_path, state_store):
    events = signal_events()
    log = run_tracker(spark, tmp_path, [events[:60], events[60:200], events[200:]], late="30 days", expire_hours=1000)
    table = tracker.replayed(spark.createDataFrame(events, tracker.EVENT), 1000)
    assert as_rows(tracker.latest_changes(log, "signal_id").drop("change")) == as_rows(table)
    assert {r.change for r in log.select("change").distinct().collect()} == {"insert", "update", "settle"}


def test_silent_signals_expire_and_come_back(spark, tmp_path, state_store):
    at = lambda d: START + d * DAY
    batches = [[("a", 1, at(0), "signal", 2.0, 1.0, None), ("b", 2, at(0), "signal", 2.0, 1.0, None), ("b", 3, at(1), "result", None, None, "win")], [("c", 4, at(9), "signal", 3.0, 1.0, None)],
               [("d", 5, at(10), "signal", 3.0, 1.0, None)], [("a", 6, at(10), "signal", 2.5, 9.0, None)], [("c", 7, at(10), "result", None, None, "loss")]]
    log = run_tracker(spark, tmp_path, batches, late="1 day", expire_hours=48)
    said = {}
    for r in log.orderBy("batch").collect():
        said.setdefault(r.signal_id, []).append((r.change, r.status))
    assert said["a"] == [("insert", "open"), ("expire", "expired"), ("update", "open")] and said["b"] == [("insert", "settled")]
    assert said["c"] == [("insert", "open"), ("settle", "settled")] and said["d"] == [("insert", "open")]
    last = {r.signal_id: r for r in tracker.latest_changes(log, "signal_id").collect()}
    assert last["a"].first_odds == 2.0 and last["a"].latest_odds == 2.5 and last["a"].stake == 1.0 and last["c"].profit == -1.0 and last["b"].profit == 1.0


def test_a_replay_leaves_rounding_to_its_caller(spark):
    rows = [("a", 1, START, "signal", 1.6, 1.0, None), ("a", 2, START + DAY, "closing", 1.1, None, None)]
    (r,) = tracker.replayed(spark.createDataFrame(rows, tracker.EVENT), digits=None).selectExpr("round(clv_pct, 2) AS v").collect()
    assert r.v == 45.45  # 45.4545...: by way of 45.455 it would be 45.46


def test_the_replay_of_the_tables_matches_sql_at_ties(spark, tmp_path):
    import duckdb

    from fathomline.plans.registry import ORACLE_SQL, QUERIES

    kinds = ["view", "purchase", "view", "click"]
    rows = [(i, i // 4, START + i * DAY, kinds[i % 4], i % 200 + (0.25 if i % 2 else 0.75)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in QUERIES["tracker_replay"](spark, str(tmp_path)).select("signal_id", "first_odds", "latest_odds", "closing_odds", "clv_pct").collect())
    sql = ORACLE_SQL["tracker_replay"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(duckdb.sql(f"SELECT signal_id, first_odds, latest_odds, closing_odds, clv_pct FROM ({sql})").fetchall())
    assert got == want
