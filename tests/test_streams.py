"""Streams against folds in plain Python, over the events table read as a stream of files in order of time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from refloom.plans import catalog
from refloom.streaming import events as E


@pytest.fixture(scope="module")
def files(spark, small, tmp_path_factory):
    """The events in six files, each later than the one before."""
    d = tmp_path_factory.mktemp("events")
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    lo, hi = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    for i in range(6):
        a, b = lo + (hi - lo + 1) * i // 6, lo + (hi - lo + 1) * (i + 1) // 6
        e.filter(F.unix_micros("ts").between(a, b - 1)).coalesce(1).write.parquet(f"{d}/part={i}")
    return str(d)


def _run(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


def _stream(spark, files):
    return E.read_events(spark, f"{files}/*", files=1)


def _fold(rows, hours=24):
    last, kept = {}, []
    for r in sorted((r for r in rows if r["user_id"] is not None and r["ts"] is not None), key=lambda r: (r["ts"], r["event_id"])):
        u = r["user_id"]
        if u not in last or r["ts"] - last[u] >= dt.timedelta(hours=hours):
            last[u] = r["ts"]
            kept.append((u, r["event_id"]))
    return sorted(kept)


def test_throttle_is_a_fold(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    for hours in (24, 5):
        assert sorted((r["user_id"], r["event_id"]) for r in E.throttle(e, hours).collect()) == _fold(e.collect(), hours)


def test_events_about_midnight(spark):
    at = lambda *x: dt.datetime(2024, 1, *x)
    rows = [(1, at(1, 23, 59), 7), (2, at(2, 0, 1), 7), (3, at(2, 23, 58), 7), (4, at(2, 23, 59), 7), (5, None, 7), (6, at(1), None), (8, at(4), 9), (7, at(4), 9)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    assert sorted(r["event_id"] for r in E.throttle(e).collect()) == [1, 4, 7]
    assert E.throttle(e.limit(0)).collect() == []


def test_throttle_of_a_stream(spark, small, files):
    got = sorted((r["user_id"], r["event_id"]) for r in _run(E.throttle_stream(_stream(spark, files)), spark, "throttled"))
    assert got == _fold(spark.read.parquet(f"{small}/events.parquet").collect())


def test_latest_of_a_stream(spark, small, files):
    last = {}
    for r in _run(E.latest_stream(_stream(spark, files)), spark, "latest_rows", "update"):
        last[r["user_id"]] = r["event_id"]
    assert last == {r["user_id"]: r["event_id"] for r in E.latest(spark.read.parquet(f"{small}/events.parquet")).collect()}


def test_windows_of_a_stream(spark, small, files):
    got = {(r["start"], r["event_type"]): r["n"] for r in _run(E.windowed_counts(_stream(spark, files)), spark, "windows")}
    want = {(r["start"], r["event_type"]): r["n"] for r in E.windowed_counts(spark.read.parquet(f"{small}/events.parquet")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and max(k[0] for k in want) - max(k[0] for k in got) <= dt.timedelta(hours=2)


def test_runs_supersede_each_other(spark, small, files):
    rows = sorted(catalog._progress(spark, small).collect(), key=lambda r: (r["ts"], r["ord"]))
    run, want = {}, []
    for r in rows:
        if r["event"] == "started":
            run[r["owner"]] = r["run_id"]
        if run.get(r["owner"]) == r["run_id"]:
            want.append((r["owner"], r["ord"]))
            if r["event"] in E.CLOSING:
                run.pop(r["owner"])
    assert sorted((r["owner"], r["ord"]) for r in catalog.current_progress(spark, small).collect()) == sorted(want)
    e = _stream(spark, files)
    kind = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("finding")
    p = e.select(F.pmod("user_id", F.lit(50)).alias("owner"), "ts", F.col("event_id").alias("ord"), F.pmod("event_id", F.lit(3)).alias("run_id"), kind.alias("event"))
    assert sorted((r["owner"], r["ord"]) for r in _run(E.current_progress_stream(p), spark, "progress_rows")) == sorted(want)
