"""The audit's event stream: windowed counts, the latest state of each key and a throttle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STATE = "user_id long, event_id long, event_type string, value double"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, form: str = "parquet", files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; works on batches and streams, whose late events are dropped after `late`."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user in a batch, by time and then id."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")


def latest_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, as updates: one row of state for each user, whatever the order of arrival."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for b in batches:
            last = b.sort_values(["ts", "event_id"]).iloc[-1]
            new = (int(last["ts"].value), int(last["event_id"]), last["event_type"], float(last["value"]))
            best = new if best is None or new[:2] > tuple(best[:2]) else best
        state.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "event_type": [best[2]], "value": [best[3]]})

    return events.groupBy("user_id").applyInPandasWithState(fold, STATE, "at long, event_id long, event_type string, value double", "update", GroupStateTimeout.NoTimeout)


def throttle(events: DataFrame, hours: int = 24) -> DataFrame:
    """The events of each user that come so many hours or more after the last one kept; the first is kept, of equal times the smallest id.

    A user's events pass one task in order, which remembers one time only; users are many.  Events without user or time are no attempts and go.
    """
    gap, names = pd.Timedelta(hours=hours), events.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = None, None
        for b in batches:
            keep = []
            for u, ts in zip(b["user_id"], b["ts"], strict=True):
                keep.append(u != user or ts - last >= gap)
                if keep[-1]:
                    user, last = u, ts
            yield b[keep][names]

    ordered = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(fold, events.schema)


def throttle_stream(events: DataFrame, hours: int = 24, late: str = "10 minutes") -> DataFrame:
    """user_id, event_id, ts of what throttle() keeps of a stream whose files come in order of time.

    The state is the time last kept.  Its timer is the watermark's passing the end of the gap: what then comes is kept anyway, so the
    state goes and idle users cost nothing.
    """
    gap = hours * 3_600_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for i, ts in zip(rows["event_id"], rows["ts"].astype("datetime64[us]").astype("int64"), strict=True):
            if last is None or ts - last >= gap:
                last = int(ts)
                kept.append((key[0], i, pd.Timestamp(last, unit="us")))
        state.update((last,))
        if last + gap > state.getCurrentWatermarkMs() * 1000:
            state.setTimeoutTimestamp((last + gap) // 1000 + 1)
        yield pd.DataFrame(kept, columns=["user_id", "event_id", "ts"])

    e = events.filter("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late).select("user_id", "event_id", "ts")
    return e.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


#: What ends a run.
CLOSING = ("completed", "cancelled", "failed")


def current_progress(progress: DataFrame) -> DataFrame:
    """progress: owner, ts, ord, run_id, event.  The events that count: an owner's new run supersedes the one before, of which nothing is heard
    any more, and after a run has ended nothing counts until the next begins."""
    before = Window.partitionBy("owner").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(F.col("event") == "started", F.struct("run_id", "ts", "ord"))
    p = progress.withColumn("_run", F.last(start, ignorenulls=True).over(before)).filter(F.col("run_id") == F.col("_run.run_id"))
    within = Window.partitionBy("owner", "_run").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(F.col("event").isin(*CLOSING)).over(within), F.lit(False))
    return p.withColumn("_closed", closed).filter("NOT _closed").drop("_run", "_closed")


def current_progress_stream(progress: DataFrame) -> DataFrame:
    """owner, ord of what current_progress() lets count of a stream, with the run at work as an owner's state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "ord"])
        kept = []
        for o, r, event in zip(rows["ord"], rows["run_id"], rows["event"], strict=True):
            run = r if event == "started" else run
            if r == run:
                kept.append((key[0], o))
                run = None if event in CLOSING else run
        if run is None:
            state.remove()
        else:
            state.update((int(run),))
        yield pd.DataFrame(kept, columns=["owner", "ord"])

    return progress.groupBy("owner").applyInPandasWithState(fold, "owner long, ord long", "run long", "append", GroupStateTimeout.NoTimeout)


def fold_report(progress: DataFrame) -> DataFrame:
    """progress: run_id, ts, event, index, bib_key, status.  The report of the latest run: findings by index, whatever their order of
    arrival; events of runs before it are stale."""
    run = progress.filter("event = 'started'").agg(F.max_by("run_id", "ts").alias("run_id"))
    p = progress.join(F.broadcast(run), "run_id")  # one row
    return p.filter("event = 'finding'").groupBy("run_id", "index").agg(F.max_by(F.struct("bib_key", "status"), "ts").alias("f")).select("run_id", "index", "f.*")
