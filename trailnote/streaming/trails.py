"""Structured Streaming over event streams: windowed counts, sessions, and transition counts with per-run state.

Times without a zone are read as UTC, which watermarks need. Every stream is bounded in state
by its watermark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: A run that is silent for so long in event time is forgotten.
IDLE_MS = 30 * 86_400_000


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of folder as a stream, with ts as a timestamp; all that is new at once, or a number of files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling or, with slide, sliding windows of event time; rows later than late are dropped."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n): stretches of one user without a longer gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of consecutive states of one run; what is kept between batches is the last state and its time."""
    if state.hasTimedOut:
        state.remove()
        return
    # A run has few rows a batch, so plain arrays: frames of pandas would cost more to sort and cut than their rows.
    ts, ids, kinds = (np.concatenate(c) for c in zip(*[[f[c].to_numpy() for c in ("ts", "event_id", "event_type")] for f in frames]))
    last, seen = state.get if state.exists else (None, None)
    timed, at = ~np.isnat(ts), ts.astype("datetime64[us]").astype("int64")
    told = timed if seen is None else timed & (at >= seen)
    order = np.lexsort((ids, at))
    order = order[told[order]]
    names = kinds[order].tolist()
    before = ([last] if state.exists else []) + names
    n_late = len(ts) - len(names)
    moves = list(zip(before[:-1], before[1:], [0] * len(before))) + [(None, None, n_late)] * (n_late > 0)
    if names:
        last, seen = names[-1], int(at[order[-1]])
        state.update((last, seen))
    if seen is not None:
        # From the run's own time: in the first batch the watermark still stands at 1970.
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), seen // 1000) + IDLE_MS)
    if moves:
        yield pd.DataFrame([(key[0], *m) for m in moves], columns=["run_id", "state", "next_state", "n_late"])


def transitions(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(run_id, state, next_state, n_late) as events arrive; rows windows are not allowed on streams, so state is kept per run.

    Rows older than what their run has already told, or without a time, make no move. They are
    counted: a row with n_late > 0 and no states says how many of a run a batch left out. Rows
    behind the watermark never get here; Spark counts them as numRowsDroppedByWatermark.
    """
    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(_moves, "run_id long, state string, next_state string, n_late long", "last string, seen long", "append", GroupStateTimeout.EventTimeTimeout)


def met_in_time(starts: DataFrame, events: DataFrame, key: str, within: str = "3 days", late: str = "2 days") -> DataFrame:
    """(key, start_id, started, event_id, ts) of each start (key, start_id, started) and each event (key, event_id, ts) of the same key no earlier and at most within later.

    A join of two streams: either row may arrive first, up to late behind the newest of its own stream. The time bound
    lets Spark drop a start within + late after it, and an event late after it, so what is kept of a key is what
    happens in that span. Rows without a key or a time meet nothing.
    """
    a = starts.select(F.col(key).alias("start_key"), "start_id", F.col("started").cast("timestamp").alias("started")).withWatermark("started", late)
    b = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    near = (F.col("start_key") == F.col(key)) & (F.col("ts") >= F.col("started")) & (F.col("ts") <= F.col("started") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select(key, "start_id", "started", "event_id", "ts")


def _woken(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Offloads of one loop whose time has come without another row; what is kept are the rows since the earliest one not yet decided."""
    rows = list(zip(*state.get)) if state.exists else []
    if not state.hasTimedOut:
        for frame in frames:
            ts, until = (frame[c].to_numpy().astype("datetime64[ms]") for c in ("ts", "until"))
            known = ~np.isnat(ts)
            until = np.where(np.isnat(until), np.datetime64(0, "ms"), until)
            rows += zip(ts[known].astype("int64").tolist(), until[known].astype("int64").tolist(), [0] * int(known.sum()))
    now = state.getCurrentWatermarkMs()
    # Everything up to the watermark is here, so an offload whose time lies before it can be decided.
    ripe = {(at, due) for at, due, told in rows if due > at and due < now and not told}
    # The next row of the loop tells, found by halving: a loop may have many rows.
    times = sorted({at for at, *_ in rows})
    after = lambda at: times[i] if (i := bisect_right(times, at)) < len(times) else inf
    out = [(key[0], pd.Timestamp(at, unit="ms"), pd.Timestamp(due, unit="ms")) for at, due in sorted(ripe) if after(at) > due]
    rows = [(at, due, int(told or (at, due) in ripe)) for at, due, told in rows]
    open_ = [(at, due) for at, due, told in rows if due > at and not told]
    since = min((at for at, _ in open_), default=None)
    rows = [r for r in rows if since is not None and r[0] >= since]
    if rows:
        state.update(tuple(map(list, zip(*rows))))
        state.setTimeoutTimestamp(max(min(due for _, due in open_), now) + 1)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["loop", "offloaded", "reopened"])


def reopened(rows: DataFrame, late: str = "2 days") -> DataFrame:
    """(loop, offloaded, reopened) of rows (loop, ts, until): loops put away at ts until a time, with no row of theirs after ts up to then.

    A row without until, or with one not after ts, puts nothing away; like any row it says that the loop was looked at.
    A timer in event time stands at the first undecided offload; when the watermark has passed it, all rows
    that could speak against it have come. A loop keeps its rows since its earliest undecided offload and is forgotten with the
    last one. Rows of one loop, time and until count once.
    """
    once = rows.select("loop", F.col("ts").cast("timestamp").alias("ts"), F.col("until").cast("timestamp").alias("until")).withWatermark("ts", late)
    return once.groupBy("loop").applyInPandasWithState(_woken, "loop long, offloaded timestamp, reopened timestamp", "ts array<long>, until array<long>, told array<int>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_files(stream: DataFrame, folder: str) -> None:
    """One run over everything that is there now, appended to Parquet files; a later run into the same folder goes on from its state and offsets."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", folder + "-log")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
