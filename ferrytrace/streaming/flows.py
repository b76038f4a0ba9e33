"""Streams over topics.

Each function starts a query and returns it.  ``drain`` is the bounded form: process what is
there, then stop.  Progress lives in the checkpoint, so a restarted query goes on where it was.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ferrytrace.functions.measures import prefixed_topic, safe_ratio
from ferrytrace.functions.messages import json_value, make_header, parse_json, payload_bytes
from ferrytrace.operators.filters import keep_listed
from ferrytrace.operators.packing import chunk_by_bytes, in_chunks
from ferrytrace.schemas import SQUARES, TOPIC
from ferrytrace.sources.topics import FileTopics, KafkaTopics


def start(writer: DataStreamWriter, checkpoint: str, bounded: bool = True) -> StreamingQuery:
    """Start with a checkpoint; a bounded query stops once it has read what is there."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if bounded else writer).start()


def drain(query: StreamingQuery, seconds: float | None = None) -> StreamingQuery:
    """Wait for a bounded query, or stop an unbounded one after ``seconds``."""
    if seconds is None:
        query.awaitTermination()
    else:
        query.awaitTermination(seconds)
        query.stop()
    return query


def stop_when_idle(query: StreamingQuery, idle_s: float, poll_s: float = 0.5) -> StreamingQuery:
    """Let an unbounded query run until, after its first rows, none came for ``idle_s`` seconds."""
    latest, rows_at = None, None
    while not query.awaitTermination(poll_s):
        progress = query.lastProgress
        if progress and progress["numInputRows"] > 0 and progress["batchId"] != latest:
            latest, rows_at = progress["batchId"], time.monotonic()
        elif rows_at is not None and time.monotonic() - rows_at >= idle_s:
            query.stop()
    return query


def append_files(stream: DataFrame, path: str, checkpoint: str, bounded: bool = True) -> StreamingQuery:
    """Append-mode sink; the file sink's own log makes each batch count once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return start(writer, checkpoint, bounded)


def parse_and_cube(topic: DataFrame, schema: T.StructType | str = SQUARES, number: str = "number") -> DataFrame:
    """JSON messages to columns plus the cube of one of them (null where it overflows)."""
    parsed = parse_json(topic, schema)
    n = F.col(number).cast("long")
    cubed = F.try_multiply(F.try_multiply(n, n), n)
    return parsed.withColumn("cubed", cubed)


def filter_and_deliver(
    source: DataFrame,
    column: str,
    values: Sequence[str],
    key: str,
    topics: FileTopics | KafkaTopics,
    topic: str,
    order: Sequence[str],
    checkpoint: str,
    partitions: int = 8,
    bounded: bool = True,
) -> StreamingQuery:
    """Publish the matching rows as they arrive.

    A batch is written under its own id, in replace mode, so a batch that is run again after a
    failure does not deliver twice.
    """
    kept = keep_listed(source, column, values)

    def publish(batch: DataFrame, batch_id: int) -> None:
        numbers = [F.col(c).cast("long").alias(f"_{c}") for c in order]
        messages = batch.select(
            F.col(key).cast("string").alias("key"), json_value(batch.columns).alias("value"), *numbers
        )
        topics.publish(
            messages, topic, [f"_{c}" for c in order], partitions, batch_id, stage=True
        )

    return start(kept.writeStream.foreachBatch(publish), checkpoint, bounded)


def replicate(
    source: DataFrame,
    target: FileTopics,
    checkpoint: str,
    names: Sequence[str],
    prefix: str = "source",
    bounded: bool = True,
) -> StreamingQuery:
    """Copy messages with key, value, headers, partition and offset to prefixed topics.

    The checkpoint stores how far each source was read.  A batch is written under its own id, in
    replace mode, so one that is run again does not copy twice; the copies open as topics.  ``names``
    are the topics to copy.
    """

    def copy(batch: DataFrame, batch_id: int) -> None:
        for name in names:
            copied = batch.where(F.col("topic") == name)
            renamed = copied.withColumn("topic", prefixed_topic(F.col("topic"), prefix))
            target.write_batch(renamed, f"{prefix}.{name}", batch_id)

    return start(source.writeStream.foreachBatch(copy), checkpoint, bounded)


def run_until(query: StreamingQuery, done: Callable[[], bool], poll_s: float = 0.5) -> StreamingQuery:
    """Let an unbounded query run until a condition, looked at between polls, holds."""
    while not query.awaitTermination(poll_s):
        if done():
            query.stop()
    return query


def batch_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """What the recent batches of a query read, and how fast: ``batch_id, records, seconds, records_per_sec``.
    A batch that several actions read counts its records for each."""
    rows = [
        (p["batchId"], p["numInputRows"], p["durationMs"].get("triggerExecution", 0) / 1000)
        for p in query.recentProgress
        if p["numInputRows"]
    ]
    seen = spark.createDataFrame(rows, "batch_id long, records long, seconds double")
    return seen.withColumn("records_per_sec", F.round(safe_ratio(F.col("records"), F.col("seconds")), 2))


def replicate_to_kafka(
    source: DataFrame,
    topics: KafkaTopics,
    checkpoint: str,
    prefix: str = "source",
    bounded: bool = True,
) -> StreamingQuery:
    """The same copy into Kafka.  Its sink delivers at least once, so each message carries the
    partition and offset it came from as headers, by which a reader can tell repeats."""
    position = [
        make_header(f"source_{name}", F.col(name).cast("string")) for name in ("partition", "offset")
    ]
    headers = F.concat(F.coalesce("headers", F.array().cast(TOPIC["headers"].dataType)), F.array(*position))
    copied = source.select(
        "key", "value", "partition", prefixed_topic(F.col("topic"), prefix).alias("topic"), headers.alias("headers")
    )
    return start(topics.publish_stream(copied), checkpoint, bounded)


def transfer_chunks(
    source: DataFrame,
    chunk_bytes: int,
    target_path: str,
    checkpoint: str,
    bounded: bool = True,
) -> StreamingQuery:
    """Move a topic as size-bounded chunks.

    A batch continues the byte count of the batches before it, so chunk numbers do not depend on
    how the stream was cut into batches.  Messages go to ``messages/batch_id=n``, chunks to
    ``chunks/batch_id=n``, and the byte totals up to and with the batch to ``totals/batch_id=n``, so
    a batch reads only what the one before it left.  A repeated batch replaces all three.
    """
    keys = ["topic", "partition"]

    def move(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def at(table: str, number: int) -> str:
            return f"{target_path}/{table}/batch_id={number}"

        layout = T.StructType([batch.schema["topic"], batch.schema["partition"], T.StructField("carried", T.LongType())])
        if batch_id > 0:
            carried = spark.read.schema(layout).parquet(at("totals", batch_id - 1))
        else:
            carried = spark.createDataFrame([], layout)
        numbered = chunk_by_bytes(batch, chunk_bytes, carried=carried)
        numbered.write.mode("overwrite").parquet(at("chunks", batch_id))
        chunks = spark.read.schema(numbered.schema).parquet(at("chunks", batch_id))
        in_chunks(batch, chunks).write.mode("overwrite").parquet(at("messages", batch_id))
        totals = carried.unionByName(chunks.select(*keys, F.col("bytes").alias("carried")))
        totals = totals.groupBy(*keys).agg(F.sum("carried").alias("carried"))
        totals.coalesce(1).write.mode("overwrite").parquet(at("totals", batch_id))

    return start(source.writeStream.foreachBatch(move), checkpoint, bounded)


def delivery_sessions(
    source: DataFrame, keys: Sequence[str], timeout_s: int, late_s: int = 0, strict: bool = False,
    arrival: str = "timestamp",
) -> DataFrame:
    """Arrival sums of each run between idle gaps, over a stream or a table.

    A gap that reaches the timeout (``strict``: exceeds it) ends a session.  On a stream, a session
    leaves the state once the watermark, ``late_s`` behind the newest arrival, has passed its end.
    """
    # Spark joins a row to a session up to and including the session's end, and lets a session go when
    # the watermark reaches that end; a millisecond more keeps it for arrivals of the same moment.
    gap = timeout_s * 1_000_000 - int(not strict)
    watched = source.withWatermark(arrival, f"{late_s * 1000 + 1} milliseconds") if source.isStreaming else source
    return (
        watched.withColumn("_size", payload_bytes())
        .groupBy(*keys, F.session_window(arrival, f"{gap} microseconds").alias("session"))
        .agg(
            F.min(arrival).alias("first_arrival"),
            F.max(arrival).alias("last_arrival"),
            F.count(F.lit(1)).alias("records"),
            F.sum("_size").alias("bytes"),
        )
    )


def monitor_delivery(
    source: DataFrame,
    keys: Sequence[str],
    timeout_s: int,
    target_path: str,
    checkpoint: str,
    bounded: bool = True,
    late_s: int = 0,
    strict: bool = False,
) -> StreamingQuery:
    """Live arrival sums per run, closed by idle gaps.

    A closed session is appended to ``target_path`` once and leaves the state, which holds one row for
    each session that is still open.  ``monitored_sessions`` reads both.
    """
    sessions = delivery_sessions(source, keys, timeout_s, late_s, strict)
    return append_files(sessions, target_path, checkpoint, bounded)


def monitored_sessions(
    spark: SparkSession, sessions: T.StructType, target_path: str, checkpoint: str
) -> DataFrame:
    """All sessions a monitor has seen in its finished batches, with ``open``: the closed ones from its
    table, the open ones from its state.  ``sessions`` is the schema of ``delivery_sessions``.

    While the monitor runs, a session may close between the two reads; it counts once, as closed.
    """
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    opened = state.toDF(*sessions.names).withColumn("open", F.lit(True))
    closed = spark.read.schema(sessions).parquet(target_path).withColumn("open", F.lit(False))
    keys = sessions.names[: sessions.names.index("session")]
    sums = sessions.names[len(keys) + 1 :]
    # Once for each start; the closed row, where there are two, has the larger sums.
    started = F.col("session.start").alias("started")
    return closed.unionByName(opened).groupBy(*keys, started).agg(
        *[(F.min if c == "first_arrival" else F.max)(c).alias(c) for c in sums], F.min("open").alias("open")
    )


def idle_end(sessions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a reader sees that stops at the first idle gap, from sessions: the sums of the first one,
    whether it is still ``open``, and the records after it."""
    at = F.unix_micros("started")
    first = {c: F.min_by(c, at).alias(c) for c in ("first_arrival", "last_arrival", "records", "bytes", "open")}
    ends = sessions.groupBy(*keys).agg(*first.values(), F.sum("records").alias("_all"))
    return ends.withColumn("records_after", F.col("_all") - F.col("records")).drop("_all")


def reader_ends(
    source: DataFrame,
    keys: Sequence[str],
    timeout_s: int,
    target: int = 0,
    late_s: int = 0,
    strict: bool = False,
    arrival: str = "timestamp",
) -> DataFrame:
    """A live reader with an end: one row per run, once it is certain that the reader stopped, at its
    first idle gap (which reaches the timeout; ``strict``: exceeds it) or at its ``target``-th message
    (0: none).  Later messages are not reported.

    Returns keys, ``first_us``, ``last_us``, ``records``, ``bytes`` and ``ended`` (``idle`` or ``target``).
    Messages of one moment count by size, smaller first.  An event-time timer wakes a run when the
    watermark, ``late_s`` behind the newest arrival, reaches its expected end.  The state has the sums of
    what the watermark has passed, and arrival and size of newer messages; after the end one flag.
    Only keys, arrivals and sizes reach Python.
    """
    keys = list(keys)
    gap = timeout_s * 1_000_000 + int(strict)
    narrow = (
        source.withWatermark(arrival, f"{late_s * 1000 + 1} milliseconds")
        .select(*keys, F.col(arrival).alias("_at"), F.unix_micros(arrival).alias("_us"), payload_bytes().alias("_size"))
    )
    outputs = [T.StructField(c, T.LongType()) for c in ("first_us", "last_us", "records", "bytes")]
    layout = T.StructType([narrow.schema[k] for k in keys] + outputs + [T.StructField("ended", T.StringType())])

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        over, first, last, records, size, held = state.get if state.exists else (False, 0, 0, 0, 0, b"")
        if over:
            return
        parts = [np.frombuffer(held, np.int64).reshape(-1, 2)]
        if not state.hasTimedOut:
            parts += [f[["_us", "_size"]].to_numpy(np.int64) for f in frames]
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        at = rows[:, 0]
        # The first gap among what is known, else the one expected after the last message.
        steps = np.diff(at, prepend=last if records else at[:1])
        wide = np.flatnonzero(steps >= gap)
        inside, ended = int(wide[0]) if len(wide) else len(rows), "idle"
        end = int(at[inside - 1] if inside else last) + gap
        if 0 < target <= records + inside:
            inside, ended = target - records, "target"
            end = int(at[inside - 1])
        passed = state.getCurrentWatermarkMs() * 1000
        certain = passed >= end
        # Nothing at or before the watermark can still come: those messages become sums.
        kept = inside if certain else min(inside, int(np.searchsorted(at, passed, "right")))
        if kept:
            first = first if records else int(at[0])
            last = int(at[kept - 1])
            records, size = records + kept, size + int(rows[:kept, 1].sum())
        if certain:
            state.update((True, 0, 0, 0, 0, b""))
            yield pd.DataFrame([[*key, first, last, records, size, ended]], columns=layout.names)
        else:
            state.update((False, first, last, records, size, rows[kept:].tobytes()))
            state.setTimeoutTimestamp(max(-(-end // 1000), state.getCurrentWatermarkMs() + 1))

    return narrow.groupBy(*keys).applyInPandasWithState(
        follow,
        layout,
        "over boolean, first long, last long, records long, bytes long, held binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def read_by_groups(
    sources: Sequence[DataFrame], target_path: str, checkpoint: str, bounded: bool = True
) -> list[StreamingQuery]:
    """One query per reader group over the same topic, each with its own progress.

    Group ``i`` writes what it saw, without message text, to ``group_no=i``.
    """
    queries = []
    for number, source in enumerate(sources, start=1):
        seen = source.select(
            "topic",
            "partition",
            "offset",
            "timestamp",
            F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("bytes"),
        )
        queries.append(
            append_files(
                seen, f"{target_path}/group_no={number}", f"{checkpoint}/{number}", bounded
            )
        )
    return queries
