"""Jobs as functions: each returns its metrics as a one-row DataFrame.

Kept rows and bytes are counted by ``observe`` while they pass by on their way into the topic or
the files.  Counting the raw rows there too would keep the filter from reaching the CSV reader, so
they come from a count-only scan, which parses no fields; measured on 5 GB, that is faster in all.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrytrace.functions.measures import MIB, records_per_pack
from ferrytrace.functions.messages import json_value, payload_bytes
from ferrytrace.operators.delivery import delivery_from_headers, delivery_summary, keep_before_idle
from ferrytrace.operators.filters import keep_listed
from ferrytrace.operators.ordered import take_first
from ferrytrace.operators.packing import pack_messages
from ferrytrace.schemas import PAYLOAD, RUN_METRICS, RUN_METRICS_PACKED
from ferrytrace.session import size_shuffles, written
from ferrytrace.sources import files
from ferrytrace.sources.topics import FileTopics, KafkaTopics

Topics = FileTopics | KafkaTopics


def _metrics(spark: SparkSession, schema: T.StructType, **values) -> DataFrame:
    row = tuple(values.get(field.name) for field in schema)
    return spark.createDataFrame([row], schema)


def _input_mib(spark: SparkSession, path: str) -> float:
    total = files.file_sizes(spark, path).agg(F.sum("length").alias("bytes")).first()
    return round((total["bytes"] or 0) / MIB, 1)


def _shares(raw: int, kept: int, size: float, reading: float, publishing: float) -> dict:
    ratio = kept / raw if raw else 0.0
    estimate = size * ratio
    return {
        "input_size_mb": size,
        "raw_records": raw,
        "filtered_records": kept,
        "filter_ratio": round(ratio, 4),
        "estimated_filtered_mb": round(estimate, 1),
        "read_time_s": round(reading, 2),
        "kafka_produce_time_s": round(publishing, 2),
        "total_time_s": round(reading + publishing, 2),
        "kafka_throughput_mbps": round(estimate / publishing, 2) if publishing > 0 else 0.0,
    }


def _select(
    rows: DataFrame, column: str, values: Sequence[str]
) -> tuple[DataFrame, Observation]:
    kept = Observation()
    selected = keep_listed(rows, column, values)
    return selected.observe(kept, F.count(F.lit(1)).alias("rows")), kept


def publish_filtered(
    spark: SparkSession,
    path: str,
    topics: Topics,
    topic: str,
    column: str = "country",
    values: Sequence[str] = ("LU", "DE", "BE"),
    key: str = "station_id",
    partitions: int = 8,
    run_id: str = "run",
) -> DataFrame:
    """CSV, filter, keyed JSON, topic."""
    size = _input_mib(spark, path)
    size_shuffles(spark, size)
    began = time.monotonic()
    rows = files.read_csv_text(spark, path)
    raw = rows.count()
    read = time.monotonic()
    selected, kept = _select(rows, column, values)
    messages = selected.select(
        F.col(key).alias("key"),
        json_value(rows.columns).alias("value"),
        F.monotonically_increasing_id().alias("_order"),
    )
    topics.publish(messages, topic, order=["_order"], partitions=partitions, stage=True)
    ended = time.monotonic()
    producer = dict(getattr(topics, "producer", {}))
    return _metrics(
        spark,
        RUN_METRICS,
        run_id=run_id,
        input_file=path.rsplit("/", 1)[-1],
        topic=topic,
        partitions=partitions,
        bootstrap_servers=getattr(topics, "bootstrap_servers", None),
        acks=producer.get("acks"),
        batch_size=producer.get("batch.size"),
        **_shares(raw, kept.get["rows"], size, read - began, ended - read),
    )


def publish_packed(
    spark: SparkSession,
    path: str,
    topics: Topics,
    topic: str,
    column: str = "country",
    values: Sequence[str] = ("LU", "DE", "BE"),
    batch_kb: int = 10,
    partitions: int = 8,
    run_id: str = "run",
) -> DataFrame:
    """CSV, filter, many rows per message, topic."""
    size = _input_mib(spark, path)
    size_shuffles(spark, size)
    began = time.monotonic()
    rows = files.read_csv_text(spark, path)
    raw = rows.count()
    read = time.monotonic()
    selected, kept = _select(rows, column, values)
    numbered = written(selected.withColumn("_order", F.monotonically_increasing_id()), "kept")
    k = records_per_pack(batch_kb)
    packed = pack_messages(numbered, ["_order"], k, columns=rows.columns)
    messages = packed.select(F.lit(None).cast("string").alias("key"), "value", "pack")
    topics.publish(messages, topic, order=["pack"], partitions=partitions, stage=True)
    ended = time.monotonic()
    counted = kept.get["rows"]
    return _metrics(
        spark,
        RUN_METRICS_PACKED,
        run_id=run_id,
        batch_kb=batch_kb,
        records_per_batch=k,
        kafka_messages=-(-counted // k),
        topic=topic,
        partitions=partitions,
        bootstrap_servers=getattr(topics, "bootstrap_servers", None),
        acks=dict(getattr(topics, "producer", {})).get("acks"),
        **_shares(raw, counted, size, read - began, ended - read),
    )


def save_filtered(
    spark: SparkSession,
    path: str,
    target: str,
    column: str = "country",
    values: Sequence[str] = ("LU", "DE", "BE"),
    run_id: str = "run",
) -> DataFrame:
    """CSV, filter, CSV parts."""
    began = time.monotonic()
    rows = files.read_csv_text(spark, path)
    raw = rows.count()
    selected, kept = _select(rows, column, values)
    files.write_csv(selected, target)
    seconds = time.monotonic() - began
    row = (run_id, raw, kept.get["rows"], _input_mib(spark, target), round(seconds, 2))
    return spark.createDataFrame(
        [row],
        "run_id string, raw_records long, filtered_records long, output_size_mb double, total_time_s double",
    )


def publish_lines(
    spark: SparkSession, path: str, topics: Topics, topic: str, partitions: int = 8
) -> None:
    """Every data line of headed files as a message."""
    lines = files.lines_as_messages(files.read_lines(spark, path))
    ordered = lines.withColumn("_order", F.monotonically_increasing_id())
    topics.publish(ordered, topic, order=["_order"], partitions=partitions, stage=True)


def publish_rows(
    spark: SparkSession, path: str, topics: Topics, topic: str, key: str = "station_id", partitions: int = 8
) -> None:
    """Every CSV row as a JSON message with its key."""
    rows = files.read_csv_text(spark, path)
    order = F.monotonically_increasing_id().alias("_order")
    topics.publish(files.rows_as_messages(rows, key, [order]), topic, order=["_order"], partitions=partitions, stage=True)


def throughput_publish(
    spark: SparkSession, path: str, topics: Topics, topic: str, partitions: int = 8
) -> DataFrame:
    """JSON lines to a topic; rates from measured bytes."""
    seen = Observation()
    began = time.monotonic()
    rows = files.read_json_lines(spark, path, PAYLOAD)
    messages = rows.select(
        F.col("id").cast("string").alias("key"),
        json_value(rows.columns).alias("value"),
        F.monotonically_increasing_id().alias("_order"),
    ).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(payload_bytes()).alias("bytes"))
    topics.publish(messages, topic, order=["_order"], partitions=partitions, stage=True)
    return _rates(spark, seen.get["rows"], seen.get["bytes"], time.monotonic() - began)


def throughput_read(spark: SparkSession, topics: Topics, topic: str) -> DataFrame:
    """Read a topic from start to end and count it; rates from measured bytes."""
    began = time.monotonic()
    total = topics.read(spark, topic).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(payload_bytes()).alias("bytes")
    ).first()
    return _rates(spark, total["rows"], total["bytes"], time.monotonic() - began)


def _rates(spark: SparkSession, rows: int, size: int | None, seconds: float) -> DataFrame:
    mb = (size or 0) / MIB
    per_second = 1 / seconds if seconds > 0 else 0.0
    row = (rows, round(mb, 4), round(seconds, 3), round(rows * per_second, 2), round(mb * per_second, 4))
    return spark.createDataFrame(
        [row],
        "records long, size_mb double, duration_seconds double, records_per_sec double, mb_per_sec double",
    )


def measure_topic(
    spark: SparkSession, topics: Topics, topic: str, started: str | None = None
) -> DataFrame:
    """Arrival measures of a topic; with ``started`` (a UTC timestamp) relative to that moment,
    otherwise end to end from the produce headers."""
    messages = topics.read(spark, topic)
    if started is None:
        return delivery_from_headers(messages, ["topic"])
    return delivery_summary(messages, ["topic"], F.lit(started).cast("timestamp"))


def receive_topic(
    spark: SparkSession,
    topics: Topics,
    topic: str,
    idle_s: int,
    target: int = 0,
    started: str | None = None,
) -> DataFrame:
    """Arrival measures of a reader that stops at the first idle gap or after ``target`` messages (0: no
    target), whichever comes first.  ``started`` is when it began (a UTC timestamp; default: the first
    arrival).  A topic without messages has latency -1 and throughput 0."""
    messages = take_first(topics.read(spark, topic), ["timestamp", "offset", "partition"], target)
    seen = keep_before_idle(messages, ["topic"], idle_s)
    began = F.col("timestamp") if started is None else F.lit(started).cast("timestamp")
    asked = spark.createDataFrame([(topic,)], "topic string")
    return delivery_summary(seen, ["topic"], began, expected=asked)
