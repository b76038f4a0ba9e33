"""The five ways to deliver filtered readings, and the packed one.

Each writes its topic and leaves measuring to the caller.  They share one selection, so a
reader gets the same records whichever way is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytrace.functions.messages import json_value
from ferrytrace.operators.filters import keep_listed
from ferrytrace.operators.packing import pack_messages
from ferrytrace.sources.files import lines_as_messages, read_lines, write_csv
from ferrytrace.sources.topics import FileTopics
from ferrytrace.streaming.flows import drain, replicate, transfer_chunks


def filtered_messages(
    rows: DataFrame, column: str, values: Sequence[str], key: str, order: str
) -> DataFrame:
    """Kept rows as keyed JSON, with their order column for numbering."""
    return keep_listed(rows, column, values).select(
        F.col(key).cast("string").alias("key"),
        json_value(rows.columns).alias("value"),
        F.col(order).cast("long").alias("_order"),
    )


def deliver_direct(
    rows: DataFrame,
    column: str,
    values: Sequence[str],
    key: str,
    order: str,
    topics: FileTopics,
    topic: str,
    partitions: int = 8,
) -> None:
    """Filter where the data is and publish.  Filtering at the destination is the same job run
    there; only the topic's address differs."""
    messages = filtered_messages(rows, column, values, key, order)
    topics.publish(messages, topic, ["_order"], partitions)


def deliver_files(
    spark: SparkSession,
    rows: DataFrame,
    column: str,
    values: Sequence[str],
    csv_path: str,
    topics: FileTopics,
    topic: str,
    partitions: int = 8,
) -> None:
    """Filter to CSV parts, then publish every data line as a message without a key.

    Lines are numbered in the order they are read.
    """
    write_csv(keep_listed(rows, column, values), csv_path)
    lines = lines_as_messages(read_lines(spark, csv_path)).withColumn(
        "_order", F.monotonically_increasing_id()
    )
    topics.publish(lines, topic, ["_order"], partitions, stage=True)


def deliver_replicated(
    spark: SparkSession, topics: FileTopics, topic: str, target: FileTopics, checkpoint: str
) -> DataFrame:
    """Copy a published topic to a prefixed one; returns the copy."""
    drain(replicate(topics.read_stream(spark, topic), target, checkpoint, [topic]))
    return target.read(spark, f"source.{topic}")


def deliver_chunked(
    spark: SparkSession,
    topics: FileTopics,
    topic: str,
    chunk_bytes: int,
    target_path: str,
    checkpoint: str,
) -> DataFrame:
    """Move a published topic in size-bounded chunks; returns the moved messages."""
    drain(transfer_chunks(topics.read_stream(spark, topic), chunk_bytes, target_path, checkpoint))
    return spark.read.parquet(f"{target_path}/messages")


def deliver_packed(
    rows: DataFrame,
    column: str,
    values: Sequence[str],
    order: str,
    records_per_message: int,
    topics: FileTopics,
    topic: str,
    partitions: int = 8,
) -> None:
    """Filter, pack many rows per message, publish without keys."""
    numbered = keep_listed(rows, column, values).withColumn("_order", F.col(order).cast("long"))
    packed = pack_messages(numbered, ["_order"], records_per_message, columns=rows.columns)
    messages = packed.select(F.lit(None).cast("string").alias("key"), "value", "pack")
    topics.publish(messages, topic, ["pack"], partitions, stage=True)
