"""The numbers behind each figure, from result tables (see ``schemas`` for their layouts).

Every report covers the whole grid of sizes and partition counts; settings without a result show 0
and ``measured = false``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytrace.functions.measures import safe_ratio, size_label
from ferrytrace.operators import results

# The grid that was measured, and the producer rate the figures show.
PARTITIONS = [1, 2, 4, 8]
NATIVE_SIZES = [100, 1024, 10240]
SPARK_SIZES = [100, 1000, 10000]
PRODUCER_RATE = 1_000_000
SPARK_BATCH = "16384b"

_KEYS = ["message_size_bytes", "partitions"]


def with_row_number(native: DataFrame) -> DataFrame:
    """Results in file order.  A results file is small: one row per measured setting."""
    return native.withColumn("row_ix", F.monotonically_increasing_id())


def _grid(native: DataFrame) -> DataFrame:
    return results.config_grid(
        native.sparkSession, message_size_bytes=NATIVE_SIZES, partitions=PARTITIONS
    )


def _producers(native: DataFrame, rate: int) -> DataFrame:
    return native.filter((F.col("test_type") == "producer") & (F.col("producer_throughput") == rate))


def native_producer(
    native: DataFrame, acks: str = "1", value: str = "mb_per_sec", rate: int = PRODUCER_RATE
) -> DataFrame:
    """The first producer row of each setting: throughput, or a latency column."""
    rows = _producers(native, rate).filter(F.col("producer_acks") == acks)
    return results.first_match(rows, _KEYS, value, ["row_ix"], _grid(native))


def native_consumer(native: DataFrame, group: int = 1) -> DataFrame:
    """Mean consumer throughput of each setting over its replicates."""
    rows = native.filter((F.col("test_type") == "consumer") & (F.col("consumer_groups") == group))
    return results.replicate_mean(rows, _KEYS, "mb_per_sec", _grid(native))


def native_throughput(native: DataFrame) -> DataFrame:
    """Producer and consumer side by side."""
    producer = native_producer(native).select(*_KEYS, F.col("mb_per_sec").alias("producer_mb"))
    consumer = native_consumer(native).select(*_KEYS, F.col("mean").alias("consumer_mb"))
    return producer.join(consumer, _KEYS)


def acks_comparison(
    native: DataFrame, value: str = "mb_per_sec", rate: int = PRODUCER_RATE
) -> DataFrame:
    """Both acks levels side by side, with the difference in percent."""
    return results.pivot_pair(
        _producers(native, rate), _KEYS, "producer_acks", ("1", "all"), value, ["row_ix"]
    )


def throughput_against_latency(native: DataFrame, rate: int = PRODUCER_RATE) -> DataFrame:
    return results.throughput_latency_points(
        _producers(native, rate), [*_KEYS, "producer_acks"], "mb_per_sec", "avg_latency_ms", ["row_ix"]
    )


def spark_throughput(runs: DataFrame, batch: str = SPARK_BATCH) -> DataFrame:
    """Mean and population deviation over the runs of each setting."""
    rows = runs.filter(F.trim("batch_size") == batch)
    spread = results.replicate_mean_std(rows, ["partitions", "record_size_bytes"], "mb_per_sec")
    grid = results.config_grid(
        runs.sparkSession, partitions=PARTITIONS, record_size_bytes=SPARK_SIZES
    )
    return results.grid_fill(grid, spread, ["partitions", "record_size_bytes"], ["mean", "std"])


def spark_against_native(native: DataFrame, runs: DataFrame) -> DataFrame:
    """Both engines by size label, as their sizes in bytes differ slightly."""
    left = native_producer(native).select(
        size_label(F.col("message_size_bytes")).alias("size"), "partitions", F.col("mb_per_sec").alias("native_mb")
    )
    right = spark_throughput(runs).select(
        size_label(F.col("record_size_bytes")).alias("size"), "partitions", F.col("mean").alias("spark_mb")
    )
    both = left.join(right, ["size", "partitions"])
    return both.withColumn("gap_mb", F.col("spark_mb") - F.col("native_mb")).withColumn(
        "ratio", safe_ratio(F.col("spark_mb"), F.col("native_mb"))
    )
