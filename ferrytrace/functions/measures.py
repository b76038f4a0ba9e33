"""Units, ratios and labels shared by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One MiB, and the assumed JSON overhead and record weight of size estimates.
MIB = 1048576
JSON_OVERHEAD = 1.1
AVERAGE_RECORD_BYTES = 70

# The message sizes compared, for either engine, and their labels.
SIZE_LABELS = {
    100: "100 B",
    1000: "1 KB",
    1024: "1 KB",
    10000: "10 KB",
    10240: "10 KB",
}

# Fixed format: "<name>-<size>b-<partitions>p-..." and "<name>-prod-<partitions>-<size>-<rate>-<acks>".
TOPIC_SIZE_FIRST = r"-(\d+)b-(\d+)p-"
TOPIC_SWEEP = r"-prod-(\d+)-(\d+)-(\d+)-(\w+)$"


def mib(size: Column, digits: int = 2) -> Column:
    return F.round(size / F.lit(float(MIB)), digits)


def safe_ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the denominator is zero or either side is missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def estimated_mib(records: Column, record_size: Column) -> Column:
    """Size guess from a nominal record size; measured bytes are better when available."""
    return records * record_size * F.lit(JSON_OVERHEAD) / F.lit(float(MIB))


def default_zero(column: Column, default: float = 0.0) -> Column:
    return F.coalesce(column, F.lit(default))


def batch_label(batch: Column) -> Column:
    return F.when(batch == "0", F.lit("nobatch")).otherwise(F.concat(batch, F.lit("b")))


def size_label(size: Column) -> Column:
    labels = F.lit(None).cast("string")
    for number, label in SIZE_LABELS.items():
        labels = F.when(size == number, F.lit(label)).otherwise(labels)
    return labels


def topic_size(topic: Column) -> Column:
    return F.nullif(F.regexp_extract(topic, TOPIC_SIZE_FIRST, 1), F.lit("")).try_cast("int")


def topic_partitions(topic: Column) -> Column:
    return F.nullif(F.regexp_extract(topic, TOPIC_SIZE_FIRST, 2), F.lit("")).try_cast("int")


def topic_sweep_field(topic: Column, position: int) -> Column:
    """Partitions, size, rate or acks (1 to 4) out of a sweep topic's name."""
    return F.nullif(F.regexp_extract(topic, TOPIC_SWEEP, position), F.lit(""))


def prefixed_topic(topic: Column, source: str = "source") -> Column:
    return F.concat(F.lit(f"{source}."), topic)


def epoch_seconds(timestamp: Column) -> Column:
    return F.unix_micros(timestamp) / F.lit(1000000.0)


def records_per_pack(target_kb: int, record_bytes: int = AVERAGE_RECORD_BYTES) -> int:
    return max(1, target_kb * 1024 // record_bytes)


def producer_batch_bytes(target_kb: int) -> int:
    return max(16384, target_kb * 1024 * 16)
