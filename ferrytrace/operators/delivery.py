"""What arrived, when, and how fast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.functions.measures import epoch_seconds, mib, safe_ratio
from ferrytrace.functions.messages import header_long, payload_bytes
from ferrytrace.operators.ordered import floor_div, join_null_safe, running_totals



def filter_stats(
    df: DataFrame, passes: Column, input_bytes: Column | float | None = None
) -> DataFrame:
    """Rows, kept rows and kept share in one pass; with the input size, also the kept MiB."""
    counted = df.agg(
        F.count(F.lit(1)).alias("raw_records"), F.count_if(passes).alias("filtered_records")
    )
    ratio = safe_ratio(F.col("filtered_records"), F.col("raw_records"))
    shared = counted.withColumn("filter_ratio", F.round(ratio, 4))
    if input_bytes is None:
        return shared
    size = input_bytes if isinstance(input_bytes, Column) else F.lit(float(input_bytes))
    return shared.withColumn("estimated_filtered_mb", mib(size * ratio, 1))


def rate_stats(df: DataFrame, records: str, size: str, seconds: str) -> DataFrame:
    """Records/s and MiB/s; 0 for a run that took no time."""
    return df.withColumn(
        "records_per_sec", F.round(safe_ratio(F.col(records), F.col(seconds)), 2)
    ).withColumn(
        "mb_per_sec",
        F.round(safe_ratio(F.col(size) / F.lit(1048576.0), F.col(seconds)), 4),
    )


def delivery_summary(
    messages: DataFrame,
    keys: Sequence[str],
    start: Column,
    arrival: str = "timestamp",
    expected: DataFrame | None = None,
) -> DataFrame:
    """First and last arrival, records, bytes, latencies and throughput of each run.

    ``start`` is when the reader began, as a timestamp; its smallest value per run counts.  Runs
    listed in ``expected`` but without a message get latency -1 and throughput 0.
    """
    summed = messages.groupBy(*keys).agg(
        F.min(start).alias("started"),
        F.min(arrival).alias("first_arrival"),
        F.max(arrival).alias("last_arrival"),
        F.count(F.lit(1)).alias("records"),
        F.sum(payload_bytes()).alias("bytes"),
    )
    if expected is not None:
        summed = expected.join(summed, list(keys), "left")
    first = epoch_seconds(F.col("first_arrival"))
    last = epoch_seconds(F.col("last_arrival"))
    began = epoch_seconds(F.col("started"))
    active = F.coalesce(last - first, F.lit(0.0))
    size = F.coalesce(F.col("bytes"), F.lit(0))
    return summed.select(
        *keys,
        F.coalesce(F.col("records"), F.lit(0)).alias("records"),
        mib(size).alias("bytes_mb"),
        F.round(F.coalesce(first - began, F.lit(-1.0)), 2).alias("first_record_latency_s"),
        F.round(active, 2).alias("active_duration_s"),
        F.round(F.coalesce(last - began, F.lit(0.0)), 2).alias("consumer_total_s"),
        F.round(safe_ratio(size / F.lit(1048576.0), active), 6).alias("throughput_mbps"),
    )


def delivery_from_headers(
    messages: DataFrame,
    keys: Sequence[str] = (),
    header: str = "ts_produce",
    arrival: str = "timestamp",
) -> DataFrame:
    """End-to-end time from the smallest produce header to the last arrival."""
    summed = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(payload_bytes()).alias("bytes"),
        F.min(header_long("headers", header)).alias("first_produce_ms"),
        F.min(arrival).alias("first_arrival"),
        F.max(arrival).alias("last_arrival"),
    )
    last = epoch_seconds(F.col("last_arrival"))
    active = last - epoch_seconds(F.col("first_arrival"))
    end_to_end = last - F.col("first_produce_ms") / F.lit(1000.0)
    size = F.col("bytes") / F.lit(1048576.0)
    return summed.select(
        *keys,
        "messages",
        F.round(size, 2).alias("bytes_mb"),
        F.round(active, 2).alias("active_duration_s"),
        F.round(end_to_end, 2).alias("e2e_s"),
        F.round(F.try_divide(size, end_to_end), 6).alias("e2e_throughput_mbps"),
        F.round(F.try_divide(size, active), 6).alias("active_throughput_mbps"),
    )


def idle_slots(
    messages: DataFrame, keys: Sequence[str], timeout_s: int, arrival: str = "timestamp"
) -> DataFrame:
    """Arrivals summed over time slots as long as the timeout."""
    slot = floor_div(F.unix_micros(arrival), timeout_s * 1_000_000)
    return messages.groupBy(*keys, slot.alias("slot")).agg(
        F.min(arrival).alias("first_arrival"),
        F.max(arrival).alias("last_arrival"),
        F.count(F.lit(1)).alias("records"),
        F.sum(payload_bytes()).alias("bytes"),
    )


def _breaks_so_far(
    slots: DataFrame, keys: Sequence[str], timeout_s: int, strict: bool
) -> DataFrame:
    """The slots with ``breaks``: how many idle gaps lie before each.

    Two arrivals of one slot are always closer than the timeout, so a long gap can only lie
    between two slots, and a run always ends at the end of a slot: the slot sums are exact.
    """
    by_slot = Window.partitionBy(*keys).orderBy("slot")
    gap = F.unix_micros("first_arrival") - F.unix_micros(F.lag("last_arrival").over(by_slot))
    limit = F.lit(timeout_s * 1_000_000)
    ended = gap > limit if strict else gap >= limit
    breaks = slots.withColumn("breaks", F.when(ended, 1).otherwise(0))
    upto = by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return breaks.withColumn("breaks", F.sum("breaks").over(upto))


def idle_cutoff_from_slots(
    slots: DataFrame, keys: Sequence[str], timeout_s: int, strict: bool = False
) -> DataFrame:
    """Records before the first gap that reaches the timeout (``strict``: exceeds it)."""
    return (
        _breaks_so_far(slots, keys, timeout_s, strict)
        .groupBy(*keys)
        .agg(
            *[
                how(F.when(F.col("breaks") == 0, F.col(column))).alias(alias)
                for how, column, alias in (
                    (F.min, "first_arrival", "first_arrival"),
                    (F.max, "last_arrival", "last_arrival"),
                    (F.sum, "records", "records"),
                    (F.sum, "bytes", "bytes"),
                )
            ],
            F.coalesce(F.sum(F.when(F.col("breaks") > 0, F.col("records"))), F.lit(0)).alias(
                "records_after"
            ),
        )
    )


def idle_cutoff(
    messages: DataFrame,
    keys: Sequence[str],
    timeout_s: int,
    strict: bool = False,
    arrival: str = "timestamp",
) -> DataFrame:
    """Per run, what a reader sees that stops at the first idle gap."""
    return idle_cutoff_from_slots(
        idle_slots(messages, keys, timeout_s, arrival), keys, timeout_s, strict
    )


def keep_before_idle(
    messages: DataFrame,
    keys: Sequence[str],
    timeout_s: int,
    strict: bool = False,
    arrival: str = "timestamp",
) -> DataFrame:
    """The messages themselves up to the first idle gap."""
    ends = idle_cutoff(messages, keys, timeout_s, strict, arrival).select(
        *keys, F.col("last_arrival").alias("_until")
    )
    met = join_null_safe(messages, ends, list(keys))
    return met.filter(F.col(arrival) <= F.col("_until")).drop("_until")


def progress_marks(
    topic: DataFrame,
    every: int,
    keys: Sequence[str] = ("topic", "partition"),
    position: str = "offset",
    arrival: str = "timestamp",
) -> DataFrame:
    """State at every ``every``-th message of a partition: count, MiB, elapsed time, rate.

    Messages are counted along the positions, which may start anywhere and have gaps.  Only keys,
    position, arrival and size of a message are shuffled.
    """
    keys = list(keys)
    narrow = topic.select(*keys, position, F.col(arrival).alias("mark_arrival"), payload_bytes().alias("_size"))
    started = narrow.groupBy(*keys).agg(F.min_by("mark_arrival", position).alias("started"))
    counted = running_totals(
        narrow, keys, position, {"records": F.lit(1).cast("long"), "bytes": F.col("_size")}
    )
    marks = counted.filter(F.pmod("records", F.lit(every)) == 0)
    running = join_null_safe(marks, started, keys)
    elapsed = epoch_seconds(F.col("mark_arrival")) - epoch_seconds(F.col("started"))
    return running.select(
        *keys,
        F.col("records").alias("running_records"),
        F.round(F.col("bytes") / F.lit(1048576.0), 4).alias("running_mb"),
        F.round(elapsed, 2).alias("elapsed_s"),
        F.round(safe_ratio(F.col("records"), elapsed), 4).alias("records_per_sec"),
    )


def reconcile_counts(sent: DataFrame, received: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sent against received per run; runs known to one side only count 0 on the other.  One sum over
    both sides, in which a null run is a run like any other."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    left = sent.select(*keys, one.alias("sent"), none.alias("received"))
    right = received.select(*keys, none.alias("sent"), one.alias("received"))
    both = left.unionByName(right).groupBy(*keys)
    both = both.agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
    return both.withColumn("missing", F.col("sent") - F.col("received"))


def reconcile_idle(
    messages: DataFrame,
    keys: Sequence[str],
    timeout_s: int,
    strict: bool = False,
    arrival: str = "timestamp",
) -> DataFrame:
    """All that was sent against what a reader saw that left at the first idle gap, from one sum over
    slots; a message without an arrival time was sent and not received."""
    slots = idle_slots(messages, keys, timeout_s, arrival)
    seen = (F.col("breaks") == 0) & F.col("slot").isNotNull()
    both = _breaks_so_far(slots, keys, timeout_s, strict).groupBy(*keys).agg(
        F.sum("records").alias("sent"),
        F.coalesce(F.sum(F.when(seen, F.col("records"))), F.lit(0).cast("long")).alias("received"),
    )
    return both.withColumn("missing", F.col("sent") - F.col("received"))


def merge_run_metrics(job: DataFrame, consumer: DataFrame, on: str = "run_id") -> DataFrame:
    """Job metrics and reader metrics of a run in one row; a lost reader log leaves nulls."""
    return job.join(consumer, on, "left")


def truncated_sum(*phases: str) -> Column:
    """Delivery time of a run made of phases timed separately: whole seconds of each, added."""
    total = F.lit(0).cast("long")
    for phase in phases:
        total = total + F.coalesce(F.floor(F.col(phase)), F.lit(0))
    return total


def group_rates(
    topic: DataFrame, groups: int, keys: Sequence[str] = ("topic",), arrival: str = "timestamp"
) -> DataFrame:
    """Every reader group reads the whole topic: its records, bytes and rate.

    All groups see the same messages, so the topic is summed once and the sums are repeated.
    """
    summed = topic.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(payload_bytes()).alias("bytes"),
        (epoch_seconds(F.max(arrival)) - epoch_seconds(F.min(arrival))).alias("seconds"),
    )
    numbers = F.explode(F.sequence(F.lit(1), F.lit(groups)))
    rated = rate_stats(summed, "records", "bytes", "seconds")
    return rated.select(
        *keys, numbers.alias("group_no"), "records", "bytes", "records_per_sec", "mb_per_sec"
    )


def overlap_summary(messages: DataFrame, keys: Sequence[str], produced: str, arrived: str) -> DataFrame:
    """Producer and consumer of one run side by side: a row each, and the seconds both ran."""
    summed = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(payload_bytes()).alias("bytes"),
        *[
            how(column).alias(f"{label}_{edge}")
            for label, column in (("producer", produced), ("consumer", arrived))
            for edge, how in (("first", F.min), ("last", F.max))
        ],
    )
    both = F.least("producer_last", "consumer_last"), F.greatest("producer_first", "consumer_first")
    overlap = F.greatest(epoch_seconds(both[0]) - epoch_seconds(both[1]), F.lit(0.0))
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"e2e-{side}").alias("test_type"),
                    F.col(f"{side}_first").alias("first"),
                    F.col(f"{side}_last").alias("last"),
                )
                for side in ("producer", "consumer")
            ]
        )
    )
    rows = summed.select(*keys, "records", "bytes", overlap.alias("overlap_s"), sides.alias("side"))
    seconds = epoch_seconds(F.col("side.last")) - epoch_seconds(F.col("side.first"))
    timed = rows.withColumn("seconds", seconds)
    return rate_stats(timed, "records", "bytes", "seconds").select(
        *keys,
        F.col("side.test_type").alias("test_type"),
        "records",
        "bytes",
        F.round("seconds", 2).alias("seconds"),
        F.round("overlap_s", 2).alias("overlap_s"),
        "records_per_sec",
        "mb_per_sec",
    )
