"""Delivery measures against plain Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from ferrytrace.operators import delivery


def _messages(spark, rows):
    df = spark.createDataFrame(rows, "run string, us long, value string")
    return df.withColumn("timestamp", F.timestamp_micros("us"))


def _loop_cutoff(times, limit, strict):
    kept = []
    for t in sorted(times):
        if kept and (t - kept[-1] > limit if strict else t - kept[-1] >= limit):
            break
        kept.append(t)
    return kept


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_idle_cutoff_matches_a_loop(spark, seed, strict):
    rng = random.Random(seed)
    limit = 10_000_000
    rows, times = [], {}
    for run in ("a", "b", "c"):
        now = rng.randrange(10**15)
        for _ in range(200):
            now += rng.choice([1, 500_000, limit - 1, limit if rng.random() < 0.03 else 7, limit + 1 if rng.random() < 0.03 else 9])
            rows.append((run, now, "xy"))
            times.setdefault(run, []).append(now)
    got = delivery.idle_cutoff(_messages(spark, rows), ["run"], 10, strict).select(
        "run", "records", "bytes", "records_after", F.unix_micros("last_arrival").alias("last")
    )
    for row in got.collect():
        kept = _loop_cutoff(times[row.run], limit, strict)
        assert (row.records, row.last, row.bytes) == (len(kept), kept[-1], 2 * len(kept))
        assert row.records_after == len(times[row.run]) - len(kept)


def test_gap_equal_to_the_timeout(spark):
    messages = _messages(spark, [("a", 0, "x"), ("a", 10_000_000, "x")])
    assert delivery.idle_cutoff(messages, ["run"], 10).first().records == 1
    assert delivery.idle_cutoff(messages, ["run"], 10, strict=True).first().records == 2


def test_times_before_1970(spark):
    messages = _messages(spark, [("a", -9_000_000, "x"), ("a", 9_000_000, "x"), ("a", 9_500_000, "x")])
    assert delivery.idle_cutoff(messages, ["run"], 10).first().records == 1


def test_keep_before_idle_keeps_rows(spark):
    messages = _messages(spark, [("a", 0, "x"), ("a", 1, "y"), ("a", 60_000_000, "z"), ("b", 5, "w")])
    kept = delivery.keep_before_idle(messages, ["run"], 30).collect()
    assert sorted(r.value for r in kept) == ["w", "x", "y"]


def test_delivery_summary_of_an_empty_run(spark):
    messages = _messages(spark, [("a", 2_000_000, "x" * 1048576), ("a", 4_000_000, None)])
    expected = spark.createDataFrame([("a",), ("silent",)], "run string")
    start = F.timestamp_micros(F.lit(1_000_000))
    got = {r.run: r for r in delivery.delivery_summary(messages, ["run"], start, expected=expected).collect()}
    a, silent = got["a"], got["silent"]
    assert (a.records, a.bytes_mb, a.first_record_latency_s, a.active_duration_s) == (2, 1.0, 1.0, 2.0)
    assert (a.consumer_total_s, a.throughput_mbps) == (3.0, 0.5)
    assert (silent.records, silent.first_record_latency_s, silent.throughput_mbps) == (0, -1.0, 0.0)


def test_end_to_end_needs_a_usable_header(spark):
    rows = [
        ("a", 5_000_000, [("ts_produce", b"3000")]),
        ("a", 9_000_000, [("ts_produce", b"oops")]),
        ("a", 7_000_000, None),
        ("b", 7_000_000, []),
    ]
    df = spark.createDataFrame(rows, "run string, us long, headers array<struct<key: string, value: binary>>")
    messages = df.select("run", F.timestamp_micros("us").alias("timestamp"), "headers", F.lit("x").alias("value"))
    got = {r.run: r for r in delivery.delivery_from_headers(messages, ["run"]).collect()}
    assert got["a"].e2e_s == 6.0 and got["a"].active_duration_s == 4.0
    assert got["b"].e2e_s is None and got["b"].active_throughput_mbps is None


@pytest.mark.parametrize("every", [1, 7, 100, 20_000])
def test_progress_marks(spark, every):
    n = 40_000 if every > 100 else 250
    topic = spark.range(n).select(
        F.lit("t").alias("topic"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("partition"),
        F.floor(F.col("id") / 3).alias("third"),
        F.col("id"),
    )
    topic = topic.select(
        "topic",
        "partition",
        F.when(F.col("partition") == 1, F.col("third")).otherwise(F.col("id") - F.col("third") - 1).alias("offset"),
        F.timestamp_micros(F.col("id") * 1_000_000).alias("timestamp"),
        F.lit("ab").alias("value"),
        "id",
    )
    got = delivery.progress_marks(topic, every).collect()
    by_partition = {}
    for row in topic.orderBy("partition", "offset").collect():
        by_partition.setdefault(row.partition, []).append(row.id)
    want = set()
    for partition, ids in by_partition.items():
        for count in range(every, len(ids) + 1, every):
            want.add((partition, count, float(ids[count - 1] - ids[0])))
    assert {(r.partition, r.running_records, r.elapsed_s) for r in got} == want


def test_reconcile_lists_both_sides(spark):
    sent = spark.createDataFrame([("a",), ("a",), ("b",)], "run string")
    received = spark.createDataFrame([("a",), ("c",)], "run string")
    got = {r.run: (r.sent, r.received, r.missing) for r in delivery.reconcile_counts(sent, received, ["run"]).collect()}
    assert got == {"a": (2, 1, 1), "b": (1, 0, 1), "c": (0, 1, -1)}


def test_filter_stats(spark):
    df = spark.createDataFrame([("LU",), ("FR",), (None,), ("FR",)], "c string")
    row = delivery.filter_stats(df, F.col("c").isin("LU"), 8 * 1048576).first()
    assert (row.raw_records, row.filtered_records, row.filter_ratio, row.estimated_filtered_mb) == (4, 1, 0.25, 2.0)
    empty = delivery.filter_stats(df.filter("false"), F.col("c").isin("LU"), 5.0).first()
    assert (empty.raw_records, empty.filter_ratio) == (0, 0.0)


def test_truncated_sum(spark):
    df = spark.createDataFrame([(1.9, 2.9, None)], "a double, b double, c double")
    assert df.select(delivery.truncated_sum("a", "b", "c").alias("s")).first().s == 3


def test_groups_see_the_whole_topic(spark):
    messages = _messages(spark, [("a", 0, "xx"), ("a", 2_000_000, "yy")])
    got = delivery.group_rates(messages, 3, ["run"]).collect()
    assert sorted(r.group_no for r in got) == [1, 2, 3]
    assert {(r.records, r.bytes, r.records_per_sec) for r in got} == {(2, 4, 1.0)}


def test_overlap(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 10, 12)], "run string, p long, c long")
    timed = df.select(
        "run",
        F.timestamp_micros(F.col("p") * 1_000_000).alias("p"),
        F.timestamp_micros(F.col("c") * 1_000_000).alias("c"),
        F.lit("v").alias("value"),
    )
    got = {r.test_type: r for r in delivery.overlap_summary(timed, ["run"], "p", "c").collect()}
    assert got["e2e-producer"].seconds == 10.0 and got["e2e-consumer"].seconds == 7.0
    assert got["e2e-producer"].overlap_s == 5.0
