"""Queries over counts, delivery measures and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrytrace.operators import delivery, results
from ferrytrace.operators.filters import keep_listed
from ferrytrace.operators.ordered import dense_index, take_first
from ferrytrace.operators.packing import chunk_by_bytes, pack_messages
from ferrytrace.plans.registry import (
    EVENT_COLUMNS,
    SWEEP_SQL,
    TOPIC_SQL,
    WANTED,
    WANTED_SQL,
    query,
    topic_view,
)
from ferrytrace.plans.scans import packed_sql
from ferrytrace.functions.measures import records_per_pack
from ferrytrace.sources.topics import topic_depth

IDLE_S = 600
MARK_EVERY = 100
CHUNK_BYTES = 32 * 1024


@query("count_rows", "SELECT count(*) AS records FROM lineitem")
def count_rows(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("records"))


@query(
    "filter_stats",
    f"""WITH c AS (SELECT count(*) AS raw_records, count(*) FILTER ({WANTED_SQL}) AS filtered_records FROM events)
        SELECT *, round(filtered_records / raw_records::DOUBLE, 4) AS filter_ratio,
               round(2097152.0::DOUBLE * (filtered_records / raw_records::DOUBLE) / 1048576, 1) AS estimated_filtered_mb
        FROM c""",
)
def filter_stats(t):
    passes = F.col("event_type").isin(WANTED)
    return delivery.filter_stats(t.events, passes, 2 * 1024 * 1024)


@query(
    "rate_stats",
    f"""WITH {TOPIC_SQL}, s AS (
          SELECT run, count(*) AS records, sum(bytes)::BIGINT AS bytes,
                 max(arrival_us) / 1e6 - min(arrival_us) / 1e6 AS seconds FROM topic GROUP BY 1)
        SELECT run, records, bytes, round(records / seconds, 2) AS records_per_sec,
               round(bytes / 1048576.0::DOUBLE / seconds, 4) AS mb_per_sec FROM s""",
)
def rate_stats(t):
    summed = t.messages().groupBy("run").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.octet_length("value")).alias("bytes"),
        (
            F.unix_micros(F.max("arrival")) / F.lit(1e6) - F.unix_micros(F.min("arrival")) / F.lit(1e6)
        ).alias("seconds"),
    )
    return delivery.rate_stats(summed, "records", "bytes", "seconds").drop("seconds")


@query("pack_messages", packed_sql(146))
def pack(t):
    rows = t.events.select(*EVENT_COLUMNS)
    return pack_messages(rows, ["event_id"], records_per_pack(10), EVENT_COLUMNS)


@query("topic_depth", "SELECT 'events' AS topic, count(*) AS depth FROM events")
def depth(t):
    return topic_depth(t.published().read(t.spark, "events"))


@query("topic_offset_sum", f"WITH {TOPIC_SQL} SELECT sum(pos)::BIGINT AS offset_sum FROM topic")
def topic_offset_sum(t):
    topic = t.published().read(t.spark, "events")
    return topic.agg(F.sum("offset").alias("offset_sum"))


@query(
    "delivery_summary",
    f"""WITH {TOPIC_SQL}, s AS (
          SELECT run, min(ts_us) / 1e6 AS began, min(arrival_us) / 1e6 AS first, max(arrival_us) / 1e6 AS last,
                 count(*) AS records, sum(bytes) AS bytes FROM topic GROUP BY 1)
        SELECT run, records, round(bytes / 1048576.0::DOUBLE, 2) AS bytes_mb,
               round(first - began, 2) AS first_record_latency_s, round(last - first, 2) AS active_duration_s,
               round(last - began, 2) AS consumer_total_s,
               round(bytes / 1048576.0::DOUBLE / (last - first), 6) AS throughput_mbps
        FROM s""",
)
def delivery_summary(t):
    return delivery.delivery_summary(t.messages(), ["run"], F.col("timestamp"), "arrival")


@query(
    "delivery_from_headers",
    f"""WITH {TOPIC_SQL}, s AS (
          SELECT run, min(ts_us // 1000) / 1e3 AS began, min(arrival_us) / 1e6 AS first, max(arrival_us) / 1e6 AS last,
                 count(*) AS messages, sum(bytes) / 1048576.0::DOUBLE AS mb FROM topic GROUP BY 1)
        SELECT run, messages, round(mb, 2) AS bytes_mb, round(last - first, 2) AS active_duration_s,
               round(last - began, 2) AS e2e_s, round(mb / (last - began), 6) AS e2e_throughput_mbps,
               round(mb / (last - first), 6) AS active_throughput_mbps FROM s""",
)
def delivery_from_headers(t):
    return delivery.delivery_from_headers(t.messages(), ["run"], arrival="arrival")


@query(
    "merge_run_metrics",
    f"""WITH {TOPIC_SQL}, job AS (
          SELECT run AS run_id, count(*) AS filtered_records, avg(event_id) AS read_s, avg(bytes) AS write_s
          FROM topic GROUP BY 1),
        seen AS (
          SELECT run AS run_id, count(*) AS consumer_records, sum(bytes)::BIGINT AS consumer_bytes
          FROM topic GROUP BY 1)
        SELECT run_id, filtered_records, floor(read_s)::BIGINT + floor(write_s)::BIGINT AS delivery_s,
               consumer_records, consumer_bytes
        FROM job LEFT JOIN seen USING (run_id)""",
)
def merge_run_metrics(t):
    """Job side and reader side per run."""
    messages = t.messages().withColumn("bytes", F.octet_length("value").cast("long"))
    job = messages.groupBy(F.col("run").alias("run_id")).agg(
        F.count(F.lit(1)).alias("filtered_records"),
        F.avg("event_id").alias("read_s"),
        F.avg("bytes").alias("write_s"),
    )
    seen = messages.groupBy(F.col("run").alias("run_id")).agg(
        F.count(F.lit(1)).alias("consumer_records"), F.sum("bytes").alias("consumer_bytes")
    )
    job = job.withColumn("delivery_s", delivery.truncated_sum("read_s", "write_s"))
    return delivery.merge_run_metrics(job.drop("read_s", "write_s"), seen)


IDLE_SQL = f"""gaps AS (
  SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY run ORDER BY ts_us) AS gap FROM topic),
breaks AS (
  SELECT *, sum(CASE WHEN gap >= {IDLE_S * 1000000} THEN 1 ELSE 0 END)
            OVER (PARTITION BY run ORDER BY ts_us RANGE UNBOUNDED PRECEDING) AS broken FROM gaps)"""


@query(
    "reconcile_counts",
    f"""WITH {TOPIC_SQL}, {IDLE_SQL}
        SELECT run, count(*) AS sent, count(*) FILTER (broken = 0) AS received,
               count(*) - count(*) FILTER (broken = 0) AS missing FROM breaks GROUP BY 1""",
)
def reconcile_counts(t):
    """All that was sent against what a reader saw that left at the first idle gap."""
    return delivery.reconcile_idle(t.messages(), ["run"], IDLE_S)


@query(
    "idle_cutoff",
    f"""WITH {TOPIC_SQL}, {IDLE_SQL}
        SELECT run, min(ts_us) AS first_us, max(ts_us) FILTER (broken = 0) AS last_us,
               count(*) FILTER (broken = 0) AS records, (sum(bytes) FILTER (broken = 0))::BIGINT AS bytes,
               count(*) FILTER (broken > 0) AS records_after FROM breaks GROUP BY 1""",
)
def idle_cutoff(t):
    ended = delivery.idle_cutoff(t.messages(), ["run"], IDLE_S)
    return ended.select(
        "run",
        F.unix_micros("first_arrival").alias("first_us"),
        F.unix_micros("last_arrival").alias("last_us"),
        "records",
        "bytes",
        "records_after",
    )


@query(
    "progress_marks",
    f"""WITH {TOPIC_SQL}, r AS (
          SELECT part, pos, ts_us, count(*) OVER w AS n, sum(bytes) OVER w AS b,
                 first_value(ts_us) OVER w AS started
          FROM topic WINDOW w AS (PARTITION BY part ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT part, n AS running_records, round(b / 1048576.0::DOUBLE, 4) AS running_mb,
               round(ts_us / 1e6 - started / 1e6, 2) AS elapsed_s,
               round(n / (ts_us / 1e6 - started / 1e6), 4) AS records_per_sec
        FROM r WHERE n % {MARK_EVERY} = 0""",
)
def progress_marks(t):
    marks = delivery.progress_marks(t.topic(), MARK_EVERY)
    return marks.withColumnRenamed("partition", "part").drop("topic")


@query(
    "dense_index",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ix
       FROM events""",
)
def dense(t):
    rows = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    return dense_index(rows, ["at", "event_id"], ["event_type"]).drop("at")


@query(
    "chunk_by_bytes",
    f"""WITH {TOPIC_SQL}, r AS (
          SELECT part, pos, bytes, sum(bytes) OVER (PARTITION BY part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto
          FROM topic)
        SELECT part, ((upto - 1) // {CHUNK_BYTES})::BIGINT AS chunk, min(pos) AS first_offset, max(pos) AS last_offset,
               count(*) AS records, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1, 2""",
)
def chunks(t):
    summed = chunk_by_bytes(t.topic(), CHUNK_BYTES)
    return summed.withColumnRenamed("partition", "part").drop("topic")


@query(
    "take_target",
    f"""WITH {TOPIC_SQL} SELECT part, pos, key, value, ts_us FROM topic
        ORDER BY ts_us, pos, part LIMIT 2500""",
)
def take_target(t):
    """A reader with a target stops after that many messages, in arrival order."""
    topic = t.published().read(t.spark, "events")
    return topic_view(take_first(topic, ["timestamp", "offset", "partition"], 2500))


@query(
    "take_sample",
    f"""WITH {TOPIC_SQL} SELECT part, pos, key, value, ts_us FROM topic ORDER BY pos, part LIMIT 5""",
)
def take_sample(t):
    """The first five messages, as a probe for data.  Offsets are dense from 0, so none of them has a
    higher one, and the scan can skip the rest."""
    topic = t.published().read(t.spark, "events").filter(F.col("offset") < 5)
    return topic_view(topic.orderBy("offset", "partition").limit(5))


@query(
    "fan_out_groups_batch",
    f"""WITH {TOPIC_SQL}, s AS (
          SELECT count(*) AS records, sum(bytes)::BIGINT AS bytes, max(ts_us) / 1e6 - min(ts_us) / 1e6 AS seconds FROM topic)
        SELECT g::INTEGER AS group_no, records, bytes, round(records / seconds, 2) AS records_per_sec,
               round(bytes / 1048576.0::DOUBLE / seconds, 4) AS mb_per_sec FROM s, range(1, 4) AS r(g)""",
)
def fan_out_groups_batch(t):
    return delivery.group_rates(t.topic(), 3).drop("topic")


@query(
    "e2e_overlap",
    f"""WITH {TOPIC_SQL}, s AS (
          SELECT run, count(*) AS records, sum(bytes)::BIGINT AS bytes, min(ts_us) AS pf, max(ts_us) AS pl,
                 min(arrival_us) AS cf, max(arrival_us) AS cl FROM topic GROUP BY 1),
        sides AS (
          SELECT *, 'e2e-producer' AS test_type, pl / 1e6 - pf / 1e6 AS seconds FROM s
          UNION ALL SELECT *, 'e2e-consumer', cl / 1e6 - cf / 1e6 FROM s)
        SELECT run, test_type, records, bytes, round(seconds, 2) AS seconds,
               round(greatest(least(pl, cl) / 1e6 - greatest(pf, cf) / 1e6, 0), 2) AS overlap_s,
               round(records / seconds, 2) AS records_per_sec,
               round(bytes / 1048576.0::DOUBLE / seconds, 4) AS mb_per_sec FROM sides""",
)
def e2e_overlap(t):
    return delivery.overlap_summary(t.messages(), ["run"], "timestamp", "arrival")


# Sweep reports.


@query(
    "replicate_mean",
    f"""WITH {SWEEP_SQL}, grid AS (
          SELECT s.size, p.partitions FROM (SELECT DISTINCT size FROM sweep) s, planned p),
        means AS (SELECT size, partitions, avg(mb_per_sec) AS mean FROM sweep WHERE acks = 'O' GROUP BY 1, 2)
        SELECT size, partitions, round(coalesce(mean, 0), 4) AS mean, mean IS NOT NULL AS measured
        FROM grid LEFT JOIN means USING (size, partitions)""",
)
def replicate_mean(t):
    sweep = t.sweep()
    keys = ["size", "partitions"]
    grid = results.grid_of(sweep, keys, t.planned())
    means = results.replicate_mean(sweep.filter(F.col("acks") == "O"), keys, "mb_per_sec", grid)
    return means.withColumn("mean", F.round("mean", 4))


@query(
    "replicate_mean_std",
    f"""WITH {SWEEP_SQL} SELECT size, partitions, round(avg(mb_per_sec), 4) AS mean,
               round(stddev_pop(mb_per_sec), 4) AS std, count(*) AS runs FROM sweep GROUP BY 1, 2""",
)
def replicate_mean_std(t):
    spread = results.replicate_mean_std(t.sweep(), ["size", "partitions"], "mb_per_sec")
    return spread.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "replicate_cv",
    f"""WITH {SWEEP_SQL} SELECT size, partitions, acks, round(avg(mb_per_sec), 4) AS avg, min(mb_per_sec) AS min,
               max(mb_per_sec) AS max, round(stddev_pop(mb_per_sec) / avg(mb_per_sec) * 100, 4) AS cv_pct
        FROM sweep GROUP BY 1, 2, 3""",
)
def replicate_cv(t):
    spread = results.replicate_cv(t.sweep(), ["size", "partitions", "acks"], "mb_per_sec")
    return spread.withColumns({c: F.round(c, 4) for c in ("avg", "cv_pct")})


@query(
    "approach_compare",
    """SELECT o_orderpriority AS approach, round(sum(cents) / count(*)::DOUBLE / 100, 4) AS mean_e2e_s,
              round(avg(o_custkey), 4) AS mean_first_record_s, count(*) AS runs
       FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders) GROUP BY 1""",
)
def approach_compare(t):
    runs = t.orders.select(
        F.col("o_orderpriority").alias("approach"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        "o_custkey",
    )
    means = results.approach_means(runs, "approach", "cents", "o_custkey")
    return means.withColumns(
        {
            "mean_e2e_s": F.round(F.col("mean_e2e_s") / 100, 4),
            "mean_first_record_s": F.round("mean_first_record_s", 4),
        }
    )


@query(
    "first_match_metric",
    f"""WITH {SWEEP_SQL}, grid AS (
          SELECT s.size, p.partitions FROM (SELECT DISTINCT size FROM sweep) s, planned p),
        firsts AS (
          SELECT DISTINCT ON (size, partitions) size, partitions, mb_per_sec FROM sweep
          WHERE acks = 'F'
          ORDER BY size, partitions, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
        SELECT size, partitions, coalesce(mb_per_sec, 0) AS mb_per_sec, mb_per_sec IS NOT NULL AS measured
        FROM grid LEFT JOIN firsts USING (size, partitions)""",
)
def first_match_metric(t):
    from ferrytrace.plans.registry import LINE_ORDER

    sweep = t.sweep()
    keys = ["size", "partitions"]
    grid = results.grid_of(sweep, keys, t.planned())
    return results.first_match(sweep.filter(F.col("acks") == "F"), keys, "mb_per_sec", LINE_ORDER, grid)
