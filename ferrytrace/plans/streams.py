"""Queries over streams, each drained and compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrytrace.functions.measures import safe_ratio
from ferrytrace.functions.messages import header_text
from ferrytrace.operators.packing import chunk_summary
from ferrytrace.plans.aggregates import CHUNK_BYTES, IDLE_S
from ferrytrace.plans.registry import (
    EVENT_JSON_SQL,
    TOPIC_SQL,
    WANTED,
    WANTED_SQL,
    key_value_view,
    query,
)
from ferrytrace.streaming import flows


@query(
    "stream_parse_project",
    "SELECT k::INTEGER AS number, k * k * k AS cubed FROM (SELECT json_extract(props, '$.k')::BIGINT AS k FROM events)",
)
def stream_parse_project(t):
    renamed = F.regexp_replace("props", '"k"', '"number"')
    stream = t.event_stream().select(renamed.alias("value"))
    parsed = flows.parse_and_cube(stream, "number int")
    target = t.area("parsed")
    flows.drain(flows.append_files(parsed, target, t.area("checkpoint")))
    return t.spark.read.parquet(target)


@query(
    "stream_filter_deliver",
    f"SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value FROM events WHERE {WANTED_SQL}",
)
def stream_filter_deliver(t):
    events = t.event_stream()
    texts = events.select(*[F.col(c).cast("string").alias(c) for c in events.columns])
    topics = t.topics()
    flows.drain(
        flows.filter_and_deliver(
            texts, "event_type", WANTED, "user_id", topics, "kept", ["event_id"], t.area("checkpoint")
        )
    )
    return key_value_view(topics.read(t.spark, "kept"))


@query(
    "stream_replicate",
    f"""WITH {TOPIC_SQL} SELECT 'source.events' AS topic, part, pos, key, value, ts_us,
               (ts_us // 1000)::VARCHAR AS ts_produce FROM topic""",
)
def stream_replicate(t):
    stream = t.published().read_stream(t.spark, "events")
    target = t.topics()
    flows.drain(flows.replicate(stream, target, t.area("checkpoint"), names=["events"]))
    copied = target.read(t.spark, "source.events")
    return copied.select(
        "topic",
        F.col("partition").alias("part"),
        F.col("offset").alias("pos"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.unix_micros("timestamp").alias("ts_us"),
        header_text("headers", "ts_produce").alias("ts_produce"),
    )


@query(
    "stream_chunk_transfer",
    f"""WITH {TOPIC_SQL}, r AS (
          SELECT part, pos, bytes, sum(bytes) OVER (PARTITION BY part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto
          FROM topic)
        SELECT part, ((upto - 1) // {CHUNK_BYTES})::BIGINT AS chunk, min(pos) AS first_offset, max(pos) AS last_offset,
               count(*) AS records, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1, 2""",
)
def stream_chunk_transfer(t):
    stream = t.published().read_stream(t.spark, "events")
    target = t.area("chunks")
    flows.drain(flows.transfer_chunks(stream, CHUNK_BYTES, target, t.area("checkpoint")))
    moved = chunk_summary(t.spark.read.parquet(f"{target}/messages"))
    return moved.withColumnRenamed("partition", "part").drop("topic")


@query(
    "stream_delivery_monitor",
    f"""WITH gaps AS (
          SELECT event_type AS run, epoch_us(ts) AS ts_us, strlen(props) AS bytes,
                 epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events),
        breaks AS (
          SELECT *, sum(CASE WHEN gap >= {IDLE_S * 1000000} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY run ORDER BY ts_us RANGE UNBOUNDED PRECEDING) AS broken FROM gaps)
        SELECT run, min(ts_us) AS first_us, max(ts_us) FILTER (broken = 0) AS last_us,
               count(*) FILTER (broken = 0) AS records, (sum(bytes) FILTER (broken = 0))::BIGINT AS bytes,
               count(*) FILTER (broken > 0) AS records_after FROM breaks GROUP BY 1""",
)
def stream_delivery_monitor(t):
    """Live sums per run; the idle end is read off closed and open sessions."""
    stream = t.event_stream().select(
        F.col("event_type").alias("run"), F.col("ts").alias("timestamp"), F.col("props").alias("value")
    )
    target, checkpoint = t.area("monitor"), t.area("checkpoint")
    flows.drain(flows.monitor_delivery(stream, ["run"], IDLE_S, target, checkpoint))
    layout = flows.delivery_sessions(stream, ["run"], IDLE_S).schema
    ended = flows.idle_end(flows.monitored_sessions(t.spark, layout, target, checkpoint), ["run"])
    return ended.select(
        "run",
        F.unix_micros("first_arrival").alias("first_us"),
        F.unix_micros("last_arrival").alias("last_us"),
        "records",
        "bytes",
        "records_after",
    )


READER_TARGET = 400


@query(
    "stream_reader_end",
    f"""WITH gaps AS (
          SELECT event_type AS run, epoch_us(ts) AS ts_us, strlen(props) AS bytes,
                 row_number() OVER w AS n, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, strlen(props))),
        breaks AS (
          SELECT *, sum(CASE WHEN gap >= {IDLE_S * 1000000} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY run ORDER BY n) AS broken FROM gaps),
        ends AS (
          SELECT run, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS records, sum(bytes)::BIGINT AS bytes,
                 CASE WHEN count(*) = {READER_TARGET} THEN 'target' ELSE 'idle' END AS ended
          FROM breaks WHERE broken = 0 AND n <= {READER_TARGET} GROUP BY 1)
        SELECT * FROM ends
        WHERE last_us + CASE WHEN ended = 'idle' THEN {IDLE_S * 1000000} ELSE 0 END
              <= ((SELECT max(epoch_us(ts)) FROM events) // 1000 - 1) * 1000""",
)
def stream_reader_end(t):
    """Where a live reader of each run stops: at its first idle gap or after so many messages."""
    stream = t.event_stream().select(
        F.col("event_type").alias("run"), F.col("ts").alias("timestamp"), F.col("props").alias("value")
    )
    target = t.area("ends")
    ends = flows.reader_ends(stream, ["run"], IDLE_S, READER_TARGET)
    flows.drain(flows.append_files(ends, target, t.area("checkpoint")))
    return t.spark.read.schema(ends.schema).parquet(target)


@query(
    "fan_out_groups",
    f"""WITH {TOPIC_SQL}, s AS (
          SELECT count(*) AS records, sum(bytes)::BIGINT AS bytes, max(ts_us) / 1e6 - min(ts_us) / 1e6 AS seconds FROM topic)
        SELECT g::INTEGER AS group_no, records, bytes, round(records / seconds, 2) AS records_per_sec
        FROM s, range(1, 3) AS r(g)""",
)
def fan_out_groups(t):
    """Two reader groups, each a query with its own progress over the same topic."""
    topics = t.published()
    target = t.area("groups")
    sources = [topics.read_stream(t.spark, "events") for _ in range(2)]
    for running in flows.read_by_groups(sources, target, t.area("checkpoint")):
        flows.drain(running)
    # Each group directory is the output of one stream, read through that stream's own log.
    seen = [
        t.spark.read.parquet(f"{target}/group_no={n}").withColumn("group_no", F.lit(n))
        for n in (1, 2)
    ]
    summed = seen[0].unionByName(seen[1]).groupBy("group_no").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("bytes").alias("bytes"),
        (
            F.unix_micros(F.max("timestamp")) / F.lit(1e6)
            - F.unix_micros(F.min("timestamp")) / F.lit(1e6)
        ).alias("seconds"),
    )
    return summed.withColumn(
        "records_per_sec", F.round(safe_ratio(F.col("records"), F.col("seconds")), 2)
    ).drop("seconds")
