"""Queries over logs: one user is one log, the user's events are its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrytrace.operators import logs
from ferrytrace.plans.registry import query
from ferrytrace.session import written

K_SQL = "json_extract(props, '$.k')::INTEGER"


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _lines(t, *texts: Column) -> DataFrame:
    """Each event gives the lines ``texts`` in that order."""
    events = t.events.select(
        F.col("user_id").alias("log"),
        "event_id",
        "value",
        "event_type",
        F.from_json("props", "k int")["k"].alias("k"),
    )
    lines = F.posexplode(F.array(*texts)).alias("n", "line")
    return events.select("log", "event_id", lines).select(
        "log", (F.col("event_id") * len(texts) + F.col("n")).alias("line_ix"), "line"
    )


def _progress() -> Column:
    return F.concat(
        _text("event_id"), F.lit(" records sent, "), _text("value"), F.lit(" records/sec ("),
        _text("k"), F.lit(" MB/sec), "), _text("value"), F.lit(" ms avg latency, "),
        _text("event_id"), F.lit(".0 ms max latency."),
    )


def _summary() -> Column:
    return F.concat(
        _progress(), F.lit(" "), _text("k"), F.lit(" ms 50th, 30 ms 95th, "),
        _text("event_id"), F.lit(" ms 99th, 42 ms 99.9th."),
    )


def _last_sql(**columns: str) -> str:
    """Each column's value on the last event of a user."""
    picked = ", ".join(f"arg_max({sql}, event_id) AS {name}" for name, sql in columns.items())
    return f"SELECT user_id AS log, {picked} FROM events GROUP BY 1"


PRODUCER_SQL = _last_sql(
    records_per_sec="value",
    mb_per_sec=f"{K_SQL}::DOUBLE",
    avg_latency_ms="value",
    max_latency_ms="event_id::DOUBLE",
)


@query("log_producer_perf", f"SELECT *, false AS failed FROM ({PRODUCER_SQL})")
def log_producer_perf(t):
    """Interim lines come first; the last summary counts."""
    return logs.producer_perf(_lines(t, F.lit("starting"), _progress(), F.lit("metric,value")))


@query("log_percentiles", _last_sql(p50_latency_ms=f"{K_SQL}::DOUBLE", p99_latency_ms="event_id::DOUBLE"))
def log_percentiles(t):
    return logs.percentiles(_lines(t, _progress(), _summary()))


@query(
    "log_latency_sketches",
    """SELECT l_returnflag || l_linestatus AS log, count(*) AS records, min(l_extendedprice) AS least_ms,
              max(l_extendedprice) AS greatest_ms, true AS p50_within, true AS p99_within
       FROM lineitem GROUP BY 1""",
)
def log_latency_sketches(t):
    """Percentiles over raw latencies (prices stand in), from sketches stored for each run (line number)
    and united over them; whether their true ranks are within the stated error (with a margin of two)."""
    log = F.concat("l_returnflag", "l_linestatus").alias("log")
    runs = t.lineitem.select(log, "l_linenumber", "l_extendedprice")
    stored = written(logs.latency_sketches(runs, ["log", "l_linenumber"], "l_extendedprice"), "sketches")
    shares = {"p50": 0.5, "p99": 0.99}
    found = logs.sketch_quantiles(logs.merge_sketches(stored, ["log"]), shares)
    value, off = F.col("l_extendedprice"), 2 * logs.rank_error()
    ranks = runs.join(found.select("log", *shares), "log").groupBy("log").agg(
        *[
            (
                (F.count_if(value <= F.col(name)) / F.count(value) >= share - off)
                & (F.count_if(value < F.col(name)) / F.count(value) <= share + off)
            ).alias(f"{name}_within")
            for name, share in shares.items()
        ]
    )
    return found.join(ranks, "log").select(
        "log", "records", F.col("least").alias("least_ms"), F.col("greatest").alias("greatest_ms"), "p50_within", "p99_within"
    )


_HEADER_LINE = "start.time, end.time, data.consumed.in.MB, MB.sec, data.consumed.in.nMsg, nMsg.sec"


def _consumer_line() -> Column:
    return F.concat_ws(
        ", ", F.lit("10:00:00"), F.lit("10:00:09"), _text("event_id"), _text("k"),
        _text("event_id"), _text("value"), _text("event_id"), _text("k"),
    )


@query(
    "log_consumer_perf",
    f"SELECT *, false AS failed FROM ({_last_sql(mb_per_sec=f'{K_SQL}::DOUBLE', records_per_sec='value')})",
)
def log_consumer_perf(t):
    """Each event repeats header, metrics and a footer; the last header's next line counts."""
    return logs.consumer_perf(
        _lines(t, F.lit(_HEADER_LINE), _consumer_line(), F.lit("a, b, c, 0, e, 0"))
    )


@query(
    "log_consumer_detailed",
    _last_sql(
        records_per_sec="value",
        mb_per_sec=f"{K_SQL}::DOUBLE",
        rebalance_time_ms="event_id::DOUBLE",
        fetch_time_ms=f"{K_SQL}::DOUBLE",
    ),
)
def log_consumer_detailed(t):
    return logs.consumer_perf_detailed(_lines(t, _consumer_line(), F.lit("time, threadId, MB")))


@query(
    "log_key_values",
    _last_sql(
        read_time_s="value", first_record_latency=f"-{K_SQL}::DOUBLE", records="event_id::DOUBLE"
    ),
)
def log_key_values(t):
    lines = _lines(
        t,
        F.lit("=" * 20),
        F.concat(F.lit("  read_time_s: "), _text("value")),
        F.concat(F.lit("  first_record_latency:  "), (-F.col("k").cast("double")).cast("string"), F.lit("s")),
        F.concat(F.lit("  records:        "), _text("event_id")),
    )
    return logs.key_values(lines, ["read_time_s", "first_record_latency", "records"])


@query("log_json_block", _last_sql(records="event_id::DOUBLE", duration_seconds="value"))
def log_json_block(t):
    """Blocks over several lines; a number after the last block does not belong to it."""
    lines = _lines(
        t,
        F.lit("RESULTS_START"),
        F.lit("{"),
        F.concat(F.lit('  "records": '), _text("event_id"), F.lit(",")),
        F.concat(F.lit('  "duration_seconds": '), _text("value")),
        F.lit("}"),
        F.lit("RESULTS_END"),
        F.lit('  "records": -1,'),
    )
    return logs.json_block(lines, ["records", "duration_seconds"])


@query(
    "log_csv_marker",
    f"""SELECT 'run_' || user_id::VARCHAR AS run_id, event_id AS records, value AS bytes_mb,
              {K_SQL}::DOUBLE AS first_record_latency_s, value AS active_duration_s,
              value AS consumer_total_s, {K_SQL}::DOUBLE AS throughput_mbps FROM events""",
)
def log_csv_marker(t):
    fields = F.concat_ws(
        ",", F.concat(F.lit("run_"), _text("log")), _text("event_id"), _text("value"),
        _text("k"), _text("value"), _text("value"), _text("k"),
    )
    marked = F.concat(F.lit("CONSUMER_CSV:"), fields)
    return logs.csv_marker(_lines(t, F.lit("CONSUMER RESULTS"), marked))


def _runs(t) -> tuple[DataFrame, DataFrame]:
    """Every customer is an expected run; a run's log has a summary where it had a purchase."""
    line = F.when(F.col("event_type") == "purchase", _progress()).otherwise(F.lit("error"))
    parsed = logs.producer_perf(_lines(t, line)).filter(~F.col("failed"))
    expected = t.customer.select(F.col("c_custkey").alias("log"))
    return expected, parsed.select("log", "records_per_sec")


@query(
    "log_failed_runs",
    """WITH last AS (SELECT user_id, arg_max(value, event_id) AS records_per_sec FROM events
                     WHERE event_type = 'purchase' GROUP BY 1)
       SELECT c_custkey AS log, records_per_sec, records_per_sec IS NULL AS failed
       FROM customer LEFT JOIN last ON c_custkey = user_id""",
)
def log_failed_runs(t):
    return logs.failed_runs(*_runs(t))


@query(
    "log_missing_runs",
    """SELECT c_custkey AS log FROM customer
       WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')""",
)
def log_missing_runs(t):
    return logs.missing_runs(*_runs(t))


_TAIL_SQL = """tail AS (SELECT user_id, event_id, value FROM events
   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5)"""


@query(
    "tail_mean",
    f"WITH {_TAIL_SQL} SELECT user_id AS log, round(avg(value), 4) AS tail_mean FROM tail GROUP BY 1",
)
def tail_mean(t):
    means = logs.tail_mean(_lines(t, _progress(), F.lit("noise")), logs.RECORDS_PER_SEC)
    return means.withColumn("tail_mean", F.round("tail_mean", 4))


@query(
    "tail_max",
    f"WITH {_TAIL_SQL} SELECT user_id AS log, max(event_id)::DOUBLE AS tail_max FROM tail GROUP BY 1",
)
def tail_max(t):
    return logs.tail_max(_lines(t, _progress(), F.lit("noise")), logs.MAX_LATENCY)


@query(
    "log_last_metric",
    f"""SELECT user_id AS log, arg_max(concat_ws(', ', '10:00:00', '10:00:09', event_id::VARCHAR, {K_SQL}::VARCHAR,
               event_id::VARCHAR, value::VARCHAR, event_id::VARCHAR, {K_SQL}::VARCHAR), event_id) AS last_line
        FROM events GROUP BY 1""",
)
def log_last_metric(t):
    return logs.last_record(_lines(t, _consumer_line(), F.lit("time, threadId, MB")))
