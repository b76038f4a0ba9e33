"""Queries over the sources, generators and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrytrace.functions.measures import batch_label, mib, records_per_pack
from ferrytrace.functions.messages import parse_json
from ferrytrace.operators.filters import keep_listed
from ferrytrace.operators.packing import pack_messages
from ferrytrace.plans.deliveries import filtered_messages
from ferrytrace.plans.registry import (
    EVENT_JSON_SQL,
    EVENT_TEXT_SQL,
    CSV_LINE_SQL,
    EVENT_COLUMNS,
    EVENT_LINE_SQL,
    TOPIC_SQL,
    WANTED,
    WANTED_SQL,
    key_value_view,
    query,
    topic_view,
)
from ferrytrace.schemas import SPARK_RESULTS
from ferrytrace.sources import files, generated
from ferrytrace.sources.topics import end_offsets, since
from ferrytrace.streaming.flows import append_files, drain

HEADER = ",".join(EVENT_COLUMNS)


def _csv_of(t, columns=None):
    path = t.area("csv")
    files.write_csv(t.event_text(columns), path)
    return path


@query("scan_csv_strings", f"SELECT {EVENT_TEXT_SQL} FROM events")
def scan_csv_strings(t):
    return files.read_csv_text(t.spark, _csv_of(t))


@query(
    "scan_csv_typed",
    "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events",
)
def scan_csv_typed(t):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = files.read_csv_typed(t.spark, _csv_of(t), schema)
    return rows.withColumn("ts", F.unix_micros("ts")).withColumnRenamed("ts", "ts_us")


@query(
    "scan_part_dir",
    f"SELECT count(*) AS records, sum(strlen({CSV_LINE_SQL}) + 1)::BIGINT AS data_bytes FROM events",
)
def scan_part_dir(t):
    """Rows of all parts, and their bytes without the header line of each part."""
    path = _csv_of(t)
    rows = files.read_csv_text(t.spark, path).select(
        F.lit(1).alias("records"), F.lit(0).cast("long").alias("data_bytes")
    )
    sizes = files.file_sizes(t.spark, path, "part-*.csv").filter(F.col("length") > 0)
    weight = sizes.select(
        F.lit(0).alias("records"), (F.col("length") - (len(HEADER) + 1)).alias("data_bytes")
    )
    return rows.unionByName(weight).agg(
        F.sum("records").alias("records"), F.sum("data_bytes").alias("data_bytes")
    )


@query("scan_json_lines", "SELECT json_extract(props, '$.k')::INTEGER AS k FROM events")
def scan_json_lines(t):
    path = t.area("json")
    t.events.select("props").write.text(path)
    return files.read_json_lines(t.spark, path, "k int")


TOPIC_VIEW_SQL = f"WITH {TOPIC_SQL} SELECT part, pos, key, value, ts_us FROM topic"


@query("topic_scan_batch", TOPIC_VIEW_SQL)
def topic_scan_batch(t):
    return topic_view(t.published().read(t.spark, "events"))


@query("topic_scan_stream", TOPIC_VIEW_SQL)
def topic_scan_stream(t):
    stream = t.published().read_stream(t.spark, "events")
    target = t.area("drained")
    drain(append_files(topic_view(stream), target, t.area("checkpoint")))
    return t.spark.read.parquet(target)


@query(
    "topic_scan_from_latest",
    f"WITH {TOPIC_SQL} SELECT part, pos, key, value, ts_us FROM topic "
    "WHERE ts_us >= epoch_us(TIMESTAMP '2024-01-16 00:00:00')",
)
def topic_scan_from_latest(t):
    """Two batches are published; a reader that started in between sees the second."""
    topics = t.topics()
    messages = t.messages()
    started = F.lit("2024-01-16 00:00:00").cast("timestamp")
    topics.publish(messages.filter(F.col("timestamp") < started), "events", ["event_id"])
    ends = end_offsets(topics.read(t.spark, "events"))
    snapshot = t.area("offsets")
    ends.write.parquet(snapshot)
    topics.publish(
        messages.filter(F.col("timestamp") >= started), "events", ["event_id"], batch_id=1
    )
    return topic_view(since(topics.read(t.spark, "events"), t.spark.read.parquet(snapshot)))


@query(
    "scan_results_csv",
    """SELECT l_linestatus AS test_type, count(*) AS n,
              count(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS with_latency,
              round(coalesce(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END), 0), 2) AS latency_sum
       FROM lineitem GROUP BY 1""",
)
def scan_results_csv(t):
    """Consumer rows have no latency: the file says N/A, the table null."""
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("test_type"),
        F.col("l_linenumber").alias("partitions"),
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice").cast("string"))
        .otherwise(F.lit("N/A"))
        .alias("avg_latency_ms"),
    )
    path = t.area("results")
    files.write_csv(rows, path)
    schema = "test_type string, partitions int, avg_latency_ms double"
    read = files.read_results(t.spark, path, schema)
    return read.groupBy("test_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("avg_latency_ms").alias("with_latency"),
        F.round(F.coalesce(F.sum("avg_latency_ms"), F.lit(0.0)), 2).alias("latency_sum"),
    )


@query(
    "scan_results_multi_run",
    """SELECT l_returnflag AS run, l_linenumber AS partitions, count(*) AS n,
              sum(l_quantity) AS mb_sum
       FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2""",
)
def scan_results_multi_run(t):
    """One results file per run directory; rows of the other batch label are left out."""
    rows = t.lineitem.select(
        F.col("l_linenumber").alias("partitions"),
        F.lit(100).alias("record_size_bytes"),
        batch_label(F.when(F.col("l_linestatus") == "O", "16384").otherwise("0")).alias("batch_size"),
        F.col("l_extendedprice").alias("records_per_sec"),
        F.col("l_quantity").alias("mb_per_sec"),
        F.lit(None).cast("double").alias("duration_sec"),
        F.lit(None).cast("long").alias("total_records"),
        F.col("l_returnflag").alias("run_dir"),
    )
    path = t.area("runs")
    rows.write.partitionBy("run_dir").option("header", True).csv(path)
    read = files.read_results(t.spark, f"{path}/run_dir=*", SPARK_RESULTS, r"/run_dir=([^/]+)/")
    kept = read.filter(F.col("batch_size") == "16384b")
    return kept.groupBy("run", "partitions").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mb_per_sec").alias("mb_sum")
    )


@query(
    "scan_log_text",
    f"""SELECT event_type AS log, count(*) AS n_lines, sum(strlen({EVENT_LINE_SQL}))::BIGINT AS n_bytes
        FROM events GROUP BY 1""",
)
def scan_log_text(t):
    """Log lines per run, the run taken from the file's path."""
    lines = t.events.select(
        F.concat_ws(",", *[F.col(c).cast("string") for c in EVENT_COLUMNS]).alias("value"),
        F.col("event_type").alias("run_dir"),
    )
    path = t.area("logs")
    lines.write.partitionBy("run_dir").text(path)
    read = files.read_log(t.spark, f"{path}/run_dir=*")
    return (
        read.withColumn("log", F.regexp_extract("log", r"/run_dir=([^/]+)/", 1))
        .groupBy("log")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.sum(F.octet_length("line")).alias("n_bytes"),
        )
    )


# Generators.  ``_draw_sql`` is the arithmetic of ``generated.draw`` in SQL.


def _draw_sql(stream: int, size: int | str, row_id: str = "event_id") -> str:
    def fold(number, bits):
        return f"xor({number}, {number} >> {bits})"

    m = generated.MODULUS
    start = f"(({row_id} % {m}) * {generated.FIRST_MULTIPLIER} + {generated.STREAM_STEP * stream}) % {m}"
    once = fold(f"({start})", 15)
    twice = fold(f"(({once} * {generated.SECOND_MULTIPLIER}) % {m})", 13)
    return f"({twice} % {size})"


def _country_sql() -> str:
    number = _draw_sql(1, sum(w for w, *_ in generated.COUNTRIES.values()))
    upto, cases = 0, []
    for code, (weight, *_) in generated.COUNTRIES.items():
        upto += weight
        cases.append(f"WHEN {number} < {upto} THEN '{code}'")
    return "CASE " + " ".join(cases) + " END"


def _by_country_sql(pick) -> str:
    cases = [f"WHEN '{code}' THEN {pick(row)}" for code, row in generated.COUNTRIES.items()]
    return "CASE country " + " ".join(cases) + " END"


def _city_sql() -> str:
    def one(row):
        names = ", ".join(f"'{n}'" for n in row[3])
        return f"[{names}][{_draw_sql(2, len(row[3]))} + 1]"

    return _by_country_sql(one)


def _near_sql(stream: int, position: int) -> str:
    centre = _by_country_sql(lambda row: str(round(row[position] * 1000)))
    return f"(({centre}) + {_draw_sql(stream, 4001)} - 2000) / 1000.0::DOUBLE"


def _kind_sql(position: int) -> str:
    items = []
    for kind in generated.POLLUTANTS:
        value = kind[position]
        items.append(f"'{value}'" if isinstance(value, str) else str(round(value * 100)))
    return f"[{', '.join(items)}][{_draw_sql(5, len(generated.POLLUTANTS))} + 1]"


READINGS_SQL = f"""readings AS (
  SELECT 'STA-' || country || '-' || lpad(({_draw_sql(7, generated.STATIONS)} + 1)::VARCHAR, 4, '0') AS station_id,
         ({generated.FIRST_HOUR} + (event_id % {generated.HOURS}) * 3600)::BIGINT AS "timestamp",
         country, {_city_sql()} AS city,
         {_near_sql(3, 1)} AS latitude, {_near_sql(4, 2)} AS longitude,
         {_kind_sql(0)} AS pollutant,
         ({_kind_sql(2)} + {_draw_sql(6, f"({_kind_sql(3)} - {_kind_sql(2)} + 1)")}) / 100.0::DOUBLE AS value,
         {_kind_sql(1)} AS unit
  FROM (SELECT event_id, {_country_sql()} AS country FROM events))"""


@query("gen_readings", f"WITH {READINGS_SQL} SELECT * FROM readings")
def gen_readings(t):
    return generated.readings(t.ids())


@query(
    "gen_selectivity_report",
    f"""WITH {READINGS_SQL}, c AS (
          SELECT count(*) AS records, count(*) FILTER (country IN ('LU', 'DE', 'BE')) AS passing FROM readings)
        SELECT records, passing, round(passing * 100.0::DOUBLE / records, 4) AS passing_pct,
               round(passing * {float(generated.ROW_BYTES)}::DOUBLE / 1048576, 4) AS estimated_mb FROM c""",
)
def gen_selectivity_report(t):
    return generated.selectivity_report(generated.readings(t.ids()))


def _payload_sql(size: int) -> str:
    length = max(0, size - 60)
    blocks = max(1, -(-length // 64))
    filler = " || ".join(f"sha256(event_id::VARCHAR || '-{n}')" for n in range(blocks))
    data = f"substr({filler}, 1, {length})"
    return (
        f"SELECT event_id AS row_id, '{{\"id\":' || ({_draw_sql(1, 1000000)} + 1)::VARCHAR || "
        f"',\"timestamp\":1704067200,\"data\":\"' || {data} || '\"}}' AS value FROM events"
    )


@query("gen_json_payload", _payload_sql(1000))
def gen_json_payload(t):
    return generated.json_payload(t.ids(), 1000, generated.FIRST_HOUR)


@query("gen_fixed_bytes", "SELECT event_id AS row_id, rpad(event_id::VARCHAR, 1024, 'x') AS value FROM events")
def gen_fixed_bytes(t):
    return generated.fixed_bytes(t.ids(), 1024)


def _compact_sql() -> str:
    codes = list(generated.COMPACT_STATIONS)
    country = f"[{', '.join(repr(c) for c in codes)}][{_draw_sql(1, len(codes))} + 1]"
    stations = f"[{', '.join(str(n) for n in generated.COMPACT_STATIONS.values())}][{_draw_sql(1, len(codes))} + 1]"
    names = ", ".join(f"'{k[0]}'" for k in generated.POLLUTANTS)
    number = f"({_draw_sql(2, stations)} + 1)"

    def two(text):
        return f"lpad(({text})::VARCHAR, 2, '0')"

    return f"""
    SELECT event_id AS row_id, concat_ws(',', {country},
        CASE WHEN {country} = 'LU' THEN 'LU010' || {number}::VARCHAR || 'A'
             ELSE {country} || lpad({number}::VARCHAR, 4, '0') || 'A' END,
        [{names}][{_draw_sql(3, len(generated.POLLUTANTS))} + 1],
        '2024-' || {two(_draw_sql(4, 12) + ' + 1')} || '-' || {two(_draw_sql(5, 28) + ' + 1')} || 'T' ||
        {two(_draw_sql(6, 24))} || ':' || {two(_draw_sql(7, 60))} || ':00',
        (({_draw_sql(8, 19901)} + 100) / 100.0::DOUBLE)::VARCHAR, 'µg/m³',
        ({_draw_sql(9, 3)} + 1)::VARCHAR, ({_draw_sql(10, 3)} + 1)::VARCHAR) AS value,
        (epoch_us(ts) // 1000)::VARCHAR AS ts_produce, '{generated.COMPACT_SOURCE}' AS ds
    FROM events"""


@query("gen_compact_lines", _compact_sql())
def gen_compact_lines(t):
    from ferrytrace.functions.messages import header_text

    ids = t.events.select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    )
    lines = generated.compact_lines(ids, F.col("ms"))
    return lines.select(
        "row_id",
        "value",
        header_text("headers", "ts_produce").alias("ts_produce"),
        header_text("headers", "ds").alias("ds"),
    )


# Sinks: write, read back, compare with what should be there.


@query("sink_topic_keyed", f"SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value FROM events WHERE {WANTED_SQL}")
def sink_topic_keyed(t):
    topics = t.topics()
    kept = filtered_messages(t.event_text(), "event_type", WANTED, "user_id", "event_id")
    topics.publish(kept, "keyed", ["_order"])
    return key_value_view(topics.read(t.spark, "keyed"))


def packed_sql(records: int, where: str = "true") -> str:
    return f"""
    WITH numbered AS (
      SELECT {EVENT_LINE_SQL} AS line, row_number() OVER (ORDER BY event_id) - 1 AS ix
      FROM events WHERE {where})
    SELECT (ix // {records})::BIGINT AS pack, count(*) AS records,
           string_agg(line, chr(10) ORDER BY ix) AS value
    FROM numbered GROUP BY 1"""


@query(
    "sink_topic_unkeyed",
    f"SELECT NULL::VARCHAR AS key, value FROM ({packed_sql(14)})",
)
def sink_topic_unkeyed(t):
    topics = t.topics()
    packed = pack_messages(
        t.events.select(*EVENT_COLUMNS), ["event_id"], records_per_pack(1), EVENT_COLUMNS
    )
    messages = packed.select(F.lit(None).cast("string").alias("key"), "value", "pack")
    topics.publish(messages, "packed", ["pack"])
    return key_value_view(topics.read(t.spark, "packed"))


@query("ingest_raw_lines", f"SELECT NULL::VARCHAR AS key, {CSV_LINE_SQL} AS value FROM events")
def ingest_raw_lines(t):
    topics = t.topics()
    lines = files.lines_as_messages(files.read_lines(t.spark, _csv_of(t)))
    numbered = lines.withColumn("_order", F.monotonically_increasing_id())
    topics.publish(numbered, "lines", ["_order"])
    return key_value_view(topics.read(t.spark, "lines"))


@query("ingest_rows_as_json", f"SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value FROM events")
def ingest_rows_as_json(t):
    topics = t.topics()
    rows = files.read_csv_text(t.spark, _csv_of(t))
    messages = files.rows_as_messages(rows, "user_id", [F.col("event_id").cast("long").alias("_order")])
    topics.publish(messages, "rows", ["_order"])
    return key_value_view(topics.read(t.spark, "rows"))


@query("ingest_rows_inline", "SELECT c_custkey AS id, c_name AS name, c_nationkey AS age FROM customer")
def ingest_rows_inline(t):
    """Rows published as JSON and decoded again by the reader."""
    people = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("age")
    )
    topics = t.topics()
    messages = people.select(
        F.lit(None).cast("string").alias("key"),
        F.to_json(F.struct("id", "name", "age")).alias("value"),
        F.col("id").alias("_order"),
    )
    topics.publish(messages, "people", ["_order"])
    schema = "id long, name string, age int"
    return parse_json(topics.read(t.spark, "people"), schema)


@query("sink_csv_dir", f"SELECT {EVENT_TEXT_SQL} FROM events WHERE {WANTED_SQL}")
def sink_csv_dir(t):
    path = t.area("filtered")
    files.write_csv(keep_listed(t.event_text(), "event_type", WANTED), path)
    return files.read_csv_text(t.spark, path)


@query(
    "sink_metrics_append",
    f"""SELECT event_type AS run_id, count(*) AS records, sum(strlen(props))::BIGINT AS bytes
        FROM events GROUP BY 1""",
)
def sink_metrics_append(t):
    """Two jobs append their metrics to one table."""
    path = t.area("metrics")
    metrics = t.events.groupBy(F.col("event_type").alias("run_id")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("props")).alias("bytes")
    )
    wanted = F.col("run_id").isin(WANTED)
    files.append_metrics(metrics.filter(wanted), path)
    files.append_metrics(metrics.filter(~wanted), path)
    return t.spark.read.parquet(path)


@query(
    "sink_stream_append",
    f"""WITH {TOPIC_SQL} SELECT part, count(*) AS records, sum(bytes)::BIGINT AS bytes FROM topic GROUP BY 1""",
)
def sink_stream_append(t):
    stream = t.published().read_stream(t.spark, "events")
    target = t.area("appended")
    drain(append_files(topic_view(stream), target, t.area("checkpoint")))
    return t.spark.read.parquet(target).groupBy("part").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.octet_length("value")).alias("bytes")
    )


@query(
    "sink_size",
    f"""SELECT sum(strlen({EVENT_LINE_SQL}) + 1)::BIGINT AS bytes,
               round(sum(strlen({EVENT_LINE_SQL}) + 1) / 1048576.0::DOUBLE, 4) AS size_mb FROM events""",
)
def sink_size(t):
    path = t.area("text")
    t.events.select(
        F.concat_ws(",", *[F.col(c).cast("string") for c in EVENT_COLUMNS]).alias("value")
    ).write.text(path)
    total = files.file_sizes(t.spark, path, "part-*").agg(F.sum("length").alias("bytes"))
    return total.withColumn("size_mb", mib(F.col("bytes"), 4))
