"""Queries over projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrytrace.functions import measures as m
from ferrytrace.functions.messages import (
    header_long,
    header_text,
    json_value,
    keyed_json,
    line_value,
    parse_json,
    payload_bytes,
    value_text,
)
from ferrytrace.operators.filters import keep_listed, keep_listed_in
from ferrytrace.plans.registry import (
    EVENT_COLUMNS,
    EVENT_TEXT_SQL,
    EVENT_JSON_SQL,
    WANTED,
    WANTED_SQL,
    query,
)

K = "k int"


@query(
    "flagship_delivery",
    f"""SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value, strlen({EVENT_JSON_SQL})::BIGINT AS bytes
        FROM events WHERE {WANTED_SQL}""",
)
def flagship_delivery(t):
    kept = keep_listed(t.event_text(), "event_type", WANTED)
    return keyed_json(kept, "user_id").withColumn("bytes", payload_bytes())


@query("filter_in_list", f"SELECT {EVENT_TEXT_SQL} FROM events WHERE {WANTED_SQL}")
def filter_in_list(t):
    return keep_listed(t.event_text(), "event_type", WANTED)


@query(
    "filter_in_table",
    """SELECT c_custkey, c_name, c_nationkey FROM customer
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name IN ('NATION_0', 'NATION_1', 'NATION_2'))""",
)
def filter_in_table(t):
    """The list as a table: customers of three nations."""
    names = ["NATION_0", "NATION_1", "NATION_2"]
    wanted = keep_listed(t.nation, "n_name", names).select("n_nationkey")
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey")
    return keep_listed_in(rows, "c_nationkey", wanted, "n_nationkey").select(*rows.columns)


@query("to_keyed_json", f"SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value FROM events")
def to_keyed_json(t):
    return keyed_json(t.event_text(), "user_id")


@query(
    "key_from_int",
    "SELECT o_orderkey::VARCHAR AS key, to_json(struct_pack(o_orderkey := o_orderkey, "
    "o_custkey := o_custkey, o_orderstatus := o_orderstatus, o_totalprice := o_totalprice, "
    "o_orderdate := o_orderdate::VARCHAR, o_orderpriority := o_orderpriority))::VARCHAR AS value FROM orders",
)
def key_from_int(t):
    orders = t.orders.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return keyed_json(orders, "o_orderkey")


@query("value_to_string", "SELECT doc_id, text AS json_value FROM documents")
def value_to_string(t):
    messages = t.documents.select("doc_id", F.encode("text", "UTF-8").alias("value"))
    return messages.select("doc_id", value_text().alias("json_value"))


@query("json_parse_expand", "SELECT json_extract(props, '$.k')::INTEGER AS k FROM events")
def json_parse_expand(t):
    return parse_json(t.events.select(F.col("props").alias("value")), K)


@query(
    "json_read_messages",
    "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events",
)
def json_read_messages(t):
    """What a reader decodes from the published JSON."""
    messages = t.event_text().select(json_value(EVENT_COLUMNS).cast("binary").alias("value"))
    texts = parse_json(messages, ", ".join(f"{c} string" for c in EVENT_COLUMNS))
    return texts.select(
        F.col("event_id").cast("long"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("user_id").cast("long"),
        "event_type",
        F.col("value").cast("double"),
        "props",
    )


@query(
    "derive_product",
    """SELECT event_id, k, k * k * k AS cubed FROM (
         SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)""",
)
def derive_product(t):
    parsed = t.events.select("event_id", F.from_json("props", K)["k"].cast("long").alias("k"))
    return parsed.withColumn("cubed", F.try_multiply(F.try_multiply("k", "k"), F.col("k")))


@query(
    "row_to_line",
    "SELECT event_id, concat_ws(',', "
    + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in EVENT_COLUMNS)
    + ") AS line FROM events",
)
def row_to_line(t):
    return t.events.select("event_id", line_value(EVENT_COLUMNS).alias("line"))


@query(
    "header_lookup",
    """SELECT event_id, epoch_us(ts) // 1000 AS ts_produce, event_type AS ds,
              NULL::VARCHAR AS absent, NULL::BIGINT AS ds_number FROM events""",
)
def header_lookup(t):
    return t.messages().select(
        "event_id",
        header_long("headers", "ts_produce").alias("ts_produce"),
        header_text("headers", "ds").alias("ds"),
        header_text("headers", "absent").alias("absent"),
        header_long("headers", "ds").alias("ds_number"),
    )


@query("payload_bytes", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents")
def payload_bytes_query(t):
    return t.documents.select("doc_id", payload_bytes("text").alias("bytes"))


@query(
    "bytes_to_mib",
    """SELECT lang, round(b / 1048576.0::DOUBLE, 1) AS mb1, round(b / 1048576.0::DOUBLE, 2) AS mb2,
              round(b / 1048576.0::DOUBLE, 4) AS mb4
       FROM (SELECT lang, sum(strlen(text)) AS b FROM documents GROUP BY lang)""",
)
def bytes_to_mib(t):
    summed = t.documents.groupBy("lang").agg(F.sum(payload_bytes("text")).alias("b"))
    return summed.select("lang", *[m.mib(F.col("b"), n).alias(f"mb{n}") for n in (1, 2, 4)])


@query(
    "safe_ratio",
    """SELECT l_returnflag, CASE WHEN zeros = 0 THEN 0 ELSE n / zeros::DOUBLE END AS per_untaxed,
              CASE WHEN none = 0 THEN 0 ELSE n / none::DOUBLE END AS per_none
       FROM (SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_tax = 0) AS zeros,
                    count(*) FILTER (l_quantity < 0) AS none FROM lineitem GROUP BY 1)""",
)
def safe_ratio(t):
    counted = t.lineitem.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_tax") == 0).alias("zeros"),
        F.count_if(F.col("l_quantity") < 0).alias("none"),
    )
    return counted.select(
        "l_returnflag",
        m.safe_ratio(F.col("n"), F.col("zeros")).alias("per_untaxed"),
        m.safe_ratio(F.col("n"), F.col("none")).alias("per_none"),
    )


@query(
    "estimate_payload",
    """SELECT l_linenumber, round(count(*) * (l_linenumber * 100) * 1.1::DOUBLE / 1048576, 4) AS estimated_mb
       FROM lineitem GROUP BY l_linenumber""",
)
def estimate_payload(t):
    counted = t.lineitem.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    estimate = m.estimated_mib(F.col("n"), F.col("l_linenumber") * 100)
    return counted.select("l_linenumber", F.round(estimate, 4).alias("estimated_mb"))


@query(
    "batch_label",
    """SELECT l_orderkey, CASE WHEN l_discount = 0 THEN 'nobatch' ELSE (l_partkey + 1)::VARCHAR || 'b' END AS label
       FROM lineitem""",
)
def batch_label(t):
    size = (F.col("l_partkey") + 1).cast("string")
    batch = F.when(F.col("l_discount") == 0, F.lit("0")).otherwise(size)
    return t.lineitem.select("l_orderkey", m.batch_label(batch).alias("label"))


@query(
    "topic_field",
    """SELECT l_orderkey, l_suppkey::INTEGER AS size, l_linenumber AS partitions,
              l_linenumber::VARCHAR AS sweep_partitions, l_suppkey::VARCHAR AS sweep_size,
              l_partkey::VARCHAR AS sweep_rate, l_linestatus AS sweep_acks
       FROM lineitem""",
)
def topic_field(t):
    """Fields of both naming schemes, read back from names built of the line item."""
    size, parts = F.col("l_suppkey"), F.col("l_linenumber")
    first = F.format_string("perf-test-%db-%dp-run", size, parts)
    second = F.format_string("test-prod-%d-%d-%d-%s", parts, size, F.col("l_partkey"), F.col("l_linestatus"))
    named = t.lineitem.select("l_orderkey", first.alias("a"), second.alias("b"))
    fields = ["sweep_partitions", "sweep_size", "sweep_rate", "sweep_acks"]
    return named.select(
        "l_orderkey",
        m.topic_size(F.col("a")).alias("size"),
        m.topic_partitions(F.col("a")).alias("partitions"),
        *[m.topic_sweep_field(F.col("b"), i).alias(n) for i, n in enumerate(fields, start=1)],
    )


@query("topic_prefix", "SELECT event_id, 'source.' || event_type AS topic FROM events")
def topic_prefix(t):
    return t.events.select("event_id", m.prefixed_topic(F.col("event_type")).alias("topic"))


@query(
    "default_zero",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, 0) AS produce_s,
              coalesce(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END, -1) AS first_record_s,
              o_orderstatus = 'F' AS failed FROM orders""",
)
def default_zero(t):
    """Missing metrics get their default and stay marked, so that means can leave them out."""
    metric = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return t.orders.select(
        "o_orderkey",
        m.default_zero(metric).alias("produce_s"),
        m.default_zero(metric, -1.0).alias("first_record_s"),
        metric.isNull().alias("failed"),
    )


@query(
    "size_class",
    """SELECT l_orderkey, CASE WHEN l_linenumber IN (1) THEN '100 B' WHEN l_linenumber IN (2, 3) THEN '1 KB'
              WHEN l_linenumber IN (4, 5) THEN '10 KB' END AS label FROM lineitem""",
)
def size_class(t):
    sizes = list(m.SIZE_LABELS)
    size = F.get(F.array(*[F.lit(s) for s in sizes]), F.col("l_linenumber") - 1)
    return t.lineitem.select("l_orderkey", m.size_label(size).alias("label"))
