"""Column functions on nulls, empty text, multi-byte text and headers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrytrace.functions import measures as m
from ferrytrace.functions import messages as msg
from ferrytrace.operators.filters import keep_listed, keep_listed_in, split_list


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("s1", "LU", "µg/m³"), ("s2", None, None), ("", "FR", "x")],
        "station string, country string, unit string",
    )


def _values(df, column="value"):
    return [r[column] for r in df.collect()]


def test_split_list():
    assert split_list("LU, DE,BE ") == ["LU", "DE", "BE"]


def test_null_never_passes_the_filter(rows):
    assert _values(keep_listed(rows, "country", ["LU", "DE"]), "station") == ["s1"]


def test_filter_by_table_equals_filter_by_list(spark, rows):
    wanted = spark.createDataFrame([("LU",), ("LU",), (None,), ("DE",)], "c string")
    assert _values(keep_listed_in(rows, "country", wanted, "c"), "station") == ["s1"]


def test_json_omits_or_keeps_nulls(rows):
    assert _values(msg.keyed_json(rows, "station"))[1] == '{"station":"s2"}'
    kept = _values(msg.keyed_json(rows, "station", keep_nulls=True))[1]
    assert kept == '{"station":"s2","country":null,"unit":null}'


def test_line_keeps_field_positions(rows):
    lines = _values(rows.select(msg.line_value(rows.columns).alias("value")))
    assert lines == ["s1,LU,µg/m³", "s2,,", ",FR,x"]


def test_empty_key_is_no_key(rows):
    assert _values(rows.select(msg.empty_to_null(F.col("station")).alias("value")))[2] is None


def test_payload_bytes_counts_utf8_and_null(rows):
    assert _values(rows.select(msg.payload_bytes("unit").alias("value"))) == [7, 0, 1]
    binary = rows.select(msg.payload_bytes(F.encode("unit", "UTF-8")).alias("value"))
    assert _values(binary) == [7, 0, 1]


def test_broken_json_gives_nulls(spark):
    df = spark.createDataFrame([('{"number": 3, "squared": 9}',), ("nonsense",), (None,)], "value string")
    schema = T.StructType.fromDDL("number int, squared int")
    assert [tuple(r) for r in msg.parse_json(df, schema).collect()] == [(3, 9), (None, None), (None, None)]


@pytest.mark.parametrize(
    "headers, text, number",
    [
        ([("ts", b"12"), ("ts", b"13")], "12", 12),
        ([("ds", b"x")], None, None),
        ([], None, None),
        (None, None, None),
        ([("ts", None)], None, None),
        ([("ts", b"12a")], "12a", None),
    ],
)
def test_header_lookup(spark, headers, text, number):
    df = spark.createDataFrame([(headers,)], "headers array<struct<key: string, value: binary>>")
    row = df.select(msg.header_text("headers", "ts").alias("t"), msg.header_long("headers", "ts").alias("n")).first()
    assert (row.t, row.n) == (text, number)


def test_ratio_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(4, 2), (4, 0), (None, 2), (4, None)], "a int, b int")
    assert _values(df.select(m.safe_ratio(F.col("a"), F.col("b")).alias("value"))) == [2.0, 0.0, 0.0, 0.0]


def test_labels(spark):
    df = spark.createDataFrame([("0", 100), ("16384", 1024), ("1", 7)], "batch string, size int")
    got = df.select(m.batch_label(F.col("batch")).alias("b"), m.size_label(F.col("size")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("nobatch", "100 B"), ("16384b", "1 KB"), ("1b", None)]


def test_topic_names(spark):
    df = spark.createDataFrame(
        [("my-perf-test-100b-4p-nobatch",), ("test-prod-2-1024-1000000-all",), ("other",)], "topic string"
    )
    got = df.select(
        m.topic_size(F.col("topic")), m.topic_partitions(F.col("topic")), m.topic_sweep_field(F.col("topic"), 4)
    ).collect()
    assert [tuple(r) for r in got] == [(100, 4, None), (None, None, "all"), (None, None, None)]


def test_mib_and_seconds(spark):
    row = spark.range(1).select(
        m.mib(F.lit(1572864), 1).alias("mb"),
        m.epoch_seconds(F.lit(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))).alias("s"),
    ).first()
    assert row.mb == 1.5
    assert row.s == 1704067200.0
