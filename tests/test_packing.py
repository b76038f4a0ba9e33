import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrytrace.functions.measures import producer_batch_bytes, records_per_pack
from ferrytrace.operators.packing import chunk_by_bytes, in_chunks, pack_messages


def test_pack_sizes():
    assert records_per_pack(10) == 146
    assert records_per_pack(1) == 14
    assert records_per_pack(0) == 1
    assert producer_batch_bytes(1) == 16384
    assert producer_batch_bytes(10) == 163840


@pytest.mark.parametrize("block", [50, 77, 10_000])
@pytest.mark.parametrize("k", [1, 14, 146, 5000])
def test_unpacking_gives_the_rows_back(spark, block, k):
    df = spark.range(1000).select((F.col("id") * 3).alias("id"), F.lit("v").alias("v")).repartition(5)
    packs = pack_messages(df, ["id"], k, rows_per_block=block).orderBy("pack").collect()
    assert [p.pack for p in packs] == list(range(-(-1000 // k)))
    assert all(p.records == k for p in packs[:-1])
    lines = [line for p in packs for line in p.value.split("\n")]
    assert lines == [f"{i * 3},v" for i in range(1000)]


def test_nulls_do_not_shift_fields(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "b", None)], "id int, b string, c string")
    packs = pack_messages(df, ["id"], 2).collect()
    assert packs[0].value == "1,,c\n2,b,"


def test_packing_nothing(spark):
    assert pack_messages(spark.range(0), ["id"], 10).count() == 0


def _topic(spark, sizes):
    rows = [("t", 0, i, bytearray(b"x" * n) if n is not None else None) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "topic string, partition int, offset long, value binary")


def _expected(sizes, limit):
    chunks, total = {}, 0
    for i, n in enumerate(sizes):
        total += n or 0
        chunks.setdefault(max(total - 1, 0) // limit, []).append((i, n or 0))
    return {c: (m[0][0], m[-1][0], len(m), sum(n for _, n in m)) for c, m in chunks.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 60)), min_size=1, max_size=40), st.integers(1, 50))
def test_chunks_match_a_loop(spark, sizes, limit):
    got = chunk_by_bytes(_topic(spark, sizes), limit, positions_per_block=7).collect()
    found = {r.chunk: (r.first_offset, r.last_offset, r.records, r.bytes) for r in got}
    assert found == _expected(sizes, limit)


def test_chunk_exceeds_limit_by_less_than_one_message(spark):
    sizes = [30, 5, 200, 1, 99, 42] * 20
    got = chunk_by_bytes(_topic(spark, sizes), 100, positions_per_block=10).collect()
    assert all(r.bytes < 100 + max(sizes) for r in got)
    assert sum(r.bytes for r in got) == sum(sizes)


def test_assigned_chunks_agree_with_summary(spark):
    sizes = [30, 5, 200, 1, 99, 42] * 20
    topic = _topic(spark, sizes)
    rows = in_chunks(topic, chunk_by_bytes(topic, 100, positions_per_block=9)).groupBy("chunk").agg(F.sum("bytes").alias("b"))
    summed = chunk_by_bytes(topic, 100, positions_per_block=11)
    assert {r.chunk: r.b for r in rows.collect()} == {r.chunk: r.bytes for r in summed.collect()}
