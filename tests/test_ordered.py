"""Blocks, dense numbering, running sums: many small blocks against plain Python."""

import pytest
from pyspark.sql import functions as F

from ferrytrace.operators.ordered import (
    add_order_blocks,
    dense_index,
    floor_div,
    running_totals,
    take_first,
    totals_before,
    totals_before_many,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; a third share one time and one key, ids are far from dense."""
    return (
        spark.range(3000)
        .select(
            (F.col("id") * 1_000_003 + F.pmod(F.col("id") * 7, F.lit(11))).alias("id"),
            F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id")).cast("long").alias("t"),
            F.when(F.col("id") % 3 == 0, F.lit("hot"))
            .otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(17)).cast("string")))
            .alias("k"),
        )
        .repartition(7)
    )


def test_floor_div_rounds_down_also_below_zero(spark):
    got = spark.range(-7, 8).select("id", floor_div(F.col("id"), 3).alias("q")).collect()
    assert all(r.q == r.id // 3 for r in got)


def test_floor_div_is_exact_for_large_numbers(spark):
    big = 2**62 + 12345
    assert spark.range(1).select(floor_div(F.lit(big), 146).alias("q")).first().q == big // 146


@pytest.mark.parametrize("size", [100, 173, 10_000])
def test_blocks_follow_order_and_are_bounded(skewed, size):
    blocked, _ = add_order_blocks(skewed, ["t", "id"], size)
    rows = sorted((r.t, r.id, r._block) for r in blocked.collect())
    numbers = [r[2] for r in rows]
    assert numbers == sorted(numbers)
    largest = max(numbers.count(b) for b in set(numbers))
    assert largest <= 3 * size


def test_hot_value_is_split_by_the_tie_breaker(skewed):
    blocked, _ = add_order_blocks(skewed, ["t", "id"], 100)
    assert blocked.filter("t = 500").select("_block").distinct().count() >= 8


@pytest.mark.parametrize("size", [64, 1000, 10_000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_dense_index_matches_a_sort(skewed, size, keys):
    got = dense_index(skewed, ["t", "id"], keys, rows_per_block=size).collect()
    seen = {}
    for row in sorted(got, key=lambda r: (r.t, r.id)):
        group = tuple(row[k] for k in keys)
        assert row.ix == seen.get(group, 0)
        seen[group] = row.ix + 1
    assert len(got) == 3000


def test_dense_index_of_nothing(spark):
    assert dense_index(spark.range(0), ["id"]).count() == 0


def test_dense_index_does_not_depend_on_partitions(skewed):
    results = [
        sorted(tuple(r) for r in dense_index(skewed.repartition(n), ["t", "id"], rows_per_block=200).collect())
        for n in (1, 4, 13)
    ]
    assert results[0] == results[1] == results[2]


def test_dense_index_orders_negative_and_fractional_values(spark):
    df = spark.range(1000).select(((F.col("id") * 37 % 1000) - 500.25).alias("x"))
    got = dense_index(df, ["x"], rows_per_block=50).orderBy("ix").collect()
    assert [r.x for r in got] == sorted(r.x for r in got)
    assert [r.ix for r in got] == list(range(1000))


@pytest.mark.parametrize("size", [10, 97, 5000])
def test_running_totals(spark, size):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.lit("cold")).alias("k"),
        F.when(F.col("id") < 1500, F.col("id")).otherwise(F.col("id") - 1500).alias("p"),
        (F.col("id") % 13).alias("w"),
    )
    got = running_totals(df, ["k"], "p", {"total": F.col("w")}, size).collect()
    sums = {}
    for row in sorted(got, key=lambda r: (r.k, r.p)):
        sums[row.k] = sums.get(row.k, 0) + row.w
        assert row.total == sums[row.k]


def test_two_level_totals_equal_one_level(spark):
    blocks = spark.range(500).select(
        F.pmod("id", F.lit(3)).alias("k"), F.col("id").alias("b"), (F.col("id") * 2).alias("n")
    )
    one = sorted(tuple(r) for r in totals_before(blocks, ["k"], "b", ["n"]).collect())
    two = sorted(tuple(r) for r in totals_before_many(blocks, ["k"], "b", ["n"], fanout=7).collect())
    assert one == two


@pytest.mark.parametrize("n", [1, 499, 1000, 1700, 3000, 9999])
def test_take_first(skewed, n):
    got = sorted((r.t, r.id) for r in take_first(skewed, ["t", "id"], n, rows_per_block=111).collect())
    want = sorted((r.t, r.id) for r in skewed.collect())[:n]
    assert got == want


def test_take_first_zero_means_all(skewed):
    assert take_first(skewed, ["t", "id"], 0).count() == 3000


def test_take_first_on_timestamps(spark):
    df = spark.range(1000).select(F.timestamp_micros(F.col("id") * 999_983).alias("t"), "id")
    got = take_first(df, ["t", "id"], 321, rows_per_block=50)
    assert sorted(r.id for r in got.collect()) == list(range(321))


def _first_branch(df):
    """The plan from its root down to the first scan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    end = next(i for i, line in enumerate(lines) if "Scan" in line or "Range (" in line)
    return "\n".join(lines[: end + 1])


def test_rows_move_once(spark):
    """Rows are shuffled by (key, block) once; the join with the block starts adds no shuffle."""
    df = spark.range(5000).select("id", F.col("id").cast("string").alias("wide"), F.lit(1).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _first_branch(dense_index(df, ["id"], ["wide"], rows_per_block=100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan
