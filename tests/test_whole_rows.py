"""Rows that are easily lost: null keys, NaN, null times, gaps in positions, odd lines."""

import pytest
from pyspark.sql import functions as F

from ferrytrace.operators.delivery import keep_before_idle, progress_marks, reconcile_counts, reconcile_idle
from ferrytrace.operators.logs import json_block
from ferrytrace.operators.ordered import dense_index, running_totals, take_first
from ferrytrace.operators.results import grid_fill, grid_of
from ferrytrace.sources.files import read_lines
from ferrytrace.sources.topics import FileTopics


@pytest.mark.parametrize("size", [10_000, 100, 7])
def test_index_keeps_null_keys_and_nan(spark, size):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 3).alias("k"),
        F.when(F.col("id") % 50 == 1, F.lit(float("nan"))).when(F.col("id") % 50 == 2, F.lit(None)).otherwise(
            F.col("id").cast("double")
        ).alias("at"),
        "id",
    )
    got = dense_index(df, ["at", "id"], ["k"], rows_per_block=size)
    assert got.count() == 1000
    one = dense_index(df, ["at", "id"], ["k"], rows_per_block=10_000)
    assert got.exceptAll(one).count() == 0
    spans = got.groupBy("k").agg(F.count("*").alias("n"), F.max("ix").alias("m"), F.countDistinct("ix").alias("d"))
    assert spans.where("n <> m + 1 OR n <> d").count() == 0


def test_totals_keep_null_keys(spark):
    df = spark.range(100).select(F.when(F.col("id") % 2 == 0, "id").alias("x"), F.lit(None).cast("int").alias("k"), "id")
    got = running_totals(df, ["k"], "id", {"n": F.lit(1).cast("long")}, positions_per_block=9)
    assert got.count() == 100 and got.where("n <> id + 1").count() == 0


def test_totals_need_positions(spark):
    df = spark.createDataFrame([(1, None)], "k int, p long")
    with pytest.raises(Exception, match="p is null"):
        running_totals(df, ["k"], "p", {"n": F.lit(1)}).collect()


@pytest.mark.parametrize("size", [5000, 90])
@pytest.mark.parametrize("n", [50, 100, 150, 999])
def test_first_rows_with_null_times(spark, n, size):
    df = spark.range(1000).select(
        F.when(F.col("id") >= 100, F.timestamp_seconds(F.col("id") - F.col("id") % 7)).alias("at"), "id"
    )
    got = take_first(df, ["at", "id"], n, rows_per_block=size)
    assert sorted(r["id"] for r in got.collect()) == list(range(n))


def _topic(spark, offsets):
    return spark.createDataFrame([(o,) for o in offsets], "offset long").select(
        F.lit("t").alias("topic"), F.lit(None).cast("int").alias("partition"), "offset",
        F.timestamp_seconds("offset").alias("timestamp"), F.lit("abc").cast("binary").alias("value"),
        F.lit(None).cast("binary").alias("key"),
    )


@pytest.mark.parametrize(
    "offsets", [range(500, 1500), range(550, 1550), [o for o in range(3000) if o % 3 == 0]]
)
def test_marks_count_messages(spark, offsets):
    got = progress_marks(_topic(spark, offsets), 100)
    assert sorted(r["running_records"] for r in got.collect()) == list(range(100, 1001, 100))


def test_idle_cut_keeps_null_runs(spark):
    messages = _topic(spark, range(10)).withColumn("run", F.lit(None).cast("string"))
    assert keep_before_idle(messages, ["run"], 5).count() == 10


def test_lines_come_whole(spark, tmp_path):
    want = []
    for name, lines in {"a": ["x\u0001y", "", '"q", \\z', "h"], "b": [], "c": ["last"]}.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(["h", *lines]) + "\n")
        want += lines
    got = [r["value"] for r in read_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_only_the_last_block_counts(spark):
    lines = ["RESULTS_START", '{"records": 1}', "RESULTS_END", '"records": 99', "RESULTS_START", '"records": 2', "RESULTS_END", "RESULTS_START", '"records": 98']
    df = spark.createDataFrame([("log", i, x) for i, x in enumerate(lines)], "log string, line_ix long, line string")
    assert [r["records"] for r in json_block(df, ["records"]).collect()] == [2.0]


def test_grid_keeps_null_settings(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (None, "b", 3.0)], "p int, s string, v double")
    grid = grid_of(df, ["p", "s"])
    assert grid.count() == 4
    filled = grid_fill(grid, df, ["p", "s"], ["v"])
    assert filled.where("measured").count() == 2 and filled.agg(F.sum("v")).first()[0] == 5.0


def test_counts_of_null_runs(spark):
    sent = spark.createDataFrame([("a",), (None,), (None,)], "run string")
    got = reconcile_counts(sent, sent.where("run IS NULL").limit(1), ["run"])
    assert sorted((r["run"] or "", r["sent"], r["received"], r["missing"]) for r in got.collect()) == [("", 2, 1, 1), ("a", 1, 0, 1)]


def test_first_batch_with_a_late_number(spark, tmp_path):
    topics = FileTopics(str(tmp_path))
    rows = spark.range(10).select(F.lit(None).cast("string").alias("key"), F.col("id").cast("string").alias("value"), "id")
    topics.publish(rows, "t", ["id"], partitions=1, batch_id=7)
    topics.publish(rows, "t", ["id"], partitions=1, batch_id=8)
    assert sorted(r["offset"] for r in topics.read(spark, "t").collect()) == list(range(20))


@pytest.mark.parametrize("strict", [False, True])
def test_reconcile_idle_equals_two_sides(spark, strict):
    """One sum over slots says what counting both sides says: null runs and times, gaps of exactly the
    timeout, runs without any time."""
    times = [("a", 0), ("a", 5), ("a", 15), ("a", 40), ("a", None), (None, 1), (None, 100), ("b", None), ("c", 7)]
    rows = [(run, None if at is None else f"2024-01-01 00:00:{at % 60:02}", b"x") for run, at in times * 3]
    messages = spark.createDataFrame(rows, "run string, at string, value binary")
    messages = messages.select("run", F.col("at").cast("timestamp").alias("timestamp"), "value")
    got = {tuple(r) for r in reconcile_idle(messages, ["run"], 10, strict).collect()}
    kept = keep_before_idle(messages, ["run"], 10, strict)
    assert got == {tuple(r) for r in reconcile_counts(messages, kept, ["run"]).collect()} and len(got) == 4


def test_grid_of_planned_settings(spark):
    """Planned settings belong to the grid, whether measured or not, once each."""
    measured = spark.createDataFrame([(1, "s", 2.0), (3, "s", 4.0)], "partitions int, size string, v double")
    planned = spark.createDataFrame([(3,), (7,), (None,)], "n long")
    grid = grid_of(measured, ["partitions", "size"], {"partitions": planned})
    assert {tuple(r) for r in grid.collect()} == {(1, "s"), (3, "s"), (7, "s"), (None, "s")} and grid.count() == 4
    filled = grid_fill(grid, measured, ["partitions", "size"], ["v"])
    assert {r["partitions"]: (r["v"], r["measured"]) for r in filled.collect()} == {
        1: (2.0, True), 3: (4.0, True), 7: (0.0, False), None: (0.0, False)
    }
