"""Result reports and log extraction on small frames with gaps, ties and failures."""

import random

import pytest
from pyspark.sql import functions as F

from ferrytrace.operators import logs, results


@pytest.fixture(scope="module")
def sweep(spark):
    rows = [
        (0, "A", 1, "1", 10.0, 5.0),
        (1, "A", 1, "1", 20.0, 6.0),
        (2, "A", 1, "all", 5.0, None),
        (3, "B", 2, "1", 20.0, 2.0),
        (4, "B", 2, "all", 0.0, 9.0),
    ]
    return spark.createDataFrame(
        rows, "ix int, size string, partitions int, acks string, mb double, latency double"
    )


def test_grid_and_fill(spark, sweep):
    grid = results.config_grid(spark, size=["A", "B"], partitions=[1, 2])
    assert grid.count() == 4
    filled = {
        (r.size, r.partitions): (r.mean, r.measured)
        for r in results.replicate_mean(sweep.filter("acks = '1'"), ["size", "partitions"], "mb", grid).collect()
    }
    assert filled == {("A", 1): (15.0, True), ("A", 2): (0.0, False), ("B", 1): (0.0, False), ("B", 2): (20.0, True)}
    assert results.grid_of(sweep, ["size", "partitions", "acks"]).count() == 8


def test_first_match_uses_file_order(spark, sweep):
    grid = results.config_grid(spark, size=["A", "B"], partitions=[1])
    got = results.first_match(sweep.orderBy(F.desc("ix")), ["size", "partitions"], "mb", ["ix"], grid)
    assert {r.size: r.mb for r in got.collect()} == {"A": 10.0, "B": 0.0}


def test_spread(sweep):
    cv = {(r.size, r.acks): r for r in results.replicate_cv(sweep, ["size", "acks"], "mb").collect()}
    a = cv["A", "1"]
    assert (a.avg, a.min, a.max) == (15.0, 10.0, 20.0) and abs(a.cv_pct - 100 / 3) < 1e-9
    assert cv["B", "all"].cv_pct == 0.0
    std = results.replicate_mean_std(sweep.filter("size = 'A' and acks = '1'"), ["size"], "mb").first()
    assert (std.mean, std.std, std.runs) == (15.0, 5.0, 2)


def test_pivots(sweep):
    wide = {r["size"]: r for r in results.pivot_pair(sweep, ["size"], "acks", ("1", "all"), "mb", ["ix"]).collect()}
    assert (wide["A"]["1"], wide["A"]["all"], wide["A"].diff_pct) == (10.0, 5.0, -50.0)
    matrix = {r["size"]: (r.p1, r.p2, r.p4) for r in results.pivot_partitions(sweep, "size", "partitions", [1, 2, 4], "mb").collect()}
    assert matrix == {"A": (35 / 3, 0.0, 0.0), "B": (0.0, 10.0, 0.0)}


def test_points_without_latency_are_dropped(sweep):
    points = results.throughput_latency_points(sweep, ["size", "acks"], "mb", "latency", ["ix"])
    assert {(r["size"], r.acks, r.mb, r.latency) for r in points.collect()} == {
        ("A", "1", 10.0, 5.0), ("B", "1", 20.0, 2.0), ("B", "all", 0.0, 9.0)}


def test_best_config_breaks_ties_by_configuration(sweep):
    best = {
        r.criterion: (r["size"], r.partitions, r.acks, r.best)
        for r in results.best_config(sweep, ["size", "partitions", "acks"], {"mb": True, "latency": False}).collect()
    }
    assert best == {"mb": ("A", 1, "1", 20.0), "latency": ("B", 2, "1", 2.0)}


def test_engines_and_sides(sweep):
    compared = results.compare_engines(sweep.filter("acks = 'all'"), sweep.filter("acks = '1'"), ["size"], "mb")
    got = {r["size"]: (r.native_mb, r.spark_mb, r.gap_mb, r.ratio) for r in compared.collect()}
    assert got == {"A": (5.0, 15.0, 10.0, 3.0), "B": (0.0, 20.0, 20.0, 0.0)}
    sides = results.producer_vs_consumer(sweep.filter("ix <> 2"), ["size"], "acks", "1", "all", "mb", ["ix"])
    assert {r["size"]: (r.producer_mb, r.consumer_mb) for r in sides.collect()} == {"A": (10.0, 0.0), "B": (20.0, 0.0)}


def test_union_pads_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "b int, c int")
    assert sorted(map(str, results.union_all([a, b]).collect())) == ["Row(a=1, b=2, c=None)", "Row(a=None, b=3, c=4)"]


@pytest.mark.parametrize(
    "text, records",
    [
        ("producer,1,consumer,2,N/Ae2e-producer,3e2e-consumer,4", ["producer,1,", "consumer,2,N/A", "e2e-producer,3", "e2e-consumer,4"]),
        ("e2e-consumer,1producer,2", ["e2e-consumer,1", "producer,2"]),
        ("producer,1", ["producer,1"]),
        ("", []),
        ("headproducer,1", ["head", "producer,1"]),
    ],
)
def test_split_fused(spark, text, records):
    got = results.split_fused(spark.createDataFrame([(text,)], "value string"))
    assert [r.record for r in got.collect()] == records


def test_approaches_fastest_first(spark):
    runs = spark.createDataFrame([("x", 9.0, 1.0), ("x", 11.0, 3.0), ("y", 5.0, 2.0)], "a string, e double, f double")
    got = results.approach_means(runs, "a", "e", "f").collect()
    assert [(r.a, r.mean_e2e_s, r.mean_first_record_s, r.runs) for r in got] == [("y", 5.0, 2.0, 1), ("x", 10.0, 2.0, 2)]


def _log(spark, **texts):
    rows = [(log, i, line) for log, lines in texts.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "log string, line_ix long, line string").repartition(4)


INTERIM = "100 records sent, 500.0 records/sec (5.00 MB/sec), 12.3 ms avg latency, 40.0 ms max latency."
FINAL = (
    "200 records sent, 512.250000 records/sec (5.12 MB/sec), 11.10 ms avg latency, 42.00 ms max latency, "
    "9 ms 50th, 30 ms 95th, 41 ms 99th, 42 ms 99.9th."
)


def test_producer_log(spark):
    lines = _log(spark, ok=["start", INTERIM, FINAL, "metric"], bad=["exception"])
    got = {r.log: r for r in logs.producer_perf(lines).collect()}
    ok = got["ok"]
    assert (ok.records_per_sec, ok.mb_per_sec, ok.avg_latency_ms, ok.max_latency_ms, ok.failed) == (
        512.25, 5.12, 11.1, 42.0, False)
    assert got["bad"].failed and got["bad"].mb_per_sec is None
    pct = {r.log: (r.p50_latency_ms, r.p99_latency_ms) for r in logs.percentiles(lines).collect()}
    assert pct == {"ok": (9.0, 41.0), "bad": (None, None)}


def test_consumer_log(spark):
    lines = _log(
        spark,
        ok=["x", "start.time, end.time, data, MB.sec, n, nMsg.sec", "a, b, 1.0, 2.5, 10, 77.0", "a, b, 0, 9, 9, 9"],
        none=["x, y"],
        cut=["start.time, end.time"],
    )
    got = {r.log: (r.mb_per_sec, r.records_per_sec, r.failed) for r in logs.consumer_perf(lines).collect()}
    assert got == {"ok": (2.5, 77.0, False), "none": (None, None, True), "cut": (None, None, True)}


def test_detailed_consumer_log(spark):
    lines = _log(spark, a=["time, thread", "t, 0, 1, 2, 3, 4, 5, 6", "t, 0, 1, 20, 3, 40, 50, 60", "time, again"])
    row = logs.consumer_perf_detailed(lines).first()
    assert (row.records_per_sec, row.mb_per_sec, row.rebalance_time_ms, row.fetch_time_ms) == (40.0, 20.0, 50.0, 60.0)
    assert logs.last_record(lines).first().last_line == "t, 0, 1, 20, 3, 40, 50, 60"


def test_key_values(spark):
    lines = _log(spark, a=["  read_time_s: 1.25", "  read_time_s: 1.50", "  first_record_latency:  -1.00s", "read: x"])
    row = logs.key_values(lines, ["read_time_s", "first_record_latency", "total"]).first()
    assert (row.read_time_s, row.first_record_latency, row.total) == (1.5, -1.0, None)


def test_json_block(spark):
    lines = _log(
        spark,
        many=['"records": 9', "RESULTS_START", "{", '  "records": 10,', '  "rate": 1.5e3', "}", "RESULTS_END", '"records": 8'],
        one=["RESULTS_START", '{"records": 3, "rate": 0.5}', "RESULTS_END"],
        open=["RESULTS_START", '{"records": 3}'],
    )
    got = {r.log: (r.records, r.rate) for r in logs.json_block(lines, ["records", "rate"]).collect()}
    assert got == {"many": (10.0, 1500.0), "one": (3.0, 0.5)}


def test_csv_marker(spark):
    lines = _log(spark, a=["noise", "CONSUMER_CSV:run_a,10,0.50,3.50,2.00,5.50,0.25"])
    assert tuple(logs.csv_marker(lines).first()) == ("run_a", 10, 0.5, 3.5, 2.0, 5.5, 0.25)


def test_failed_runs(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "log string")
    parsed = spark.createDataFrame([("a", 1.0)], "log string, mb double")
    got = {r.log: (r.mb, r.failed) for r in logs.failed_runs(expected, parsed).collect()}
    assert got == {"a": (1.0, False), "b": (None, True)}
    assert [r.log for r in logs.missing_runs(expected, parsed).collect()] == ["b"]


def test_tail(spark):
    values = [9, 1, 2, 3, 4, 50, 6]
    lines = _log(spark, a=[f"{v}.0 records/sec" for v in values], b=["8.0 records/sec", "none"])
    assert {r.log: r.tail_mean for r in logs.tail_mean(lines, logs.RECORDS_PER_SEC).collect()} == {"a": 13.0, "b": 8.0}
    assert {r.log: r.tail_max for r in logs.tail_max(lines, logs.RECORDS_PER_SEC).collect()} == {"a": 50.0, "b": 8.0}
    plan = logs.tail_mean(lines, logs.RECORDS_PER_SEC)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]


def plain_consumer_perf(rows):
    """{log: (mb, records, failed)}: the line with the next higher position after the last header."""
    found = {}
    for log in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == log), key=lambda r: r[1])
        at = [i for i, r in enumerate(mine) if r[2] is not None and logs.CONSUMER_HEADER in r[2]]
        after = [r[2] for r in mine[at[-1] + 1 : at[-1] + 2]] if at else []
        fields = after[0].split(",") if after and after[0] is not None else None
        pick = lambda i: float(fields[i]) if fields and len(fields) > i and fields[i].strip() else None
        found[log] = (pick(3), pick(5), fields is None)
    return found


@pytest.mark.parametrize("block", [1, 2, 7, 65_536])
def test_consumer_log_in_blocks(spark, block):
    """Headers at the end of a block, gaps in positions, empty blocks, null lines, negative positions."""
    rng = random.Random(block)
    rows = []
    for log in range(40):
        at = rng.randint(-20, 0)
        for _ in range(rng.randint(1, 25)):
            at += rng.choice([1, 1, 2, 9])
            kind = rng.choice(["start.time, MB", "0, 0, 0, 1.5, 0, 2.5", "junk", None, f"a,b,c,{at},e,{at + 1}", ",,,,,"])
            rows.append((log, at, kind))
    lines = spark.createDataFrame(rows, "log int, line_ix int, line string").repartition(5)
    got = logs.consumer_perf(lines, block)
    assert {r.log: (r.mb_per_sec, r.records_per_sec, r.failed) for r in got.collect()} == plain_consumer_perf(rows)


def test_consumer_log_sends_no_text_and_joins_nothing(spark):
    lines = spark.createDataFrame([(1, 1, "x")], "log int, line_ix long, line string")
    plan = logs.consumer_perf(lines)._jdf.queryExecution().executedPlan().toString()
    steps = plan.splitlines()
    exchanges = [i for i, x in enumerate(steps) if "Exchange" in x]
    text = [i for i, x in enumerate(steps) if " line#" in x or "[line#" in x or ",line#" in x]
    assert len(exchanges) == 2 and min(text) > max(exchanges)
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan.replace("isFinalPlan", "")


@pytest.mark.parametrize("shape", ["even", "heavy tail", "few values", "one log"])
def test_latency_sketches_are_within_their_error(spark, shape):
    """Sketches of parts, united, against the exact percentile by rank."""
    rng = random.Random(shape)
    draw = {
        "even": lambda: rng.random(), "heavy tail": lambda: rng.paretovariate(0.7),
        "few values": lambda: float(rng.randrange(5)), "one log": lambda: rng.gauss(100, 15),
    }[shape]
    rows = [(0 if shape == "one log" or rng.random() < 0.6 else rng.randrange(1, 4), i % 7, draw()) for i in range(20_000)]
    df = spark.createDataFrame([*rows, (0, 1, None), (0, 1, float("nan"))], "log int, run int, ms double")
    parts = logs.latency_sketches(df, ["log", "run"], "ms")
    shares = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "p999": 0.999}
    for r in logs.sketch_quantiles(logs.merge_sketches(parts, ["log"]), shares).collect():
        mine = sorted(x[2] for x in rows if x[0] == r.log)
        assert (r.records, r.least, r.greatest) == (len(mine), mine[0], mine[-1])
        for name, share in shares.items():
            below, upto = sum(x < r[name] for x in mine), sum(x <= r[name] for x in mine)
            off = 2 * logs.rank_error() * len(mine) + 1
            assert below - off <= share * len(mine) <= upto + off, name


def test_sketches_of_few_and_no_latencies(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0)], "log string, ms double")
    merged = logs.merge_sketches(logs.latency_sketches(df, ["log"], "ms"), ["log"])
    got = {r.log: (r.records, r.p50) for r in logs.sketch_quantiles(merged, {"p50": 0.5}).collect()}
    assert got == {"a": (3, 2.0), "b": (0, None), None: (1, 5.0)}
    assert logs.sketch_quantiles(logs.merge_sketches(logs.latency_sketches(df.limit(0), ["log"], "ms"), ["log"]), {"p50": 0.5}).collect() == []
