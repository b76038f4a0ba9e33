"""Figure tables from small result files with gaps, replicates and both acks levels."""

import pytest

from ferrytrace.plans import figures
from ferrytrace.schemas import NATIVE_RESULTS, SPARK_RESULTS
from ferrytrace.sources import files


@pytest.fixture(scope="module")
def native(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("native") / "r.csv"
    path.write_text(
        ",".join(f.name for f in NATIVE_RESULTS) + "\n"
        "producer,1,100,100000,1,N/A,9.0,1.5,4.0,5.0,\n"
        "producer,1,100,1000000,1,N/A,9.0,10.0,4.0,5.0,\n"
        "producer,1,100,1000000,1,N/A,9.0,99.0,4.0,5.0,\n"
        "producer,1,100,1000000,all,N/A,9.0,8.0,6.0,5.0,\n"
        "producer,8,10240,1000000,1,N/A,9.0,40.0,N/A,N/A,\n"
        "consumer,1,100,N/A,N/A,1,9.0,2.0,N/A,N/A,N/A\n"
        "consumer,1,100,N/A,N/A,1,9.0,4.0,N/A,N/A,N/A\n"
        "consumer,1,100,N/A,N/A,2,9.0,50.0,N/A,N/A,N/A\n"
    )
    return figures.with_row_number(files.read_results(spark, str(path), NATIVE_RESULTS))


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    for run, mb in (("run_1", 20.0), ("run_2", 40.0)):
        (root / run).mkdir()
        (root / run / "r.csv").write_text(
            ",".join(f.name for f in SPARK_RESULTS) + f"\n1,100,16384b,1.0,{mb},1.0,5\n1,100,nobatch,1.0,1.0,1.0,5\n"
        )
    return files.read_results(spark, f"{root}/run_*", SPARK_RESULTS, r"/(run_\d+)/")


def test_throughput(native):
    got = {(r.message_size_bytes, r.partitions): (r.producer_mb, r.consumer_mb)
           for r in figures.native_throughput(native).collect()}
    assert len(got) == 12
    assert got[100, 1] == (10.0, 3.0) and got[10240, 8] == (40.0, 0.0) and got[1024, 2] == (0.0, 0.0)


def test_acks(native):
    row = figures.acks_comparison(native).filter("message_size_bytes = 100").first()
    assert (row["1"], row["all"], row.diff_pct) == (10.0, 8.0, -20.0)
    latency = figures.acks_comparison(native, "avg_latency_ms").filter("message_size_bytes = 100").first()
    assert (latency["1"], latency["all"], latency.diff_pct) == (4.0, 6.0, 50.0)


def test_points_need_a_latency(native):
    points = figures.throughput_against_latency(native).collect()
    assert {(p.producer_acks, p.mb_per_sec, p.avg_latency_ms) for p in points} == {("1", 10.0, 4.0), ("all", 8.0, 6.0)}


def test_engines(native, runs):
    spread = figures.spark_throughput(runs).filter("measured").first()
    assert (spread["mean"], spread["std"], spread.runs) == (30.0, 10.0, 2)
    both = figures.spark_against_native(native, runs).filter("size = '100 B' and partitions = 1").first()
    assert (both.native_mb, both.spark_mb, both.gap_mb, both.ratio) == (10.0, 30.0, 20.0, 3.0)
