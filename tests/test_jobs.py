"""The jobs end to end on generated readings and file topics."""

import pytest
from pyspark.sql import functions as F

from ferrytrace.jobs import delivery_jobs as jobs
from ferrytrace.jobs import run
from ferrytrace.sources import files, generated
from ferrytrace.sources.topics import FileTopics


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    files.write_csv(generated.readings(spark.range(3000)), f"{root}/readings")
    kept = files.read_csv_text(spark, f"{root}/readings").filter("country in ('LU', 'DE', 'BE')")
    return str(root), kept.count()


def test_publish_counts_while_it_writes(spark, data):
    root, kept = data
    topics = FileTopics(f"{root}/topics")
    row = jobs.publish_filtered(spark, f"{root}/readings", topics, "a", run_id="r").first()
    assert (row.raw_records, row.filtered_records) == (3000, kept)
    assert row.filter_ratio == round(kept / 3000, 4)
    topic = topics.read(spark, "a")
    assert topic.count() == kept
    value = topic.select(F.col("value").cast("string").alias("v")).first().v
    assert value.startswith('{"station_id":"STA-') and '"unit":"' in value


def test_publish_packed(spark, data):
    root, kept = data
    topics = FileTopics(f"{root}/topics")
    row = jobs.publish_packed(spark, f"{root}/readings", topics, "b", batch_kb=1).first()
    topic = topics.read(spark, "b")
    assert row.records_per_batch == 14
    assert row.kafka_messages == topic.count() == -(-kept // 14)
    lines = topic.select(F.explode(F.split(F.col("value").cast("string"), "\n")))
    assert lines.count() == kept


def test_save_lines_and_rows(spark, data):
    root, kept = data
    row = jobs.save_filtered(spark, f"{root}/readings", f"{root}/filtered").first()
    assert (row.raw_records, row.filtered_records) == (3000, kept)
    topics = FileTopics(f"{root}/topics")
    jobs.publish_lines(spark, f"{root}/filtered", topics, "c")
    jobs.publish_rows(spark, f"{root}/filtered", topics, "d")
    assert topics.read(spark, "c").count() == topics.read(spark, "d").count() == kept
    assert topics.read(spark, "d").filter("key is null").isEmpty()


def test_throughput_jobs(spark, data):
    root, _ = data
    generated.json_payload(spark.range(500), 100, 1).select("value").write.text(f"{root}/payload")
    topics = FileTopics(f"{root}/topics")
    sent = jobs.throughput_publish(spark, f"{root}/payload", topics, "e").first()
    seen = jobs.throughput_read(spark, topics, "e").first()
    assert (sent.records, sent.size_mb) == (seen.records, seen.size_mb) == (500, sent.size_mb)
    assert sent.size_mb > 0


def test_command_line(spark, data, tmp_path, capsys, monkeypatch):
    root, kept = data
    monkeypatch.setattr(run, "build_session", lambda name: spark)
    place = ["--topic-root", str(tmp_path / "t")]
    metrics = str(tmp_path / "metrics")
    for run_id in ("x", "y"):
        run.main(["publish", "--input", f"{root}/readings", "--topic", run_id, "--run-id", run_id,
                  "--metrics", metrics, *place])
    assert spark.read.parquet(metrics).count() == 2
    run.main(["measure", "--topic", "x", "--started", "2024-01-01 00:00:00", *place])
    assert f"{kept}" in capsys.readouterr().out
    numbers = spark.range(5).select(
        F.lit(None).cast("string").alias("key"),
        F.to_json(F.struct(F.col("id").alias("number"), (F.col("id") * F.col("id")).alias("squared"))).alias("value"),
        "id",
    )
    FileTopics(str(tmp_path / "t")).publish(numbers, "n", ["id"])
    run.main(["cube-stream", "--topic", "n", "--output", str(tmp_path / "cubes"), *place])
    cubes = spark.read.parquet(str(tmp_path / "cubes"))
    assert sorted(r.cubed for r in cubes.collect()) == [0, 1, 8, 27, 64]


def test_receive_stops_at_a_gap_or_a_target(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(run, "build_session", lambda name: spark)
    seconds = [0, 1, 1, 2, 40, 41]
    rows = [(i, s, "x" * (i + 1)) for i, s in enumerate(seconds)]
    messages = spark.createDataFrame(rows, "id long, s long, value string").select(
        F.lit(None).cast("string").alias("key"), "value", F.timestamp_seconds("s").alias("timestamp"), "id"
    )
    topics = FileTopics(str(tmp_path / "t"))
    topics.publish(messages, "m", ["id"], partitions=2)
    topics.publish(messages.limit(0), "none", ["id"], partitions=2)
    for idle_s, target, records, active in ((30, 0, 4, 2.0), (60, 0, 6, 41.0), (30, 2, 2, 1.0), (30, 5, 4, 2.0)):
        got = jobs.receive_topic(spark, topics, "m", idle_s, target, "1969-12-31 23:59:55").first()
        assert (got.records, got.active_duration_s, got.first_record_latency_s) == (records, active, 5.0)
    nothing = jobs.receive_topic(spark, topics, "none", 30).first()
    assert (nothing.records, nothing.first_record_latency_s) == (0, -1.0)
    metrics = str(tmp_path / "metrics")
    run.main(["receive", "--topic", "m", "--topic-root", topics.root, "--target", "3", "--metrics", metrics])
    assert spark.read.parquet(metrics).first().records == 3
