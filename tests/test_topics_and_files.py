"""Sources and sinks: CSV, lines, logs, results, file topics, Kafka option mapping."""

import pytest
from pyspark.sql import functions as F

from ferrytrace.schemas import NATIVE_RESULTS, READING, TOPIC
from ferrytrace.session import CHECKPOINT_DIR, new_area, shared_dir, size_shuffles, written
from ferrytrace.sources import files
from ferrytrace.sources.topics import (
    KEYED_PRODUCER,
    FileTopics,
    KafkaTopics,
    end_offsets,
    since,
    topic_depth,
    with_offsets,
)


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get(CHECKPOINT_DIR)
    assert new_area(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert new_area(spark, "x") != new_area(spark, "x")


class _Bare:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_only_a_local_session_may_leave_the_folder_unset():
    local = _Bare("local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        shared_dir(_Bare("spark://host:7077"))


def test_shuffles_grow_with_the_input(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        assert size_shuffles(spark, 10) == int(before)
        assert size_shuffles(spark, 256_000) == 1000 == int(spark.conf.get(name))
        assert size_shuffles(spark, 1e8) == 390_625
    finally:
        spark.conf.set(name, before)


def test_written_is_the_same_table(spark):
    df = spark.range(10).withColumn("s", F.lit("a"))
    again = written(df, "t")
    assert again.schema["id"].dataType == df.schema["id"].dataType
    assert sorted(r.id for r in again.collect()) == list(range(10))


def test_csv_text_and_types(spark, tmp_path):
    path = _write(
        tmp_path / "r.csv",
        "station_id,timestamp,country,city,latitude,longitude,pollutant,value,unit\n"
        "S1,1704067200,LU,Differdange,49.5,6.0,PM10,4.2,µg/m³\n"
        "S2,x,DE,Berlin,1.0,2.0,NO2,7.0,µg/m³\n",
    )
    text = files.read_csv_text(spark, path)
    assert {f.dataType.simpleString() for f in text.schema} == {"string"}
    typed = files.read_csv_typed(spark, path, READING, corrupt_column="bad").cache()
    rows = {r.station_id: r for r in typed.collect()}
    assert rows["S1"].value == 4.2 and rows["S1"].bad is None
    assert rows["S2"].timestamp is None and rows["S2"].bad.startswith("S2,x")
    dropped = files.read_csv_typed(spark, path, READING, mode="DROPMALFORMED")
    assert [r.station_id for r in dropped.collect()] == ["S1"]


def test_lines_drop_only_the_header_of_each_file(spark, tmp_path):
    _write(tmp_path / "d/a.csv", 'id,v\n1,"a ""q"" b"\nid,v\n 2 ,\\x\n')
    _write(tmp_path / "d/b.csv", "id,v\n3,é\n")
    _write(tmp_path / "d/c.csv", "id,v\n")
    lines = sorted(r.value for r in files.read_lines(spark, str(tmp_path / "d")).collect())
    assert lines == sorted(['1,"a ""q"" b"', "id,v", " 2 ,\\x", "3,é"])


def test_log_lines_keep_their_order(spark, tmp_path):
    wanted = {}
    for name, n in (("a.log", 5000), ("b.log", 10)):
        lines = [f"{name} line {i}" for i in range(n)]
        wanted[name] = lines
        _write(tmp_path / "logs" / name, "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        log = files.read_log(spark, str(tmp_path / "logs"))
        assert log.rdd.getNumPartitions() > 3
        rows = log.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in wanted.items():
        mine = sorted((r.line_ix, r.line) for r in rows if r.log.endswith(name))
        assert [line for _, line in mine] == lines


def test_results_with_gaps_and_runs(spark, tmp_path):
    header = ",".join(f.name for f in NATIVE_RESULTS) + "\n"
    _write(tmp_path / "run_1/r.csv", header + "producer,1,100,1000,all,N/A,5.5,0.1,3.0,9.0,\n")
    _write(tmp_path / "run_2/r.csv", header + "consumer,1,100,N/A,N/A,1,5.5,0.2,N/A,N/A,N/A\n")
    df = files.read_results(spark, str(tmp_path / "run_*"), NATIVE_RESULTS, r"/(run_\d+)/")
    rows = {r.run: r for r in df.collect()}
    assert rows["run_1"].test_duration_sec is None and rows["run_1"].consumer_groups is None
    assert rows["run_2"].producer_throughput is None and rows["run_2"].mb_per_sec == 0.2


def test_sizes_and_metrics(spark, tmp_path):
    _write(tmp_path / "s/a.txt", "12345")
    _write(tmp_path / "s/deep/b.txt", "é")
    total = files.file_sizes(spark, str(tmp_path / "s")).agg(F.sum("length")).first()[0]
    assert total == 7
    path = str(tmp_path / "metrics")
    for i in range(2):
        files.append_metrics(spark.createDataFrame([(f"run{i}", i)], "run string, n int"), path)
    assert sorted(r.run for r in spark.read.parquet(path).collect()) == ["run0", "run1"]


def test_rows_as_messages_keep_null_fields(spark):
    df = spark.createDataFrame([("", None)], "k string, v string")
    row = files.rows_as_messages(df, "k").first()
    assert (row.key, row.value) == (None, '{"k":"","v":null}')


@pytest.fixture
def messages(spark):
    return spark.range(1000).select(
        F.when(F.col("id") % 3 != 0, F.pmod("id", F.lit(10)).cast("string")).alias("key"),
        F.concat(F.lit("v"), "id").alias("value"),
        "id",
    )


@pytest.mark.parametrize("size", [37, 100_000])
def test_offsets_are_dense_and_ordered(messages, size):
    topic = with_offsets(messages, "t", ["id"], partitions=4, rows_per_block=size)
    assert [f.name for f in topic.schema] == [f.name for f in TOPIC]
    assert [f.dataType for f in topic.schema] == [f.dataType for f in TOPIC]
    seen = {}
    for row in topic.collect():
        seen.setdefault(row.partition, []).append((row.offset, int(bytes(row.value)[1:])))
    assert len(seen) == 4
    for rows in seen.values():
        rows.sort()
        assert [o for o, _ in rows] == list(range(len(rows)))
        assert [v for _, v in rows] == sorted(v for _, v in rows)


def test_a_key_stays_in_one_partition(messages):
    topic = with_offsets(messages, "t", ["id"], partitions=4)
    per_key = topic.filter("key is not null").groupBy("key").agg(F.countDistinct("partition").alias("n"))
    assert {r.n for r in per_key.collect()} == {1}


def test_batches_continue_offsets_and_can_be_repeated(spark, messages, tmp_path):
    topics = FileTopics(str(tmp_path))
    topics.publish(messages.filter("id < 400"), "t", ["id"], 4)
    ends = written(end_offsets(topics.read(spark, "t")), "ends")
    for _ in range(2):
        topics.publish(messages.filter("id >= 400"), "t", ["id"], 4, batch_id=1)
    whole = topics.read(spark, "t")
    assert whole.count() == 1000
    assert topic_depth(whole).first().depth == 1000
    assert whole.groupBy("partition", "offset").count().filter("count > 1").isEmpty()
    new = sorted(int(bytes(r.value)[1:]) for r in since(whole, ends).collect())
    assert new == list(range(400, 1000))


def test_kafka_options():
    topics = KafkaTopics("b:9092", KEYED_PRODUCER)
    assert topics.write_options("t") == {
        "kafka.bootstrap.servers": "b:9092",
        "topic": "t",
        "kafka.acks": "1",
        "kafka.batch.size": "16384",
        "kafka.linger.ms": "10",
        "kafka.buffer.memory": "67108864",
    }
    read = topics.read_options("t")
    assert read["subscribe"] == "t" and read["failOnDataLoss"] == "false"
    assert (read["startingOffsets"], read["endingOffsets"]) == ("earliest", "latest")
    stream = topics.read_options("t.*", {"t": {"0": 5}}, None)
    assert stream["subscribePattern"] == "t.*" and "endingOffsets" not in stream
    assert stream["startingOffsets"] == '{"t": {"0": 5}}'
