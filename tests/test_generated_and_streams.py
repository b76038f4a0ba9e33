"""Generators do not depend on partitions; streams equal their batch form, also across batches."""

import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrytrace.operators.delivery import idle_cutoff
from ferrytrace.operators.packing import chunk_by_bytes, chunk_summary, in_chunks
from ferrytrace.schemas import READING, TOPIC
from ferrytrace.session import new_area, written
from ferrytrace.sources import generated
from ferrytrace.sources.topics import FileTopics, copy_lag, end_offsets, topic_depth
from ferrytrace.streaming import flows


def test_rows_for_size():
    assert generated.rows_for_size(5) == 83_886_080


def test_readings_do_not_depend_on_partitions(spark):
    ids = spark.range(2000)
    one = sorted(map(tuple, generated.readings(ids.coalesce(1)).collect()))
    many = sorted(map(tuple, generated.readings(ids.repartition(13)).collect()))
    assert one == many
    assert [f.dataType for f in generated.readings(ids).schema] == [f.dataType for f in READING]
    again = generated.readings(spark.range(100)).select("timestamp").collect()
    assert again[0].timestamp == generated.FIRST_HOUR


def test_a_ninth_of_the_readings_passes(spark):
    report = generated.selectivity_report(generated.readings(spark.range(200_000))).first()
    assert report.records == 200_000
    assert abs(report.passing_pct - 100 / 9) < 0.5


def test_every_country_city_and_pollutant_occurs(spark):
    df = generated.readings(spark.range(50_000))
    assert df.select("country", "city").distinct().count() == sum(len(c[3]) for c in generated.COUNTRIES.values())
    limits = {r.pollutant: (r.low, r.high) for r in df.groupBy("pollutant").agg(
        F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    for name, _, low, high in generated.POLLUTANTS:
        assert low <= limits[name][0] <= limits[name][1] <= high


@pytest.mark.parametrize("size", [50, 100, 1000])
def test_payload_sizes(spark, size):
    df = generated.json_payload(spark.range(100), size, 1_700_000_000)
    data = df.select(F.length(F.get_json_object("value", "$.data")).alias("n"))
    assert {r.n for r in data.collect()} == {max(0, size - 60)}
    fixed = generated.fixed_bytes(spark.range(100), size).select(F.octet_length("value").alias("n"))
    assert {r.n for r in fixed.collect()} == {size}


def test_compact_lines(spark):
    rows = generated.compact_lines(spark.range(500), F.lit(123)).collect()
    assert all(len(r.value.split(",")) == 8 for r in rows)
    assert {r.value.split(",")[0] for r in rows} == {"LU", "DE", "BE"}
    assert bytes(rows[0].headers[0].value) == b"123"


@pytest.fixture
def topic(spark, tmp_path):
    """A topic in three batches, so a stream can take them one by one."""
    rng = random.Random(5)
    rows, now = [], 0
    for i in range(600):
        now += rng.choice([1, 2, 3, 40])
        rows.append((i, str(i % 5), "x" * rng.randrange(0, 50), now))
    df = spark.createDataFrame(rows, "id long, key string, value string, s long")
    messages = df.withColumn("timestamp", F.timestamp_micros(F.col("s") * 1_000_000))
    topics = FileTopics(str(tmp_path / "topics"))
    for batch in range(3):
        part = messages.filter((F.col("id") >= batch * 200) & (F.col("id") < (batch + 1) * 200))
        topics.publish(part, "t", ["id"], 3, batch_id=batch)
    return topics


def test_chunks_continue_across_batches(spark, topic):
    target, checkpoint = new_area(spark, "chunks"), new_area(spark, "cp")
    stream = topic.read_stream(spark, "t", maxFilesPerTrigger="1")
    flows.drain(flows.transfer_chunks(stream, 300, target, checkpoint))
    moved = spark.read.parquet(f"{target}/messages")
    assert moved.select("batch_id").distinct().count() == 3
    got = sorted(map(tuple, chunk_summary(moved).collect()))
    assert got == sorted(map(tuple, chunk_by_bytes(topic.read(spark, "t"), 300).collect()))


def test_chunks_equal_the_batch_form(spark, topic):
    target, checkpoint = new_area(spark, "chunks"), new_area(spark, "cp")
    flows.drain(flows.transfer_chunks(topic.read_stream(spark, "t"), 300, target, checkpoint))
    moved = sorted(map(tuple, chunk_summary(spark.read.parquet(f"{target}/messages")).collect()))
    assert moved == sorted(map(tuple, chunk_by_bytes(topic.read(spark, "t"), 300).collect()))


def test_chunk_bookkeeping_stays_constant_over_many_batches(spark):
    """Fifty batches: each leaves one small file of totals, of all partitions seen so far, and its
    messages are chunked as in one go; batch n reads the totals of batch n - 1 alone."""
    rng = random.Random(8)
    rows = [("t", i % 3 if i < 200 else 0, None, "x" * rng.choice([0, 1, 30, 400]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "topic string, partition int, key string, value string, i long")
    window = Window.partitionBy("partition").orderBy("i")
    df = df.withColumn("offset", (F.row_number().over(window) + 10).cast("long"))
    source, target, checkpoint = (new_area(spark, x) for x in ("in", "chunks", "cp"))
    df.cache().count()
    for part in range(50):
        df.filter(F.floor(F.col("i") / 10) == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    flows.drain(flows.transfer_chunks(stream, 700, target, checkpoint))
    moved = spark.read.parquet(f"{target}/messages")
    assert sorted(map(tuple, chunk_summary(moved).collect())) == sorted(map(tuple, chunk_by_bytes(df, 700).collect()))
    assert moved.select(df.columns).exceptAll(df).isEmpty() and moved.count() == 500
    files = [len(list(Path(f"{target}/totals/batch_id={n}").glob("part-*"))) for n in range(50)]
    assert files == [1] * 50
    newest = {r.partition: r.carried for r in spark.read.parquet(f"{target}/totals/batch_id=49").collect()}
    assert newest == {p: sum(len(r[3]) for r in rows if r[1] == p) for p in range(3)}


@pytest.mark.parametrize("size", [1, 700, 10**9])
def test_messages_find_their_chunk(spark, topic, size):
    """Chunks of one message, of some, and one for all: each message is in the chunk whose interval has it."""
    messages = topic.read(spark, "t")
    chunks = chunk_by_bytes(messages, size)
    placed = in_chunks(messages, chunks)
    assert placed.count() == 600
    assert sorted(map(tuple, chunk_summary(placed).collect())) == sorted(map(tuple, chunks.collect()))


def test_replica_is_the_same_multiset_and_resumes(spark, topic):
    target, checkpoint = FileTopics(new_area(spark, "replica")), new_area(spark, "cp")
    for _ in range(2):
        flows.drain(flows.replicate(topic.read_stream(spark, "t"), target, checkpoint, ["t"]))
    copied = target.read(spark, "source.t")
    assert topic_depth(copied).first()["depth"] == topic_depth(topic.read(spark, "t")).first()["depth"]
    assert {r.lag for r in copy_lag(topic.read(spark, "t"), copied).collect()} == {0}
    assert {r.topic for r in copied.select("topic").distinct().collect()} == {"source.t"}
    columns = ["key", "value", "partition", "offset", "timestamp"]
    assert copied.select(columns).exceptAll(topic.read(spark, "t").select(columns)).isEmpty()
    assert copied.count() == 600


def test_replica_of_many_batches(spark, topic):
    """Repeated batches replace themselves; ends reach over all batches; the lag shows what is missing."""
    target, checkpoint = FileTopics(new_area(spark, "replica")), new_area(spark, "cp")
    stream = topic.read_stream(spark, "t", maxFilesPerTrigger="1")
    query = flows.drain(flows.replicate(stream, target, checkpoint, names=["t"]))
    source, copied = topic.read(spark, "t"), target.read(spark, "source.t")
    progress = flows.batch_progress(spark, query).collect()
    assert sum(r.records for r in progress) == copied.count() == 600
    ends = target.ends_before(spark, "source.t", 10**6)
    assert sorted(map(tuple, ends.collect())) == sorted(
        (r["partition"], r["end_offset"]) for r in end_offsets(source).collect()
    )
    first = spark.read.schema(TOPIC).parquet(f"{target.path('source.t')}/batch_id=0")
    lags = copy_lag(source, first).agg(F.sum("lag")).first()[0]
    assert lags == 600 - first.count()
    target.write_batch(written(first, "again"), "source.t", 0)
    assert target.read(spark, "source.t").count() == 600


def test_unbounded_replica_until_the_copy_is_whole(spark, topic):
    target = FileTopics(new_area(spark, "replica"))
    source = topic.read(spark, "t")
    query = flows.replicate(topic.read_stream(spark, "t"), target, new_area(spark, "cp"), ["t"], bounded=False)

    def whole():
        if not query.lastProgress:
            return False
        return copy_lag(source, target.read(spark, "source.t")).filter("lag > 0").isEmpty()

    flows.run_until(query, whole, 0.2)
    assert not query.isActive and target.read(spark, "source.t").count() == 600


def plain_ends(rows, timeout_us, target):
    """Per run (first, last, records, bytes, why) of a reader with an end, from (run, us, bytes)."""
    found, newest = [], max(us for _, us, _ in rows) // 1000 * 1000 - 1000
    for run in {r[0] for r in rows}:
        mine = sorted((us, size) for key, us, size in rows if key == run)
        taken = [mine[0]]
        while len(taken) != target and len(taken) < len(mine) and mine[len(taken)][0] - taken[-1][0] < timeout_us:
            taken.append(mine[len(taken)])
        why = "target" if len(taken) == target else "idle"
        if taken[-1][0] + (timeout_us if why == "idle" else 0) <= newest:
            found.append((run, taken[0][0], taken[-1][0], len(taken), sum(x for _, x in taken), why))
    return found


@pytest.mark.parametrize(("files", "restart"), [(1, False), (5, False), (5, True)])
@pytest.mark.parametrize("target", [0, 1, 30, 10**6])
def test_reader_ends_at_the_first_gap_or_target(spark, files, restart, target):
    """The same ends however the stream is cut, in files whose order is not that of arrival, and restarted."""
    messages = run_messages(spark, files)
    source, ended, checkpoint = (new_area(spark, x) for x in ("in", "ends", "cp"))
    for part in range(files):
        messages.filter(F.col("part") == part).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(source)
        if restart or part == files - 1:
            stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
            ends = flows.reader_ends(stream, ["run"], 20, target)
            flows.drain(flows.append_files(ends, ended, checkpoint))
    rows = messages.select("run", F.unix_micros("timestamp"), F.coalesce(F.octet_length("value"), F.lit(0))).collect()
    got = sorted(map(tuple, spark.read.schema(ends.schema).parquet(ended).collect()), key=repr)
    assert got == sorted(plain_ends([tuple(r) for r in rows], 20 * 1_000_000, target), key=repr)


IDLE_COLUMNS = ["first_arrival", "last_arrival", "records", "bytes", "records_after"]


def monitored(spark, messages, files, timeout_s, strict=False, restart=False, late_s=0):
    """The idle ends of runs whose messages arrive in so many files, and the rows of state by batch."""
    source, target, checkpoint = (new_area(spark, x) for x in ("in", "monitor", "cp"))
    rows = []
    for part in range(files):
        chosen = messages.filter(F.col("part") == part).coalesce(1)
        chosen.write.mode("append").parquet(source)
        if restart or part == files - 1:
            stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = flows.drain(flows.monitor_delivery(stream, ["run"], timeout_s, target, checkpoint, True, late_s, strict))
            rows += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    layout = flows.delivery_sessions(stream, ["run"], timeout_s).schema
    ends = flows.idle_end(flows.monitored_sessions(spark, layout, target, checkpoint), ["run"])
    return sorted(map(tuple, ends.select("run", *IDLE_COLUMNS).collect()), key=repr), rows


def run_messages(spark, parts, seed=3, count=400):
    rng, rows, now = random.Random(seed), [], 0
    for i in range(count):
        now += rng.choice([0, 1, 2, 3, 10, 11])
        rows.append((rng.choice(["a", "b", None]), now, "x" * rng.randrange(9) if rng.random() < 0.9 else None, i * parts // count))
    df = spark.createDataFrame(rows, "run string, s long, value string, part int")
    return df.withColumn("timestamp", F.timestamp_micros(F.col("s") * 1_000_000)).drop("s")


def batch_ends(messages, timeout_s, strict=False):
    ends = idle_cutoff(messages, ["run"], timeout_s, strict)
    return sorted(map(tuple, ends.select("run", *IDLE_COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("timeout_s", [10, 25, 1000])
def test_monitor_equals_batch(spark, timeout_s, strict):
    """However the stream is cut into batches; gaps equal to the timeout count unless strict."""
    for parts in (1, 4):
        messages = run_messages(spark, parts)
        assert monitored(spark, messages, parts, timeout_s, strict)[0] == batch_ends(messages, timeout_s, strict)


def test_monitor_goes_on_after_a_restart(spark):
    messages = run_messages(spark, 3, seed=4)
    assert monitored(spark, messages, 3, 20, restart=True)[0] == batch_ends(messages, 20)


def test_monitor_state_is_bounded_over_many_batches(spark):
    """Closed sessions leave: never more rows than open sessions and those of one batch."""
    messages = run_messages(spark, 50, seed=5, count=1500)
    ends, rows = monitored(spark, messages, 50, 12)
    assert ends == batch_ends(messages, 12)
    assert len(rows) >= 50 and max(rows) <= 20 and max(rows[25:]) <= max(rows[:25]) + 6


def test_live_monitor_counts_open_sessions(spark):
    messages = run_messages(spark, 1, count=50)
    source, target, checkpoint = (new_area(spark, x) for x in ("in", "monitor", "cp"))
    messages.write.parquet(source)
    stream = spark.readStream.schema(messages.schema).parquet(source)
    flows.drain(flows.monitor_delivery(stream, ["run"], 10**6, target, checkpoint))
    layout = flows.delivery_sessions(stream, ["run"], 10**6).schema
    seen = flows.monitored_sessions(spark, layout, target, checkpoint).collect()
    assert sum(r.records for r in seen) == 50 and all(r.open for r in seen)


def test_filter_and_deliver_in_batches(spark, tmp_path):
    rows = [(i, "LU" if i % 4 == 0 else "FR") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, country string")
    source = str(tmp_path / "in")
    for batch in range(3):
        df.filter(F.pmod("id", F.lit(3)) == batch).coalesce(1).write.mode("append").parquet(source)
    topics = FileTopics(str(tmp_path / "out"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    flows.drain(
        flows.filter_and_deliver(stream, "country", ["LU"], "id", topics, "kept", ["id"], new_area(spark, "cp"), 2)
    )
    kept = topics.read(spark, "kept")
    assert sorted(int(bytes(r.key)) for r in kept.collect()) == list(range(0, 100, 4))
    assert kept.groupBy("partition", "offset").count().filter("count > 1").isEmpty()


def test_cube_overflow_is_null(spark):
    df = spark.createDataFrame([('{"number": 3}',), ('{"number": 2147483647}',)], "value string")
    got = [(r.number, r.cubed) for r in flows.parse_and_cube(df).collect()]
    assert got == [(3, 27), (2147483647, None)]


def test_groups_read_everything(spark, topic):
    target, checkpoint = new_area(spark, "groups"), new_area(spark, "cp")
    sources = [topic.read_stream(spark, "t") for _ in range(2)]
    for query in flows.read_by_groups(sources, target, checkpoint):
        flows.drain(query)
    for n in (1, 2):
        assert spark.read.parquet(f"{target}/group_no={n}").count() == 600


def test_drain_stops_an_unbounded_stream(spark, topic):
    target, checkpoint = new_area(spark, "open"), new_area(spark, "cp")
    query = flows.append_files(topic.read_stream(spark, "t"), target, checkpoint, bounded=False)
    flows.drain(query, seconds=3)
    assert not query.isActive


def test_idle_stop(spark, topic):
    target, checkpoint = new_area(spark, "idle"), new_area(spark, "cp")
    query = flows.append_files(topic.read_stream(spark, "t"), target, checkpoint, bounded=False)
    flows.stop_when_idle(query, idle_s=2, poll_s=0.2)
    assert not query.isActive
    assert spark.read.parquet(target).count() == 600
