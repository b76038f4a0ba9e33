"""Topics: partitioned, offset-numbered messages.

``FileTopics`` keeps each topic as parquet with the columns of Spark's Kafka source, so reads,
streams and measurements are written once.  ``KafkaTopics`` maps the same calls to the Kafka
connector; it needs the connector's jar and is covered by option-mapping tests only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ferrytrace.functions.measures import prefixed_topic
from ferrytrace.operators.ordered import dense_index
from ferrytrace.schemas import TOPIC
from ferrytrace.session import written

BATCH_DIR = "batch_id"


def with_offsets(
    messages: DataFrame,
    topic: str | Column,
    order: list[str],
    partitions: int = 8,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Messages in the Kafka source layout, offsets counted from 0 in each topic partition.

    Messages have ``key`` and ``value``; optional are ``partition``, ``timestamp`` and
    ``headers``.  Without a ``partition`` the key decides (rows without a key spread by their
    order column).  ``order`` must be unique; it may name columns that are not published.
    """
    df = messages
    if "partition" not in df.columns:
        spread = F.coalesce(F.xxhash64(F.col("key")), F.lit(0))
        keyless = F.xxhash64(*[F.col(c) for c in order])
        df = df.withColumn(
            "partition",
            F.pmod(F.when(F.col("key").isNull(), keyless).otherwise(spread), F.lit(partitions)),
        )
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp())
    if "headers" not in df.columns:
        df = df.withColumn("headers", F.lit(None).cast(TOPIC["headers"].dataType))
    df = df.withColumn("partition", F.col("partition").cast("int"))
    name = F.lit(topic) if isinstance(topic, str) else topic
    df = df.withColumn("topic", name)
    numbered = dense_index(df, order, ["topic", "partition"], "offset", rows_per_block)
    return numbered.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
        F.col("headers").cast(TOPIC["headers"].dataType).alias("headers"),
    )


def end_offsets(topic: DataFrame) -> DataFrame:
    """One past the last offset of each partition."""
    return topic.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))


def since(topic: DataFrame, ends: DataFrame) -> DataFrame:
    """Messages at or after the given end offsets; partitions unknown then are read whole."""
    return (
        topic.join(ends, ["topic", "partition"], "left")
        .filter(F.col("offset") >= F.coalesce(F.col("end_offset"), F.lit(0)))
        .select(*topic.columns)
    )


def depth_per_partition(topic: DataFrame) -> DataFrame:
    """Messages held by each partition, from its first and last offset."""
    return topic.groupBy("topic", "partition").agg(
        (F.max("offset") - F.min("offset") + 1).alias("depth")
    )


def copy_lag(source: DataFrame, copy: DataFrame, prefix: str = "source") -> DataFrame:
    """How many messages of each source partition its copy under a prefixed name still lacks."""
    copied = depth_per_partition(copy).withColumnsRenamed({"topic": "_copy", "depth": "_copied"})
    named = depth_per_partition(source).withColumn("_copy", prefixed_topic(F.col("topic"), prefix))
    lag = F.col("depth") - F.coalesce("_copied", F.lit(0))
    return named.join(copied, ["_copy", "partition"], "left").select("topic", "partition", lag.alias("lag"))


def topic_depth(topic: DataFrame) -> DataFrame:
    return depth_per_partition(topic).groupBy("topic").agg(F.sum("depth").alias("depth"))


@dataclass(frozen=True)
class FileTopics:
    """Topics below one directory: ``<root>/<topic>/batch_id=<n>/*.parquet``."""

    root: str

    def path(self, topic: str) -> str:
        return f"{self.root.rstrip('/')}/{topic}"

    def publish(
        self,
        messages: DataFrame,
        topic: str,
        order: list[str],
        partitions: int = 8,
        batch_id: int = 0,
        rows_per_block: int | None = None,
        stage: bool = False,
    ) -> None:
        """Write one batch.  Writing the same ``batch_id`` again replaces it, so a retry after a
        failure neither loses nor doubles messages; offsets go on after the earlier batches.

        Numbering looks at the messages several times.  ``stage`` writes them to the shared folder
        first, for inputs that are dear to compute again: text files, packed messages, streams.
        """
        if stage:
            messages = written(messages, "messages")
        numbered = with_offsets(messages, topic, order, partitions, rows_per_block)
        if batch_id > 0:
            before = self.ends_before(messages.sparkSession, topic, batch_id)
            numbered = numbered.join(before, "partition", "left").withColumn(
                "offset", F.col("offset") + F.coalesce(F.col("end_offset"), F.lit(0))
            )
        self.write_batch(numbered, topic, batch_id)

    def write_batch(self, topic_rows: DataFrame, topic: str, batch_id: int = 0) -> None:
        """Write rows that already have partition and offset, then the end offsets the topic has
        reached with them, so the newest batch's ends are the topic's."""
        spark = topic_rows.sparkSession
        target = f"{self.path(topic)}/{BATCH_DIR}={batch_id}"
        topic_rows.select(*[f.name for f in TOPIC]).write.mode("overwrite").parquet(target)
        reached = spark.read.schema(TOPIC).parquet(target).select("partition", (F.col("offset") + 1).alias("end_offset"))
        if batch_id > 0:
            reached = reached.unionByName(self.ends_before(spark, topic, batch_id))
        ends = reached.groupBy("partition").agg(F.max("end_offset").alias("end_offset"))
        ends.coalesce(1).write.mode("overwrite").parquet(f"{self._ends(topic)}/{BATCH_DIR}={batch_id}")

    def _ends(self, topic: str) -> str:
        return f"{self.root.rstrip('/')}/_ends/{topic}"

    def ends_before(self, spark: SparkSession, topic: str, batch_id: int) -> DataFrame:
        """End offsets reached before a batch: only the ends the newest earlier batch left are read.
        A topic that has none yet begins at 0, whatever the batch is called."""
        layout = "partition int, end_offset long"
        reader = spark.read.schema(layout)
        try:
            left = reader.option("recursiveFileLookup", True).parquet(self._ends(topic)).inputFiles()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            left = []
        numbers = [int(n) for n in re.findall(rf"/{BATCH_DIR}=(\d+)/", "\n".join(left))]
        earlier = [n for n in numbers if n < batch_id]
        if not earlier:
            return spark.createDataFrame([], layout)
        return spark.read.schema(layout).parquet(f"{self._ends(topic)}/{BATCH_DIR}={max(earlier)}")

    def read(self, spark: SparkSession, topic: str) -> DataFrame:
        """Everything from the earliest to the latest offset."""
        return spark.read.schema(TOPIC).option("recursiveFileLookup", True).parquet(self.path(topic))

    def read_stream(self, spark: SparkSession, topic: str, **options: str) -> DataFrame:
        """The topic as an unbounded table; ``topic`` may be a glob over topic names."""
        return (
            spark.readStream.schema(TOPIC).options(**options).parquet(f"{self.path(topic)}/*")
        )


@dataclass(frozen=True)
class KafkaTopics:
    """The same calls on a Kafka cluster."""

    bootstrap_servers: str
    producer: Mapping[str, str] = field(default_factory=dict)

    def write_options(self, topic: str) -> dict[str, str]:
        """Producer settings only work as writer options with the ``kafka.`` prefix."""
        return {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "topic": topic,
            **{f"kafka.{name}": str(value) for name, value in self.producer.items()},
        }

    def read_options(
        self,
        topic: str,
        starting: str | Mapping[str, Mapping[str, int]] = "earliest",
        ending: str | Mapping[str, Mapping[str, int]] | None = "latest",
        fail_on_data_loss: bool = False,
    ) -> dict[str, str]:
        def offsets(value):
            return value if isinstance(value, str) else json.dumps(value)

        options = {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "subscribePattern" if any(c in topic for c in "*|[(") else "subscribe": topic,
            "startingOffsets": offsets(starting),
            "failOnDataLoss": str(fail_on_data_loss).lower(),
            "includeHeaders": "true",
        }
        if ending is not None:
            options["endingOffsets"] = offsets(ending)
        return options

    def publish(
        self, messages: DataFrame, topic: str, order: list[str] | None = None, *_, **__
    ) -> None:
        """Publish in one pass; the broker numbers the messages, so ``order`` is not used."""
        columns = [c for c in ("key", "value", "headers", "partition") if c in messages.columns]
        messages.select(*columns).write.format("kafka").options(**self.write_options(topic)).save()

    def publish_stream(self, stream: DataFrame) -> DataStreamWriter:
        """A stream writer for rows that name their ``topic`` in a column."""
        options = self.write_options("")
        options.pop("topic")
        return stream.writeStream.format("kafka").options(**options)

    def read(self, spark: SparkSession, topic: str, **offsets) -> DataFrame:
        return spark.read.format("kafka").options(**self.read_options(topic, **offsets)).load()

    def read_stream(self, spark: SparkSession, topic: str, starting="earliest") -> DataFrame:
        options = self.read_options(topic, starting, ending=None)
        return spark.readStream.format("kafka").options(**options).load()


# Producer settings of the delivery jobs, by job.
KEYED_PRODUCER = {
    "acks": "1",
    "batch.size": "16384",
    "linger.ms": "10",
    "buffer.memory": "67108864",
}
