"""Registered queries: a function over the test tables and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytrace.functions.messages import make_header
from ferrytrace.session import new_area
from ferrytrace.sources.topics import FileTopics, with_offsets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
WANTED = ["click", "purchase"]
TOPIC_PARTITIONS = 4


class Tables:
    """The test tables and the stand-ins made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def area(self, label: str) -> str:
        return new_area(self.spark, label)

    def topics(self) -> FileTopics:
        return FileTopics(self.area("topics"))

    def ids(self) -> DataFrame:
        """Row ids for the generators: one generated row per event."""
        return self.events.select(F.col("event_id").alias("id"))

    def event_text(self, columns: list[str] | None = None) -> DataFrame:
        """Events as read from a file without a schema: every column is text."""
        return self.events.select(*[F.col(c).cast("string").alias(c) for c in columns or EVENT_COLUMNS])

    def event_stream(self) -> DataFrame:
        """Events as a stream, ``ts`` declared as a timestamp."""
        schema = (
            "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
        )
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        return reader.parquet(self.sf_dir)

    def messages(self) -> DataFrame:
        """Events as messages with produce time, arrival time, headers, partition and run."""
        events = self.events
        produced = F.col("ts").cast("timestamp")
        texts = [F.col(c).cast("string").alias(c) for c in EVENT_COLUMNS]
        late = F.make_dt_interval(secs=F.pmod("event_id", F.lit(7)).cast("decimal(18,6)"))
        return events.select(
            F.col("user_id").cast("string").alias("key"),
            F.to_json(F.struct(*texts)).alias("value"),
            F.pmod("user_id", F.lit(TOPIC_PARTITIONS)).cast("int").alias("partition"),
            produced.alias("timestamp"),
            (produced + late).alias("arrival"),
            F.array(
                make_header("ts_produce", F.unix_millis(produced).cast("string")),
                make_header("ds", F.col("event_type")),
            ).alias("headers"),
            F.col("event_type").alias("run"),
            "event_id",
        )

    def topic(self) -> DataFrame:
        """The messages with offsets, in the layout of a topic."""
        return with_offsets(self.messages(), "events", ["event_id"])

    def published(self) -> FileTopics:
        """The topic ``events`` written to a fresh place."""
        topics = self.topics()
        topics.publish(self.messages(), "events", ["event_id"])
        return topics

    def sweep(self) -> DataFrame:
        """Benchmark results: one line item is one measured row."""
        return self.lineitem.select(
            F.col("l_linenumber").alias("partitions"),
            F.col("l_returnflag").alias("size"),
            F.col("l_linestatus").alias("acks"),
            F.col("l_quantity").alias("mb_per_sec"),
            F.col("l_extendedprice").alias("latency"),
            *LINE_ORDER,
        )

    def planned(self) -> dict[str, DataFrame]:
        """Partition counts that a sweep planned besides those it measured: the region keys."""
        return {"partitions": self.region.select("r_regionkey")}


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

# SQL for the stand-ins above.
EVENT_TEXT_SQL = ", ".join(f"{c}::VARCHAR AS {c}" for c in EVENT_COLUMNS)
EVENT_JSON_SQL = (
    "to_json(struct_pack(" + ", ".join(f"{c} := {c}::VARCHAR" for c in EVENT_COLUMNS) + "))::VARCHAR"
)
EVENT_LINE_SQL = "concat_ws(',', " + ", ".join(f"{c}::VARCHAR" for c in EVENT_COLUMNS) + ")"
# The same line as a CSV writer puts it down: the JSON column is quoted, its quotes are escaped.
CSV_LINE_SQL = EVENT_LINE_SQL.replace(
    "props::VARCHAR", "chr(34) || replace(props, chr(34), chr(92) || chr(34)) || chr(34)"
)
WANTED_SQL = "event_type IN (" + ", ".join(f"'{w}'" for w in WANTED) + ")"
TOPIC_SQL = f"""topic AS (
  SELECT user_id::VARCHAR AS key, {EVENT_JSON_SQL} AS value,
         (user_id % {TOPIC_PARTITIONS})::INTEGER AS part,
         row_number() OVER (PARTITION BY user_id % {TOPIC_PARTITIONS} ORDER BY event_id) - 1 AS pos,
         epoch_us(ts) AS ts_us, epoch_us(ts) + (event_id % 7) * 1000000 AS arrival_us,
         event_type AS run, event_id, strlen({EVENT_JSON_SQL})::BIGINT AS bytes
  FROM events)"""
SWEEP_SQL = """sweep AS (
  SELECT l_linenumber AS partitions, l_returnflag AS size, l_linestatus AS acks,
         l_quantity AS mb_per_sec, l_extendedprice AS latency,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem),
planned AS (SELECT partitions FROM sweep UNION SELECT r_regionkey FROM region)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its inventory id."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def topic_view(topic: DataFrame) -> DataFrame:
    """A topic's rows as comparable columns."""
    return topic.select(
        F.col("partition").alias("part"),
        F.col("offset").alias("pos"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        F.unix_micros("timestamp").alias("ts_us"),
    )


def key_value_view(topic: DataFrame) -> DataFrame:
    return topic.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )
