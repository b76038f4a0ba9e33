"""Record layouts, stated once."""

from pyspark.sql import types as T


_TYPES = {"string": T.StringType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType}


def _struct(columns: str) -> T.StructType:
    """``"name type, name type"`` to a schema, without needing a running session."""
    fields = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in fields])


READING = _struct(
    "station_id string, timestamp long, country string, city string, latitude double, "
    "longitude double, pollutant string, value double, unit string"
)
READING_TEXT = T.StructType([T.StructField(f.name, T.StringType()) for f in READING])

PAYLOAD = _struct("id long, timestamp long, data string")
SQUARES = _struct("number int, squared int")

_HEADER = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]
)
TOPIC = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
        T.StructField("headers", T.ArrayType(_HEADER)),
    ]
)

RUN_METRICS = _struct(
    "run_id string, input_file string, input_size_mb double, raw_records long, "
    "filtered_records long, filter_ratio double, estimated_filtered_mb double, "
    "bootstrap_servers string, topic string, partitions int, acks string, batch_size string, "
    "read_time_s double, filter_time_s double, kafka_produce_time_s double, "
    "total_time_s double, kafka_throughput_mbps double"
)
RUN_METRICS_PACKED = _struct(
    "run_id string, input_size_mb double, raw_records long, filtered_records long, "
    "filter_ratio double, estimated_filtered_mb double, batch_kb int, records_per_batch int, "
    "kafka_messages long, bootstrap_servers string, topic string, partitions int, acks string, "
    "read_time_s double, filter_time_s double, batch_time_s double, "
    "kafka_produce_time_s double, total_time_s double, kafka_throughput_mbps double"
)
CONSUMER_METRICS = _struct(
    "run_id string, records long, bytes_mb double, first_record_latency_s double, "
    "active_duration_s double, consumer_total_s double, throughput_mbps double"
)
CONSUMER_E2E = _struct(
    "kafka_messages long, bytes_mb double, active_duration_s double, e2e_s double, "
    "e2e_throughput_mbps double, active_throughput_mbps double"
)

NATIVE_RESULTS = _struct(
    "test_type string, partitions int, message_size_bytes int, producer_throughput long, "
    "producer_acks string, consumer_groups int, records_per_sec double, mb_per_sec double, "
    "avg_latency_ms double, max_latency_ms double, test_duration_sec double"
)
SPARK_RESULTS = _struct(
    "partitions int, record_size_bytes int, batch_size string, records_per_sec double, "
    "mb_per_sec double, duration_sec double, total_records long"
)
SCALING_RESULTS = _struct(
    "num_brokers int, replication_factor int, test_type string, partitions int, "
    "message_size_bytes int, producer_acks string, consumer_groups int, "
    "records_per_sec double, mb_per_sec double, avg_latency_ms double, max_latency_ms double"
)
RF_RESULTS = _struct(
    "rf int, partitions int, acks string, run int, records_per_sec double, mb_per_sec double, "
    "avg_latency_ms double, max_latency_ms double"
)
CLOUD_RESULTS = _struct(
    "segment string, aws_region string, test_type string, partitions int, "
    "message_size_bytes int, producer_acks string, records_per_sec double, mb_per_sec double, "
    "avg_latency_ms double, max_latency_ms double, p50_latency_ms double, p99_latency_ms double"
)
MAX_THROUGHPUT_RESULTS = _struct(
    "partitions int, message_size_bytes int, producer_acks string, records_per_sec double, "
    "mb_per_sec double, avg_latency_ms double, max_latency_ms double"
)
CONSUMER_THROUGHPUT_RESULTS = _struct(
    "partitions int, message_size_bytes int, records_per_sec double, mb_per_sec double, "
    "rebalance_time_ms double, fetch_time_ms double"
)
