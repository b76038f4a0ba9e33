"""Session builder and the shared scratch area used for written tables."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# The temporary folder of each local application that has none configured.
_local_dirs: dict[str, str] = {}


def build_session(app: str = "ferrytrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder; anywhere else the
    executors could not see it, so the missing setting is an error.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="ferrytrace-")
    return _local_dirs[application]


def size_shuffles(spark: SparkSession, input_mib: float) -> int:
    """Raise the number of shuffle partitions to about one per 256 MiB of input, so that a task
    sorts in memory; AQE merges them again where less arrives.  Never lowers a setting."""
    name = "spark.sql.shuffle.partitions"
    now = int(spark.conf.get(name))
    wanted = math.ceil(input_mib / 256)
    if wanted > now:
        spark.conf.set(name, str(wanted))
    return max(now, wanted)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> int:
    """Lower the bytes of rows that Spark hands to a Python step at once (64 MiB by default, held by
    the JVM and by the worker of each running task).  Never raises a setting; rows stay whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if now > most:
        spark.conf.set(name, str(most))
    return min(now, most)


def new_area(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, safe if executors are lost."""
    spark = df.sparkSession
    path = new_area(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
