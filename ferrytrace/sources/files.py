"""Text files: readings as CSV, JSON lines, results of sweeps, logs, metrics tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrytrace.functions.messages import empty_to_null, json_value
from ferrytrace.schemas import READING



def read_csv_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header line per file; every column is text."""
    return spark.read.option("header", True).csv(path)


def read_csv_typed(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str = READING,
    mode: str = "PERMISSIVE",
    corrupt_column: str | None = None,
) -> DataFrame:
    """CSV with declared types.  ``corrupt_column`` keeps the text of lines that do not fit."""
    reader = spark.read.option("header", True).option("mode", mode)
    if corrupt_column:
        if isinstance(schema, str):
            schema = f"{schema}, {corrupt_column} string"
        else:
            schema = T.StructType([*schema.fields, T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    return reader.schema(schema).csv(path)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Data lines of headed text files, untouched, as the single column ``value``.

    Only the first line of every file goes; blank lines and all characters stay.  The text reader
    numbers rows in the order in which a task reads them, so the first line of a file has the least
    number among those of the piece that begins at byte 0: one row per file.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_from"),
        F.monotonically_increasing_id().alias("_row"),
    )
    heads = lines.filter("_from = 0").groupBy("_file").agg(F.min("_row").alias("_row"))
    return lines.join(heads, ["_file", "_row"], "left_anti").select("value")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema, so nothing is read twice to infer one."""
    return spark.read.schema(schema).json(path)


def read_results(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, run_pattern: str | None = None
) -> DataFrame:
    """Sweep results: ``N/A`` and empty cells are null.

    ``run_pattern`` takes the run's name out of the file path, for one file per run directory.
    """
    df = spark.read.option("header", True).option("nullValue", "N/A").schema(schema).csv(path)
    if run_pattern is None:
        return df
    return df.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1))


def read_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Log lines as ``(log, line_ix, line)``.

    ``line_ix`` increases along the lines of one log: the byte where the piece of the file begins
    plus the row number within the task.  A task reads no more rows than bytes, and no more bytes
    than lie between two pieces of a file, so a later piece always starts above an earlier one.
    """
    row_in_task = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"),
        (F.col("_metadata.file_block_start") + row_in_task).alias("line_ix"),
        F.col("value").alias("line"),
    )


def file_sizes(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """Path and length of each file below ``path``; file contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a directory with CSV parts, each with a header line."""
    df.write.option("header", True).mode("overwrite").csv(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Add rows to a metrics table."""
    df.write.mode("append").parquet(path)


def rows_as_messages(df: DataFrame, key: str, keep: Sequence[Column] = ()) -> DataFrame:
    """Each row becomes a message: key (null when empty) and the row as JSON, nulls kept."""
    return df.select(
        empty_to_null(F.col(key).cast("string")).alias("key"),
        json_value(df.columns, keep_nulls=True).alias("value"),
        *keep,
    )


def lines_as_messages(lines: DataFrame) -> DataFrame:
    """Each line becomes a message without a key."""
    return lines.select(F.lit(None).cast("string").alias("key"), F.col("value"))
