"""Reports over benchmark results: replicates, comparisons, grids, pivots, best settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrytrace.functions.measures import safe_ratio

# The test types a result row starts with, and the prefix that belongs to them.
_KINDS = ("producer,", "consumer,")
_BOTH_SIDES = "e2e-"
_BREAK = "\u0001"


def config_grid(spark: SparkSession, **settings: Sequence) -> DataFrame:
    """Every combination of the given settings, one row each."""
    grid = spark.range(1)
    for name, values in settings.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.select(*settings)


# More different settings of one column than this are no sweep.
MOST_SETTINGS = 1000


def settings_found(results: DataFrame, column: str) -> list:
    """The different values of a setting, in order; an error if there are too many to be one."""
    found = results.select(column).distinct().orderBy(column).limit(MOST_SETTINGS + 1).toLocalIterator()
    values = [row[0] for row in found]
    if len(values) > MOST_SETTINGS:
        raise ValueError(f"{column} has over {MOST_SETTINGS} values: it is not a setting")
    return values


def grid_of(
    df: DataFrame, columns: Sequence[str], planned: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Every combination of the settings that occur, null included.

    ``planned`` has, for some columns, a table of one column whose values belong to the grid as well,
    whether they were measured or not.
    """
    grid = df.sparkSession.range(1)
    for column in columns:
        kind = df.schema[column].dataType
        found = df.select(column)
        if planned and column in planned:
            found = found.union(planned[column].select(F.col(planned[column].columns[0]).cast(kind)))
        values = F.array(*[F.lit(v).cast(kind) for v in settings_found(found, column)])
        grid = grid.withColumn(column, F.explode(values.cast(T.ArrayType(kind))))
    return grid.select(*columns)


def grid_fill(
    grid: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """One row per grid cell; a cell without a result shows 0 and ``measured = false``."""
    other = {k: f"_present_{k}" for k in keys}
    present = values.withColumn("measured", F.lit(True)).withColumnsRenamed(other)
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    filled = grid.join(present, same, "left").drop(*other.values()).fillna(0.0, list(columns))
    return filled.fillna(False, ["measured"])


def replicate_mean(df: DataFrame, keys: Sequence[str], value: str, grid: DataFrame) -> DataFrame:
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return grid_fill(grid, means, keys, ["mean"])


def replicate_mean_std(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation over the replicates."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.count(value).alias("runs"),
    )


def replicate_cv(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average, extremes and coefficient of variation in percent, in key order."""
    spread = df.groupBy(*keys).agg(
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("_std"),
    )
    cv = F.when(F.col("avg") > 0, F.col("_std") / F.col("avg") * 100).otherwise(F.lit(0.0))
    return spread.withColumn("cv_pct", cv).drop("_std").orderBy(*keys)


def first_match(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], grid: DataFrame
) -> DataFrame:
    """The value of the first row, in file order, of each setting; 0 when there is none."""
    found = df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))
    return grid_fill(grid, found, keys, [value])


def approach_means(
    runs: DataFrame, approach: str, end_to_end: str, first_record: str
) -> DataFrame:
    """Mean end-to-end time and first-record latency per approach, fastest first."""
    return (
        runs.groupBy(approach)
        .agg(
            F.avg(end_to_end).alias("mean_e2e_s"),
            F.avg(first_record).alias("mean_first_record_s"),
            F.count(F.lit(1)).alias("runs"),
        )
        .orderBy("mean_e2e_s", approach)
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compare_engines(
    native: DataFrame, other: DataFrame, keys: Sequence[str], value: str = "mb_per_sec"
) -> DataFrame:
    """Mean throughput of two engines per setting, their gap and ratio."""
    left = native.groupBy(*keys).agg(F.avg(value).alias("native_mb"))
    right = other.groupBy(*keys).agg(F.avg(value).alias("spark_mb"))
    return left.join(right, list(keys)).select(
        *keys,
        "native_mb",
        "spark_mb",
        (F.col("spark_mb") - F.col("native_mb")).alias("gap_mb"),
        safe_ratio(F.col("spark_mb"), F.col("native_mb")).alias("ratio"),
    )


def pivot_pair(
    df: DataFrame,
    keys: Sequence[str],
    by: str,
    pair: tuple[str, str],
    value: str,
    order: Sequence[str],
) -> DataFrame:
    """The first result of two settings (such as both acks levels) side by side, and their
    difference relative to the first in percent."""
    first, second = pair
    wide = (
        df.groupBy(*keys)
        .pivot(by, [first, second])
        .agg(F.min_by(value, F.struct(*order)))
    )
    change = safe_ratio(F.col(f"`{second}`") - F.col(f"`{first}`"), F.col(f"`{first}`")) * 100
    return wide.withColumn("diff_pct", change)


def pivot_partitions(
    df: DataFrame, rows: str, partitions: str, counts: Sequence[int], value: str
) -> DataFrame:
    """Size by partition-count matrix of mean throughput; empty cells are 0."""
    names = [f"p{n}" for n in counts]
    means = [F.avg(F.when(F.col(partitions) == n, F.col(value))).alias(f"p{n}") for n in counts]
    return df.groupBy(rows).agg(*means).fillna(0.0, names)


def producer_vs_consumer(
    df: DataFrame,
    keys: Sequence[str],
    kind: str,
    producer: Column | str,
    consumer: Column | str,
    value: str,
    order: Sequence[str],
) -> DataFrame:
    """Producer result (first row) and consumer result (mean of rows) per setting."""
    is_producer = F.col(kind) == producer
    is_consumer = F.col(kind) == consumer
    place = F.when(is_producer, F.struct(*order))
    return df.groupBy(*keys).agg(
        F.coalesce(F.min_by(value, place), F.lit(0.0)).alias("producer_mb"),
        F.coalesce(F.avg(F.when(is_consumer, F.col(value))), F.lit(0.0)).alias("consumer_mb"),
    )


def throughput_latency_points(
    df: DataFrame, keys: Sequence[str], throughput: str, latency: str, order: Sequence[str]
) -> DataFrame:
    """One (throughput, latency) point per setting from its first row; incomplete ones dropped."""
    first = F.min_by(F.struct(throughput, latency), F.struct(*order))
    points = df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")
    return points.dropna(subset=[throughput, latency])


def best_config(
    df: DataFrame, config: Sequence[str], criteria: Mapping[str, bool]
) -> DataFrame:
    """The best row per criterion (column -> whether a larger value is better).

    One pass with partial aggregation; ties go to the smallest configuration.
    """
    winners = []
    for column, larger in criteria.items():
        rank = -F.col(column) if larger else F.col(column)
        best = F.min_by(
            F.struct(F.lit(column).alias("criterion"), *config, F.col(column).alias("best")),
            F.when(F.col(column).isNotNull(), F.struct(rank.alias("rank"), *config)),
        )
        winners.append(best)
    picked = df.agg(F.array(*winners).alias("winners"))
    return picked.select(F.inline("winners"))


def size_report(df: DataFrame, size: str, partitions: str, acks: str) -> DataFrame:
    return df.orderBy(size, partitions, acks)


def split_fused(df: DataFrame, text: str = "value") -> DataFrame:
    """Result rows whose line breaks were lost, split before each test type.

    Plain text replacement puts a break before each type and then moves it in front of the
    prefix, so a prefixed type stays whole; that is several times faster than look-around.
    """
    marked = F.col(text)
    for kind in _KINDS:
        marked = F.replace(marked, F.lit(kind), F.lit(_BREAK + kind))
    marked = F.replace(marked, F.lit(_BOTH_SIDES + _BREAK), F.lit(_BREAK + _BOTH_SIDES))
    pieces = F.explode(F.split(marked, _BREAK))
    return df.select(pieces.alias("record")).filter(F.trim("record") != "")
