"""Metrics out of tool and job logs, as ``(log, line_ix, line)`` rows.

Every extraction is an aggregate per log (``max_by`` keeps the latest line), so one huge log is
reduced where it is read and never sorted or collected as a whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.operators.ordered import floor_div
from ferrytrace.schemas import CONSUMER_METRICS

# Fixed patterns and markers of the log formats: a number stands before each of these units.
_NUMBER = r"(\d+(?:\.\d+)?)"
RECORDS_PER_SEC = " records/sec"
MB_PER_SEC = " MB/sec"
AVG_LATENCY = " ms avg latency"
MAX_LATENCY = " ms max latency"
P50 = " ms 50th"
P99 = " ms 99th"
KEY_VALUE = r"^\s*(\w+):\s+(-?[0-9.]+)"
CONSUMER_HEADER = "start.time"
DETAIL_HEADER = "time"
RESULTS_START = "RESULTS_START"
RESULTS_END = "RESULTS_END"
CONSUMER_CSV = "CONSUMER_CSV:"

# Lines of one log that one task puts in order.
LINES_PER_BLOCK = 65_536
# The size of quantile sketches: a rank error of 0.44 %.
SKETCH_K = 1024

_CONSUMER_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CONSUMER_METRICS)


def number_before(line: Column, unit: str) -> Column:
    """The number in front of a unit; null when the line has none.

    The plain text search comes first: most lines of a log stop there, before the pattern.
    """
    found = F.regexp_extract(line, _NUMBER + unit, 1)
    return F.when(line.contains(unit), found.try_cast("double"))


def number_matching(line: Column, pattern: str, group: int = 1) -> Column:
    """The number captured by a pattern; null when the line does not match."""
    found = F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))
    return found.try_cast("double")


def _last(value: Column, present: Column, ix: str = "line_ix") -> Column:
    """The value on the latest line where ``present`` holds."""
    return F.max_by(value, F.when(present, F.col(ix)))


def _latest_numbers(lines: DataFrame, units: Mapping[str, str], marker: str) -> DataFrame:
    """Per log, the numbers on its latest line that has the ``marker`` column's number.

    One ``max_by`` per number keeps the aggregation state flat, so it is hashed, not sorted,
    when ``line_ix`` is a number.
    """
    line = F.col("line")
    numbers = [number_before(line, unit).alias(name) for name, unit in units.items()]
    parsed = lines.select("log", "line_ix", *numbers)
    marked = parsed.withColumn("at", F.when(F.col(marker).isNotNull(), F.col("line_ix")))
    return marked.groupBy("log").agg(
        *[F.max_by(name, "at").alias(name) for name in units], F.count("at").alias("_matched")
    )


def producer_perf(lines: DataFrame) -> DataFrame:
    """Final summary of a producer run; a log without one is marked failed, not zero."""
    found = _latest_numbers(
        lines,
        {
            "records_per_sec": RECORDS_PER_SEC,
            "mb_per_sec": MB_PER_SEC,
            "avg_latency_ms": AVG_LATENCY,
            "max_latency_ms": MAX_LATENCY,
        },
        "records_per_sec",
    )
    return found.withColumn("failed", F.col("_matched") == 0).drop("_matched")


def percentiles(lines: DataFrame) -> DataFrame:
    """Median and 99th percentile latency of the final summary."""
    wanted = {"p50_latency_ms": P50, "p99_latency_ms": P99}
    return _latest_numbers(lines, wanted, "p99_latency_ms").drop("_matched")


def latency_sketches(
    records: DataFrame, keys: Sequence[str], latency: str, k: int = SKETCH_K
) -> DataFrame:
    """One quantile sketch of the latencies per key, to be stored: ``sketch`` (binary), with the exact
    number, least and greatest.  Nulls and NaN are no latencies; without any the sketch is null."""
    value = F.nanvl(F.col(latency).cast("double"), F.lit(None))
    count = F.count(value)
    return records.groupBy(*keys).agg(
        count.alias("records"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.when(count > 0, F.kll_sketch_agg_double(value, F.lit(k))).alias("sketch"),
    )


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """Stored sketches united over runs: the same columns by fewer keys."""
    known = F.count("sketch")
    return sketches.groupBy(*keys).agg(
        F.sum("records").alias("records"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.when(known > 0, F.kll_merge_agg_double("sketch", F.lit(k))).alias("sketch"),
    )


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of a sketch's quantile may be off, as a share of all latencies (at 99 %)."""
    return 2.296 / k**0.9021


def sketch_quantiles(sketches: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """The quantiles at the shares (by column name), within ``rank_error`` in rank."""
    found = {
        name: F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(share)))
        for name, share in shares.items()
    }
    return sketches.withColumns(found).drop("sketch")


def _csv_field(line: Column, position: int) -> Column:
    return F.trim(F.get(F.split(line, ","), F.lit(position - 1))).try_cast("double")


def consumer_perf(lines: DataFrame, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """MB/s and records/s (fields 4 and 6) of the line that follows the last header.

    Lines are shuffled as numbers, without text, to blocks of positions, so a huge log is many tasks'
    work.  A block is summed up as its last header with the line after it, and its first line; along
    the blocks of a log the first line of a block follows a header that ends the block before.
    """
    line, ix = F.col("line"), F.col("line_ix")
    fields = {"mb_per_sec": 4, "records_per_sec": 6}
    parsed = lines.select(
        "log",
        ix.cast("long").alias("line_ix"),
        floor_div(ix.cast("long"), lines_per_block).alias("_block"),
        F.coalesce(line.contains(CONSUMER_HEADER), F.lit(False)).alias("_header"),
        line.isNotNull().alias("_is"),
        *[_csv_field(line, position).alias(name) for name, position in fields.items()],
    )
    inside = Window.partitionBy("log", "_block").orderBy("line_ix")
    followed = parsed.select(
        "log", "_block", "line_ix", "_is", *fields,
        F.when(F.col("_header"), ix).alias("_at"),
        *[F.lead(c).over(inside).alias(f"_next_{c}") for c in ("_is", *fields)],
    )
    blocks = followed.groupBy("log", "_block").agg(
        F.max("_at").alias("_at"),
        *[F.max_by(f"_next_{c}", "_at").alias(f"_next_{c}") for c in ("_is", *fields)],
        *[F.min_by(c, "line_ix").alias(f"_first_{c}") for c in ("_is", *fields)],
    )
    along = Window.partitionBy("log").orderBy("_block")
    ends = blocks.select(
        "log",
        "_at",
        *[
            F.when(F.col("_next__is").isNotNull(), F.col(f"_next_{c}"))
            .otherwise(F.lead(f"_first_{c}").over(along))
            .alias(c)
            for c in ("_is", *fields)
        ],
    )
    last = ends.groupBy("log").agg(*[F.max_by(c, "_at").alias(c) for c in ("_is", *fields)])
    return last.select("log", *fields, (~F.coalesce("_is", F.lit(False))).alias("failed"))


def consumer_perf_detailed(lines: DataFrame) -> DataFrame:
    """Rates, rebalance and fetch time of the last line that is no header."""
    line = F.col("line")
    body = ~line.startswith(DETAIL_HEADER)
    last = lines.groupBy("log").agg(_last(line, body).alias("m"))
    metrics = F.col("m")
    return last.select(
        "log",
        _csv_field(metrics, 6).alias("records_per_sec"),
        _csv_field(metrics, 4).alias("mb_per_sec"),
        _csv_field(metrics, 7).alias("rebalance_time_ms"),
        _csv_field(metrics, 8).alias("fetch_time_ms"),
    )


def key_values(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """``name: number`` lines to one column per name (the latest value of each)."""
    name = F.regexp_extract("line", KEY_VALUE, 1)
    pairs = lines.select(
        "log", "line_ix", name.alias("name"), number_matching(F.col("line"), KEY_VALUE, 2).alias("v")
    )
    return pairs.groupBy("log").agg(
        *[_last(F.col("v"), F.col("name") == n).alias(n) for n in names]
    )


def json_block(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Number fields of the JSON between the result markers, on one line or many.

    Only the last closed block of a log counts: an end marker and the start marker right before it.
    """
    line = F.trim("line")
    values = {
        n: number_matching(F.col("line"), rf'"{n}":\s*(-?[0-9.]+(?:[eE][-+]?\d+)?)') for n in names
    }
    # Marker lines only, so the window sorts a few rows per log.
    marks = lines.filter(line.isin(RESULTS_START, RESULTS_END)).select(
        "log", "line_ix", (line == RESULTS_START).alias("starts")
    )
    along = Window.partitionBy("log").orderBy("line_ix")
    blocks = marks.withColumn("opened", F.lag(F.when(F.col("starts"), F.col("line_ix"))).over(along))
    blocks = blocks.filter(~F.col("starts") & F.col("opened").isNotNull())
    edges = blocks.groupBy("log").agg(F.max("opened").alias("opened"), F.max("line_ix").alias("closed"))
    fields = lines.filter(reduce(or_, [v.isNotNull() for v in values.values()]))
    inside = fields.join(edges, "log").filter(
        (F.col("line_ix") > F.col("opened")) & (F.col("line_ix") < F.col("closed"))
    )
    return inside.groupBy("log").agg(
        *[_last(v, v.isNotNull()).alias(n) for n, v in values.items()]
    )


def csv_marker(lines: DataFrame) -> DataFrame:
    """The reader's machine-readable summary lines."""
    marked = lines.filter(F.col("line").startswith(CONSUMER_CSV))
    body = F.substr("line", F.lit(len(CONSUMER_CSV) + 1))
    return marked.select(F.from_csv(body, _CONSUMER_DDL).alias("m")).select("m.*")


def failed_runs(expected: DataFrame, parsed: DataFrame, run: str = "log") -> DataFrame:
    """Expected runs with their metrics; runs without any have nulls and ``failed = true``."""
    known = parsed.withColumn("_found", F.lit(True))
    merged = expected.join(known, run, "left")
    return merged.withColumn("failed", F.col("_found").isNull()).drop("_found")


def missing_runs(expected: DataFrame, parsed: DataFrame, run: str = "log") -> DataFrame:
    return expected.join(parsed, run, "left_anti")


def tail_values(lines: DataFrame, unit: str, last: int = 5) -> DataFrame:
    """The ``last`` numbers with a unit in each log.

    The rank limit runs before the shuffle too, so a log sends at most ``last`` rows per task.
    """
    values = lines.select("log", "line_ix", number_before(F.col("line"), unit).alias("value"))
    latest = Window.partitionBy("log").orderBy(F.desc("line_ix"))
    ranked = values.filter(F.col("value").isNotNull()).withColumn(
        "n", F.row_number().over(latest)
    )
    return ranked.filter(F.col("n") <= last).select("log", "line_ix", "value")


def tail_mean(lines: DataFrame, unit: str, last: int = 5) -> DataFrame:
    return tail_values(lines, unit, last).groupBy("log").agg(F.avg("value").alias("tail_mean"))


def tail_max(lines: DataFrame, unit: str, last: int = 5) -> DataFrame:
    return tail_values(lines, unit, last).groupBy("log").agg(F.max("value").alias("tail_max"))


def last_record(lines: DataFrame) -> DataFrame:
    """The last line of each log that is no header."""
    body = ~F.col("line").startswith(DETAIL_HEADER)
    return lines.groupBy("log").agg(_last(F.col("line"), body).alias("last_line"))
