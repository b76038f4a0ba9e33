"""Order-dependent work without ever sorting one key in one task.

A plain ``row_number`` or running ``sum`` puts all rows of a key (or the whole data
set) into one task.  Here rows are first cut into *blocks* that follow the order and
have a bounded number of rows.  The window runs inside a block; one small row per block
carries its total, and a running sum over those rows gives each block its start.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A block has at least this many rows, and there are about this many blocks at most: 100,000 rows
# of 10 KB, or 20 million rows of 100 B out of 10^12, are a comfortable sort for one task.
MIN_BLOCK_ROWS = 100_000
MAX_BLOCKS = 50_000
POSITIONS_PER_BLOCK = 131_072

# Rows looked at per cut point.  Cut points only balance the blocks; results never depend on them.
_SAMPLES_PER_CUT = 200

_BLOCK = "_block"
_KEY = "_key"


def floor_div(value: Column, step: int) -> Column:
    """Exact whole-number division, rounding down."""
    return F.call_function("div", value - F.pmod(value, F.lit(step)), F.lit(step))


def _cuts(df: DataFrame, columns: Sequence[str], rows: int, blocks: int) -> list[list[float]]:
    """Evenly spaced quantiles of each column, from a sample when there are many rows."""
    shares = [i / blocks for i in range(1, blocks)]
    narrow = df.select(
        *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"q{i}") for i, c in enumerate(columns)]
    )
    fraction = _SAMPLES_PER_CUT * blocks / rows
    if fraction < 0.5:
        narrow = narrow.sample(fraction, seed=17)
    accuracy = max(10_000, 4 * blocks)
    row = narrow.agg(
        *[F.percentile_approx(c, shares, accuracy).alias(c) for c in narrow.columns]
    ).first()
    return [row[c] or [] for c in narrow.columns]


def _bucket(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    """Number of cut points at or below the value (nulls sort first, so they go to bucket 0; NaN sorts
    last and gets a bucket of its own)."""
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    splits = [-math.inf, *cuts, math.inf]
    number = f"{name}_number"
    ready = df.withColumn(number, F.coalesce(F.col(column).cast("double"), F.lit(-math.inf)))
    placed = Bucketizer(
        splits=splits, inputCol=number, outputCol=name, handleInvalid="keep"
    ).transform(ready)
    return placed.drop(number).withColumn(name, F.col(name).cast("long"))


def add_order_blocks(
    df: DataFrame, order: Sequence[str], rows_per_block: int | None = None, name: str = _BLOCK
) -> tuple[DataFrame, int]:
    """Add a block number that never decreases along ``order``; returns also the block count.

    ``order`` is one unique numeric (or timestamp) column, or such a column followed by
    tie-breakers of which the first is (nearly) unique.  A value that fills several blocks by
    itself, e.g. one time stamp shared by a third of all rows, is split by quantiles of the
    tie-breaker; as that one is unique, every part is bounded as well.

    The cut points are literals, so every evaluation of the plan, also after a lost executor,
    puts a row into the same block.
    """
    rows = df.count()
    size = rows_per_block or max(MIN_BLOCK_ROWS, math.ceil(rows / MAX_BLOCKS))
    blocks = math.ceil(rows / size)
    if blocks <= 1:
        return df.withColumn(name, F.lit(0).cast("long")), 1
    primary, *ties = _cuts(df, order[:2], rows, blocks)
    distinct = sorted(set(primary))
    heavy = {value for value, times in Counter(primary).items() if times > 1}
    if not heavy or not ties:
        return _bucket(df, order[0], distinct, name), len(distinct) + 1

    # A heavy value gets a bucket of its own: [value, next representable number).
    edges = sorted({*distinct, *(math.nextafter(value, math.inf) for value in heavy)})
    heavy_buckets = [at + 1 for at, edge in enumerate(edges) if edge in heavy]
    tie_edges = sorted(set(ties[0]))
    parts = len(tie_edges) + 1
    first, second = f"{name}_a", f"{name}_b"
    both = _bucket(_bucket(df, order[0], edges, first), order[1], tie_edges, second)
    split = F.when(F.col(first).isin(heavy_buckets), F.col(second)).otherwise(F.lit(0))
    blocked = both.withColumn(name, F.col(first) * F.lit(parts) + split)
    return blocked.drop(first, second), (len(edges) + 1) * parts


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null; the keys appear once."""
    other = {k: f"_right_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return left.join(right.withColumnsRenamed(other), same).drop(*other.values())


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The keys as one struct: equal structs may hold nulls, and a window and a join on it share one
    shuffle."""
    return (df.withColumn(_KEY, F.struct(*keys)), [_KEY]) if keys else (df, [])


def totals_before(
    blocks: DataFrame, keys: Sequence[str], block: str, measures: Sequence[str]
) -> DataFrame:
    """For each block row, the sum of every measure over the earlier blocks of its key.

    One task sums the blocks of one key: one narrow row per block, not per record.
    """
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(block)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in measures]
    return blocks.select(*keys, block, *sums)


def totals_before_many(
    blocks: DataFrame, keys: Sequence[str], block: str, measures: Sequence[str], fanout: int = 4096
) -> DataFrame:
    """The same in two levels, for keys with so many blocks that one task should not sum them."""
    group = "_group"
    grouped = blocks.withColumn(group, floor_div(F.col(block), fanout))
    groups = grouped.groupBy(*keys, group).agg(*[F.sum(m).alias(m) for m in measures])
    starts = totals_before(groups, keys, group, measures).withColumnsRenamed(
        {f"{m}_before": f"_start_{m}" for m in measures}
    )
    inside = totals_before(grouped, [*keys, group], block, measures)
    return join_null_safe(inside, starts, [*keys, group]).select(
        *keys,
        block,
        *[(F.col(f"{m}_before") + F.col(f"_start_{m}")).alias(f"{m}_before") for m in measures],
    )


def dense_index(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "ix",
    rows_per_block: int | None = None,
) -> DataFrame:
    """0, 1, 2, ... along ``order``, over the data set or per key; null is a key like any other."""
    keys = list(keys)
    blocked, count = add_order_blocks(df, order, rows_per_block)
    blocked, key = _with_key(blocked, keys)
    local = Window.partitionBy(*key, _BLOCK).orderBy(*order)
    numbered = blocked.withColumn(name, F.row_number().over(local).cast("long") - 1)
    if count == 1:
        return numbered.drop(_BLOCK, _KEY)
    totals = blocked.groupBy(*key, _BLOCK).agg(F.count(F.lit(1)).alias("rows"))
    starts = totals_before(totals, key, _BLOCK, ["rows"])
    return (
        numbered.join(starts, [*key, _BLOCK])
        .withColumn(name, F.col(name) + F.col("rows_before"))
        .select(*df.columns, name)
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    measures: Mapping[str, Column],
    positions_per_block: int = POSITIONS_PER_BLOCK,
) -> DataFrame:
    """Running sums along a dense position (such as a topic offset) of each key.

    A range of positions is a block, so a block holds at most ``positions_per_block`` rows
    however the keys are distributed.  Null keys are a key like any other; a row without a position
    has no place among the others, so it is an error.
    """
    keys = list(keys)
    names = list(measures)
    placed = F.coalesce(
        floor_div(F.col(position), positions_per_block),
        F.raise_error(F.lit(f"running totals: {position} is null")).cast("long"),
    )
    blocked, key = _with_key(df.withColumn(_BLOCK, placed), keys)
    upto = Window.partitionBy(*key, _BLOCK).orderBy(position).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = blocked.withColumns({m: F.sum(of).over(upto) for m, of in measures.items()})
    # Block totals come off the same shuffle (Spark reuses it), so the input is read once.
    totals = local.groupBy(*key, _BLOCK).agg(*[F.max_by(m, position).alias(m) for m in names])
    starts = totals_before_many(totals, key, _BLOCK, names)
    summed = local.join(starts, [*key, _BLOCK])
    return summed.withColumns({m: F.col(m) + F.col(f"{m}_before") for m in names}).drop(
        _BLOCK, _KEY, *[f"{m}_before" for m in names]
    )


def take_first(
    df: DataFrame, order: Sequence[str], n: int, rows_per_block: int | None = None
) -> DataFrame:
    """The first ``n`` rows along ``order`` (0 = no limit), as a plain filter.

    Only the order columns of one block are sorted, to find the last row that is kept; the
    result is a comparison with that row, which reaches the scan.
    """
    if n <= 0:
        return df
    order = list(order)
    narrow = df.select(*order)
    blocked, _ = add_order_blocks(narrow, order, rows_per_block)
    sizes = blocked.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("rows"))
    starts = totals_before(sizes, [], _BLOCK, ["rows"]).join(sizes, _BLOCK)
    edge = starts.filter((F.col("rows_before") < n) & (F.col("rows_before") + F.col("rows") >= n))
    edge_row = edge.first()
    if edge_row is None:
        return df
    nth = n - edge_row["rows_before"]
    times = {f.name for f in narrow.schema if isinstance(f.dataType, T.TimestampType)}
    last = (
        blocked.filter(F.col(_BLOCK) == edge_row[_BLOCK])
        .withColumn("_n", F.row_number().over(Window.partitionBy(_BLOCK).orderBy(*order)))
        .filter(F.col("_n") == nth)
        .select(*[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in order])
        .first()
    )
    kept = F.lit(False)
    equal = F.lit(True)
    for column in order:
        if last[column] is None:  # nulls come first: nothing is before one
            equal = equal & F.col(column).isNull()
            continue
        bound = F.lit(last[column])
        if column in times:
            bound = F.timestamp_micros(bound)
        before = F.col(column).isNull() | (F.col(column) < bound)
        kept = kept | (equal & before)
        equal = equal & F.col(column).eqNullSafe(bound)
    return df.filter(kept | equal)
