"""Many records per message, and transfer chunks of bounded size."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.functions.messages import line_value, payload_bytes
from ferrytrace.operators.ordered import (
    POSITIONS_PER_BLOCK,
    add_order_blocks,
    floor_div,
    running_totals,
    totals_before,
)


def pack_messages(
    df: DataFrame,
    order: Sequence[str],
    records_per_message: int,
    columns: Sequence[str] | None = None,
    rows_per_block: int | None = None,
) -> DataFrame:
    """``(pack, records, value)``: every ``records_per_message`` consecutive rows as lines of one
    message; only the very last message may be shorter.

    Rows move once, to the task of their block, where they are numbered and joined into
    messages.  Only a message that straddles two blocks is put together by a second, tiny shuffle.
    """
    columns = list(columns or df.columns)
    k = records_per_message
    blocked, count = add_order_blocks(df, order, rows_per_block)
    local = Window.partitionBy("_block").orderBy(*order)
    lines = blocked.select(
        "_block", *order, line_value(columns).alias("_line")
    ).withColumn("_ix", F.row_number().over(local).cast("long") - 1)
    if count > 1:
        sizes = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("rows"))
        starts = totals_before(sizes, [], "_block", ["rows"])
        lines = lines.join(starts, "_block").withColumn(
            "_ix", F.col("_ix") + F.col("rows_before")
        )
    ordered_lines = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_ix", "_line"))), lambda row: row["_line"]
        ),
        "\n",
    )
    parts = (
        lines.withColumn("pack", floor_div(F.col("_ix"), k))
        .groupBy("_block", "pack")
        .agg(
            ordered_lines.alias("value"),
            F.count(F.lit(1)).alias("records"),
            F.min("_ix").alias("_first"),
        )
    )
    if count == 1:
        return parts.select("pack", "records", "value")
    joined_parts = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_first", "value"))), lambda row: row["value"]
        ),
        "\n",
    )
    whole = parts.filter(F.col("records") == k).select("pack", "records", "value")
    straddling = (
        parts.filter(F.col("records") < k)
        .groupBy("pack")
        .agg(joined_parts.alias("value"), F.sum("records").alias("records"))
        .select("pack", "records", "value")
    )
    return whole.unionByName(straddling)


def chunk_number(running_bytes: Column, chunk_bytes: int) -> Column:
    """Chunk of the message that ends at this byte; an empty message in front is in the first."""
    return floor_div(F.greatest(running_bytes - 1, F.lit(0)), chunk_bytes)


def chunk_summary(
    chunked: DataFrame, keys: Sequence[str] = ("topic", "partition"), position: str = "offset"
) -> DataFrame:
    return chunked.groupBy(*keys, "chunk").agg(
        F.min(position).alias("first_offset"),
        F.max(position).alias("last_offset"),
        F.count(F.lit(1)).alias("records"),
        F.sum("bytes").alias("bytes"),
    )


def chunk_by_bytes(
    topic: DataFrame,
    chunk_bytes: int,
    keys: Sequence[str] = ("topic", "partition"),
    position: str = "offset",
    positions_per_block: int = POSITIONS_PER_BLOCK,
    carried: DataFrame | None = None,
) -> DataFrame:
    """One row per chunk: the running byte count of a partition over the chunk size numbers a message's
    chunk, so a chunk exceeds the size by less than one message.  Only positions and sizes are
    shuffled, never the message text.  ``carried`` (keys, ``carried``) has bytes that came before."""
    narrow = topic.select(*keys, position, payload_bytes().alias("_size"))
    summed = running_totals(
        narrow, keys, position, {"running_bytes": F.col("_size")}, positions_per_block
    )
    upto = F.col("running_bytes")
    if carried is not None:
        summed = summed.join(carried, list(keys), "left")
        upto = upto + F.coalesce(F.col("carried"), F.lit(0))
    chunked = summed.select(
        *keys, position, F.col("_size").alias("bytes"), chunk_number(upto, chunk_bytes).alias("chunk")
    )
    return chunk_summary(chunked, keys, position)


def in_chunks(
    topic: DataFrame, chunks: DataFrame, keys: Sequence[str] = ("topic", "partition"), position: str = "offset"
) -> DataFrame:
    """Each message with the number of its ``chunk``, from the rows of ``chunk_by_bytes``, and ``bytes``.

    A chunk is an interval of positions.  Intervals are cut at blocks of as many positions as chunks
    have on average, so the join is on equal keys and blocks, and few intervals meet in one block.
    Messages move only if the intervals are too many to be sent to them.
    """
    sizes = chunks.agg(F.sum(F.col("last_offset") - F.col("first_offset") + 1), F.count(F.lit(1))).first()
    block = max(1, math.ceil((sizes[0] or 0) / max(sizes[1], 1)))
    first, last = (floor_div(F.col(c), block) for c in ("first_offset", "last_offset"))
    intervals = chunks.select(*keys, "chunk", "first_offset", "last_offset", F.explode(F.sequence(first, last)).alias("_block"))
    placed = topic.withColumn("_block", floor_div(F.col(position), block))
    inside = (F.col(position) >= F.col("first_offset")) & (F.col(position) <= F.col("last_offset"))
    met = placed.join(intervals, [*keys, "_block"]).where(inside)
    return met.select(*topic.columns, payload_bytes().alias("bytes"), "chunk")
