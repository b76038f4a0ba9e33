"""Removal of long repeated byte strings, by a column-wise suffix order of many documents.

A string of ``LENGTH`` bytes is found through its *anchor*: the smallest hash among its first
``REACH`` places.  Equal strings have the same anchor at the same distance, so all their occurrences
meet under one key, aligned at the anchor.  What one anchor stands for in one text (the strings that
begin up to ``REACH`` places before it) is a *segment*.

Segments under a key that are equal as a whole repeat each other and enter the collection once.  The
collection of a key's different segments is then ordered column by column from the right: every
round inserts one symbol of each segment, sorts stably by it and carries the common prefixes of
neighbours along.  When a neighbour shares ``LENGTH`` symbols, the string that starts in this column
is repeated.  Columns are taken from one array of a bounded number of segments in turn.

Texts that are equal as a whole (two or more rows) are repeated as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.llm.common import chunks, ids_and_text, string_bytes
from ferrytrace.llm.ngram_join import text_key
from ferrytrace.llm.words import RangeHash, byte_values, mixed
from ferrytrace.session import written

LENGTH = 400
REACH = 256
# Bytes that a hash of one place looks at.
GRAM = 16
# Segments ordered at once; larger groups are dealt into blocks, every two of which meet.
SEGMENTS = 8192
# Text bytes that a step holds at once, unless one text alone is longer.
HELD_BYTES = 1 << 20
# Stands for what lies beyond a segment; it equals nothing, not even itself.
OUTSIDE = 256

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _place_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all ``GRAM`` bytes long strings, doubling their length."""
    found, width = byte_values(2, False)[data], 1
    for factor in _FACTORS:
        found = found[: len(found) - width] * factor + found[width:]
        width *= 2
    return mixed(found)


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start): runs of starts of ``length`` byte strings with one anchor."""
    nothing = np.zeros(0, np.int64)
    if len(data) < length:
        return nothing, nothing, nothing
    reach = min(REACH, length - GRAM + 1)
    least = (_place_hashes(data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    width = 1
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    starts = len(data) - length + 1
    anchor = (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    whole = np.flatnonzero(sizes >= length)
    marks = np.zeros(starts + 1, np.int8)
    marks[offsets[whole]] += 1
    marks[offsets[whole + 1] - length + 1] -= 1
    valid = np.cumsum(marks[:-1], dtype=np.int8) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= (anchor[:-1] != anchor[1:]) | ~valid[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return anchor[begin], begin, end


def _anchors(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    sure = length - min(REACH, length - GRAM + 1) + 1
    for chunk in chunks(batches, limit=HELD_BYTES):
        texts = list(zip(chunk.column("t1").to_pylist(), chunk.column("t2").to_pylist(), strict=True))
        new = [text not in seen and not seen.add(text) for text in texts]  # a task enters a text once
        chunk = chunk.filter(pa.array(new, pa.bool_()))
        data, offsets = string_bytes(chunk.column("text"))
        anchor, begin, end = find_anchors(data, offsets, length)
        if not len(anchor):
            continue
        row = np.searchsorted(offsets, anchor, "right") - 1
        one, two = RangeHash(data, 0), RangeHash(data, 1)
        at = ((anchor - offsets[row]) << 18) | ((anchor - begin) << 9) | (anchor - end)
        columns = {
            "key": one(anchor, anchor + sure).view(np.int64),
            "c1": one(begin, end + length).view(np.int64),
            "c2": two(begin, end + length).view(np.int64),
            "t1": chunk.column("t1").to_numpy(zero_copy_only=False)[row],
            "t2": chunk.column("t2").to_numpy(zero_copy_only=False)[row],
            "at": at,
        }
        for a in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_pydict({k: pa.array(v[a : a + (1 << 16)]) for k, v in columns.items()})


def repeated_columns(
    symbols: np.ndarray, group: np.ndarray, length: int, columns: int
) -> np.ndarray:
    """Which strings of ``length`` symbols occur twice in the same column of a group's segments.

    ``symbols`` (columns in all, segments) is read column by column from the last; the result
    (segments, columns) speaks of strings that start in the first ``columns`` columns.
    """
    size = symbols.shape[1]
    order = np.argsort(group, kind="stable")
    # Common prefix of each segment, in order, with the one before it in its group.
    common = np.zeros(size, np.int32)
    ranked = np.unique(group, return_inverse=True)[1].astype(np.int64)
    repeated = np.zeros((size, columns), bool)
    for column in range(symbols.shape[0] - 1, -1, -1):
        symbol = symbols[column][order]
        bucket = ranked[order] * 257 + symbol
        moved = np.argsort(bucket, kind="stable")
        bucket = bucket[moved]
        same = np.flatnonzero((bucket[1:] == bucket[:-1]) & (symbol[moved[1:]] != OUTSIDE)) + 1
        new = np.zeros(size, np.int32)
        if len(same):
            # Between two neighbours now stood others before: the least common prefix among them.
            spans = np.empty(2 * len(same), np.int64)
            spans[0::2], spans[1::2] = moved[same - 1] + 1, moved[same] + 1
            padded = np.append(common, 0)
            new[same] = np.minimum.reduceat(padded, spans)[0::2] + 1
        order, common = order[moved], new
        if column < columns:
            long = common >= length
            long[:-1] |= long[1:]
            repeated[order[long], column] = True
    return repeated


def _segments(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted segment."""
    names = ["t1", "t2", "text", "wanted"]
    for batch in chunks(batches, limit=HELD_BYTES):
        found: dict[str, list] = {k: [] for k in ("key", "t1", "t2", "at", "blocks", "segment")}
        for t1, t2, text, wanted in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            data = text.encode()
            for entry in wanted:
                at = entry["at"]
                anchor, back, near = at >> 18, (at >> 9) & 511, at & 511
                for k, v in (("key", entry["key"]), ("t1", t1), ("t2", t2), ("at", at), ("blocks", entry["blocks"])):
                    found[k].append(v)
                found["segment"].append(data[anchor - back : anchor - near + length])
        kinds = {"segment": pa.binary()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()})


def _runs(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Byte ranges that the collection of these segments (group, t1, t2, at, segment) marks."""
    reach = min(REACH, length - GRAM + 1)
    symbols = np.full((len(rows), reach - 1 + length), OUTSIDE, np.int16)
    for i, (_, _, _, at, segment) in enumerate(rows):
        start = reach - 1 - ((at >> 9) & 511)
        symbols[i, start : start + len(segment)] = np.frombuffer(segment, np.uint8)
    numbers = {g: i for i, g in enumerate(dict.fromkeys(r[0] for r in rows))}
    group = np.array([numbers[r[0]] for r in rows], np.int64)
    marked = repeated_columns(np.ascontiguousarray(symbols.T), group, length, reach)
    edges = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    one, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    anchors = np.array([rows[i][3] >> 18 for i in one], np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "t1": pa.array([rows[i][1] for i in one], pa.int64()),
            "t2": pa.array([rows[i][2] for i in one], pa.int64()),
            "start": pa.array(anchors - (reach - 1 - first), pa.int64()),
            "end": pa.array(anchors - (reach - 1 - last) + length, pa.int64()),
        }
    )


def _collections(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; whole groups are ordered together up to the bound."""
    held: list[tuple] = []
    names = ["key", "i", "j", "t1", "t2", "at", "segment"]
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            group = row[:3]
            if held and held[-1][0] != group:
                if len(held) >= SEGMENTS:
                    yield _runs(held, length)
                    held = []
            held.append((group, *row[3:]))
    if held:
        yield _runs(held, length)


def _strip(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Merge the ranges of each row and cut them out."""
    names = ["text", "copies", "ranges"]
    for batch in chunks(batches, limit=HELD_BYTES):
        spans, kept, sizes = [], [], []
        for text, copies, ranges in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            data = (text or "").encode()
            if copies > 1 and len(data) >= length:
                ranges = [{"start": 0, "end": len(data)}]
            merged: list[list[int]] = []
            for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            at, parts = 0, []
            for start, end in merged:
                parts.append(data[at:start])
                at = end
            sizes.append(len(data))
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join([*parts, data[at:]]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    key: str = "doc_id",
    text: str = "text",
    group_segments: int = SEGMENTS,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``spans`` (byte ranges removed, merged, in order) and
    ``kept`` (the remaining bytes; they need not be whole characters).

    A byte goes when a string of ``length`` bytes that covers it starts anywhere else as well, in any
    row, the same one included, judged on the input.  Null texts are empty.  Rows with equal or null
    ids are rows of their own, and repeated rows repeat each other.  Other columns are ignored; an
    empty table gives none.
    """
    if length < GRAM + 2:
        raise ValueError(f"strings of at least {GRAM + 2} bytes")
    source = ids_and_text(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = source.withColumns(dict(zip(("t1", "t2"), text_key("text"), strict=True)))
    texts = keyed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))

    long = keyed.where(F.octet_length("text") >= length).select("t1", "t2", "text")
    anchors = long.mapInArrow(
        lambda batches: _anchors(batches, length), "key long, c1 long, c2 long, t1 long, t2 long, at long"
    )
    # Under each key, the same segments stand side by side.
    ordered = Window.partitionBy("key").orderBy("c1", "c2")
    whole = Window.partitionBy("key")

    def equals(neighbour: Callable[[str], Column]) -> Column:
        return F.coalesce((neighbour("c1").over(ordered) == F.col("c1")) & (neighbour("c2").over(ordered) == F.col("c2")), F.lit(False))

    met = anchors.select(
        "*",
        equals(F.lag).alias("like_before"),
        equals(F.lead).alias("like_after"),
        ((F.min("c1").over(whole) != F.max("c1").over(whole)) | (F.min("c2").over(whole) != F.max("c2").over(whole))).alias("several"),
        F.count(F.lit(1)).over(whole).alias("rows"),
    ).where("rows > 1")
    met = written(met.where("like_before OR like_after OR several"), "anchors")
    back, near = F.shiftright("at", 9).bitwiseAND(511), F.col("at").bitwiseAND(511)
    place = F.shiftright("at", 18)
    equal = met.where("like_before OR like_after").select(
        "t1", "t2", (place - back).alias("start"), (place - near + length).alias("end")
    )

    wanted = met.where("several AND NOT like_before").select(
        "t1", "t2", F.struct("key", "at", F.ceil(F.col("rows") / group_segments).alias("blocks")).alias("entry")
    )
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list("entry").alias("wanted"))
    wanted = wanted.join(texts, ["t1", "t2"]).withColumnsRenamed({"t1": "w1", "t2": "w2"})
    same = [F.col("t1") == F.col("w1"), F.col("t2") == F.col("w2")]
    fetched = keyed.join(wanted, same).where(F.col("doc_id").eqNullSafe(F.col("least")))
    segments = fetched.select("t1", "t2", "text", "wanted").mapInArrow(
        lambda batches: _segments(batches, length),
        "key long, t1 long, t2 long, at long, blocks long, segment binary",
    )
    own = F.pmod(F.xxhash64("t2", "at"), F.col("blocks"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")),
    )
    dealt = segments.withColumn("own", own).select("key", F.explode(pairs).alias("p"), "t1", "t2", "at", "segment")
    found = (
        dealt.select("key", "p.*", "t1", "t2", "at", "segment")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(lambda batches: _collections(batches, length), "t1 long, t2 long, start long, end long")
    )

    ranges = equal.unionByName(found).groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    known = texts.join(ranges, ["t1", "t2"], "left").withColumnsRenamed({"t1": "w1", "t2": "w2"})
    return (
        keyed.join(known, same)
        .select("doc_id", "text", "copies", "ranges")
        .mapInArrow(
            lambda batches: _strip(batches, length),
            f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary",
        )
    )
