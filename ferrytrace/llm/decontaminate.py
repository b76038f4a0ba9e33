"""Benchmark decontamination with suffix arrays over the training texts.

Each task makes suffix arrays of its own part of the documents (the shards): the word suffixes,
sorted.  Every suffix of every test item is then looked up in every shard by binary search.  Matches
of a whole window mark document words; matches in a row are one verbatim match, of which the longest
and its place are kept.  No text is shuffled.

Only suffixes that start like some test suffix (with the same few words) can be found by a search,
so only they are entered in the array; nothing that could match is left out.

The test items are the one thing every shard needs.  They go out as broadcasts of bounded size, one
block after another: a task holds one block at a time, and the driver makes one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytrace.llm.common import chunks, ids_and_text, string_bytes
from ferrytrace.llm.words import ALNUM, RangeHash, mixed, word_spans

WINDOW = 10
# Words that a suffix must share with the start of some test window to be entered in the array.
LEAD = 3
# Test text in one broadcast, unless one item alone is longer.
BLOCK_BYTES = 8 << 20
# Document text behind one suffix array, unless one text alone is longer.
SHARD_BYTES = 8 << 20


@dataclass
class TestBlock:
    """Test items as words: ids of words, and the windows to look for."""

    names: list[str | None]
    vocabulary: np.ndarray  # sorted hashes; the id of a word is its place + 1
    words: np.ndarray  # ids of all words, one item after the other
    starts: np.ndarray  # first word of each window
    lengths: np.ndarray  # words in each window
    items: np.ndarray  # item of each window
    lead: int
    leads: np.ndarray  # sorted hashes of the first ``lead`` words of the windows


@dataclass
class Found:
    """What one shard's documents hold of one block."""

    hit: np.ndarray  # by word
    pairs: set[tuple[int, int]]  # (document, item)
    longest: dict[int, tuple[int, int, int]]  # document: words, -first word, item


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_bytes(texts)
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return RangeHash(data, fold=True)(starts, ends), first


def _lead_hash(ids: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    found = np.zeros(len(at), np.uint64)
    for i in range(lead):
        found = mixed(found + ids[at + i].astype(np.uint64) + np.uint64(1))
    return found


def make_block(items: list[tuple[str | None, str]], window: int = WINDOW) -> TestBlock:
    hashes, first = _words(pa.array([text for _, text in items], pa.large_string()))
    vocabulary = np.unique(hashes)
    words = np.searchsorted(vocabulary, hashes).astype(np.uint32) + np.uint32(1)
    counts = np.diff(first)
    lengths = np.minimum(counts, window)
    windows = np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0)
    owner = np.repeat(np.arange(len(items)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[owner] + within
    lead = int(min([LEAD, *lengths[counts > 0]]))
    leads = np.unique(_lead_hash(words, starts, lead))
    return TestBlock([n for n, _ in items], vocabulary, words, starts, lengths[owner], owner, lead, leads)


def _keys(ids: np.ndarray, at: np.ndarray, ends: np.ndarray, window: int, fill: int) -> np.ndarray:
    """The next ``window`` word ids from each place as one comparable byte string."""
    places = at[:, None] + np.arange(window)
    inside = places < ends[:, None]
    found = np.where(inside, ids[np.minimum(places, len(ids) - 1)], np.uint32(fill))
    return np.ascontiguousarray(found.astype(">u4")).view(f"S{4 * window}").ravel()


def _grown(lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [low, high): the range of each member, and the members."""
    counts = highs - lows
    owner = np.repeat(np.arange(len(lows)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + lows[owner]


def search(block: TestBlock, hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> Found:
    """Look up every test suffix of the block in the suffix array of these documents."""
    found = Found(np.zeros(len(hashes), bool), set(), {})
    if not len(block.starts) or not len(hashes):
        return found
    place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[place] == hashes, place + 1, 0).astype(np.uint32)
    lead = block.lead
    known = ids > 0
    start = known.copy()
    for i in range(1, lead):
        start[:-i] &= known[i:]
        start[-i:] = False
    at = np.flatnonzero(start)
    document = np.searchsorted(first, at, "right") - 1
    inside = at + lead <= first[document + 1]
    at, document = at[inside], document[inside]
    led = _lead_hash(ids, at, lead)
    entered = np.isin(led, block.leads)
    at, document, led = at[entered], document[entered], led[entered]
    if not len(at):
        return found

    keys = _keys(ids, at, first[document + 1], window, 0)
    order = np.argsort(keys, kind="stable")
    array, places, owners = keys[order], at[order], document[order]

    wanted = np.flatnonzero(np.isin(_lead_hash(block.words, block.starts, lead), led))
    starts, lengths = block.starts[wanted], block.lengths[wanted]
    lows = np.searchsorted(array, _keys(block.words, starts, starts + lengths, window, 0), "left")
    highs = np.searchsorted(array, _keys(block.words, starts, starts + lengths, window, 0xFFFFFFFF), "right")
    which, member = _grown(lows, np.maximum(highs, lows))
    if not len(which):
        return found
    at, document = places[member], owners[member]
    length, item, test = lengths[which], block.items[wanted][which], starts[which]

    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + length, -1)
    found.hit = np.cumsum(marks[:-1]) > 0
    pairs = np.unique(np.stack([document, item], 1), axis=0)
    found.pairs = set(map(tuple, pairs.tolist()))

    # Windows in a row on one diagonal are one verbatim match.
    diagonal = at - test
    order = np.lexsort((at, item, diagonal, document))
    at, length, item, document, diagonal = (x[order] for x in (at, length, item, document, diagonal))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(item) != 0) | (np.diff(diagonal) != 0) | (np.diff(document) != 0)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(at)) - 1
    words = at[ends] + length[ends] - at[begins]
    for d, n, a, i in zip(
        document[begins].tolist(), words.tolist(), at[begins].tolist(), item[begins].tolist(), strict=True
    ):
        better = (n, -(a - int(first[d])), -i)
        if better > found.longest.get(d, (0, 0, 0)):
            found.longest[d] = better
    return found


def test_blocks(
    benchmark: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, size: int = BLOCK_BYTES
) -> list[Broadcast]:
    """The items as broadcasts of about ``size`` text bytes each; items without words are skipped."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    rows = rows.where(F.col("t").isNotNull())
    blocks, items, held = [], [], 0
    for row in rows.toLocalIterator():
        items.append((row["k"], row["t"]))
        held += len(row["t"].encode())
        if held >= size:
            blocks.append(spark.sparkContext.broadcast(make_block(items, window)))
            items, held = [], 0
    if items:
        blocks.append(spark.sparkContext.broadcast(make_block(items, window)))
    return blocks


def _loaded(block: Broadcast, alone: bool) -> TestBlock:
    value = block.value
    if not alone and hasattr(block, "_value"):
        del block._value  # the next block needs the room; the file stays on the executor
    return value


def _scanner(blocks: list[Broadcast], window: int) -> Callable[[pa.Array], dict[str, list]]:
    def scan(texts: pa.Array) -> dict[str, list]:
        hashes, first = _words(texts)
        hit = np.zeros(len(hashes), bool)
        items: list[set[str]] = [set() for _ in range(len(texts))]
        longest: list[tuple] = [(0, 0, "")] * len(texts)
        for shared in blocks:
            block = _loaded(shared, len(blocks) == 1)
            found = search(block, hashes, first, window)
            hit |= found.hit
            for document, item in found.pairs:
                if block.names[item] is not None:
                    items[document].add(block.names[item])
            for document, (words, at, item) in found.longest.items():
                name = block.names[-item]
                longest[document] = max(longest[document], (words, at, name or ""))
        hits = np.concatenate([[0], np.cumsum(hit)])[first]
        return {
            "n_words": np.diff(first).tolist(),
            "n_hit": np.diff(hits).tolist(),
            "items": [sorted(x) for x in items],
            "longest": [x[0] for x in longest],
            "longest_at": [-x[1] if x[0] else None for x in longest],
            "longest_item": [x[2] if x[0] else None for x in longest],
        }

    return scan


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (ids as sorted strings), ``longest``
    verbatim match in words, ``longest_at`` (its first word) and ``longest_item``.

    A null text has no words and is never hit.  Items that are null or have no words are in no
    document.  An item with a null id marks words but is not listed; an id used twice is listed
    once.  Among equally long matches the first place counts.  Repeated rows stay; empty tables give
    no rows or no hits; other columns are ignored.
    """
    scan = _scanner(test_blocks(benchmark, text="text", window=window, size=block_bytes), window)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in chunks(batches, "text", shard_bytes):
            rows = scan(shard.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    shard.column("doc_id"),
                    pa.array(rows["n_words"], pa.int64()),
                    pa.array(rows["n_hit"], pa.int64()),
                    pa.array(rows["items"], pa.list_(pa.string())),
                    pa.array(rows["longest"], pa.int64()),
                    pa.array(rows["longest_at"], pa.int64()),
                    pa.array(rows["longest_item"], pa.string()),
                ],
                ["doc_id", "n_words", "n_hit", "items", "longest", "longest_at", "longest_item"],
            )

    narrow = ids_and_text(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        work,
        f"doc_id {kind}, n_words long, n_hit long, items array<string>, longest long, "
        "longest_at long, longest_item string",
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW
) -> DataFrame:
    """The documents, all columns, in which no test window occurs; the cases are as above."""
    scan = _scanner(test_blocks(benchmark, window=window), window)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in chunks(batches, text, SHARD_BYTES):
            clean = pa.array([n == 0 for n in scan(shard.column(text))["n_hit"]], pa.bool_())
            yield shard.filter(clean)

    return docs.mapInArrow(work, docs.schema)


