"""Alignment of two tokenizers' tokens by the byte offsets where both end.

The cumulative ends of each tokenization are the keys of a dictionary from end to index; the sorted
keys that both have slice both id lists into groups, and each slice is expanded into links.

How many documents hold an id pair linked is counted over the whole corpus.  Links travel in blocks:
a block lists the different pairs of some documents once, documents refer to places in that list, and
only the lists are exchanged for the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrytrace.llm.automata import compressed, decompressed, from_planes, planes
from ferrytrace.llm.bpe import PRE_TOKEN, ByteBPE, pack_ids
from ferrytrace.llm.bpe import _Cache as Remembered
from ferrytrace.llm.common import chunks, ids_and_text

# Text bytes that are tokenized at once, and places a block holds (unless one text alone has more).
CHUNK_BYTES = 1 << 20
BLOCK_PLACES = 1 << 20
# Groups with more links are expanded by their different ids.
MANY_LINKS = 4096
SPACE = "▁"


class Tokenizers:
    """A byte-level vocabulary (a tokenizers file) and a sentencepiece model, with their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.a = ByteBPE(path_a)
        self.a.special_pattern = None  # special strings in a text are plain text
        special = set(self.a.special.values())
        ranks = {t: i for i, t in enumerate(self.a.token_bytes) if t and i not in special}
        # The same merges, compiled, where ids ascend with them.
        self.compiled = None
        if self.a.merged == sorted(self.a.merged):
            self.compiled = tiktoken.Encoding("a", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.a.words = Remembered(self._word)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # No piece has a space behind another character: then words are merged independently.
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.words_b = Remembered(self.b.encode)
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (
            np.array([len(t) for t in tokens], np.int64) for tokens in (self.a.token_bytes, self.bytes_b)
        )
        # An id inside its group, and at the end of its half of it; those of B behind those of A.
        self.written = [f"{i}{end}" for i in range(len(self.length_a)) for end in ",|"]
        self.written += [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def _bytes_b(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace(SPACE, " ").encode()

    def _word(self, word: str) -> bytes:
        """The ids of a pre-token; those that other engines may class or split otherwise go our way."""
        if self.compiled is None or len(word) > 300 or word.isspace() or max(word) > "\u024f":
            return self.a._encode_word(word)
        return pack_ids(self.compiled.encode_ordinary(word))

    def encode_a(self, text: str) -> np.ndarray:
        return np.frombuffer(self.a.encode(text), "<u4").astype(np.int64)

    def encode_b(self, text: str) -> list[int]:
        """Each word with the space before it, remembered; texts with other spaces as a whole."""
        if not self.by_word or "  " in text or SPACE in text or text[:1] == " " or text[-1:] == " ":
            return self.b.encode(text)
        return list(chain.from_iterable(map(self.words_b.__getitem__, text.split(" "))))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both; none where they don't spell space + text."""
        for text in texts:
            whole, other = (" " + text).encode(), self.encode_b(text)
            if text and b"".join(map(self.bytes_b.__getitem__, other)) == whole:
                ids = self.encode_a(" " + text)
                if self.length_a[ids].sum() == len(whole):  # its tokens' bytes can only be the text's
                    yield ids, np.array(other, np.int64)
                    continue
            yield _EMPTY, _EMPTY


_EMPTY = np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """Read once in each worker."""
    return Tokenizers(path_a, path_b)


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups begin in both lists, and where the last one ends."""
    index_b = dict(zip(ends_b, range(1, len(ends_b) + 1), strict=True))
    # By index of A: the index in B of the same end, or 0; ends ascend, so common ones are in order.
    common = np.array([index_b.get(end, 0) for end in ends_a], np.int64)
    index_a = np.flatnonzero(common)
    return np.append(0, index_a + 1), np.append(0, common[index_a])


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different id pairs (a * 2**32 + b, ascending) in a group together, and how often."""
    size_a, size_b = np.diff(cut_a), np.diff(cut_b)
    large = size_a * size_b > MANY_LINKS
    group = np.repeat(np.arange(len(size_a)), size_a)
    partners = np.where(large, 0, size_b)[group]
    ends = np.cumsum(partners)
    at_b = np.repeat(cut_b[group] - (ends - partners), partners) + np.arange(partners.sum())
    pairs, times = np.unique((np.repeat(a, partners) << 32) | b[at_b], return_counts=True)
    if not large.any():
        return pairs, times
    total = Counter(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
    for g in np.flatnonzero(large).tolist():
        some_a, some_b = (np.unique(x[c[g] : c[g + 1]], return_counts=True) for x, c in ((a, cut_a), (b, cut_b)))
        both = ((some_a[0] << 32)[:, None] | some_b[0]).ravel().tolist()
        total.update(dict(zip(both, np.outer(some_a[1], some_b[1]).ravel().tolist(), strict=True)))
    ordered = sorted(total)
    return np.array(ordered, np.int64), np.array([total[p] for p in ordered], np.int64)


def written_groups(
    known: Tokenizers, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray
) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[cut_a[1:] - 1] = last_b[cut_b[1:] - 1] = 1
    # A token stands behind all tokens of the groups before, and those of B also behind A's own group.
    place_a = np.arange(len(a)) + np.repeat(cut_b[:-1], np.diff(cut_a))
    place_b = np.arange(len(b)) + np.repeat(cut_a[1:], np.diff(cut_b))
    places = np.empty(len(a) + len(b), np.int64)
    places[place_a] = 2 * a + last_a
    places[place_b] = 2 * (b + len(known.length_a)) + last_b
    return "".join(map(known.written.__getitem__, places.tolist()))[:-1]


def align_texts(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's alignment, in blocks.

    Rows of documents have ``block``, ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``
    (as text), and ``links`` (packed): places in the list of their block, and how often.  One further row
    for each block, with ``pairs`` in place of ``links``, has that list: pairs (a * 2**32 + b, ascending)
    and how many documents of the block hold them.  Write the result before it is used twice: rows of a
    block belong together.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 32
        waiting, size = [], 0
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            keys = chunk.column("doc_id")
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            for i, (a, b) in enumerate(known.encode(texts)):
                ends = [np.cumsum(n[x]).tolist() for n, x in ((known.length_a, a), (known.length_b, b))]
                cut_a, cut_b = cuts(*ends)
                pairs, times = links(a, b, cut_a, cut_b)
                groups = written_groups(known, a, b, cut_a, cut_b)
                total = int((np.diff(cut_a) * np.diff(cut_b)).sum())
                waiting.append((keys[i], len(a), len(b), len(cut_a) - 1, total, groups, pairs, times))
                size += len(pairs)
                if size >= BLOCK_PLACES:
                    yield from _block(number, waiting, keys.type)
                    waiting, size, number = [], 0, number + 1
        if waiting:
            yield from _block(number, waiting, keys.type)

    narrow = ids_and_text(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = (
        f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string,"
        " links binary, pairs binary"
    )
    return narrow.mapInArrow(work, schema)


def _pack(ascending: np.ndarray, numbers: np.ndarray, kind: str = "<i8") -> bytes:
    return compressed(planes(np.diff(ascending, prepend=0), kind) + planes(numbers, "<i8"))


def _unpack(packed: bytes, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    data, width = decompressed(packed), np.dtype(kind).itemsize
    cut = len(data) * width // (width + 8)
    return np.cumsum(from_planes(data[:cut], kind)), from_planes(data[cut:], "<i8")


def _block(number: int, rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    every = np.concatenate([r[6] for r in rows])
    pairs, place, documents = np.unique(every, return_inverse=True, return_counts=True)
    ends = np.cumsum([0, *(len(r[6]) for r in rows)]).tolist()
    for start in range(0, len(rows), 1000):
        some = rows[start : start + 1000]
        columns = [pa.array([number] * len(some), pa.int64()), pa.array([r[0].as_py() for r in some], kind)]
        columns += [pa.array([r[i] for r in some], pa.int64()) for i in range(1, 5)]
        packed = [_pack(place[ends[i] : ends[i + 1]], r[7], _PLACE) for i, r in enumerate(some, start)]
        columns += [pa.array([r[5] for r in some], pa.string()), pa.array(packed, pa.binary()), pa.nulls(len(some), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, list(_NAMES))
    columns = [pa.array([number], pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4]
    columns += [pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([_pack(pairs, documents)], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, list(_NAMES))


# A place in the list of a block.
_PLACE = "<i4"
_NAMES = ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs")


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """``block``, ``pair`` and ``documents`` of the lists in the blocks."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, documents = _unpack(packed)
                for start in range(0, len(pairs), 10_000):
                    some = pairs[start : start + 10_000]
                    blocks = pa.array(np.full(len(some), block))
                    yield pa.RecordBatch.from_arrays(
                        [blocks, pa.array(some), pa.array(documents[start : start + 10_000])], ["block", "pair", "documents"]
                    )

    lists = aligned.where("pairs IS NOT NULL").select("block", "pairs")
    return lists.mapInArrow(work, "block long, pair long, documents long")


def count_pairs(listed: DataFrame) -> DataFrame:
    """``pair``, ``count`` of documents, and ``best``: whether no other pair of its first id has more."""
    counted = listed.groupBy("pair").agg(F.sum("documents").alias("count"))
    first = F.shiftright("pair", 32).alias("a")
    # At most one row of 16 bytes for each id of the vocabulary.
    most = counted.groupBy(first).agg(F.max("count").alias("most"))
    joined = counted.withColumn("a", first).join(F.broadcast(most), "a")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """The documents of ``align_texts`` (already written) with ``n_best``, the links whose pair is its
    first id's most frequent, and ``count_sum`` over links; ``links`` and ``block`` go."""
    listed = linked_pairs(aligned)
    known = listed.drop("documents").join(count_pairs(listed), "pair")
    documents = aligned.where("pairs IS NULL").drop("pairs")
    kept = [c for c in documents.columns if c not in ("block", "links")]

    def work(rows: pa.Table, lists: pa.Table) -> pa.Table:
        order = np.argsort(lists.column("pair").to_numpy())
        count = lists.column("count").to_numpy()[order]
        best = lists.column("best").to_numpy(zero_copy_only=False)[order]
        sums = []
        for packed in rows.column("links").to_pylist():
            places, times = _unpack(packed, _PLACE)
            sums.append((int(times[best[places]].sum()), int((times * count[places]).sum())))
        columns = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
        return pa.table([*rows.select(kept).columns, *columns], [*kept, "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return (
        documents.groupBy("block")
        .cogroup(known.groupBy("block"))
        .applyInArrow(work, f"{schema}, n_best long, count_sum long")
    )
