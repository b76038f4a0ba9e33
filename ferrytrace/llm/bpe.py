"""Byte-pair encoding by forced-boundary splitting, and decoding.

Every token that merging can ever build is in the vocabulary.  So two neighbouring bytes that occur
next to each other inside no token can never end up in one: between them lies a certain cut.  A
pre-token is cut there, its fragments are merged independently, and the ids are concatenated.

The vocabulary file is a parameter; its special strings are recognised in the text as the file says.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ferrytrace.llm.common import chunks, ids_and_text

# Fixed: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Pre-tokens and fragments a worker remembers; longer ones are encoded each time.
CACHED = 400_000
CACHED_LENGTH = 64
# Longer fragments are merged with a heap.
LONG_FRAGMENT = 100
NO_RANK = 1 << 60


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in vocab.items():
            if token not in self.special:
                self.token_bytes[number] = bytes(letters[c] for c in token)
        ids = {token: number for number, token in enumerate(self.token_bytes) if token}
        for token, number in self.special.items():
            self.token_bytes[number] = token.encode()
        self.single = [vocab[letter] for letter in byte_letters()]
        self.ranks, self.merged = {}, []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault((vocab[left] << 32) | vocab[right], rank)
            self.merged.append(vocab[left + right])
        self.joined = bytearray(65536)
        for token in ids:
            for a, b in zip(token, token[1:], strict=False):
                self.joined[a * 256 + b] = 1
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.fragments = _Cache(self._merge)
        self.words = _Cache(self._encode_word)

    def _merge(self, fragment: bytes) -> bytes:
        """The ids of one fragment: again and again the pair of lowest rank, leftmost first."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > LONG_FRAGMENT:
            return self._merge_long(ids)
        rank_of = self.ranks.get
        ranks = [rank_of((a << 32) | b, NO_RANK) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest == NO_RANK:
                break
            i = ranks.index(lowest)
            ids[i : i + 2] = [self.merged[lowest]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1] << 32) | ids[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i] << 32) | ids[i + 1], NO_RANK)
        return pack_ids(ids)

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same with a heap and linked places, for fragments of any length."""
        size, rank_of = len(ids), self.ranks.get
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(rank_of((a << 32) | b, NO_RANK), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
        heap = [entry for entry in heap if entry[0] != NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= size or rank_of((ids[i] << 32) | ids[j], NO_RANK) != rank:
                continue
            ids[i], ids[j], after[i] = self.merged[rank], -1, after[j]
            if after[j] < size:
                before[after[j]] = i
                if (new := rank_of((ids[i] << 32) | ids[after[j]], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (new, i))
            if (k := before[i]) >= 0 and (new := rank_of((ids[k] << 32) | ids[i], NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (new, k))
        return pack_ids([i for i in ids if i >= 0])

    def forced_cuts(self, data: bytes) -> list[int]:
        """Positions between two bytes that stand together in no token."""
        joined = self.joined
        return [
            i + 1
            for i, (a, b) in enumerate(zip(data, data[1:], strict=False))
            if not joined[a * 256 + b]
        ]

    def _encode_word(self, word: str) -> bytes:
        data = word.encode()
        cuts = self.forced_cuts(data)
        if not cuts:
            return self._merge(data)
        edges = [0, *cuts, len(data)]
        return b"".join(self.fragments[data[a:b]] for a, b in zip(edges, edges[1:], strict=False))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return b"".join(map(self.words.__getitem__, self.find(text)))
        parts = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                parts.append(pack_ids([self.special[part]]))
            else:
                parts.extend(map(self.words.__getitem__, self.find(part)))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of the ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, numbers)).decode("utf-8", "replace")


class _Cache(dict):
    """A bounded memory of results; it starts anew when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """The vocabulary, read once in each worker."""
    return ByteBPE(path)


def encode_and_decode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` of every row.

    ``path`` must be readable on every executor.  A null text counts as empty: no ids, empty text.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.  Rows are
    worked on where they are read: no shuffle, and memory holds one chunk of texts.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for chunk in chunks(batches):
            ids = [bpe.encode(t) if t else b"" for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    narrow = ids_and_text(docs, key, text)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"doc_id {kind}, ids binary, decoded string")
