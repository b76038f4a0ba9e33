"""Weighted acyclic automata over numbers: a set of sequences of one length, each with a count.

An automaton is built from sorted sequences, a layer at a time from their ends: prefixes whose
continuations are equal share a state.  A sequence's place in the sorted order (how many are accepted
before it) is its place in the array of counts, so states are shared whatever the counts are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import zstandard

from ferrytrace.llm.words import mixed

compressed, decompressed = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
_STEP = np.uint64(0x9FB21C651E98DF25)


def planes(values: np.ndarray, kind: str) -> bytes:
    """The lowest bytes of all numbers, then the next ones: what is alike stands together."""
    kept = np.ascontiguousarray(values, kind)
    return kept.view(np.uint8).reshape(-1, kept.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(parts.T).view(kind).ravel()


def sequence_hash(parts: Iterable[np.ndarray]) -> np.ndarray:
    """One hash of several columns of numbers."""
    found = None
    for part in parts:
        found = mixed(part) if found is None else mixed(found * _STEP + part)
    return found


def summed(columns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal sequences (columns of the matrix) once, with the sum of their counts."""
    _, place, inverse = np.unique(sequence_hash(columns), return_index=True, return_inverse=True)
    total = np.zeros(len(place), np.int64)
    np.add.at(total, inverse, counts)
    return columns[:, place], total


class CountAutomaton:
    """Layer i has the transitions with the i-th label of each sequence: ``first[i]`` says where a
    state's transitions begin, ``labels[i]`` (places in the sorted ``alphabet``) ascend within a state,
    ``targets[i]`` are states of the next layer.  The first layer has one state."""

    def __init__(self, alphabet: np.ndarray, first: list, labels: list, targets: list, counts: np.ndarray):
        self.alphabet, self.first, self.labels, self.targets, self.counts = alphabet, first, labels, targets, counts

    @classmethod
    def of(cls, columns: np.ndarray, counts: np.ndarray) -> CountAutomaton:
        """From the matrix of distinct sequences: a row for each place, a column for each sequence."""
        alphabet, labels = np.unique(columns, return_inverse=True)
        labels = labels.reshape(columns.shape).astype(np.int32)
        order = np.lexsort(labels[::-1])
        labels, counts = labels[:, order], counts[order]
        depth, size = labels.shape
        # new[i]: where a prefix of i + 1 labels differs from the one before.
        new = np.ones((depth, size), bool)
        for i in range(depth):
            new[i, 1:] = labels[i, 1:] != labels[i, :-1]
            if i:
                new[i] |= new[i - 1]
        firsts, edges, ends = [None] * depth, [None] * depth, [None] * depth
        # States of the next layer, by distinct prefix; behind the last label there is only one.
        target = np.zeros(size, np.int32)
        for i in range(depth - 1, -1, -1):
            heads = np.flatnonzero(new[i])  # one for each transition
            label = labels[i, heads]
            if i:
                begins = np.flatnonzero(new[i - 1][heads])  # one for each prefix before it
            else:
                begins = np.zeros(min(size, 1), np.int64)
            degree = np.diff(np.append(begins, len(heads)))
            sign = mixed(label.astype(np.uint64) * _STEP + mixed(target.astype(np.uint64)))
            sign = np.add.reduceat(sign, begins) if len(begins) else sign
            _, one, state = np.unique(mixed(sign + degree.astype(np.uint64)), return_index=True, return_inverse=True)
            kept = np.repeat(begins[one] - np.cumsum(np.append(0, degree[one]))[:-1], degree[one]) + np.arange(degree[one].sum())
            firsts[i] = np.append(0, np.cumsum(degree[one])).astype(np.int32)
            edges[i], ends[i] = label[kept], target[kept]
            target = state.astype(np.int32)
        return cls(alphabet, firsts, edges, ends, counts.astype(np.int64))

    def sequences(self) -> np.ndarray:
        """The matrix of all sequences in order; ``counts`` belongs to it."""
        states, columns = np.zeros(min(len(self.counts), 1), np.int32), []
        for first, labels, targets in zip(self.first, self.labels, self.targets, strict=True):
            degree = (first[states + 1] - first[states]).astype(np.int64)
            ends = np.cumsum(degree)
            edges = np.repeat(first[states] - (ends - degree), degree) + np.arange(degree.sum())
            columns = [np.repeat(c, degree) for c in columns] + [labels[edges]]
            states = targets[edges]
        return self.alphabet[np.array(columns, np.int64).reshape(len(self.first), -1)]

    def compose(self, asked: CountAutomaton) -> CountAutomaton:
        """The sequences of ``asked`` that this one has too, with this one's counts."""
        wanted = asked.sequences()
        if not len(self.counts) or not wanted.size:
            return CountAutomaton.of(wanted[:, :0], np.zeros(0, np.int64))
        # How many sequences each transition accepts, and so how many stand before it.
        before, inside = [None] * len(self.first), np.ones(1, np.int64)
        for i in range(len(self.first) - 1, -1, -1):
            through = inside[self.targets[i]]
            upto = np.append(0, np.cumsum(through))
            source = np.repeat(np.arange(len(self.first[i]) - 1), np.diff(self.first[i]))
            before[i] = (upto[:-1] - upto[self.first[i][source]], source)
            inside = upto[self.first[i][1:]] - upto[self.first[i][:-1]]
        size = len(self.alphabet)
        state, rank = np.zeros(wanted.shape[1], np.int64), np.zeros(wanted.shape[1], np.int64)
        found = np.ones(wanted.shape[1], bool)
        for i, column in enumerate(wanted):
            label = np.minimum(np.searchsorted(self.alphabet, column), size - 1)
            skipped, source = before[i]
            keys = source.astype(np.int64) * size + self.labels[i]
            edge = np.minimum(np.searchsorted(keys, state * size + label), len(keys) - 1)
            found &= (self.alphabet[label] == column) & (keys[edge] == state * size + label)
            rank += skipped[edge]
            state = self.targets[i][edge].astype(np.int64)
        return CountAutomaton.of(wanted[:, found], self.counts[rank[found]])

    def to_bytes(self) -> bytes:
        steps = np.diff(self.alphabet, prepend=np.uint64(0))
        parts, sizes = [planes(steps, "<u8"), planes(self.counts, "<i8")], [len(self.first), len(steps), len(self.counts)]
        for first, labels, targets in zip(self.first, self.labels, self.targets, strict=True):
            parts += [planes(np.diff(first), "<i4"), planes(labels, "<i4"), planes(targets, "<i4")]
            sizes += [len(first) - 1, len(labels)]
        return compressed(struct.pack(f"<{len(sizes)}i", *sizes) + b"".join(parts))

    @classmethod
    def from_bytes(cls, packed: bytes) -> CountAutomaton:
        data = decompressed(packed)
        depth, letters, paths = struct.unpack_from("<3i", data)
        sizes = struct.unpack_from(f"<{2 * depth}i", data, 12)
        at = 12 + 8 * depth

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            start, at = at, at + count * np.dtype(kind).itemsize
            return from_planes(data[start:at], kind)

        alphabet, counts = np.cumsum(take("<u8", letters), dtype=np.uint64), take("<i8", paths)
        layers = [
            (np.append(0, np.cumsum(take("<i4", states))).astype(np.int32), take("<i4", edges), take("<i4", edges))
            for states, edges in zip(sizes[::2], sizes[1::2], strict=True)
        ]
        return cls(alphabet, *map(list, zip(*layers, strict=True)), counts)
