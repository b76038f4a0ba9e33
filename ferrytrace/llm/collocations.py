"""Phrases that occur far more often than their parts, by weighted acyclic automata.

Each shard of the texts builds automata that count its n-grams, one for every range of prefixes.  The
automata of a range are united, their weights summed, and what is frequent becomes that range's count
transducer.  To look up the parts of candidates, each batch of candidates writes the parts it asks for
as automata, and the transducers are composed with them.

Only n-grams enter that may be frequent.  Sieves tell, one for each order, of n-grams whose shorter
ones passed: shards count short hashes, Spark sums them, and a bit table of fixed size keeps the
frequent ones.  It never misses one; where hashes meet by chance, an n-gram is counted in vain and
falls to the threshold.

Labels are 64-bit hashes of the language and the words; the words themselves travel once a shard.
Rows are (range, depth, packed): automata of sequences of ``depth`` labels (the language and so many
words less one), and at depth 0 the spellings of labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.llm.automata import (
    CountAutomaton,
    compressed,
    decompressed,
    from_planes,
    planes,
    sequence_hash,
    summed,
)
from ferrytrace.llm.common import chunks, string_bytes
from ferrytrace.llm.words import LOWER, RangeHash, byte_class, mixed, word_spans
from ferrytrace.session import written

UNKNOWN_LANG = "und"
# Fixed: bytes between pieces, and bytes between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
WORD = byte_class(b" \t" + PIECE_ENDS)
ENDS_PIECE = ~byte_class(PIECE_ENDS)
LONGEST = 4
# Bits of a table of frequent n-grams: 8 MB, whatever the input; and of the hashes that sieves count.
TABLE_BITS = 26
HASH_BITS = 40
# Text bytes that are worked on at once, and numbers a shard holds before its automata are taken.
CHUNK_BYTES = 1 << 20
SHARD_NUMBERS = 4 << 20

ROW = "range int, depth int, packed binary"
SPELLINGS, LANGUAGE, WORDS = 0, 1, 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    edges = np.cumsum([0, *map(len, words)])
    return RangeHash(data)(edges[:-1], edges[1:])


def prefix_range(columns: np.ndarray, ranges: int) -> np.ndarray:
    """The range of sequences (language, words), by the language and the first two words."""
    return (sequence_hash(columns[:3]) >> np.uint64(33)).astype(np.int64) % ranges


def label_range(labels: np.ndarray, ranges: int) -> np.ndarray:
    """The range that keeps the spelling of a label."""
    return (sequence_hash([labels]) >> np.uint64(33)).astype(np.int64) % ranges


def short(columns: Iterable[np.ndarray]) -> np.ndarray:
    """The hash of sequences that sieves count."""
    return sequence_hash(columns) >> np.uint64(64 - HASH_BITS)


def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    second = mixed(hashes) >> np.uint64(64 - TABLE_BITS)
    return (hashes >> np.uint64(HASH_BITS - TABLE_BITS)).astype(np.int64), second.astype(np.int64)


class BitTable:
    """Which sequences may be frequent: never wrong about one that is."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, columns: list[np.ndarray]) -> np.ndarray:
        first, second = probes(short(columns))
        found = (self.bits[first >> 3] >> (first & 7).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(found)
        second = second[at]
        found[at] = (self.bits[second >> 3] >> (second & 7).astype(np.uint8)) & 1 == 1
        return found


def pack_hashes(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes as steps, with their counts."""
    return compressed(planes(np.diff(hashes, prepend=np.uint64(0)), "<u8") + planes(counts, "<i8"))


def unpack_hashes(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = decompressed(packed)
    steps, counts = data[: len(data) // 2], data[len(data) // 2 :]
    return np.cumsum(from_planes(steps, "<u8"), dtype=np.uint64), from_planes(counts, "<i8")


def sieve(docs: DataFrame, ranges: int, least: int, *tables: BitTable) -> BitTable:
    """The table of n-grams of (lang, text) that occur ``least`` times, of the order after those of the
    given tables.  Hashes are summed by range; the bits are set by Spark and reach the driver as at
    most 2**TABLE_BITS bits."""
    sent = [docs.sparkSession.sparkContext.broadcast(t.bits) for t in tables]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from HashShard(ranges, tuple(BitTable(b.value) for b in sent)).rows_of(batches)

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, total = [], 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for packed in _packed(batches):
            waiting.append(unpack_hashes(packed))
            size += len(waiting[-1][0])
            if size > 500_000 + len(total[0]):
                total, waiting, size = united([total, *waiting]), [], 0
        hashes, counts = united([total, *waiting])
        both = probes(hashes[counts >= least])
        # Spark numbers bits from 1.
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(both)) + 1)], ["bit"])

    rows = (
        docs.select("lang", "text")
        .mapInArrow(count, ROW)
        .repartitionById(ranges, F.col("range"))
        .mapInArrow(frequent, "bit long")
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        start = (row["bucket"] - 1) * len(part)
        bits[start : start + len(part)] = part
    return BitTable(bits)


def united(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Equal hashes once, in order, with the sum of their counts."""
    hashes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(hashes), np.int64)
    np.add.at(total, inverse, np.concatenate([p[1] for p in parts]))
    return hashes, total


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        yield from batch.column("packed").to_pylist()


def _row(number: int, depth: int, packed: bytes) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int32()), pa.array([depth], pa.int32()), pa.array([packed], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "depth", "packed"])


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(words), *map(len, words)], "<i4")
    return sizes.tobytes() + b"".join(words)


def unpack_words(packed: bytes) -> list[bytes]:
    count = int(np.frombuffer(packed, "<i4", 1)[0])
    sizes = np.frombuffer(packed, "<i4", count, 4)
    ends = (4 + 4 * count + np.append(0, np.cumsum(sizes, dtype=np.int64))).tolist()
    return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Shard:
    """Counts of the n-grams of some texts, in bounded memory until its rows are taken.

    With the tables of all orders, the n-grams that pass; with fewer, those of the next order whose
    shorter ones pass."""

    def __init__(self, ranges: int, tables: tuple[BitTable, ...]):
        self.ranges, self.tables = ranges, tables
        self.clear()

    def clear(self) -> None:
        self.found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def rows_of(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of the texts; they are taken as often as memory asks for."""
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            self.add(chunk.column("lang").to_pylist(), *string_bytes(chunk.column("text")))
            if self.size >= SHARD_NUMBERS:
                self.merge()
                if self.size >= SHARD_NUMBERS // 2:
                    yield from self.rows()
        yield from self.rows()

    def add(self, langs: list[str | None], data: np.ndarray, offsets: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends, first = word_spans(low, offsets, WORD)
        if not len(starts):
            return
        word = RangeHash(low)(starts, ends)
        names = {x: (UNKNOWN_LANG if x is None else x).encode() for x in langs}
        codes = dict(zip(names, word_hashes(list(names.values())), strict=True))
        per_text = np.diff(first)
        lang = np.repeat(np.array([codes[x] for x in langs], np.uint64), per_text)
        # The number of separators before a word, texts counted as well: equal within a piece.
        piece = np.cumsum(ENDS_PIECE[low], dtype=np.int32)[starts]
        piece += np.repeat(np.arange(len(per_text), dtype=np.int32), per_text)
        joined = piece[1:] == piece[:-1]
        places = self._places(lang, word, joined)
        for order, at in places.items():
            self.keep(order + 1, np.array([lang[at], *(word[at + i] for i in range(order))]))
        self.spell(dict(zip(map(int, codes.values()), names.values(), strict=True)), lang, low, starts, ends, word, places)

    def _places(self, lang: np.ndarray, word: np.ndarray, joined: np.ndarray) -> dict[int, np.ndarray]:
        """Where n-grams of each order start."""
        places: dict[int, np.ndarray] = {}
        may = np.ones(len(word), bool)
        for order in range(1, LONGEST + 1):
            if order > 1:
                may = may[:-1] & may[1:]
            if order == 2:
                may &= joined
            at = np.flatnonzero(may)
            if order > len(self.tables):
                return {order: at}
            at = at[self.tables[order - 1].may_hold([lang[at], *(word[at + i] for i in range(order))])]
            may[:] = False
            may[at] = True
            places[order] = at
        return places

    def keep(self, depth: int, columns: np.ndarray) -> None:
        some = summed(columns, np.ones(columns.shape[1], np.int64))
        self.found.setdefault(depth, []).append(some)
        self.size += some[0].size + some[1].size

    def merge(self) -> None:
        """Equal n-grams of several chunks once."""
        self.size = 0
        for depth, parts in self.found.items():
            some = summed(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))
            self.found[depth] = [some]
            self.size += some[0].size + some[1].size

    def spell(self, names: dict[int, bytes], lang: np.ndarray, *text: object) -> None:
        pass

    def rows(self) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class HashShard(Shard):
    """Counts by short hash."""

    def keep(self, depth: int, columns: np.ndarray) -> None:
        some = np.unique(short(columns), return_counts=True)
        self.found.setdefault(depth, []).append(some)
        self.size += 2 * len(some[0])

    def merge(self) -> None:
        self.found = {depth: [united(parts)] for depth, parts in self.found.items()}
        self.size = sum(2 * len(hashes) for [(hashes, _)] in self.found.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The hashes of each range in turn; the shard is empty afterwards."""
        self.merge()
        for depth, [(hashes, counts)] in self.found.items():
            of_range = ((hashes >> np.uint64(HASH_BITS - 24)).astype(np.int64) * self.ranges) >> 24
            for at in np.split(np.arange(len(hashes)), np.flatnonzero(np.diff(of_range)) + 1) if len(hashes) else []:
                yield _row(int(of_range[at[0]]), depth, pack_hashes(hashes[at], counts[at]))
        self.clear()


class SpelledShard(Shard):
    """Counts by sequence of labels, with their spellings, and of all words by language."""

    def clear(self) -> None:
        super().clear()
        self.spelled: dict[int, bytes] = {}

    def spell(
        self,
        names: dict[int, bytes],
        lang: np.ndarray,
        low: np.ndarray,
        starts: np.ndarray,
        ends: np.ndarray,
        word: np.ndarray,
        places: dict[int, np.ndarray],
    ) -> None:
        self.keep(LANGUAGE, lang[None, :])
        self.spelled.update(names)
        at = places[1]
        labels, once = np.unique(word[at], return_index=True)
        at, content = at[once], low.tobytes()
        for key, a, b in zip(labels.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
            if key not in self.spelled:
                self.spelled[key] = content[a:b]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One automaton for each range and depth, and the spellings; the shard is empty afterwards."""
        self.merge()
        for depth, [(columns, counts)] in self.found.items():
            of_range = prefix_range(columns, self.ranges)
            order = np.argsort(of_range, kind="stable")
            cuts = np.flatnonzero(np.diff(of_range[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                made = CountAutomaton.of(columns[:, at], counts[at])
                yield _row(int(of_range[at[0]]), depth, made.to_bytes())
        labels = np.array(list(self.spelled), np.uint64)
        of_range = label_range(labels, self.ranges).tolist() if len(labels) else []
        by_range: dict[int, list[bytes]] = {}
        for number, name in zip(of_range, self.spelled.values(), strict=True):
            by_range.setdefault(number, []).append(name)
        for number, names in by_range.items():
            yield _row(number, SPELLINGS, pack_words(names))
        self.clear()


def shard_automata(docs: DataFrame, ranges: int, tables: tuple[BitTable, ...]) -> DataFrame:
    """Rows of each shard of (lang, text)."""
    sent = [docs.sparkSession.sparkContext.broadcast(t.bits) for t in tables]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from SpelledShard(ranges, tuple(BitTable(b.value) for b in sent)).rows_of(batches)

    return docs.select("lang", "text").mapInArrow(work, ROW)


def unite(shards: DataFrame, ranges: int, least: int) -> DataFrame:
    """The automata of each range and depth united, their counts summed, with what occurs ``least``
    times, and the number of words by language (depth 1); each spelling once."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        names: dict[int, set[bytes]] = {}

        def add(key: tuple[int, int]) -> None:
            parts = [*([total[key]] if key in total else []), *waiting.pop(key, [])]
            if parts:
                total[key] = summed(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))

        for batch in batches:
            for number, depth, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if depth == SPELLINGS:
                    names.setdefault(number, set()).update(unpack_words(packed))
                    continue
                automaton, key = CountAutomaton.from_bytes(packed), (number, depth)
                waiting.setdefault(key, []).append((automaton.sequences(), automaton.counts))
                # As much again as is united already.
                if sum(p[1].size for p in waiting[key]) > 100_000 + (total[key][1].size if key in total else 0):
                    add(key)
        for key in list(waiting):
            add(key)
        for (number, depth), (columns, counts) in total.items():
            kept = counts >= (least if depth > LANGUAGE else 1)
            yield _row(number, depth, CountAutomaton.of(columns[:, kept], counts[kept]).to_bytes())
        for number, some in names.items():
            yield _row(number, SPELLINGS, pack_words(sorted(some)))

    return shards.repartitionById(ranges, F.col("range")).mapInArrow(work, ROW)


def sequences_of(transducers: DataFrame) -> DataFrame:
    """``lang``, ``words`` (labels) and ``count`` of all sequences in the transducers."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in _packed(batches):
            automaton = CountAutomaton.from_bytes(packed)
            columns, counts = automaton.sequences().view(np.int64), automaton.counts
            depth = len(columns) - 1
            for start in range(0, len(counts), 10_000):
                some = columns[:, start : start + 10_000]
                edges = np.arange(0, depth * some.shape[1] + 1, depth, dtype=np.int32) if depth else np.zeros(some.shape[1] + 1, np.int32)
                words = pa.ListArray.from_arrays(pa.array(edges), pa.array(some[1:].T.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some[0]), words, pa.array(counts[start : start + 10_000])], ["lang", "words", "count"]
                )

    automata = transducers.where(F.col("depth") > SPELLINGS).select("packed")
    return automata.mapInArrow(work, "lang long, words array<long>, count long")


Sequence = tuple[int, ...]


def weakest_cut(sequence: Sequence, count: int, of: dict[Sequence, int]) -> tuple[int, int, int]:
    """(score, l, r) of the cut with the lowest score, the first of those."""
    lang, words = sequence[:1], sequence[1:]
    cuts = []
    for k in range(1, len(words)):
        left, right = of[lang + words[:k]], of[lang + words[k:]]
        cuts.append((2_000_000 * count // (left + right), k, left, right))
    score, _, left, right = min(cuts)
    return score, left, right


def _candidates(table: pa.Table) -> list[Sequence]:
    langs, words = table.column("lang").to_pylist(), table.column("words").to_pylist()
    return [(x, *ws) for x, ws in zip(langs, words, strict=True)]


def scored_by_parts(candidates: DataFrame, transducers: DataFrame, ranges: int) -> DataFrame:
    """``lang``, ``words``, ``count`` with the ``name`` of the language, the ``phrase``, and ``l``, ``r``
    and ``score`` of the weakest cut.

    Each batch of candidates asks every range once for what it needs of it, so a part that many
    candidates share is no hot key."""

    def ask(table: pa.Table) -> pa.Table:
        parts: set[Sequence] = set()
        sequences = _candidates(table)
        for s in sequences:
            for k in range(2, len(s)):
                parts |= {s[:k], s[:1] + s[k:]}
        asked = []
        for depth in sorted({len(p) for p in parts}):
            columns = np.array([p for p in parts if len(p) == depth], np.int64).T.view(np.uint64)
            of_range = prefix_range(columns, ranges)
            for number in np.unique(of_range).tolist():
                some = columns[:, of_range == number]
                asked.append((number, depth, CountAutomaton.of(some, np.zeros(some.shape[1], np.int64)).to_bytes()))
        labels = np.unique(np.array([x for s in sequences for x in s], np.int64)).view(np.uint64)
        of_range = label_range(labels, ranges)
        asked += [(n, SPELLINGS, labels[of_range == n].tobytes()) for n in np.unique(of_range).tolist()]
        batch = table.column("batch")[0].as_py()
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        columns = [pa.array([a[i] for a in asked], kind) for i, kind in enumerate(kinds)]
        return pa.table([pa.array([batch] * len(asked), pa.int64()), *columns], ["batch", "range", "depth", "packed"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        counted: dict[int, CountAutomaton] = {}
        spelled: dict[int, bytes] = {}
        for depth, packed in zip(known.column("depth").to_pylist(), known.column("packed").to_pylist(), strict=True):
            if depth == SPELLINGS:
                names = unpack_words(packed)
                spelled.update(zip(word_hashes(names).tolist(), names, strict=True))
            else:
                counted[depth] = CountAutomaton.from_bytes(packed)
        found = []
        for depth, packed in zip(asked.column("depth").to_pylist(), asked.column("packed").to_pylist(), strict=True):
            if depth == SPELLINGS:
                found.append(pack_words([spelled[x] for x in np.frombuffer(packed, "<u8").tolist() if x in spelled]))
            else:
                found.append(counted[depth].compose(CountAutomaton.from_bytes(packed)).to_bytes())
        return pa.table([*asked.select(["batch", "depth"]).columns, pa.array(found, pa.binary())], ["batch", "depth", "packed"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        of: dict[Sequence, int] = {}
        spelled: dict[int, str] = {}
        for depth, packed in zip(answers.column("depth").to_pylist(), answers.column("packed").to_pylist(), strict=True):
            if depth == SPELLINGS:
                names = unpack_words(packed)
                labels = word_hashes(names).view(np.int64).tolist()
                spelled.update((x, n.decode()) for x, n in zip(labels, names, strict=True))
            else:
                automaton = CountAutomaton.from_bytes(packed)
                columns = automaton.sequences().view(np.int64).tolist()
                of.update(zip(zip(*columns, strict=True), automaton.counts.tolist(), strict=True))
        sequences = _candidates(table)
        rows = [weakest_cut(s, c, of) for s, c in zip(sequences, table.column("count").to_pylist(), strict=True)]
        names = pa.array([spelled[s[0]] for s in sequences], pa.string())
        phrases = pa.array([" ".join(spelled[x] for x in s[1:]) for s in sequences], pa.string())
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        return pa.table(
            [*table.select(["lang", "words", "count"]).columns, names, phrases, *columns],
            ["lang", "words", "count", "name", "phrase", "score", "l", "r"],
        )

    batches = F.pmod(F.xxhash64("lang", "words"), F.lit(ranges))
    dealt = candidates.withColumn("batch", batches)
    asked = dealt.groupBy("batch").applyInArrow(ask, "batch long, " + ROW)
    answers = (
        asked.groupBy("range")
        .cogroup(transducers.groupBy("range"))
        .applyInArrow(answer, "batch long, depth int, packed binary")
    )
    return (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(
            score, "lang long, words array<long>, count long, name string, phrase string, score long, l long, r long"
        )
    )


def without_absorbed(scored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that don't nearly always (four times of five) stand inside one longer candidate."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), m ->"
        " transform(sequence(1, size(words) - m + 1), s -> slice(words, s, m))))"
    )
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(inner).alias("words"), "count")
    most = longer.groupBy("lang", "words").agg(F.max("count").alias("longer"))
    # Products may pass 64 bits.
    part = F.col("longer").cast("decimal(30,0)") * F.lit(100).cast("decimal(3,0)")
    whole = F.col("count").cast("decimal(30,0)") * F.lit(80).cast("decimal(3,0)")
    return scored.join(most, ["lang", "words"], "left").where(F.coalesce(part < whole, F.lit(True))).drop("longer")


def mine_phrases(docs: DataFrame, least: int = 30, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of two to four words of each language: ``lang``, ``rank``, ``phrase``, its
    count ``a``, the counts ``l`` and ``r`` of its parts at the weakest cut, ``n`` words of the
    language, and ``score``.

    Null texts are empty; a null language is ``und``.  Equal rows count each; ties go by count, then
    by phrase in byte order; other columns, whatever their names, are ignored; an empty table gives no
    row.  Texts are read whole, in chunks, however long one is.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    tables: tuple[BitTable, ...] = ()
    while len(tables) < LONGEST:
        tables += (sieve(narrow, ranges, least, *tables),)
    found = written(unite(shard_automata(narrow, ranges, tables), ranges, least), "phrases")
    candidates = sequences_of(found.where(F.col("depth") > WORDS))
    sizes = sequences_of(found.where(F.col("depth") == LANGUAGE)).groupBy("lang").agg(F.sum("count").alias("n"))
    scored = scored_by_parts(candidates, found.where(F.col("depth") != LANGUAGE), ranges)
    listed = without_absorbed(scored, candidates)
    # First within parts of a language, so that no task ranks more than the best of a few.
    order = [F.desc("score"), F.desc("count"), "phrase"]
    listed = listed.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        best = Window.partitionBy(*keys).orderBy(*order)
        listed = listed.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return listed.join(sizes, "lang").select(
        F.col("name").alias("lang"), "rank", "phrase", F.col("count").alias("a"), "l", "r", "n", "score"
    )
