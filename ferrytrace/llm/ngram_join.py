"""Similarity join of documents on their word n-grams, by token combinations.

Two sets that are similar enough differ in few tokens: with a threshold of T percent and a set of n
tokens, in at most n * (100 - T) / T.  The whole set is dealt by hash into more parts than that, so
similar sets agree on all tokens of some part: on a *combination* of tokens, which is what gets
indexed.  Sets are compared within size classes, so that both sides deal into the same parts.

Documents that share a combination, directly or in a chain, form a candidate component.  No link
leads out of one.  Chains through passages make such components large, so they are cut by *parity
sketches* first: a bit for each bucket tells whether the set has an odd number of tokens there.  Two
sketches differ in at most as many bits as the sets in tokens, so similar sets never have sketches
further apart than that, and chains of near sketches are small.  A sketch has one to two bits a token,
a fiftieth of the text.  Inside each chain, all sets are compared exactly.  What is too large for a
task is dealt into blocks, every two of which meet.  What leaves a task is a spanning forest, never
all pairs.

A document is its text here: copies of a text are one node, so they are linked and cost one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrytrace.llm.common import chunks, free_name, ids_and_text, string_bytes
from ferrytrace.llm.components import components
from ferrytrace.llm.words import NOT_SPACE, RangeHash, mixed, word_spans
from ferrytrace.session import written

# Documents of one block, twice as many sketches: two blocks are compared in a task.
BLOCK_DOCS = 5000
# Rows of a block of sketches compared at once.
SKETCH_ROWS = 128
# Columns of the membership matrix, and rows of their products, held at once.
COLUMN_BLOCK = 1024
ROW_STRIP = 512
# Text bytes whose words and hashes a step holds at once, unless one text alone is longer.
HELD_BYTES = 1 << 20

Links = list[tuple[int, int]]

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-grams of ``words`` words; a text with fewer
    words has the one of all its words, a text without words has none."""
    data, offsets = string_bytes(texts)
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    hashes = RangeHash(data, fold=True)(starts, ends)
    factors = _FACTORS[:words]
    if len(factors) < words:
        raise ValueError(f"at most {len(_FACTORS)} words")
    grams = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for i in range(words if len(grams) else 0):
        grams += mixed(hashes[i : i + len(grams)] * factors[i])
    grams = mixed(grams)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            found.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            whole = np.add.reduce(mixed(hashes[a:b] * factors[: b - a])) + np.uint64(b - a)
            found.append(mixed(np.array([whole])))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


@lru_cache(maxsize=4)
def size_classes(percent: int) -> np.ndarray:
    """First size of each class: up to the size at which two sets may differ, then by a quarter more,
    or by as much as similar sets can differ in size, so that these are in neighbouring classes."""
    bounds = [1, -(-percent // (100 - percent))]
    while bounds[-1] < 1 << 40:
        bounds.append(max(-(-bounds[-1] * 5 // 4), -(-bounds[-1] * 100 // percent)))
    return np.array(bounds)


def spare_parts(differing: int, percent: int) -> tuple[int, int]:
    """Fewest tokens of a part that is indexed, and how many parts with fewer a set may have.

    From 88 percent on, parts hold six tokens or more on average, and those with one can be left out
    as well; below, only the empty ones.
    """
    return (2, differing // 32 + 3) if percent >= 88 else (1, differing * 3 // 20 + 3)


@lru_cache(maxsize=512)
def _bounds(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)


def combinations(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the token combinations under which a set is indexed."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    bounds = size_classes(percent)
    own = int(np.searchsorted(bounds, n, "right")) - 1
    labels = [own]
    if own and n * percent <= (int(bounds[own]) - 1) * 100:
        labels.append(own - 1)  # it may be similar to a smaller set of the class below
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens + np.uint64(1)))])
    found = []
    for label in labels:
        differing = (int(bounds[label + 1]) - 1) * (100 - percent) // percent
        small, spare = spare_parts(differing, percent) if differing else (1, 0)
        parts = differing + 1 + spare
        edges = np.concatenate([[0], np.searchsorted(tokens, _bounds(parts)), [n]])
        counts = np.diff(edges)
        keys = summed[edges[1:]] - summed[edges[:-1]]
        keys = mixed(mixed(keys + counts.astype(np.uint64)) + np.arange(parts, dtype=np.uint64) * _FACTORS[0])
        keys = mixed(keys + np.uint64(label * int(_FACTORS[1]) & 0xFFFFFFFFFFFFFFFF))
        kept = counts >= small
        if parts - int(kept.sum()) > spare:
            kept[:] = True  # too many small parts to leave them out
        found.append(keys[kept])
    return np.concatenate(found)


def sketch_bits(size: int | np.ndarray, percent: int) -> np.ndarray:
    """Bits of the sketch of a set: the next power of two, at least 64.  Unrelated sets differ in about
    half of the bits, which has to be more than similar ones may: low thresholds need twice as many."""
    wanted = np.maximum(size, 1) * (2 if percent < 75 else 1)
    return 1 << np.maximum(np.ceil(np.log2(wanted)), 6).astype(np.int64)


def parity_sketch(tokens: np.ndarray, percent: int) -> bytes:
    """For each bucket of token hashes, whether it holds an odd number of tokens."""
    bits = int(sketch_bits(len(tokens), percent))
    buckets = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(buckets, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def near_sketches(sizes: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs of sketches near enough to be of similar sets.

    Sets of a and b tokens differ in (a + b) * (100 - percent) / (100 + percent) tokens if they just
    reach the threshold.  The longer of two sketches folds to the length of the shorter.
    """
    order = np.argsort(sizes, kind="stable")
    sizes = np.asarray(sizes, np.int64)[order]
    bits = sketch_bits(sizes, percent)
    starts = np.append(np.flatnonzero(np.diff(bits, prepend=0)), len(bits))
    classes = [
        (a, b, np.frombuffer(b"".join(sketches[i] for i in order[a:b]), np.uint64).reshape(b - a, -1))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
    ]

    def folded(first: int, last: int, words: int) -> np.ndarray:
        parts = [m[max(first - a, 0) : last - a] for a, b, m in classes if a < last and b > first]
        return np.concatenate([np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1) for x in parts])

    label, links = np.arange(len(sizes)), []
    for a, b, matrix in classes:
        for first in range(a, b, SKETCH_ROWS):
            end = min(first + SKETCH_ROWS, b)
            last = int(np.searchsorted(sizes, sizes[end - 1] * 100 // percent, "right"))
            words = matrix.shape[1]
            others = np.ascontiguousarray(folded(first, last, words).T)
            differ = np.zeros((end - first, last - first), np.int64)
            for own in others:
                differ += np.bitwise_count(own[: end - first, None] ^ own[None, :])
            own_sizes, other_sizes = sizes[first:end, None], sizes[None, first:last]
            differ = np.maximum(differ, np.abs(own_sizes - other_sizes))
            near = differ * (100 + percent) <= (own_sizes + other_sizes) * (100 - percent)
            for row in range(end - first):
                at = first + row
                links += _joined(label, at, at + 1 + np.flatnonzero(near[row, row + 1 :]))
    return [(int(order[a]), int(order[b])) for a, b in links]


def sets_of_many(texts: Iterable[str], words: int) -> list[np.ndarray]:
    """The shingle sets of any number of texts, a bounded part of them at a time."""
    found: list[np.ndarray] = []
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text or "")
        if size >= HELD_BYTES:
            found += shingle_sets(pa.array(some, pa.large_string()), words)
            some, size = [], 0
    return found + shingle_sets(pa.array(some, pa.large_string()), words) if some else found


def _shared_tokens(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted tokens that several sets have, and how many have each."""
    tokens = np.concatenate(sets)
    tokens.sort()
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(starts, append=len(tokens))
    several = counts > 1
    return tokens[starts[several]], counts[several]


def _places(tokens: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Where the tokens that are shared stand among these."""
    at = np.searchsorted(shared, tokens)
    at[at == len(shared)] = 0
    return at[shared[at] == tokens].astype(np.int32) if len(shared) else at[:0].astype(np.int32)


def _prefix_groups(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Groups of sets outside which no set has a similar one.

    Tokens are ordered from rare to frequent among these sets; similar sets share a token among their
    first n - ceil(n * percent / 100) + 1.  Sets that share such a token, or are chained by some, are
    a group: a frequent passage is at the end of the order and chains nothing.
    """
    shared, counts = _shared_tokens(sets)
    prefixes = []
    for tokens in sets:
        place = _places(tokens, shared)
        # The rarest, which no other set has, come first.
        left = len(place) - -(-len(tokens) * percent // 100) + 1
        prefixes.append(place[np.argsort(counts[place], kind="stable")[: max(left, 0)]])
    rows = np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
    place = np.concatenate(prefixes)
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = np.flatnonzero(place[1:] == place[:-1])
    for x, y in np.unique(np.stack([rows[same], rows[same + 1]], 1), axis=0).tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(sets))])
    order = np.argsort(roots, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)
    return [g for g in groups if len(g) > 1]


def _forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among these sets."""
    found = []
    for group in _prefix_groups(sets, percent):
        found += [(group[a], group[b]) for a, b in _compared([sets[i] for i in group], percent)]
    return found


def _compared(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The same for one group, by counting the common tokens of all its sets at once."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    several = _shared_tokens(sets)[0]
    places = [_places(s, several) for s in sets]
    rows = np.repeat(np.arange(m, dtype=np.int32), [len(p) for p in places])
    place = np.concatenate(places)
    del places
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    total = len(several)
    edges = np.searchsorted(place, np.arange(0, total + COLUMN_BLOCK, COLUMN_BLOCK))
    label, links = np.arange(m), []
    for first in range(0, m, ROW_STRIP):
        end = min(first + ROW_STRIP, m)
        # Common tokens of this strip's sets with all later ones.
        common = np.zeros((end - first, m - first), np.float32)
        for start, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            later = rows[a:b] >= first
            block = np.zeros((m - first, COLUMN_BLOCK), np.float32)
            block[rows[a:b][later] - first, place[a:b][later] - start * COLUMN_BLOCK] = 1
            common += block[: end - first] @ block.T
        for at in range(first, end):
            # The same as 100 * common >= percent * (sizes' sum - common), in whole numbers.
            shared = common[at - first, at - first + 1 :].astype(np.int64)
            near = (100 + percent) * shared >= percent * (sizes[at] + sizes[at + 1 :])
            links += _joined(label, at, at + 1 + np.flatnonzero(near))
    return links


def _joined(label: np.ndarray, at: int, others: np.ndarray) -> Links:
    """Give ``at`` and the others one label; one link to each label that was a different one."""
    others = others[label[others] != label[at]]
    if not len(others):
        return []
    names, once = np.unique(label[others], return_index=True)
    label[np.isin(label, names)] = label[at]
    return [(at, int(i)) for i in others[once]]


def text_key(text: str | Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text (null is the empty text)."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def _index(batches: Iterable[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()
    nothing = np.zeros(0, np.uint64)
    for chunk in chunks(batches, limit=HELD_BYTES):
        sets = shingle_sets(chunk.column("text"), words)
        texts = zip(chunk.column("t1").to_pylist(), chunk.column("t2").to_pylist(), strict=True)
        keys = []
        for tokens, text in zip(sets, texts, strict=True):
            keys.append(nothing if text in seen else combinations(tokens, percent))
            seen.add(text)  # a task enters a text once, so copies don't pile up in the index
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        values = np.concatenate(keys).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                chunk.column("t1"),
                chunk.column("t2"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                pa.array([parity_sketch(s, percent) for s in sets], pa.binary()),
            ],
            ["doc_id", "t1", "t2", "n_shingles", "keys", "sketch"],
        )


def _met(
    batches: Iterable[pa.RecordBatch], payload: list[str], linked: Callable[..., Links]
) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; each group holds one block, or two that meet.  ``linked`` finds the links
    of a group from the payload columns of its different texts."""
    held: dict[tuple[int, int], tuple] = {}
    group, sides = None, set()

    def links() -> pa.RecordBatch:
        keys = sorted(held)
        alone = len(keys) < 2 or group[1] != group[2] and len(sides) == 1
        found = [] if alone else linked(*zip(*[held[k] for k in keys], strict=True))
        ends = {"a": [keys[a] for a, _ in found], "b": [keys[b] for _, b in found]}
        return pa.RecordBatch.from_pydict(
            {f"{x}{i + 1}": pa.array([key[i] for key in ends[x]], pa.int64()) for x in "ab" for i in (0, 1)}
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "side", "t1", "t2", *payload)]
        for row in zip(*columns, strict=True):
            if row[:3] != group and held:
                yield links()
                held, sides = {}, set()
            group = row[:3]
            sides.add(row[3])
            held[row[4:6]] = row[6:]
    if held:
        yield links()


def _connected(
    rows: DataFrame, block: int, payload: list[str], linked: Callable[..., Links], label: str
) -> DataFrame:
    """``node`` and ``component``, both (t1, t2), of what the links connect.  ``rows`` have a component
    and its ``size``; larger ones than ``block`` are dealt into blocks, every two of which meet."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("size") / block))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("t2"), F.col("blocks")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, F.col("own")).alias("i"),
            F.greatest(k, F.col("own")).alias("j"),
            F.when(k >= F.col("own"), 0).otherwise(1).alias("side"),
        ),
    )
    met = dealt.select("component", F.explode(pairs).alias("p"), "t1", "t2", *payload)
    links = (
        met.select("component", "p.*", "t1", "t2", *payload)
        .repartition("component", "i", "j")
        .sortWithinPartitions("component", "i", "j")
        .mapInArrow(lambda batches: _met(batches, payload, linked), "a1 long, a2 long, b1 long, b2 long")
    )
    ends = [F.struct(F.col(f"{x}1").alias("t1"), F.col(f"{x}2").alias("t2")).alias(x) for x in "ab"]
    return components(links.select(*ends), label)


def _groups(docs: DataFrame, words: int, percent: int, key: str, text: str, block_docs: int) -> DataFrame:
    """Per row ``doc_id, t1, t2, n_shingles, component`` (a node, null without n-grams) and
    ``component_id`` (the least doc_id of the component)."""
    source = ids_and_text(docs, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = source.withColumns(dict(zip(("t1", "t2"), text_key("text"), strict=True)))
    index = written(
        keyed.mapInArrow(
            lambda batches: _index(batches, words, percent),
            f"doc_id {kind}, t1 long, t2 long, n_shingles long, keys array<long>, sketch binary",
        ),
        "ngrams",
    )
    nodes = index.where("n_shingles > 0").groupBy("t1", "t2").agg(F.min("doc_id").alias("least"))
    # Candidate components: every text of a combination is tied to its smallest.
    entries = index.select(F.col("t1").alias("a"), F.explode("keys").alias("key"))
    ties = entries.withColumn("b", F.min("a").over(Window.partitionBy("key"))).where("a != b")
    candidates = written(components(ties.select("a", "b"), "candidates"), "candidates")

    def members(found: DataFrame, node: str) -> DataFrame:
        """One row of each text in a component, named by its key and smallest id."""
        sized = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        of = nodes.withColumn("node", F.struct("t1", "t2") if node == "text" else F.col("t1"))
        named = of.join(found, "node").join(sized, "component")
        return named.select("component", "size", F.col("t1").alias("m1"), F.col("t2").alias("m2"), "least")

    same = [
        F.col("t1") == F.col("m1"),
        F.col("t2") == F.col("m2"),
        F.col("doc_id").eqNullSafe(F.col("least")),
    ]

    def by_sketch(sizes: tuple[int, ...], sketches: tuple[bytes, ...]) -> Links:
        return near_sketches(np.array(sizes), list(sketches), percent)

    def by_tokens(texts: tuple[str, ...]) -> Links:
        return _forest(sets_of_many(texts, words), percent)

    sketched = index.join(members(candidates, "hash"), same)
    chains = written(
        _connected(sketched, block_docs * 2, ["n_shingles", "sketch"], by_sketch, "sketches"), "chains"
    )
    linked = _connected(keyed.join(members(chains, "text"), same), block_docs, ["text"], by_tokens, "links")
    groups = nodes.withColumn("node", F.struct("t1", "t2")).join(linked, "node", "left")
    groups = groups.withColumn("component", F.coalesce("component", "node"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "component").select("t1", "t2", "component", "component_id")
    return index.select("doc_id", "t1", "t2", "n_shingles").join(named, ["t1", "t2"], "left")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    key: str = "doc_id",
    text: str = "text",
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles``, ``component_id`` and the text's key ``t1``, ``t2``.

    Documents are linked when 100 * intersection >= percent * union of their n-gram sets (A-Z in
    lower case, words between white space); ``component_id`` is the smallest doc_id that links reach.
    Null and empty texts and texts of white space have no n-grams, are linked with nothing and keep
    their own id.  Rows with a null id take part; a component of only such rows has a null id.
    Repeated rows stay and are linked with each other; other columns are ignored; an empty table
    gives none.
    """
    groups = _groups(docs, words, percent, key, text, block_docs)
    lonely = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return groups.select("doc_id", "n_shingles", lonely.alias("component_id"), "t1", "t2")


def keep_one_of_each(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents, all columns: of each component only the row with the smallest id stays (null
    ids last, ties by the text's hash); of equal rows one.  Rows without n-grams all stay."""
    groups = _groups(docs, words, percent, key, text, BLOCK_DOCS).where("n_shingles > 0")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    kept = groups.groupBy("component").agg(F.min(rank).alias("kept")).select("kept.*")
    one, two, three, turn = (free_name(docs, f"kept_{x}") for x in ("t1", "t2", "id", "turn"))
    hashes = dict(zip((one, two), text_key(text), strict=True))
    k1, k2, k3 = (free_name(docs, f"kept_k{x}") for x in (1, 2, 3))
    named = kept.select(F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("doc_id").alias(k3))
    marked = docs.withColumns({**hashes, three: F.col(key)})
    same = [
        F.col(one) == F.col(k1),
        F.col(two) == F.col(k2),
        F.col(three).eqNullSafe(F.col(k3)),
    ]
    numbered = marked.join(named, same, "left").withColumn(
        turn, F.row_number().over(Window.partitionBy(one, two, three).orderBy(F.lit(0)))
    )
    blank = ~F.coalesce(F.rlike(F.col(text), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    chosen = numbered.where(blank | (F.col(k1).isNotNull() & (F.col(turn) == 1)))
    return chosen.select(*docs.columns)
