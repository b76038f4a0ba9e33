"""Document fingerprints as invertible Bloom lookup sketches over paragraphs.

A text's paragraphs (its lines, cut further at the ends of sentences) are hashed; every digest goes
into one cell of each of three sub-tables, where counts, digests and check values add up.  Subtracting
two sketches of one size leaves only what differs: a cell with a single digest gives it away, taking
that digest out of its other cells opens more of them, and so on ("peeling").  When cells stay closed,
both texts are sketched anew, larger and with other hash functions, until none stay.

DataFrame functions only.  All cells of a document are in one task, so the rounds of peeling need no
shuffle: they are sums by document and cell, which shrink from round to round.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrytrace.llm.common import ids_and_text
from ferrytrace.session import written

# Where a text is cut: at line breaks, at white space after a mark that is not a comma, and where 256
# characters have gone by since the last cut.
PARAGRAPH = r"\n+|\s(?<=[^\p{L}\p{N}\s,]\s)\s*|(?<=\G[\s\S]{256})"
TABLES = 3
# Cells in each sub-table of the smallest sketch, and the seed of the printed one.
LEAST_CELLS = 64
# Cells in each sub-table for one digest: a text opens against one of several times its size.
ROOM = 4
PRINTED_SEED = 1
# Sub-tables in the order in which a round opens them.
SWEEPS = (0, 1, 2, 0)
# Documents in a block of neighbouring ids; cut points only balance the blocks.  Blocks are small, so
# that the cells of a task's documents fit in memory; beyond MOST_CUTS they grow, and sums spill.
BLOCK_ROWS = 300
MOST_CUTS = 20_000


def paragraph_digests(text: Column) -> Column:
    """The distinct paragraph digests of a text; null and blank texts have none."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def shared_start(first: Column, second: Column) -> Column:
    """How many digests two arrays have alike from their beginnings."""
    differs = F.transform(first, lambda d, i: ~d.eqNullSafe(F.get(second, i)))
    return F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.size(first)).cast("int")


def _place(digest: Column, table: int | Column, cells: Column | int, seed: int) -> Column:
    table = F.lit(table) if isinstance(table, int) else table
    cells = F.lit(cells).cast("long") if isinstance(cells, int) else cells
    return F.pmod(F.xxhash64(digest, table, F.lit(seed)), cells)


def _check(digest: Column, seed: int) -> Column:
    return F.xxhash64(digest, F.lit("check"), F.lit(seed))


def sketch_cells(digests: Column) -> Column:
    """Cells in each sub-table of a text's sketch: a power of two, at least ROOM for each digest, so that
    the larger of two sketches folds to the size of the smaller one (place modulo size)."""
    doublings = F.ceil(F.log2(F.greatest(F.size(digests) * ROOM, F.lit(LEAST_CELLS)))).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), doublings)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def printed(digests: Column) -> Column:
    """The text's sketch: the cells of a sub-table, then of every cell that is not empty its number
    (sub-table x size + place), count, digest sum and check sum, all in hexadecimal."""

    def placed(cells: Column) -> Column:
        def entry(t: int):
            return lambda d: F.struct((cells * t + _place(d, t, cells, PRINTED_SEED)).alias("at"), d.alias("d"))

        tables = [F.transform(digests, entry(t)) for t in range(TABLES)]
        return F.sort_array(F.concat(*tables))

    def written_cells(entries: Column) -> Column:
        begins = F.filter(
            F.transform(entries, lambda e, i: F.when((i > 0) & (F.get(entries, i - 1)["at"] == e["at"]), -1).otherwise(i)),
            lambda i: i >= 0,
        )

        def alone(e: Column) -> Column:
            return F.concat_ws(":", F.hex(e["at"]), F.lit("1"), F.hex(e["d"]), F.hex(_check(e["d"], PRINTED_SEED)))

        def cell(inside: Column) -> Column:
            total = F.aggregate(inside, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e["d"]))
            checks = F.aggregate(inside, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(_check(e["d"], PRINTED_SEED)))
            return F.concat_ws(":", F.hex(F.get(inside, F.lit(0))["at"]), F.hex(F.size(inside)), F.hex(total), F.hex(checks))

        def joined(starts: Column) -> Column:
            ends = lambda k: F.coalesce(F.get(starts, k + 1), F.size(entries))
            several = lambda i, k: _let(F.slice(entries, i + 1, ends(k) - i), cell)
            return F.transform(
                starts,
                lambda i, k: F.when(ends(k) - i == 1, _let(F.get(entries, i), alone)).otherwise(several(i, k)),
            )

        return _let(begins, joined)

    def whole(cells: Column) -> Column:
        return F.array_join(F.concat(F.array(F.hex(cells)), _let(placed(cells), written_cells)), " ")

    return _let(sketch_cells(digests), whole)


def _cell(table: int, place: Column, n: Column, digest: Column, check: Column) -> Column:
    return F.struct(
        F.lit(table).alias("table"), place.cast("long").alias("place"), n.cast("long").alias("n"),
        digest.alias("digest"), check.alias("check"),
    )


# Table numbers of recovered digests: only in the first text, only in the second.
ONLY_FIRST, ONLY_SECOND = TABLES, TABLES + 1


def peel(
    pairs: DataFrame,
    keys: list[str],
    seed: int = PRINTED_SEED,
    growth: int = 1,
    list_digests: bool = False,
    as_printed: bool = False,
) -> DataFrame:
    """Subtract and peel.  ``pairs`` has ``keys`` and arrays ``first`` and ``second`` of digests.
    ``as_printed`` takes the printed sketches, the larger one folded, instead of one sized by both.

    Returns per key ``only_first`` and ``only_second`` (how many digests each text has alone),
    ``closed`` (cells that stayed closed: a failure unless 0) and, if asked for, the digests.
    Pairs without any difference do not appear.
    """
    if as_printed:
        cells = F.least(sketch_cells(F.col("first")), sketch_cells(F.col("second")))
    else:
        cells = sketch_cells(F.concat("first", "second"))
    signed = F.concat(
        F.transform("first", lambda d: F.struct(d.alias("digest"), F.lit(1).alias("n"))),
        F.transform("second", lambda d: F.struct(d.alias("digest"), F.lit(-1).alias("n"))),
    )
    rows = pairs.select(*keys, (cells * growth).alias("cells"), F.explode(signed).alias("s"))
    digest, n = F.col("s.digest"), F.col("s.n")
    entered = F.array(
        *[_cell(t, _place(digest, t, F.col("cells"), seed), n, digest, _check(digest, seed)) for t in range(TABLES)]
    )
    state = _summed(rows.select(*keys, "cells", F.explode(entered).alias("c")), keys)
    for table in SWEEPS:
        n, digest, check = F.col("n"), F.col("digest"), F.col("check")
        single = (F.col("table") == table) & (F.abs(n) == 1) & (check == _check(digest, seed))
        found_place = digest if list_digests else F.lit(0)
        nothing = F.lit(0).cast("long")

        def found(number: int, place: Column = found_place, nothing: Column = nothing) -> Column:
            return _cell(number, place, F.lit(1), nothing, nothing)

        recovered = F.when(n > 0, found(ONLY_FIRST)).otherwise(found(ONLY_SECOND))
        taken = [
            _cell(t, _place(digest, t, F.col("cells"), seed), -n, digest, check)
            for t in range(TABLES)
            if t != table
        ]
        itself = F.struct("table", "place", "n", "digest", "check")
        moved = state.select(
            *keys,
            "cells",
            F.explode(F.when(single, F.array(recovered, *taken)).otherwise(F.array(itself))).alias("c"),
        )
        state = _summed(moved, keys)

    def count(table: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("table") == table, F.col("n"))), F.lit(0).cast("long"))

    results = [
        count(ONLY_FIRST).alias("only_first"),
        count(ONLY_SECOND).alias("only_second"),
        F.sum(F.when(F.col("table") < TABLES, 1).otherwise(0)).alias("closed"),
    ]
    if list_digests:
        for table, name in ((ONLY_FIRST, "first_digests"), (ONLY_SECOND, "second_digests")):
            results.append(F.collect_list(F.when(F.col("table") == table, F.col("place"))).alias(name))
    return state.groupBy(*keys).agg(*results)


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that hold the same place added up; empty ones go."""
    flat = cells.select(*keys, "cells", "c.*")
    added = flat.groupBy(*keys, "cells", "table", "place").agg(
        F.sum("n").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check")
    )
    return added.where("table >= 3 OR n <> 0 OR digest <> 0")


def likeness(first: Column, second: Column, differing: Column) -> Column:
    """Shared digests over all digests of two sets; two empty sets are alike."""
    total = first + second
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differing) / (total + differing))


def _as_number(docs: DataFrame) -> Column:
    """A number that never falls as the id grows: of text ids, their first six bytes."""
    ident = F.col("doc_id")
    if not isinstance(docs.schema["doc_id"].dataType, T.StringType):
        return ident.cast("double")
    lead = F.rpad(F.hex(F.substring(F.encode(ident, "UTF-8"), 1, 6)), 12, "0")
    return F.conv(lead, 16, 10).cast("double")


def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Add ``block``, a number that never falls along descending ids (nulls last); and their number."""
    rows = docs.count()
    parts = max(1, min(math.ceil(rows / BLOCK_ROWS), MOST_CUTS))
    cuts = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = docs.agg(F.percentile_approx(_as_number(docs), shares, 4 * parts)).first()[0]
        cuts = sorted(set(found or []))
    if not cuts:
        return docs.withColumn("block", F.lit(0).cast("long")), 1
    splits = [-math.inf, *cuts, math.inf]
    placed = docs.withColumn("place", F.coalesce(_as_number(docs), F.lit(-math.inf)))
    placed = Bucketizer(splits=splits, inputCol="place", outputCol="bucket").transform(placed)
    last = F.lit(len(splits) - 2).cast("long")
    return placed.withColumn("block", last - F.col("bucket").cast("long")).drop("place", "bucket"), len(splits) - 1


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with ``block``, ``row`` (a unique number), ``digests``, and ``next_text``,
    ``next_digests``: of the next row in descending order of doc_id (nulls last, ties by the text's
    hash), in a ring.

    Rows are dealt into blocks of neighbouring ids.  The first row of each block also goes to the end
    of the block before, so one shuffle is enough.  Only texts move; they are cut where they arrive.
    """
    tied = docs.withColumn("tie", F.bitwise_not(F.xxhash64("text")))
    blocked, count = _blocks(tied)
    heads = blocked.groupBy("block").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    # One row per block, at most MOST_CUTS + 1.
    ring = Window.partitionBy(F.lit(0)).orderBy("block")
    around = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc())
    heads = heads.select(
        F.col("block").alias("b"),
        "head",
        F.coalesce(F.lag("block").over(ring), F.first("block").over(around)).alias("before"),
    )
    is_head = [
        F.col("block") == F.col("b"),
        F.col("doc_id").eqNullSafe(F.col("head.doc_id")),
        F.col("tie") == F.col("head.tie"),
    ]
    marked = blocked.join(F.broadcast(heads), is_head, "left")
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("copy"))
    copied = F.struct(F.col("before").alias("block"), F.lit(1).alias("copy"))
    twice = F.when(F.col("before").isNotNull(), F.array(own, copied)).otherwise(F.array(own))
    dealt = marked.select("doc_id", "text", "tie", F.explode(twice).alias("p"))
    dealt = dealt.select("doc_id", "text", "tie", "p.*").repartition(2 * count, "block")
    dealt = dealt.withColumn("digests", paragraph_digests(F.col("text")))
    order = Window.partitionBy("block").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    ringed = dealt.select(
        "block",
        (F.shiftleft(F.col("block"), 40) + F.row_number().over(order)).alias("row"),
        "copy",
        "doc_id",
        "text",
        "digests",
        F.lead("text").over(order).alias("next_text"),
        F.lead("digests").over(order).alias("next_digests"),
    )
    return ringed.where("copy = 0").drop("copy")


def compare_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of the edited text, and the likeness to it and to the next
    document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, edited_changes, next_changes`` (how many digests differ).

    The fingerprint is the sketch that is compared: near_* come from subtracting two of them, and only
    pairs that do not peel are sketched anew.  The edited text has its last third replaced by the start of the next document's text.  Null texts
    are empty; null ids come last; rows with equal ids follow each other by a hash of the text;
    repeated rows stay; the only row is its own next; an empty table gives none; other columns are
    ignored.
    """
    source = ids_and_text(docs, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    lined = with_next(source)
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - third), F.substr("next_text", F.lit(1), third))
    versions = lined.withColumn("edited", edited).select(
        "block",
        "row",
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "digests",
        paragraph_digests(F.col("edited")).alias("edited_digests"),
        "next_digests",
    )
    both = F.array(
        F.struct(F.lit(0).alias("pair"), F.col("edited_digests").alias("second")),
        F.struct(F.lit(1).alias("pair"), F.col("next_digests").alias("second")),
    )
    # A block's rows are together already, so peeling by block and row needs no shuffle.
    pairs = versions.select("block", "row", F.col("digests").alias("first"), F.explode(both).alias("p"))
    peeled = peel(pairs.select("block", "row", "p.pair", "first", "p.second"), ["block", "row", "pair"], as_printed=True)

    def of(pair: int, value: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("pair") == pair, value)), F.lit(0).cast("long"))

    apart = F.when(F.col("closed") > 0, -1).otherwise(F.col("only_first") + F.col("only_second"))
    changes = peeled.groupBy("block", "row").agg(
        of(0, apart).alias("edited_changes"), of(1, apart).alias("next_changes")
    )
    # Sums of a block are where its rows are, so rows and sums meet by grouping, without a shuffle.
    payload = F.struct(
        "doc_id", "n_chars", "edited_sha256", "digests", "edited_digests", "next_digests"
    ).alias("version")
    known = versions.select("block", "row", payload)
    met = known.unionByName(changes, allowMissingColumns=True).groupBy("block", "row").agg(
        F.first("version", ignorenulls=True).alias("version"),
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in ("edited_changes", "next_changes")],
    )
    first = met.select("row", "version.*", "edited_changes", "next_changes")
    first = first.withColumn("shared", shared_start(F.col("digests"), F.col("edited_digests")))
    failed = (F.col("edited_changes") < 0) | (F.col("next_changes") < 0)
    sizes = {f"n_{c}": F.size(c).cast("long") for c in ("digests", "edited_digests", "next_digests")}
    done = first.select(
        "row",
        "doc_id",
        "n_chars",
        "edited_sha256",
        "edited_changes",
        "next_changes",
        *[v.alias(k) for k, v in sizes.items()],
        "digests",
        # Both texts begin alike: what they share is kept once.
        "shared",
        _after(F.col("edited_digests"), F.col("shared")).alias("edited_rest"),
        F.when(failed, F.col("next_digests")).alias("next_digests"),
    )
    done = _retry(written(done, "fingerprints"))
    edited_digests = _joined(F.col("digests"), F.col("shared"), F.col("edited_rest"))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("digests")).alias("fingerprint"),
        printed(edited_digests).alias("edited_fingerprint"),
        likeness(F.col("n_digests"), F.col("n_edited_digests"), F.col("edited_changes")).alias("near_edited"),
        likeness(F.col("n_digests"), F.col("n_next_digests"), F.col("next_changes")).alias("near_next"),
        "edited_changes",
        "next_changes",
    )


def _after(digests: Column, shared: Column) -> Column:
    return F.slice(digests, shared + 1, F.size(digests) - shared)


def _joined(first: Column, shared: Column, rest: Column) -> Column:
    """The array that begins like ``first`` and goes on with ``rest``."""
    return F.concat(F.slice(first, F.lit(1), shared), rest)


def _retry(done: DataFrame) -> DataFrame:
    """Peel what stayed closed again, each time twice as large and with other hash functions."""
    closed = done.where("edited_changes < 0 OR next_changes < 0")
    left = closed.select(
        "row",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("pair"), F.col("edited_changes").alias("d"), "shared", F.col("edited_rest").alias("rest")),
                F.struct(F.lit(1).alias("pair"), F.col("next_changes").alias("d"), F.lit(0).alias("shared"), F.col("next_digests").alias("rest")),
            )
        ).alias("p"),
        F.col("digests").alias("first"),
    ).where("p.d < 0").select("row", "p.pair", "first", "p.shared", "p.rest")
    fixed, turn = None, 1
    while count := left.count():
        turn += 1
        # The digests move, not the cells they make.
        left = left.repartition(math.ceil(count / BLOCK_ROWS), "row", "pair")
        pairs = left.withColumn("second", _joined(F.col("first"), F.col("shared"), F.col("rest")))
        opened = written(peel(pairs, ["row", "pair"], seed=turn, growth=2 ** (turn - 1)), "peeled")
        good = opened.where("closed = 0").select("row", "pair", (F.col("only_first") + F.col("only_second")).alias("d"))
        fixed = good if fixed is None else fixed.unionByName(good)
        again = opened.where("closed > 0").select("row", "pair")
        if again.isEmpty():
            break
        left = written(left.join(again, ["row", "pair"], "left_semi"), "closed")
    if fixed is None:
        return done
    repaired = fixed.groupBy("row").agg(
        F.max(F.when(F.col("pair") == 0, F.col("d"))).alias("d0"), F.max(F.when(F.col("pair") == 1, F.col("d"))).alias("d1")
    )
    # Only the rows that were peeled again meet their results.
    mended = closed.join(repaired, "row", "left").withColumns(
        {
            "edited_changes": F.when(F.col("edited_changes") < 0, F.col("d0")).otherwise(F.col("edited_changes")),
            "next_changes": F.when(F.col("next_changes") < 0, F.col("d1")).otherwise(F.col("next_changes")),
        }
    )
    return done.where("edited_changes >= 0 AND next_changes >= 0").unionByName(mended.drop("d0", "d1"))
