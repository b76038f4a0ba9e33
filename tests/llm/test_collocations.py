"""Count automata, and the phrases found with them against a plain version."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import collocations as plain_phrases
from brute import count_phrases
from conftest import EDGE_ROWS

from ferrytrace.llm import collocations
from ferrytrace.llm.automata import CountAutomaton
from ferrytrace.llm.queries import ORACLES, QUERIES


def counted(seed, depth, size=400, values=30):
    """{sequence: count}, and the same as a matrix and counts."""
    rng = random.Random(seed)
    of = {tuple(rng.randrange(values) << 58 for _ in range(depth)): rng.randint(1, 1 << 60) for _ in range(size)}
    return of, *matrix(of, depth)


def matrix(of, depth):
    return np.array(list(of), np.uint64).reshape(len(of), depth).T, np.array(list(of.values()), np.int64)


def listed(automaton):
    return list(zip(zip(*automaton.sequences().tolist(), strict=True), automaton.counts.tolist(), strict=True))


@pytest.mark.parametrize("depth", [1, 2, 5])
@pytest.mark.parametrize("size", [0, 1, 2, 400])
def test_automaton_returns_what_it_was_built_from(depth, size):
    of, columns, counts = counted(depth, depth, size)
    made = CountAutomaton.of(columns, counts)
    assert listed(made) == sorted(of.items())
    assert listed(CountAutomaton.from_bytes(made.to_bytes())) == listed(made)


def test_automaton_is_minimal():
    """States with the same continuations are one state: start, middle and end are left, five transitions."""
    of = {(a, b): a * b for a in (10, 20, 30) for b in (1, 2)}
    made = CountAutomaton.of(*matrix(of, 2))
    assert [len(f) - 1 for f in made.first] == [1, 1] and [len(x) for x in made.labels] == [3, 2]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_composition_looks_up_what_is_asked(depth):
    known, asked = counted(2, depth), counted(3, depth)
    found = CountAutomaton.of(*known[1:]).compose(CountAutomaton.of(*asked[1:]))
    assert listed(found) == sorted((s, known[0][s]) for s in asked[0] if s in known[0])
    nothing = CountAutomaton.of(*counted(4, depth, 0)[1:])
    assert listed(nothing.compose(CountAutomaton.of(*asked[1:]))) == []
    assert listed(CountAutomaton.of(*known[1:]).compose(nothing)) == []


def test_words_are_packed_whole():
    words = [b"", b"a", b"line\nbreak", "é".encode(), b"z" * 300]
    assert collocations.unpack_words(collocations.pack_words(words)) == words
    assert collocations.unpack_words(collocations.pack_words([])) == []


def test_hashes_are_packed_whole():
    rng = np.random.default_rng(6)
    hashes = np.unique(rng.integers(0, 1 << 40, 999, np.uint64))
    counts = rng.integers(1, 1 << 50, len(hashes))
    for size in (0, 1, len(hashes)):
        got = collocations.unpack_hashes(collocations.pack_hashes(hashes[:size], counts[:size]))
        assert got[0].tolist() == hashes[:size].tolist() and got[1].tolist() == counts[:size].tolist()


@pytest.mark.parametrize("least", [1, 40, 300])
def test_sieves_pass_all_that_is_frequent(spark, least):
    rows = some_texts(7) + [("ab cd ef " * 400, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    tables = ()
    counts, _ = count_phrases(rows)
    for size in (1, 2, 3, 4):
        table = collocations.sieve(docs, 3, least, *tables)
        tables += (table,)
        labels = [(lang, *p) for lang, of in counts.items() for p in of if len(p) == size]
        often = np.array([counts[s[0]][s[1:]] >= least for s in labels])
        passed = table.may_hold([collocations.word_hashes([x.encode() for x in c]) for c in zip(*labels, strict=True)])
        assert passed[often].all() and passed.sum() <= often.sum() + 1


def some_texts(seed, count=300):
    rng = random.Random(seed)
    words = ["Of", "the", "new", "York", "city", "ünï", "a", "b"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c"]
    langs = ["en", "de", None, "und", "two\nlines", ""]
    return [
        ("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40))), rng.choice(langs))
        for _ in range(count)
    ] + [("New york City of " * 3000, "en"), (None, "en"), ("", None)]


@pytest.mark.parametrize("seed, least, top", [(1, 30, 2000), (2, 3, 50), (3, 1, 10_000)])
def test_phrases_equal_the_plain_version(spark, seed, least, top):
    rows = some_texts(seed)
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "text string, lang string, words string, COUNT string")
    got = collocations.mine_phrases(docs.repartition(5), least=least, top=top).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, least, top)


def as_batches(rows):
    table = pa.table({"lang": [r[1] for r in rows], "text": [r[0] for r in rows]}, pa.schema([("lang", pa.string()), ("text", pa.string())]))
    return table.to_batches(max_chunksize=7)


def test_small_shards(spark, monkeypatch):
    """Shards whose automata are taken again and again, and chunks of a few rows, count the same."""
    rows = some_texts(4)
    all_pass = collocations.BitTable(np.full(1 << (collocations.TABLE_BITS - 3), 255, np.uint8))
    want, got = {}, {}
    add_up(want, collocations.SpelledShard(1, (all_pass,) * 4).rows_of(as_batches(rows)))
    monkeypatch.setattr(collocations, "SHARD_NUMBERS", 400)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    parts = list(collocations.SpelledShard(3, (all_pass,) * 4).rows_of(as_batches(rows)))
    add_up(got, parts)
    assert got == want and len(parts) > 100


def add_up(total, batches):
    for batch in batches:
        row = batch.to_pylist()[0]
        if row["depth"]:
            for sequence, count in listed(CountAutomaton.from_bytes(row["packed"])):
                total[sequence] = total.get(sequence, 0) + count


def test_edge_rows(spark, edge, nothing):
    got = collocations.mine_phrases(edge, least=2).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases([(r[1], r[2]) for r in EDGE_ROWS], 2, 2000)
    assert collocations.mine_phrases(nothing).collect() == []


def test_query_equals_sql(spark):
    """The registered query and its SQL, and the plain version, on the same table."""
    data = Path("/root/testdata/sf0.01")
    if not data.exists():
        pytest.skip("test tables not present")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = QUERIES["op11_collocations"](spark, str(data))
    want = duck.sql(ORACLES["op11_collocations"])
    assert got.columns == want.columns
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(want.fetchall())
    assert rows == plain_phrases(duck.sql("SELECT text, lang FROM documents").fetchall(), 30, 2000)
