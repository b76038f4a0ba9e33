"""What the Python steps of the pipeline hold, beside the rows they are given."""

import tracemalloc
from collections.abc import Callable

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from ferrytrace.llm import langid, ngram_join, words
from ferrytrace.session import bound_batches

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def held(make: Callable):
    """The result, the most bytes held while it was made, and those held after it."""
    tracemalloc.start()
    try:
        result = make()
        now, most = tracemalloc.get_traced_memory()
        return result, most, now
    finally:
        tracemalloc.stop()


@pytest.fixture
def batch_setting(spark):
    before = spark.conf.get(BATCH)
    yield
    spark.conf.set(BATCH, before)


@pytest.mark.parametrize(
    ("set_to", "expected"),
    [("67108864b", 8 << 20), ("1g", 8 << 20), ("2m", 2 << 20), ("4096", 4096), ("5MB", 5 << 20)],
)
def test_batches_are_bounded_and_never_raised(spark, batch_setting, set_to, expected):
    spark.conf.set(BATCH, set_to)
    assert bound_batches(spark) == expected
    if expected < 8 << 20:
        assert spark.conf.get(BATCH) == set_to


@pytest.mark.parametrize("stage", [0, 1, 2, 4])
def test_stages_get_bounded_batches(spark, batch_setting, stage, tmp_path):
    spark.conf.set(BATCH, "64m")
    docs = spark.createDataFrame([(1, "some words here", "en")], "doc_id long, text string, lang string")
    spark.createDataFrame([("i", "an item")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    long = spark.range(0, 30, 1, 1).selectExpr("repeat('x', 1 << 20) AS text")
    assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) <= 9


def test_range_hashes_hold_one_sum():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5 * words.HASH_STEP + 17, np.uint8)
    starts = np.sort(rng.integers(0, len(data), 500))
    ends = np.minimum(starts + rng.integers(0, 3 * words.HASH_STEP, 500), len(data))
    for which, fold in ((0, False), (0, True), (1, False)):
        hashed = words.RangeHash(data, which, fold)
        values = words.byte_values(which, fold)[data] * words.powers(words._BASES[which], len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values)])
        back = words.powers(hashed.inverse, len(sums))
        assert (hashed(starts, ends) == words.mixed((sums[ends] - sums[starts]) * back[starts])).all()
    assert len(words.RangeHash(data[:0])(np.zeros(1, int), np.zeros(1, int))) == 1
    data = np.zeros(4 << 20, np.uint8)
    _, most, after = held(lambda: words.RangeHash(data)(np.arange(10), np.arange(10) + 5))
    assert most < 10 * len(data)
    assert after < len(data)


def test_languages_hold_bytes_of_windows_only(monkeypatch):
    net = langid.Network.new(["a", "b"], 4, np.random.default_rng(1))
    monkeypatch.setattr(net, "probabilities", lambda rows: np.full((rows.shape[1], len(rows), 2), 0.5, np.float32))
    data = np.full(4 << 20, 97, np.uint8)
    offsets = np.arange(0, len(data) + 1, 1 << 12)
    found, most, _ = held(lambda: langid.document_probabilities(net, data, offsets))
    assert np.allclose(found, 0.5)
    assert most < 6 * len(data)


def test_sets_of_many_texts_hold_a_part_at_a_time():
    texts = [f"{i} {i + 1} " + "word " * 3000 for i in range(400)] + [None, "", "two words"]
    plain = ngram_join.shingle_sets(pa.array(texts, pa.large_string()), 5)
    found, most, _ = held(lambda: ngram_join.sets_of_many(texts, 5))
    assert len(found) == len(plain) and all((a == b).all() for a, b in zip(found, plain, strict=True))
    assert most < 4 * sum(len(t or "") for t in texts)
    assert ngram_join.sets_of_many([], 5) == []


def test_groups_hold_little_more_than_their_sets():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    sets = [np.unique(np.append(common[rng.random(2000) < 0.995], rng.integers(0, 1 << 63, 8000).astype(np.uint64))) for _ in range(100)]
    sets += [np.sort(s[rng.random(len(s)) < 0.97]) for s in sets[:20]]
    size = sum(s.nbytes for s in sets)
    links, most, _ = held(lambda: ngram_join._forest(sets, 80))
    assert sorted((min(a, b), max(a, b)) for a, b in links) == [(i, 100 + i) for i in range(20)]
    assert most < 3.5 * size
