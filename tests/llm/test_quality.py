"""Rules from trees, their lasso weights, and the compiled column."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import EDGE_ROWS
from pyspark.sql import functions as F

from ferrytrace.llm import quality
from ferrytrace.llm.queries import QUERIES


def some_rows(seed, size=600):
    """Label 1 unless the first statistic is high, or the second is low while the third is high."""
    rng = np.random.default_rng(seed)
    values = rng.random((size, 5))
    return values, 1.0 - ((values[:, 0] > 0.8) | ((values[:, 1] < 0.4) & (values[:, 2] > 0.6)))


def test_rules_find_the_conjunctions():
    model = quality.fit(list("abcde"), *some_rows(1))
    values, labels = some_rows(2)
    assert ((model(values) >= 0.5) == labels).mean() > 0.95
    assert 2 <= len(model.rules) < 200 and str(model).count(" if ") == len(model.rules)


def test_lasso_is_at_its_minimum():
    """Optimality: the gradient equals the strength where a weight is not zero, and is below elsewhere."""
    rng = np.random.default_rng(3)
    x = np.column_stack([(rng.random((300, 20)) < 0.4).astype(float), np.ones(300)])
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1] + 0.3)))).astype(float)
    weight = quality.lasso_logistic(x, y, np.ones(300), 0.02, np.zeros(21), steps=5000)
    gradient = x.T @ (1 / (1 + np.exp(-x @ weight)) - y) / len(y)
    used = weight[:-1] != 0
    assert 2 <= used.sum() < 20 and abs(gradient[-1]) < 1e-5
    assert np.allclose(gradient[:-1][used], -0.02 * np.sign(weight[:-1][used]), atol=1e-5)
    assert (np.abs(gradient[:-1][~used]) <= 0.02 + 1e-5).all()


def test_simplified_rule_holds_for_the_same_rows():
    values, _ = some_rows(4)
    rule = ((0, True, 0.2), (1, False, 0.9), (0, True, 0.5), (0, False, 0.8), (1, False, 0.4))
    short = quality.simplified(rule)
    assert len(short) == 3 and (quality._holds(values, rule) == quality._holds(values, short)).all()


@pytest.mark.parametrize("labels", [[], [1, 1, 1], [0, 0]])
def test_without_both_labels_there_are_no_rules(labels):
    model = quality.fit(["a"], np.zeros((len(labels), 1)), np.array(labels, float))
    assert model.rules == [] and abs(model(np.zeros((1, 1)))[0] - (np.mean(labels) if labels else 0.5)) < 0.01


def test_column_equals_the_model(spark, edge):
    """The compiled column gives what numpy gives for the same statistics, on awkward rows as well."""
    long = "x" * 400_000 + " " + "word " * 50_000 + "!" * 100_000
    rows = [*[r[:2] for r in EDGE_ROWS], (20, long), (21, "AGAIN!! AGAIN!! | a | b $$$ ###\n\n" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.statistics(F.col("text"))
    values = np.array([r[1:] for r in docs.select("doc_id", *found.values()).collect()], float)
    assert not np.isnan(values).any()
    cuts = [0.1 * x for x in range(60)]
    rules = [(((i, True, c), (0, False, 9.0)), 0.1 * i - 0.5 + c) for i in range(len(found)) for c in cuts]
    model = quality.RuleModel(list(found), -0.2, rules)
    got = [r["score"] for r in quality.score_texts(docs, model).collect()]
    assert np.allclose(got, model(values), atol=1e-12)


def test_statistics_of_a_text(spark):
    rows = [("a a b | c!\nAB 1é",)]
    found = quality.statistics(F.col("text"))
    got = spark.createDataFrame(rows, "text string").select(*[c.alias(n) for n, c in found.items()]).first().asDict()
    size = 16
    want = {"letters": 7, "upper": 2, "digits": 1, "space": 6, "symbols": 0, "bars": 1, "calls": 1, "stops": 0, "other": 0, "repeated": 1}
    assert {n: round(got[n] * size) for n in want} == want
    assert got["distinct_words"] == 6 / 7 and got["distinct_lines"] == 1 and got["word_length"] == size / 7


def test_edge_rows(spark, edge, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, 0), (9, None), (None, 1), (99, 1), (7, 0)], "doc_id long, quality int")
    model = quality.learn(edge, labels)
    got = quality.score_texts(edge, model).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(repr(r[0]) for r in EDGE_ROWS)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_texts(nothing, quality.learn(nothing, labels.limit(0))).collect() == []


def test_query_held_out(spark):
    data = Path("/root/testdata/sf0.1")
    if not data.exists():
        pytest.skip("test tables not present")
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{data}/labels.parquet'").fetchall())
    got = QUERIES["op13_quality"](spark, str(data)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in label]
    low = [r["predicted"] for r in held if label[r["doc_id"]] == 0]
    right = sum(r["predicted"] == label[r["doc_id"]] for r in held)
    print(f"held out {len(held)}, right {right}, low {len(low)}, of them found {len(low) - sum(low)}")
    assert right > 0.97 * len(held) and sum(low) < 0.1 * len(low)
