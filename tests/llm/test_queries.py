"""The registered queries on the small tables against plain versions and held-out labels."""

import zlib
from pathlib import Path

import duckdb
import pytest
from brute import components, contamination, repeats, secrets, sha, versions

import __spark_entry__ as entry_point
import corpus_pipeline
from ferrytrace.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()


def rows(spark, name, data=DATA):
    return QUERIES[name](spark, str(data)).collect()


def test_registered():
    assert set(QUERIES) < set(entry_point.queries()) and "pipeline" in entry_point.queries()
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, len(numbers) + 1))


def test_op1(spark, docs):
    got = [(r[0], r[1], r[2], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows(spark, "op1_fingerprints")]
    assert sorted(got) == sorted(versions(docs))


def test_op2(spark):
    data = DATA.parent / "sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{data}/documents.parquet'").fetchall())
    got = rows(spark, "op2_langid", data)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.93 * len(held)


def test_op3(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = [(k, n, h, len(i), sha(",".join(i)), h > 0) for k, n, h, i in contamination(docs, items)]
    assert sorted(tuple(r)[:6] for r in rows(spark, "op3_decontaminate")) == sorted(want)


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_pii")}
    assert got.keys() == dict(docs).keys() and any(r["n_replaced"] for r in got.values())
    assert all((got[k]["text"] == t) == (got[k]["n_replaced"] == 0) for k, t in docs)


def test_op5(spark, docs):
    assert sorted(list(r)[:5] for r in rows(spark, "op5_secrets")) == sorted([k, *secrets(t)] for k, t in docs)


def test_op6(spark, docs):
    found = repeats([t for _, t in docs], 400)
    want = [(k, n, g, s, sha(kept)) for (k, _), (n, g, s, kept) in zip(docs, found, strict=True)]
    got = rows(spark, "op6_repeats")
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    texts = {k: kept.decode(errors="replace") for (k, _), (*_, kept) in zip(docs, found, strict=True)}
    assert {r["doc_id"]: r["text"] for r in got} == texts


def test_op7(spark, docs):
    texts = dict(docs)
    got = rows(spark, "op7_bpe")
    assert len(got) == len(docs) and all(r["decoded_sha256"] == sha(texts[r["doc_id"]]) for r in got)


def test_op8(spark):
    """In these tables about 70 toxic texts in each rarer language are all there is to learn from."""
    data = DATA.parent / "sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    got = rows(spark, "op8_toxicity", data)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) > 0.92 * len(held)


def test_op8_accuracy(spark):
    """The accuracy, and how many of the toxic rows are found: most rows are not toxic."""
    data = DATA.parent / "sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{data}/labels.parquet'").fetchall())
    held = [r for r in rows(spark, "op8_toxicity", data) if r["held_out"] and r["doc_id"] in toxic]
    found = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held)
    print(f"held out {len(held)}, right {right}, toxic {len(found)}, of them found {sum(found)}")
    assert right > 0.95 * len(held) and sum(found) > 0.6 * len(found)


def test_op9(spark):
    got = rows(spark, "op9_chat")
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{DATA}/conversations.parquet'").fetchall()[0][0]


def test_op10(spark, docs):
    assert sorted(tuple(r) for r in rows(spark, "op10_ngram_join")) == sorted(components(docs, 3, 90))


def test_pipeline(spark, docs):
    """The stages that plain code can follow: what is kept, and that tokens decode."""
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(DATA)).collect()}
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    first = {k for k, _, c in components(docs, 5, 80) if k == c}
    clean = {k for k, _, hit, _ in contamination(docs, items) if not hit}
    assert got.keys() == first & clean
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and sha(bytes(r["ids"])) == r["ids_sha256"] for r in got.values())
