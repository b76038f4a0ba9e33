"""Token alignment against a version that walks token by token."""

import random
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from brute import alignment as plain_alignment
from brute import sha
from conftest import EDGE_ROWS

from ferrytrace.llm import alignment
from ferrytrace.llm.queries import QUERIES
from ferrytrace.session import written

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def aligned(docs):
    return [tuple(r[f] for f in FIELDS) for r in alignment.with_counts(written(alignment.align_texts(docs, *PATHS), "a")).collect()]


def plain(rows):
    return sorted(rows, key=repr)


def test_edge_rows(spark, edge, nothing):
    rows = [r[:2] for r in EDGE_ROWS]
    assert plain(aligned(edge)) == plain(plain_alignment(rows, *PATHS))
    assert aligned(nothing) == []


@pytest.mark.parametrize("block, many", [(1 << 20, 4096), (50, 1)])
def test_random_texts(spark, monkeypatch, block, many):
    """Repeated letters make large groups; spaces, special strings and rare letters leave some unaligned."""
    monkeypatch.setattr(alignment, "BLOCK_PLACES", block)
    monkeypatch.setattr(alignment, "MANY_LINKS", many)
    rng = random.Random(block)
    parts = ["the", " ", "  ", "<|endoftext|>", "<s>", "<0x41>", "▁", "é", "中文", "😀", "aaaaaaa", "ing", "\n", "\t", "7", "don't", "ﬁ"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(120)]
    rows += [(500 + i, " ".join(rng.choices(["the", "unhappiness", "tokenize", "re", "x1"], k=30))) for i in range(40)]
    rows += [(900, "ab" * 700 + "a" * 3000), (900, "ab" * 700 + "a" * 3000), (901, "zz" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    assert plain(aligned(docs)) == plain(plain_alignment(rows, *PATHS))


def test_compiled_encoder_equals_the_library():
    from tokenizers import Tokenizer

    known, library, rng = alignment.Tokenizers(*PATHS), Tokenizer.from_file(PATHS[0]), random.Random(11)
    library.encode_special_tokens = True
    letters = [chr(i) for i in range(0x250)] + list("  \n\n''srevtlld") * 9
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|endoftext|>", "a" * 3000, " " * 500 + "x", "!" * 400, "中文 😀", "don't  we'LL\x1c\x85\xa0 x"]
    assert known.compiled is not None
    for text in texts:
        assert known.encode_a(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_are_encoded_as_the_library_does_texts():
    import sentencepiece

    known, library, rng = alignment.Tokenizers(*PATHS), sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), random.Random(12)
    letters = [chr(i) for i in range(1, 0x250)] + list("  \n\t▁中😀ﬁ½ err the ing tion") * 9
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a ", " a", "a  b", "the \n the", "<s> </s> <unk> <0x0A>", "x" * 5000 + " y", "a\u00a0b \u3000c"]
    assert known.by_word
    for text in texts:
        assert known.encode_b(text) == library.encode(text), text


def test_query(spark):
    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("test tables not present")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    want = [(*r[:-1], r[-1] and sha(r[-1])) for r in plain_alignment(rows, *PATHS)]
    got = QUERIES["op12_alignment"](spark, str(data))
    assert got.columns == [*FIELDS[:-1], "groups_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
