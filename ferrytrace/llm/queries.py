"""The registered queries of the operators in this folder: one ``opN_<name>`` each, whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytrace.llm import (
    alignment,
    bpe,
    chat,
    collocations,
    common,
    decontaminate,
    fingerprints,
    langid,
    ngram_join,
    pii,
    quality,
    repeats,
    secrets,
    toxicity,
)
from ferrytrace.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


ROOT = str(Path(__file__).resolve().parents[2])


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as tests and local runs
    need; on a cluster it is installed or sent with ``--py-files``."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, compared with its edited text's and the next document's."""
    return fingerprints.compare_versions(table(spark, sf_dir, "documents"))


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(common.crc_of_id(), F.lit(3)) == 1
    net = langid.learn(docs.where(~held_out).select("text", "lang"))
    found = langid.predict_languages(docs, net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, by windows of ten words."""
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
        "longest_at",
        "longest_item",
    )


# The key of the registered query; a real run brings its own.
PII_KEY = "registered query"


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with personal data replaced by format-preserving pseudonyms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count="n_replaced")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, weak parts only where complementary ones are near."""
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the bytes that strings of 400 bytes cover which occur elsewhere too; ``text``
    has the replacement character where a cut fell inside a character."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the byte-level vocabulary."""
    coded = bpe.encode_and_decode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(common.crc_of_id(), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    found = toxicity.score_texts(docs, toxicity.learn(docs, labels))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its roles repaired at the least cost, rendered turn by turn."""
    return chat.repair(table(spark, sf_dir, "conversations"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to four words in each language."""
    return collocations.mine_phrases(table(spark, sf_dir, "documents"), least=30, top=2000)


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's tokens by two vocabularies, aligned, with corpus-wide counts of linked ids."""
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.align_texts(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    slim = written(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), "aligned")
    return alignment.with_counts(slim).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(common.crc_of_id(), F.lit(5)) == 0
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = quality.score_texts(docs, model)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


ORACLES["op11_collocations"] = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
),
grams AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k:
    list_transform(range(1, len(words) - k + 2), lambda i: words[i : i + k - 1])))) AS gram
  FROM words
),
counted AS (SELECT lang, gram, count(*) AS a FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(len(words))::BIGINT AS n FROM words GROUP BY ALL),
candidates AS (SELECT * FROM counted WHERE len(gram) > 1 AND a >= 30),
cuts AS (SELECT *, unnest(range(1, len(gram))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.gram, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.gram = c.gram[1 : c.k]
  JOIN counted y ON y.lang = c.lang AND y.gram = c.gram[c.k + 1 : len(c.gram)]
),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
),
inside AS (
  SELECT lang, unnest(flatten(list_transform(range(2, len(gram)), lambda m:
    list_transform(range(1, len(gram) - m + 2), lambda i: gram[i : i + m - 1])))) AS gram, a
  FROM candidates
),
longer AS (SELECT lang, gram, max(a) AS most FROM inside GROUP BY ALL),
kept AS (
  SELECT w.*, array_to_string(w.gram, ' ') AS phrase
  FROM weakest w LEFT JOIN longer b ON b.lang = w.lang AND b.gram = w.gram
  WHERE b.most IS NULL OR 100::HUGEINT * b.most < 80::HUGEINT * w.a
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, rank, phrase, a, l, r.r, n, score::BIGINT AS score
FROM ranked r JOIN sizes USING (lang) WHERE rank <= 2000
"""
