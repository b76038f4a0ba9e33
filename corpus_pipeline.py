"""From documents to token ids: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrytrace.llm import bpe, common, decontaminate, langid, ngram_join, pii
from ferrytrace.llm.queries import table, workers_find_package
from ferrytrace.session import bound_batches, new_area

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A network that is sure of nothing gives each of its languages an equal share; below this, a text is
# in none of them.
LEAST_SCORE = 0.3
PII_KEY = "corpus pipeline"
VOCABULARY = "byte_bpe_50k.json"


def ready_for_python(spark: SparkSession) -> None:
    """Workers find the package and get texts in batches of bounded size."""
    workers_find_package(spark)
    bound_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in no known language, go."""
    ready_for_python(spark)
    learned = docs.where(F.pmod(common.crc_of_id(), F.lit(3)) != 1).select("text", "lang")
    return langid.keep_identified(docs, langid.learn(learned), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    ready_for_python(spark)
    return ngram_join.keep_one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    ready_for_python(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms; ``n_chars`` follows the new text."""
    replaced = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" not in docs.columns:
        return replaced
    kind = docs.schema["n_chars"].dataType
    return replaced.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), with digests of ids and decoded text."""
    ready_for_python(spark)
    coded = bpe.encode_and_decode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("bpe", encode),
]

# The network of the first stage is not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        area = new_area(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(area)
        docs = spark.read.parquet(area)
    return docs
