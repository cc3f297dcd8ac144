"""A training-data pipeline of five corpus operators: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import bpe, language, minhash, mixing, repeats
from curbline.llm.common import table
from curbline.session import cut

LEAST_SHARE = 0.4  # of its main language, in a document that stays
PASSAGE = 240  # bytes; 50 words have 290 to 500


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without a letter, or of no language for the most part, go."""
    found = language.identify(docs.select("text", F.struct("*").alias("row")), *language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return minhash.one_per_group(docs, width=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of about 50 words and more that occur anywhere else."""
    return repeats.strip(docs, length=PASSAGE).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.emit(docs, cut(mixing.mix(docs)))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit), and whether they decode to the text."""
    done = bpe.encode_and_back(docs.select("doc_id", "lang", "source", "text"), same="round_trip")
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("tokens", to_tokens),
]

ORACLE_SQL = None  # mixtures of languages and byte-level BPE are beyond SQL; tests/llm checks the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
