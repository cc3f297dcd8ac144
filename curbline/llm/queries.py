"""One registered query per corpus operator, over whole tables, and check SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import bpe, check_sql, collisions, imatch, language, lloyd, minhash, mixing, pipelined, quality, quotes, rans, recipes, repeats
from curbline.llm.common import table
from curbline.session import scratch_dir


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark).rstrip('/')}/curbline-ids-{uuid.uuid4().hex}"
    rans.write(table(spark, sf_dir, "documents"), folder)
    return rans.digests(rans.read(spark, folder))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op8_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"), length=400)


def op6_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threads(table(spark, sf_dir, "conversations"))


def op7_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language.remainder(5) == 0
    stats = quality.with_statistics(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.scored(stats, quality.fit(stats, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_mixture_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), language.remainder(4) == 2
    found = language.identify(docs.select("doc_id", "text"), *language.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_pipelined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelined.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes")


def op13_heap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dimensions=64, scale=64)


QUERIES = {f.__name__: f for f in (
    op1_collision_counting, op2_imatch_fingerprints, op3_systematic_mix, op4_rans_token_files, op5_minhash_near_duplicates, op6_quotation_threads, op7_quadratic_quality, op8_matrix_bpe, op9_mixture_language,
    op10_prefix_free_repeats, op11_pipelined_terms, op12_chunk_recipes, op13_heap_bounds,
)}
CHECKS = {
    "op3_systematic_mix": mixing.check_sql(), "op5_minhash_near_duplicates": check_sql.near_duplicates(), "op10_prefix_free_repeats": check_sql.repeats(),
    "op11_pipelined_terms": pipelined.CHECK_SQL, "op12_chunk_recipes": recipes.CHECK_SQL, "op13_heap_bounds": lloyd.check_sql(),
}
