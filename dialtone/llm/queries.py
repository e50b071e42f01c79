"""The registered queries of the operators, with the columns that their contracts name."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from dialtone.llm import (
    exact_dedup, jaccard_join, license_scans, periodic_runs, piece_encoding, pitman_yor, pivot_search, quality_network, secret_scans, source_mixing,
    spot_signatures, sql, token_counts, whitening,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scans.scan_documents(table(spark, sf_dir, "documents"))
    labels = F.array_union("base_labels", F.transform("matches", lambda m: m["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
        joined(labels).alias("labels"), share.alias("score"),
    )


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, ledger = table(spark, sf_dir, "documents"), secret_scans.new_ledger(spark)
    # Documents arrive twice: one half first, then all of them, of which the ledger knows that half's blobs.
    ledger.scan(secret_scans.addressed(documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)))
    return secret_scans.digests(documents, ledger)


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(documents, model).select("doc_id", "counts.*")


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    signed = spot_signatures.with_signatures(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "signatures")
    classes = spot_signatures.similar_classes(signed).withColumnRenamed("id", "doc_id")
    return spot_signatures.fingerprints(documents, beside=classes)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position")


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_encoding.encoding_digests(documents, model).select("doc_id", "digest.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = quality_network.fit(documents, table(spark, sf_dir, "labels"))
    scored = quality_network.score(documents.select("doc_id", "text"), net)
    return scored.select(
        "doc_id", quality_network.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's word order: the words of a tenth of the documents go round in a loop from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), order=looped)
    # By start and period already, so of equal exponents the first one stays.
    found = found.withColumn("best", F.expr(
        "reduce(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), "
        "(b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period AS exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    # null where it is no long
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_license_scans, op2_secret_scans, op3_pivot_search, op4_token_counts, op5_spot_signatures,
        op6_source_mixing, op7_piece_encoding, op8_ngram_jaccard_join, op9_quality_classifier,
        op10_pitman_yor, op11_exact_dedup, op12_periodic_runs,
        op13_embedding_whitening,
    )}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()
