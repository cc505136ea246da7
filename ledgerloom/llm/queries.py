"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, language, license_scan, line_dedup, mixing, order_minhash, permutation_index, secret_scan, simhash, token_counts
from ledgerloom.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, keep rate and draw of every document, raked to tempered source, language and topic marginals."""
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__weight", 7).alias("cell_weight"), F.round("__rate", 5).alias("rate"), F.col("__kept").alias("kept"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document: how many paragraphs, which families, and where."""
    docs = read(spark, sf_dir, "documents")
    found = license_scan.scan(docs, license_scan.fit(license_scan.sample_negatives(docs, "text")), ["doc_id"])
    spot = F.transform("licenses", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"]))
    return found.select(
        "doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct("licenses.family")), ",").alias("families"),
        F.array_join(spot, ",").alias("spans"),
        F.round(F.coalesce(F.array_min("licenses.probability"), F.lit(0.0)), 3).alias("least_probability"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, their digest, and all spans."""
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id", *(secret_scan.how_many(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    marked = docs.select("doc_id", language.held_out("doc_id").alias("held_out"), "text")
    return language.predict(marked, language.learn(docs), ["doc_id", "held_out"])


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    found = order_minhash.compare_with_edits(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document dropped as its source's boilerplate, and the digest of what stays."""
    found = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"), "source")
    return found.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("host"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"], decoded=True)
    return found.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    rows = read(spark, sf_dir, "embeddings")
    return permutation_index.search(rows, rows.where("vec_id % 20 = 0"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), path, ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_licenses, op3_secrets, op4_language, op5_order_minhash, op6_line_dedup, op7_byte_bpe, op8_permutation_index, op9_simhash, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.oracle(), "op3_secrets": secret_scan.oracle(), "op6_line_dedup": line_dedup.ORACLE}
