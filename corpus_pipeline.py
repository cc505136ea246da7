"""Corpus preparation over `documents`, in stages; each is written as Parquet and read again before the next.

Stages take (spark, docs, sf_dir) and return the columns of docs, the last one the encoded corpus:

1. language ID: texts without a letter and texts in none of the learned languages go; lang becomes the predicted one;
2. line dedup: lines that too many pages of a source hold go from the texts;
3. near-dedup: one document of each group stays, linked by a Jaccard similarity of 0.8 of five-word shingles;
4. mixing: documents are drawn so that source, language and topic meet their target weights;
5. byte BPE: the texts' token ids, and the digest of what they decode to.

No stage has an SQL form as a whole (the first trains a model), so ORACLE_SQL is None and
tests/llm hold each stage against a brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, language, line_dedup, mixing, simhash
from ledgerloom.llm.common import batches_of, checkpoint_folder, cut

ORACLE_SQL = None
#: Rows in one Arrow batch: the default of 10,000 rows with texts takes tens of MB, in each task twice in the JVM while a buffer grows, and again in its Python worker.
WIDE = 512

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def written(stage: Stage) -> Stage:
    """The stage with its result materialised in Arrow batches of few rows, whatever reads it; for stages whose last step is Python.
    A checkpoint, as Spark can clean it up when the result is not used any more."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        found = stage(spark, docs, sf_dir)
        with batches_of(spark, WIDE):
            return cut(found)

    return run


@written
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, with lang as predicted. Trained on labelled documents that are not held
    out; the least familiarity of a text is fixed on the same labelled rows, so documents that mix languages stay."""
    model = language.learn(docs)
    found = language.predict(docs, model, docs.columns).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("familiar") >= model.bound))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    found = line_dedup.drop_boilerplate(docs, "source")
    n = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return simhash.drop_near_duplicates(docs)


@written
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the kept tokens meet the targets; the budget is an upper limit."""
    return mixing.mix(docs).where("__kept").select(*docs.columns)


@written
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (packed little-endian uint32) and decoded_sha256."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], decoded=True)
    return found.select("doc_id", "lang", "source", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_cleaning),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
