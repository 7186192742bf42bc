"""Corpus pipeline: quality classifier, exact dedup, near-dedup, mixing, encoding.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. Between stages rows lie as Parquet in the folder that executors share.
A stage that repeats documents (mixing) repeats their ids too. No SQL stands
beside it: sampling, SimHash groups and subword ids have none.

Defined cases: a null or empty text is kept by the first stage, is one text for
exact dedup and near-dedup, and has no words, so the mix does not take it; a null id
is below all others; a null source is a source of its own; empty tables give an
empty result; columns beyond those of documents go along up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, importance, mixing, registry, sentencepiece_bpe, simhash
from tidemark.llm.common import shared_folder

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return importance.select(docs, registry.labels(spark, sf_dir)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, lang, source, ids, n_tokens and the decoded text's digest."""
    done = sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text"), registry.model_path())
    return done.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
