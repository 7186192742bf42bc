"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, importance, interpolation, mixing, secrets, sentencepiece_bpe, simhash, substring_dedup, suffix_dedup, tandem_runs, tiered_search, toxicity, weighted_sampling
from .common import documents

TOXIC_FROM = 0.3


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), model_path())
    id_list = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(id_list, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def span_text(spans: str) -> Column:
    """The removed runs as start:end, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",").alias("removed_spans")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("removed"), span_text("spans")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = importance.select(documents(spark, sf_dir), labels(spark, sf_dir))
    return kept.select("doc_id", "log_weight", "sample_key")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(documents(spark, sf_dir))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("removed"),
        span_text("spans"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.with_neighbours(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, labels(spark, sf_dir))
    return toxicity.detect(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return tiered_search.ranked(documents(spark, sf_dir), items).select("item_id", "rank", "doc_id", "score")


def op12_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tandem_runs.detect(tandem_runs.plant(documents(spark, sf_dir)))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = found.select("*", tandem_runs.strongest("runs").alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_importance": op6_importance,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_toxicity": op10_toxicity,
    "op11_tiered_search": op11_tiered_search,
    "op12_interpolation": op12_interpolation,
    "op13_periodic_runs": op13_periodic_runs,
}
