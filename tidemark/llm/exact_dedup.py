"""Exact dedup by skew-safe combining.

Equal texts are found in three steps, each of which compares the full text
next to its digest: every scan task first folds its own copies into one row
(the partial aggregate), rows of frequent digests are then merged per salt, and
the salt winners are merged globally. A digest counts as frequent when it holds
over 1/10,000 of all rows, so there are fewer than 10,000 of them and their
list can be broadcast whatever the size of the corpus.

Defined cases: a null text is the empty text; a null id is below every other
id, so it stays only where all ids of a text are null; rows that repeat an id and a
text get the same verdict in ``dedup_report`` (all of the largest id are kept there,
null ones too) and are one row in ``keep_one``; an empty table gives an empty result; extra
columns are ignored by ``dedup_report`` and come back unchanged, whatever their
names, from ``keep_one``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, text_or_empty

HOT_SHARE = 10_000
SALTS = 64


def _hot_digests(narrow: DataFrame) -> DataFrame:
    """Digests of more than one in ``HOT_SHARE`` rows: at most ``HOT_SHARE`` rows."""
    least = F.lit(narrow.count() // HOT_SHARE + 1)
    return narrow.groupBy("digest").count().where(F.col("count") > least).select("digest")


def _grouped(keyed: DataFrame, hot: DataFrame, local: list[Column], merged: list[Column]) -> DataFrame:
    """One row per (digest, text). ``keyed`` has digest, body and the inputs of
    ``local``; ``merged`` combines the outputs of ``local``."""
    salted = keyed.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "digest", "left").withColumn(
        "salt", F.when(F.col("is_hot"), F.spark_partition_id() % SALTS)
    )
    by_salt = salted.groupBy("salt", "digest", "body").agg(*local)
    cold = by_salt.where(F.col("salt").isNull()).drop("salt")
    winners = by_salt.where(F.col("salt").isNotNull()).groupBy("digest", "body").agg(*merged)
    return cold.unionByName(winners)


def _by_text(rows: DataFrame, groups: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with their group, joined on digest and text; hot digests are dealt over salts."""
    flag = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    salts = F.when(F.col("is_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(flag, "digest", "left").withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    right = groups.join(flag, "digest", "left").withColumn("salt", F.explode(salts)).drop("is_hot")
    return left.drop("is_hot").join(right, ["digest", "body", "salt"])


def _digest(sha: Column, digest_bytes: int) -> Column:
    return F.substring(sha, 1, digest_bytes)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (largest id among equal
    texts), group_size, kept, text_sha256. ``digest_bytes`` shortens the digest
    that proposes equal texts; the result does not depend on it."""
    body = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha"))
    keyed = keyed.withColumn("digest", _digest(F.col("sha"), digest_bytes))
    narrow = cut(keyed.select("doc_id", "sha", "digest"))
    hot = _hot_digests(narrow)
    local = [F.max("doc_id").alias("keep_id"), F.count("*").alias("n")]
    merged = [F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")]
    groups = _grouped(keyed, hot, local, merged)
    by_digest = cut(
        groups.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    )
    alone = by_digest.where("texts = 1").select("digest", "keep_id", "n")
    out = join_hot(narrow, alone, "digest", "n", narrow.count()).select("doc_id", "sha", "keep_id", "n")
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():  # different texts under one digest: join on the text itself
        mixed = keyed.join(shared, "digest", "left_semi")
        exact = _grouped(mixed, hot, local, merged)
        out = out.unionByName(_by_text(mixed, exact, hot).select("doc_id", "sha", "keep_id", "n"))
    return out.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """``docs`` with one row per distinct text, the one with the largest id (of
    rows that repeat an id and a text, any one). Columns are unchanged."""
    row = F.struct(*[docs[c] for c in docs.columns])
    body = text_or_empty(text_col)
    keyed = docs.select(
        F.col(id_col).alias("rank"), row.alias("row"), body.alias("body"), F.unhex(F.sha2(body, 256)).alias("sha")
    ).withColumn("digest", _digest(F.col("sha"), digest_bytes))
    # the text is the key already, so the carried row leaves it out
    fields = [c for c in docs.columns if c != text_col]
    keyed = keyed.withColumn(
        "row", F.struct(F.col("row")[text_col].isNull().alias("no_text"), *[F.col("row")[c].alias(f"c{i}") for i, c in enumerate(fields)])
    ).withColumn("order", F.struct(F.col("rank"), ~F.col("row.no_text")))
    narrow = cut(docs.select(_digest(F.unhex(F.sha2(body, 256)), digest_bytes).alias("digest")))
    best = F.max_by(F.struct("order", "row"), "order").alias("best")
    groups = _grouped(keyed, _hot_digests(narrow), [best], [F.max_by("best", F.col("best.order")).alias("best")])
    back = {c: F.col("best.row")[f"c{i}"] for i, c in enumerate(fields)}
    back[text_col] = F.when(~F.col("best.row.no_text"), F.col("body"))
    return groups.select(*[back[c].alias(c) for c in docs.columns])
