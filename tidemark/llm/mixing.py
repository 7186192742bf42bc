"""Mixing sources to target weights by Pareto order sampling.

A source's quota in words comes from water-filling: every source gets its
weight's share of all words, a source that would need over ``max_copies``
copies of itself stops there, and the excess goes to the others by weight.

Within a source a document of length class k (k = bits of its word count) is
expected ``e = min(max_copies, lambda * v_k)`` times, with v_k falling slowly
with k so that a few very long documents do not fill a quota; lambda makes the
expected words meet the quota. The whole part of ``e`` is taken for certain.
The rest, p = e - floor(e), is an inclusion probability: each document draws u
from a hash of its id and is ranked by its random odds over its inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the documents of lowest rank are taken until
the source's remaining quota is met, to within half a document.

The ranked prefix is cut without sorting a source: words are summed in
``BUCKETS`` rank intervals per source, and only the one interval where the
quota ends is ordered row by row.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own, after all others; repeated ids share one draw; an empty
table gives an empty result; extra columns pass through ``mix_rows`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

BUCKETS = 4096
TILT = 64
#: Rows up to which a table of sources (and length classes) is broadcast; beyond it Spark joins as it sees fit.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, which has been cut, marked for broadcast if it is short."""
    return F.broadcast(df) if df.count() <= SMALL else df


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(df: DataFrame, within: list[str], total: str, weight: str, cap: str, out: str) -> DataFrame:
    """Adds ``out``: the level at which ``sum(min(cap, level * weight)) = total``
    over the rows of each ``within`` group. Needs sum(cap) >= total."""
    # Filling in order of cap / weight, level_i is the one that holds if exactly the rows
    # before i are at their cap; it rises while that is so and falls afterwards.
    order = Window.partitionBy(*within).orderBy(F.col(cap) / F.col(weight), F.col("ordinal"))
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = df.withColumn("level_if_first", (F.col(total) - before) / rest)
    return levels.withColumn(out, F.max("level_if_first").over(Window.partitionBy(*within))).drop("level_if_first")


def quotas(sizes: DataFrame, max_copies: int = 3) -> DataFrame:
    """One row per source: source, source_size, target. Runs on one row per source."""
    by_code_point = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    sources = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("ordinal", F.row_number().over(by_code_point))
        .withColumn("weight", (F.col("ordinal") - 1) % 3 + 1)
        .withColumn("cap", F.col("source_size") * max_copies)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
        .withColumn("one", F.lit(0))
    )
    filled = water_fill(sources, ["one"], "total", "weight", "cap", "level")
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return filled.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``seed`` alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _with_copies(rows: DataFrame, seed: int, max_copies: int) -> DataFrame:
    """``rows`` has m_id, m_source, m_size and any other columns, which are
    carried without a shuffle; adds source_size, target and copies."""
    sizes = cut(rows.select(F.col("m_id").alias("doc_id"), F.col("m_source").alias("source"), F.col("m_size").alias("size")))
    quota = cut(quotas(sizes, max_copies))
    length_class = F.length(F.bin("size")).cast("int")
    classed = sizes.withColumn("length_class", length_class)
    by_class = (
        classed.where("size > 0")
        .groupBy("source", "length_class")
        .agg(F.sum("size").alias("words"))
        .join(quota.withColumnRenamed("source", "q_source"), F.col("source").eqNullSafe(F.col("q_source")))
        .withColumn("ordinal", F.col("length_class"))
        .withColumn("cap", F.col("words") * max_copies)
        .withColumn("weight", F.col("words") * (F.lit(TILT) - F.col("length_class")))
    )
    # one row per source and length class
    expected = cut(
        water_fill(by_class, ["source"], "target", "weight", "cap", "level")
        .withColumn("e", F.least(F.lit(float(max_copies)), F.col("level") * (F.lit(TILT) - F.col("length_class"))))
        .withColumn("whole", F.floor("e"))
        .withColumn("p", F.col("e") - F.col("whole"))
        .select("source", "length_class", "words", "target", "whole", "p")
    )
    wanted = expected.groupBy(F.col("source").alias("w_source")).agg(
        (F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("wanted")
    )
    ranked = _ranked(sizes.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size")), expected, seed)
    by_rank = Window.partitionBy("m_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per source at most: where its quota ends
    ends = cut(
        ranked.where("odds is not null")
        .groupBy("m_source", "bucket")
        .agg(F.sum("m_size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(by_rank), F.lit(0)))
        .join(wanted, F.col("m_source").eqNullSafe(F.col("w_source")))
        .where("before <= wanted and wanted < before + words")
        .select(F.col("m_source").alias("e_source"), F.col("bucket").alias("end_bucket"), "before", "wanted")
    )
    q = quota.select(F.col("source").alias("q_source"), "source_size", "target")
    placed = (
        _ranked(rows, expected, seed)
        .join(small(ends), F.col("m_source").eqNullSafe(F.col("e_source")), "left")
        .join(small(q), F.col("m_source").eqNullSafe(F.col("q_source")))
        .drop("e_source", "q_source")
    )
    at_end = F.col("odds").isNotNull() & F.col("bucket").eqNullSafe(F.col("end_bucket"))
    before_end = F.col("odds").isNotNull() & (F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")))
    sure = placed.where(~at_end).withColumn("extra", before_end.cast("int"))
    in_order = Window.partitionBy("m_source").orderBy("odds", "m_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("m_size").over(in_order), F.lit(0)) + F.col("m_size") / 2.0
    last = placed.where(at_end).withColumn("extra", (reached <= F.col("wanted")).cast("int"))
    copies = (F.coalesce(F.col("whole"), F.lit(0)) + F.col("extra")).cast("int")
    return sure.unionByName(last).withColumn("copies", copies)


def _ranked(rows: DataFrame, expected: DataFrame, seed: int) -> DataFrame:
    """Adds whole, p, odds (null where nothing is left to draw) and bucket."""
    classes = small(expected.select(F.col("source").alias("c_source"), F.col("length_class").alias("c_class"), "whole", "p"))
    u = draw(F.col("m_id"), seed)
    same_class = (F.length(F.bin("m_size")).cast("int") == F.col("c_class")) & (F.col("m_size") > 0)
    return (
        rows.join(classes, F.col("m_source").eqNullSafe(F.col("c_source")) & same_class, "left")
        .drop("c_source", "c_class")
        .withColumn("odds", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
        .withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS)))
    )


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [docs[id_col].alias("m_id"), docs[source_col].cast("string").alias("m_source"), n_words(docs[text_col]).alias("m_size")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_copies: int = 3) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = cut(docs.select(*_keys(docs, id_col, text_col, source_col)))
    return _with_copies(sizes, seed, max_copies).select(
        F.col("m_id").alias("doc_id"),
        F.col("m_source").alias("source"),
        F.col("m_size").alias("size"),
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("m_size")).alias("taken"),
    )


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, max_copies: int = 3) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    taken = _with_copies(docs.select(*_keys(docs, id_col, text_col, source_col), row), seed, max_copies).where("copies > 0")
    each = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
