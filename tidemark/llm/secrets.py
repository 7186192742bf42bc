"""Secret scans with multipart credential linking.

Three base kinds are found in every text on their own. The linking kinds are
the parts of a credential that say little alone: an identifier (access key id,
client id, user name), a secret (a long random-looking string, a short
assignment) and an endpoint. Every part covers a scope, ``SCOPE`` code points to
both sides of it; parts meet by an interval join, bucketed by position so that
no document is compared with itself part by part. An identifier counts only
where a secret lies in its scope, a secret only where an identifier does, and
an endpoint only where both do.

Positions are code points, ends exclusive. A pattern's matches and the pieces
between them alternate, so their lengths add up to the positions.

Defined cases: a null text is the empty text; rows that repeat id and text are
linked as one document; a null id is an id of its own; empty tables and extra
columns need nothing special.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

SCOPE = 160

# Fixed values of the base scan.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more
BASE_KINDS = ("assign", "access", "hex")

# Parts that count only together.
IDENTIFIER = r"""(?i:(?:aws_?)?access_?key(?:_?id)?|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|sftp|s3)://[^\x20\x09-\x0D"'<>]{3,}"""
RANDOM = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])(?=[0-9A-Z+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}"
SHORT_SECRET = r"""(?i:pwd|passphrase|private_?key|auth_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})"""
LINKED_KINDS = ("linked_id", "linked_secret", "linked_endpoint")


def find_spans(text: Column, pattern: str, least: int = 0) -> Column:
    """array<struct<start, end>> of the pattern's leftmost non-overlapping
    matches; with ``least``, of those whose first group is that long."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    # the piece behind the last match has none; zip_with, unlike an index in a lambda, takes each list once
    paired = F.zip_with(whole, between, lambda m, gap: F.struct((F.length(gap) + F.length(m)).alias("step"), F.length(m).alias("n")))
    widths = F.filter(paired, lambda w: w["n"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = lambda at: F.struct(at.alias("at"), none.alias("out"))

    def add(acc: Column, w: Column) -> Column:
        end = acc["at"] + w["step"]
        span = F.struct((end - w["n"]).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def shift(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    def placed(w: Column) -> Column:
        # in stretches of sqrt(n) matches, since every step of an aggregate copies what it has
        stretch = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(w)))).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / stretch).cast("int")), lambda k: F.slice(w, k * stretch + 1, stretch))
        parts = F.transform(cuts, lambda part: F.aggregate(part, start(F.lit(0)), add))
        return F.aggregate(parts, start(F.lit(0)), shift, lambda acc: acc["out"])

    spans = F.transform(F.array(widths), placed)[0]  # the matches are found once
    if least:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        long = F.zip_with(spans, groups, lambda s, g: F.when(F.length(g) >= least, s))
        spans = F.filter(long, lambda s: s.isNotNull())
    # most texts hold no match: one search then decides
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _digest_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in BASE_KINDS + LINKED_KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_key, the spans of each base kind and of each part."""
    body = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    return rows.select(
        "doc_id",
        F.concat(F.xxhash64("body").cast("string"), F.lit(":"), F.length("body").cast("string")).alias("text_key"),
        find_spans(F.col("body"), ASSIGN, 6).alias("assign"),
        find_spans(F.col("body"), ACCESS).alias("access"),
        find_spans(F.col("body"), HEX).alias("hex"),
        find_spans(F.col("body"), IDENTIFIER).alias("identifier"),
        F.concat(find_spans(F.col("body"), RANDOM), find_spans(F.col("body"), SHORT_SECRET)).alias("secret"),
        find_spans(F.col("body"), ENDPOINT).alias("endpoint"),
    )


def _meets(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """The rows of ``parts`` in whose scope a row of ``others`` lies."""
    near = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    left = parts.withColumn("bin", F.explode(near))
    right = others.select(
        F.col("doc_id").alias("o_id"),
        F.col("text_key").alias("o_key"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("o_bin"),
    )
    overlap = (F.col("o_start") < F.col("end") + scope) & (F.col("o_end") > F.col("start") - scope)
    apart = (F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start"))
    same = F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_key") == F.col("o_key")) & (F.col("bin") == F.col("o_bin"))
    return left.join(right, same & overlap & apart, "left_semi").drop("bin").distinct()


def link_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, text_key, kind (index into all kinds), start, end of the linked parts."""
    part = lambda name, kind: F.transform(
        F.col(name), lambda s: F.struct(F.lit(kind).alias("part"), s["start"].alias("start"), s["end"].alias("end"))
    )
    parts = cut(
        found.select(
            "doc_id",
            "text_key",
            F.explode(
                F.concat(
                    part("access", "strong_id"),
                    part("identifier", "id"),
                    part("assign", "strong_secret"),
                    part("hex", "strong_secret"),
                    part("secret", "secret"),
                    part("endpoint", "endpoint"),
                )
            ).alias("p"),
        )
        .select("doc_id", "text_key", "p.*")
        .distinct()
    )
    ids = parts.where(F.col("part").isin("strong_id", "id"))
    secrets = parts.where(F.col("part").isin("strong_secret", "secret"))
    linked_ids = _meets(ids.where("part = 'id'"), secrets, scope)
    linked_secrets = _meets(secrets.where("part = 'secret'"), ids, scope)
    linked_endpoints = _meets(_meets(parts.where("part = 'endpoint'"), ids, scope), secrets, scope)
    each = [linked_ids, linked_secrets, linked_endpoints]
    n = len(BASE_KINDS)
    tagged = [df.select("doc_id", "text_key", F.lit(n + i).alias("kind"), "start", "end") for i, df in enumerate(each)]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = cut(find_parts(docs, id_col, text_col))
    links = (
        link_parts(found, scope)
        .groupBy(F.col("doc_id").alias("l_id"), F.col("text_key").alias("l_key"))
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    )
    base = F.concat(*[_tagged(F.col(k), i) for i, k in enumerate(BASE_KINDS)])
    joined = found.join(links, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key")), "left")
    every = F.when(F.col("linked").isNull(), base).otherwise(F.concat(base, F.col("linked")))
    return joined.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_digest_text(base), 256).alias("base_sha256"),
        _digest_text(every).alias("spans"),
    )
