"""Vector search, number search, pages and visibility.

Tables are DataFrames with these columns: events (event_id, status, owner_email),
sources (source_id, event_id, name, removed), photos (photo_id, source_id,
event_id), faces (photo_id, row_idx), bibs (photo_id, bib, conf).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text, vectors
from ..session import cut

PUBLIC = ("ready", "partial")


def visible(events: DataFrame) -> DataFrame:
    return events.where(F.col("status").isin(*PUBLIC))


def live_only(photos: DataFrame, sources: DataFrame) -> DataFrame:
    """Without the photos of withdrawn sources."""
    gone = sources.where("removed").select("source_id")
    return photos.join(gone, "source_id", "left_anti")


def owned_by(events: DataFrame, email: str, is_operator: bool = False) -> DataFrame:
    """All for an operator; an event without an owner is for operators only."""
    return events if is_operator else events.where(F.lower("owner_email") == email.strip().lower())


def in_roster(people: DataFrame, roster: DataFrame) -> DataFrame:
    return people.join(roster.where("banned_at is null").select("email"), "email", "left_semi")


def matrix(cells: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, one row a place) of the vectors in a list column that have ``dim``
    numbers; a vector that is null, of another length or holds a null is left out."""
    lengths = np.diff(cells.offsets.to_numpy())
    whole = cells.is_valid().to_numpy(zero_copy_only=False) & (lengths == dim)
    inner = cells.values
    if inner.null_count:
        missing = np.concatenate([[0], np.cumsum(inner.is_null().to_numpy(zero_copy_only=False))])
        ends = cells.offsets.to_numpy()
        whole &= missing[ends[1:]] == missing[ends[:-1]]
    at = np.flatnonzero(whole)
    kept = cells.take(pa.array(at)).flatten()
    return at, kept.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)


def score_codes(table: DataFrame, query: list[int], codes: str = "codes") -> DataFrame:
    """``table`` with its score against one query, in the JVM."""
    return table.withColumn("score", vectors.dot(F.col(codes), F.array(*[F.lit(int(c)) for c in query])))


def score_vectors(table: DataFrame, query: list[int], least: float, keep: list[str], vector: str = "vector", top: int | None = None) -> DataFrame:
    """The columns ``keep`` (longs) and the score of the rows that reach ``least``: a
    batch of float vectors is quantized and scored by one matrix product. With
    ``top``, of every batch only the rows that score with its best ``top``, ties too.
    Rows without a whole vector of the query's length have no score."""
    codes = np.array(query, np.float64)
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat = matrix(batch.column(len(keep)), len(codes))
            score = (np.clip(np.rint(flat * vectors.UNIT), -vectors.UNIT, vectors.UNIT) @ codes).astype(np.int64)
            bound = least if top is None or len(score) <= top else max(least, np.partition(score, -top)[-top])
            hit = np.flatnonzero(score >= bound)
            rows = pa.array(at[hit])
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns[: len(keep)]], pa.array(score[hit])], names)

    plain = table.select(*[F.col(c).cast("long").alias(c) for c in keep], vector)
    return plain.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def face_search(scored: DataFrame, faces: DataFrame, photos: DataFrame, sources: DataFrame, threshold: float, top_faces: int = 200, top_photos: int = 60, live_first: bool = False) -> DataFrame:
    """photo_id, row_idx, score of the best photos. ``scored`` has row_idx and
    score. By default withdrawn photos count among ``top_faces`` and are dropped
    afterwards; ``live_first`` drops them before the cut."""
    hits = scored.where(F.col("score") >= threshold * vectors.SQUARE)
    if live_first:
        owned = faces.join(live_only(photos, sources).select("photo_id"), "photo_id", "left_semi").select("row_idx")
        hits = hits.join(owned, "row_idx", "left_semi")
    best = best_faces(hits, faces, photos, sources, top_faces, ["row_idx"]).select("photo_id", "row_idx", "score")
    return best.orderBy(F.desc("score"), "row_idx").limit(top_photos)


def best_faces(hits: DataFrame, faces: DataFrame, photos: DataFrame, sources: DataFrame, top_faces: int, columns: list[str]) -> DataFrame:
    """The best face of each live photo among the ``top_faces`` best hits: photo_id, score
    and ``columns`` of faces and photos. The hits, which are few, go to the faces, and the
    faces found to the photos and sources, so that no large table is shuffled."""
    top = hits.orderBy(F.desc("score"), "row_idx").limit(top_faces).select("row_idx", "score")
    found = faces.join(F.broadcast(top), "row_idx")
    ids = F.broadcast(found.select("photo_id").distinct())  # rows of `top_faces` row numbers
    there = photos.join(ids, "photo_id")
    theirs = F.broadcast(there.select("source_id").distinct())
    gone = sources.where("removed").join(theirs, "source_id").select("source_id")
    live = there.join(F.broadcast(gone), "source_id", "left_anti").withColumnRenamed("photo_id", "p_id")
    joined = found.join(F.broadcast(live), F.col("photo_id") == F.col("p_id"))
    return best_per(joined.select("photo_id", "score", *columns), "photo_id", F.desc("score"), F.asc("row_idx"))


def face_answer(scored: DataFrame, faces: DataFrame, photos: DataFrame, sources: DataFrame, threshold: float, base: str = "", top_faces: int = 200, top_photos: int = 60) -> DataFrame:
    """What a search shows, the best first: score (a cosine), the photo's public columns and
    the face's box in fractions of the frame (null where the frame is not known). faces has
    bbox, photos file_id, thumb_key, width, height, taken_at."""
    hits = scored.where(F.col("score") >= threshold * vectors.SQUARE)
    shown = ["row_idx", "bbox", "file_id", "thumb_key", "width", "height", "taken_at"]
    best = best_faces(hits, faces, photos, sources, top_faces, shown).orderBy(F.desc("score"), "row_idx").limit(top_photos)
    box = geometry.box_fraction(geometry.parse_box(F.col("bbox")), F.col("width"), F.col("height"))
    seen = public_photos(best, base).columns
    return best.select(
        "photo_id",
        "row_idx",
        (F.col("score") / vectors.SQUARE).alias("score"),
        text.asset_url(base, F.col("thumb_key")).alias("thumb_url"),
        text.original_url(F.col("file_id")).alias("original_url"),
        "width",
        "height",
        "taken_at",
        box.alias("box"),
    ).select("row_idx", "score", *seen, "box")


def best_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    ranked = df.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("rank_ = 1").drop("rank_")


def whole_only(table: DataFrame) -> DataFrame:
    """Without the rows whose codes are null or hold a null."""
    return table.where(F.col("codes").isNotNull() & ~F.exists("codes", lambda c: c.isNull()))


def similar_pairs(table: DataFrame, threshold: float, rows: int, block: int = 2048) -> DataFrame:
    """(a, b, score) of all pairs a < b at or above the threshold. ``table`` has id
    and codes, ``rows`` is its size: it is cut into blocks of about ``block`` rows
    and every pair of blocks is one matrix product in one task, so a task holds
    two blocks whatever the size. All pairs are compared; this is for sets of
    queries, not for a whole corpus."""
    blocks = max(1, -(-rows // block))
    own = whole_only(table).select("id", F.col("codes").cast("array<tinyint>").alias("codes"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = own.withColumn("other", F.explode(others)).select("id", "codes", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    least = threshold * vectors.SQUARE

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        low, high = int(df["low"].iloc[0]), int(df["high"].iloc[0])
        left, right = df[df["own"] == low], df[df["own"] == high]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "score": []}).astype("int64")
        x, y = (np.stack(d["codes"].to_list()).astype(np.float32) for d in (left, right))
        score = np.rint(x.astype(np.float64) @ y.T).astype(np.int64)
        i, j = np.nonzero(score >= least)
        a, b = left["id"].to_numpy()[i], right["id"].to_numpy()[j]
        keep = a < b if low == high else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": score[i, j][keep]})

    return dealt.groupBy("low", "high").applyInPandas(compare, "a long, b long, score long")


def scores_of(table: DataFrame, queries: np.ndarray, ids: list[int], least: int) -> DataFrame:
    """(query, id, score) of every row against a bounded set of query codes."""
    shared = table.sparkSession.sparkContext.broadcast((queries.astype(np.float32), np.array(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, names = shared.value
        for batch in batches:
            at, flat = matrix(batch.column(1), codes.shape[1])
            score = np.rint(flat.astype(np.float32) @ codes.T).astype(np.int64)
            i, j = np.nonzero(score >= least)
            yield pa.RecordBatch.from_arrays([pa.array(names[j]), batch.column(0).take(pa.array(at[i])), pa.array(score[i, j])], ["query", "id", "score"])

    return table.select("id", "codes").mapInArrow(run, "query long, id long, score long")


def scores_of_many(table: DataFrame, asked: DataFrame, least: int, block: int = 2048) -> DataFrame:
    """(query, id, score) of every row against every row of ``asked``; both have id
    and codes. Each side is dealt into blocks of about ``block`` rows and a task
    compares two of them, so neither side has to fit in one place."""
    sides = []
    for rows in (table, asked):
        blocks = max(1, -(-rows.count() // block))
        sides.append((whole_only(rows).select("id", F.col("codes").cast("array<tinyint>").alias("codes"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own")), blocks))
    (rows, row_blocks), (queries, query_blocks) = sides
    left = rows.select("id", "codes", F.lit(False).alias("asks"), F.col("own").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("high"))
    right = queries.select("id", "codes", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("low"), F.col("own").alias("high"))

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        x, y = df[~df["asks"]], df[df["asks"]]
        if not len(x) or not len(y):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype("int64")
        a, b = (np.stack(d["codes"].to_list()).astype(np.float64) for d in (x, y))
        score = np.rint(a @ b.T).astype(np.int64)
        i, j = np.nonzero(score >= least)
        return pd.DataFrame({"query": y["id"].to_numpy()[j], "id": x["id"].to_numpy()[i], "score": score[i, j]})

    return left.unionByName(right).groupBy("low", "high").applyInPandas(compare, "query long, id long, score long")


def bib_hits(bibs: DataFrame, photos: DataFrame, sources: DataFrame, printed: str, fuzzy: bool = False) -> DataFrame:
    """photo_id, bib, conf, kind ('exact' or 'suffix'): exact hits, or with
    ``fuzzy`` and without exact ones those whose digits end in the number; one per
    photo, the surest first."""
    wanted = text.normalize_bib(F.lit(printed), lenient=True)  # a constant, so the filter reaches the scan
    found = matching(bibs, wanted, fuzzy)
    live = found.join(live_only(photos, sources).select("photo_id"), "photo_id", "left_semi")
    hits = best_per(live.select("photo_id", "bib", "conf", "kind"), "photo_id", F.asc("kind"), F.desc("conf"), F.asc("bib"))
    if not fuzzy:
        return hits
    hits = cut(hits)  # found once, then asked whether an exact one is among them
    return hits.where(F.col("kind") == ("suffix" if hits.where("kind = 'exact'").isEmpty() else "exact"))


def matching(bibs: DataFrame, wanted: Column, fuzzy: bool) -> DataFrame:
    """The numbers that are ``wanted`` (a constant), or with ``fuzzy`` end in its digits under the same prefix, with their kind."""
    same = F.col("bib") == wanted
    prefix, digits = text.bib_prefix(wanted), text.bib_digits(wanted)
    head = F.when(prefix == "", "").otherwise(F.concat(prefix, F.lit("-")))
    bare = F.col("bib").contains("-") == (prefix != "")
    alike = F.startswith(F.col("bib"), head) & bare & F.endswith(text.bib_digits(F.col("bib")), digits)
    found = bibs.where((wanted != "") & (alike if fuzzy else same))  # what is the same is alike
    return found.withColumn("kind", F.when(same, "exact").otherwise("suffix"))


def bib_alternatives(bibs: DataFrame, printed: str, most: int = 10) -> DataFrame:
    """Stored numbers with the same digits and another prefix."""
    wanted = bibs.sparkSession.range(1).select(text.normalize_bib(F.lit(printed), lenient=True).alias("wanted"))
    other = (text.bib_digits(F.col("bib")) == text.bib_digits(F.col("wanted"))) & (F.col("bib") != F.col("wanted"))
    return bibs.join(F.broadcast(wanted)).where(other).select("bib").distinct().orderBy("bib").limit(most)


def bib_lookup(events: DataFrame, bibs: DataFrame, photos: DataFrame, sources: DataFrame, event_id: int, printed: str, fuzzy: bool = False, most: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """(hits, answer) inside one public event (events has bibs_enabled, bibs has
    event_id and bib_raw). Hits: photo_id, bib, conf, bib_raw, kind, one per photo of
    the ``most`` surest reads (None: of all). Answer, one row: bib, error ('no_bibs' where the event
    has none), matched, bib_read (the surest hit's print), alternatives, photos,
    fuzzy_available."""
    wanted = text.normalize_bib(F.lit(printed), lenient=True)  # a constant, so the filter reaches the scan
    event = visible(events).where(F.col("event_id") == event_id).select("event_id", "bibs_enabled", wanted.alias("wanted"))
    asked = F.broadcast(event.where("bibs_enabled").select("event_id"))  # one event
    own = bibs.where(F.col("event_id") == event_id)
    live = matching(own, wanted, fuzzy).join(asked, "event_id").join(live_only(photos, sources).select("photo_id"), "photo_id", "left_semi")
    # `most` rows; exact ones come first, so if there are any no other one is the first
    if most is None:  # of any number, so no task holds them all
        first = F.broadcast(live.agg(F.min("kind").alias("first_")))  # a row
        rows = live.join(first, F.col("kind") == F.col("first_")) if fuzzy else live
    else:
        rows = live.orderBy("kind", F.desc("conf"), "photo_id", "bib").limit(most)
        rows = rows.withColumn("first_", F.min("kind").over(Window.partitionBy("event_id"))).where("kind = first_")
    hits = best_per(rows.select("photo_id", "bib", "conf", "bib_raw", "kind"), "photo_id", F.desc("conf"), F.asc("bib"))
    unsure_last = F.coalesce(-F.col("conf").cast("double"), F.lit(float("inf")))
    surest = F.min_by("bib_raw", F.struct(unsure_last, "photo_id"))
    told = hits.agg(F.count("*").alias("photos"), F.max("kind").alias("matched"), surest.alias("bib_read"))
    digits = (wanted != "") & (text.bib_digits(F.col("bib")) == text.bib_digits(wanted)) & (F.col("bib") != wanted)
    others = own.join(asked, "event_id").where(digits).select("bib").distinct().orderBy("bib").limit(10).agg(F.array_sort(F.collect_list("bib")).alias("alternatives"))
    open_ = F.col("bibs_enabled") & (F.col("wanted") != "") & (F.col("photos") == 0)
    answer = event.join(F.broadcast(told)).join(F.broadcast(others)).select(  # a row each
        F.nullif("wanted", F.lit("")).alias("bib"),
        F.when(~F.col("bibs_enabled"), "no_bibs").alias("error"),
        "matched",
        "bib_read",
        "alternatives",
        "photos",
        (open_ & F.lit(not fuzzy)).alias("fuzzy_available"),
    )
    return hits, answer


def public_photos(photos: DataFrame, base: str = "") -> DataFrame:
    """What anyone may see of a photo (photo_id, file_id, thumb_key, width, height, taken_at)."""
    return photos.select("photo_id", text.asset_url(base, F.col("thumb_key")).alias("thumb_url"), text.original_url(F.col("file_id")).alias("original_url"), "width", "height", "taken_at")


def public_events(events: DataFrame, base: str = "") -> DataFrame:
    """What anyone may see of an event; an unset ``bibs_enabled`` counts as on."""
    shown = F.coalesce(F.col("bibs_enabled").cast("int") != 0, F.lit(True))
    return events.select("event_id", "slug", "name", "event_date", text.asset_url(base, F.col("banner_key")).alias("banner_url"), "status", "photo_count", "face_count", shown.alias("bibs_enabled"))


def next_cursor(page: DataFrame, limit: int, key: str = "photo_id") -> DataFrame:
    """One row: returned, cursor (the page's last key; null unless the page is full)."""
    return page.agg(F.count("*").alias("returned"), F.when(F.count("*") == limit, F.max(key)).alias("cursor"))


def listed(df: DataFrame, most: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` rows, one row: total, returned), so that a cut list says so."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(most), total.withColumn("returned", F.least("total", F.lit(most)))


def photo_source(photos: DataFrame, sources: DataFrame, photo_id: int) -> DataFrame:
    """A photo's row with its source's folder and image_source."""
    one = photos.where(F.col("photo_id") == photo_id)
    return F.broadcast(one).join(sources.select("source_id", "folder_id", "image_source"), "source_id").select("photo_id", "event_id", "source_id", "folder_id", "image_source")


def photo_ids(photos: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and photo_id of ``files`` (event_id, file_id) that are photos of that event."""
    return files.distinct().join(photos.select("event_id", "file_id", "photo_id"), ["event_id", "file_id"]).select("event_id", "file_id", "photo_id")


def photo_page(photos: DataFrame, cursor: int | None, limit: int, faces: DataFrame | None = None, bibs: DataFrame | None = None, only: str = "all", source_id: int | None = None) -> DataFrame:
    """A page after ``cursor`` in id order; ``only`` is all, no_face, no_bib or
    has_bib, anything else counts as all."""
    out = photos if cursor is None else photos.where(F.col("photo_id") > cursor)
    out = out if source_id is None else out.where(F.col("source_id") == source_id)
    return quality_filter(out, faces, bibs, only).orderBy("photo_id").limit(limit)


def quality_filter(photos: DataFrame, faces: DataFrame | None, bibs: DataFrame | None, only: str) -> DataFrame:
    how = {"no_face": (faces, "left_anti"), "no_bib": (bibs, "left_anti"), "has_bib": (bibs, "left_semi")}.get(only)
    return photos if how is None else photos.join(how[0].select("photo_id"), "photo_id", how[1])


def photo_details(photos: DataFrame, faces: DataFrame, bibs: DataFrame) -> DataFrame:
    """Per photo (photo_id, width, height): faces (face_id, bib and the box as
    fractions; a box that cannot be told is left out) and bibs (as printed, key,
    conf, source), each in a fixed order."""
    box = geometry.box_fraction(geometry.parse_box(F.col("bbox")), F.col("width"), F.col("height"))
    own = faces.join(photos.select("photo_id", "width", "height"), "photo_id").withColumn("f", box).where("f is not null")
    f = own.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("face_id", "bib", "f.x", "f.y", "f.w", "f.h"))).alias("faces"))
    row = F.struct(F.coalesce("bib_raw", "bib").alias("bib"), F.col("bib").alias("bib_key"), "conf", F.coalesce("source", F.lit("ocr")).alias("source"))
    b = bibs.groupBy("photo_id").agg(F.array_sort(F.collect_list(row)).alias("bibs"))
    joined = photos.select("photo_id").join(f, "photo_id", "left").join(b, "photo_id", "left")
    return joined.select("photo_id", *[F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("faces", "bibs")])


def event_list(events: DataFrame) -> DataFrame:
    """Published events, the latest day first; days are text and compare as such."""
    return visible(events).orderBy(F.coalesce("event_date", "created_at").desc(), "event_id")


def credits(sources: DataFrame, photos: DataFrame) -> DataFrame:
    """event_id, name, photo_count of live sources that have photos."""
    counts = photos.groupBy("source_id").agg(F.count("*").alias("photo_count"))
    return sources.where("not removed").join(counts, "source_id").orderBy(F.desc("photo_count"), "source_id").select("event_id", "source_id", "name", "photo_count")


def photo_nested(photos: DataFrame, bibs: DataFrame) -> DataFrame:
    """photo_id with its numbers as a sorted array of structs."""
    each = bibs.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("bib", "conf"))).alias("bibs"))
    return photos.select("photo_id").join(each, "photo_id", "left").withColumn("bibs", F.coalesce("bibs", F.array().cast("array<struct<bib:string,conf:double>>")))
