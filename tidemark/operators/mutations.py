"""Table changes as new snapshots: a function takes the table and the change and
returns the table after it. Changes carry ``seq``, their order of arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, text

Rule = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def new_or_old(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def larger(old: Column, new: Column) -> Column:
    """Null if either is, unlike ``greatest``."""
    return F.when(old.isNotNull() & new.isNotNull(), F.greatest(old, new))


def fold(delta: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """One row per key: 'last' arrival, last that is not null ('known'), or 'max' of each column."""
    # several rows a key at most: the changes of one batch
    place = F.struct("seq")
    how = {
        "last": lambda c: F.max_by(F.struct(c), place)[c],
        "known": lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.struct(c)), F.when(F.col(c).isNotNull(), place))[c],
        "max": lambda c: F.when(F.count(c) == F.count("*"), F.max(c)),
    }
    return delta.groupBy(*keys).agg(*[how[kind](c).alias(c) for c, kind in rules.items()])


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, Rule], when: Callable[[Callable[[str], Column]], Column] | None = None, parts: int | None = None) -> DataFrame:
    """``base`` with ``delta`` (one row a key) put in: a new row as it is, a known
    one column by column by ``rules`` (old, new); other columns stay. ``when``
    tells, from the old row's columns, whether it may change at all. ``parts``: how
    many partitions the tables take, if not the session's number."""
    names = base.columns
    old = base.select(F.struct(*names).alias("o"), *[F.col(k).alias(f"k_{k}") for k in keys])
    new = delta.select(F.struct(*delta.columns).alias("n"), *[F.col(k).alias(f"j_{k}") for k in keys])
    if parts is not None:
        own = [k for k in keys if k != "event_id"]  # a constant event is no key of the join; others come to one more shuffle
        old, new = old.repartition(parts, *[f"k_{k}" for k in own]), new.repartition(parts, *[f"j_{k}" for k in own])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"k_{k}") == F.col(f"j_{k}"))
    joined = old.join(new, on, "full")
    is_new, touched = F.col("o").isNull(), F.col("n").isNotNull()
    if when is not None:
        touched = touched & F.coalesce(when(lambda c: F.col("o")[c]), F.lit(False))
    out = []
    for c in names:
        given = F.col("n")[c] if c in delta.columns else F.lit(None).cast(base.schema[c].dataType)
        changed = rules[c](F.col("o")[c], given) if c in rules else F.col("o")[c]
        out.append(F.when(is_new, given).when(touched, changed).otherwise(F.col("o")[c]).alias(c))
    return joined.select(*out)


def insert_ignore(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and, of ``rows``, those whose keys it has not, one each (the first by ``seq`` if
    there is one); known rows stay as they are. Null keys are like no other."""
    fresh = rows.join(base.select(*keys).distinct(), keys, "left_anti")
    if "seq" in rows.columns:
        known = [F.col(k).isNotNull() for k in keys]
        whole = known[0]
        for k in known[1:]:
            whole = whole & k
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
        fresh = fresh.withColumn("place_", F.when(whole, place).otherwise(1)).where("place_ = 1").drop("place_")
    else:
        fresh = fresh.dropDuplicates(keys)
    return base.unionByName(fresh.select(*[c for c in base.columns if c in fresh.columns]), allowMissingColumns=True)


def write_photos(photos: DataFrame, delta: DataFrame, pending: bool = True) -> DataFrame:
    """delta: event_id, file_id, source_id, thumb_key, width, height, seq. Known
    sizes are kept where none is given; faces are due again only if ``pending``."""
    keys = ["event_id", "file_id"]
    folded = fold(delta, keys, {"photo_id": "last", "source_id": "last", "thumb_key": "last", "width": "known", "height": "known"}).withColumn("faces_done", F.lit(0))
    rules: dict[str, Rule] = {"thumb_key": take_new, "width": new_or_old, "height": new_or_old}
    if pending:
        rules["faces_done"] = take_new
    return upsert(photos, folded, keys, rules)


def write_bibs(bibs: DataFrame, delta: DataFrame, rejects: DataFrame, replaced: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Read numbers (event_id, photo_id, bib, conf, bib_raw, seq): those rejected
    before are left out, read ones of ``replaced`` photos (event_id, photo_id) go
    first, the larger confidence and the last print stay, and what a person
    entered is never changed. ``parts`` as in ``upsert``."""
    keys = ["event_id", "photo_id", "bib"]
    pair = ["photo_id", "bib"]
    listed = rejects.select(*pair)
    if parts is not None:
        delta, listed = delta.repartition(parts, *pair), listed.repartition(parts, *pair)
    kept = delta.join(listed, pair, "left_anti")
    folded = fold(kept, keys, {"conf": "max", "bib_raw": "last"}).withColumn("source", F.lit("ocr"))
    return upsert(drop_read(bibs, replaced, parts), folded, keys, {"conf": larger, "bib_raw": take_new}, lambda old: old("source") == "ocr", parts)


def drop_read(bibs: DataFrame, photos: DataFrame | None, parts: int | None = None) -> DataFrame:
    """Without the read numbers of ``photos``; entered ones stay."""
    if photos is None:
        return bibs
    listed = photos.select(F.col("photo_id").alias("r_photo"))
    if parts is not None:
        bibs, listed = bibs.repartition(parts, "photo_id"), listed.repartition(parts, "r_photo")
    return bibs.join(listed, (F.col("photo_id") == F.col("r_photo")) & (F.col("source") == "ocr"), "left_anti")


def enter_bibs(bibs: DataFrame, delta: DataFrame, parts: int | None = None) -> DataFrame:
    """Numbers that a person entered: event_id, photo_id, bib, bib_raw, seq."""
    keys = ["event_id", "photo_id", "bib"]
    folded = fold(delta, keys, {"bib_raw": "last"}).withColumns({"conf": F.lit(1.0), "source": F.lit("manual")})
    return upsert(bibs, folded, keys, {"conf": take_new, "bib_raw": take_new, "source": take_new}, parts=parts)


def reject(rejects: DataFrame, pairs: DataFrame) -> DataFrame:
    return rejects.unionByName(pairs.join(rejects.select("photo_id", "bib"), ["photo_id", "bib"], "left_anti").distinct(), allowMissingColumns=True)


def unreject(rejects: DataFrame, pairs: DataFrame) -> DataFrame:
    return rejects.join(pairs.select("photo_id", "bib"), ["photo_id", "bib"], "left_anti")


def write_faces(faces: DataFrame, delta: DataFrame, event_id: int, base: int, count: int) -> DataFrame:
    """Replaces an event's rows base .. base + count - 1; a repeated write changes nothing."""
    inside = (F.col("event_id") == event_id) & F.col("row_idx").between(base, base + count - 1)
    return faces.where(~inside).unionByName(delta.where(inside).dropDuplicates(["event_id", "row_idx"]))


def misfits(delta: DataFrame, photos: DataFrame) -> DataFrame:
    """Face rows (photo_id, bbox) whose box does not lie in their photo's frame; a
    photo that is not known is not judged here."""
    known = photos.select("photo_id", F.col("width").alias("frame_w"), F.col("height").alias("frame_h"))
    box = geometry.parse_box(F.col("bbox"))
    fits = F.when(F.col("frame_h").isNull() | F.col("frame_w").isNull(), F.lit(True)).otherwise(F.coalesce(geometry.box_fits(F.col("box_"), F.col("frame_w"), F.col("frame_h")), F.lit(False)))
    return delta.withColumn("box_", box).join(known, "photo_id").where(~fits).drop("box_")


def write_checked_faces(faces: DataFrame, delta: DataFrame, photos: DataFrame, event_id: int, base: int, count: int) -> DataFrame:
    """As ``write_faces``; refuses the whole write if one box does not fit its photo."""
    wrong = misfits(delta, photos).select("photo_id", "bbox", "frame_w", "frame_h").limit(1).collect()
    if wrong:
        raise ValueError(f"face box does not fit its photo: {wrong[0].asDict()}")
    return write_faces(faces, delta, event_id, base, count)


def write_directory(directory: DataFrame, delta: DataFrame) -> DataFrame:
    """Shard rows (event_id, shard_key, row_base, row_count, seq): the last one given stays."""
    keys = ["event_id", "shard_key"]
    folded = fold(delta, keys, {"row_base": "last", "row_count": "last"})
    return upsert(directory, folded, keys, {"row_base": take_new, "row_count": take_new})


def write_sources(sources: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources after it, refused changes). delta: event_id, folder_id, source_id, url,
    added_at, image_source, is_operator, seq. A withdrawn folder is refused until it is
    restored. Only an operator chooses the image source; what they leave out or
    misspell stays as it was, 'original' at first. A known folder keeps its id."""
    keys = ["event_id", "folder_id"]
    gone = sources.where("removed_at is not null").select(*keys)
    refused = delta.join(gone, keys, "left_semi")
    rest = delta.join(gone, keys, "left_anti")
    old = sources.select(*keys, F.col("image_source").alias("was"))
    given = F.when(F.col("image_source").isin("thumb", "original"), F.col("image_source"))
    chosen = F.when(F.col("is_operator"), given).otherwise("thumb")
    folded = fold(rest.withColumn("image_source", chosen), keys, {"source_id": "last", "url": "last", "added_at": "last", "image_source": "known"})
    told = folded.join(old, keys, "left").withColumn("image_source", F.coalesce("image_source", "was", F.lit("original"))).drop("was")
    return upsert(sources, told, keys, {"url": take_new, "image_source": take_new}), refused


def restore_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    return mark(sources, ids, "source_id", "removed_at", F.lit(None).cast(sources.schema["removed_at"].dataType))


def start_indexing(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Drafts among ``ids`` are being indexed from now on; published events stay published."""
    return mark(events, ids, "event_id", "status", F.when(F.col("status") == "draft", "indexing").otherwise(F.col("status")))


def add_organizers(organizers: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: email, added_at, added_by, seq. Adding someone again lifts a ban."""
    folded = fold(delta.withColumn("email", text.clean_email(F.col("email"))).where("email is not null"), ["email"], {"added_at": "last", "added_by": "last"})
    gone = lambda old, new: F.lit(None).cast("string")
    return upsert(organizers, folded, ["email"], {"banned_at": gone, "reason": gone})


def ban(organizers: DataFrame, events: DataFrame, delta: DataFrame, own_email: str, unpublish: bool = True) -> tuple[DataFrame, DataFrame]:
    """(organizers, events) after bans (email, banned_at, banned_by, reason, seq);
    the operator's own address is left out. Someone who is on no list is put on it.
    With ``unpublish`` the ready events of the banned become drafts."""
    mail = text.clean_email(F.col("email"))
    reason = F.nullif(F.substring(text.stripped(F.col("reason")), 1, 200), F.lit(""))
    given = delta.withColumns({"email": mail, "reason": reason}).where((F.col("email").isNotNull()) & (F.col("email") != own_email))
    folded = fold(given, ["email"], {"banned_at": "last", "banned_by": "last", "reason": "last"})
    rows = folded.select("email", F.col("banned_at").alias("added_at"), F.col("banned_by").alias("added_by"), "banned_at", "reason")
    after = upsert(organizers, rows, ["email"], {"banned_at": take_new, "reason": take_new})
    if not unpublish:
        return after, events
    hit = events.join(rows.select(F.col("email").alias("b_email")), F.lower("owner_email") == F.col("b_email"), "left_semi").where("status = 'ready'")
    return after, mark(events, hit.select("event_id"), "event_id", "status", F.lit("draft"))


def withdraw(tables: dict[str, DataFrame], ids: DataFrame, now: Column) -> dict[str, DataFrame]:
    """``tables`` (sources, photos, faces, bibs, rejects, events) after the sources
    ``ids`` were taken off: ``removed_at`` is set once, their photos go with all that
    hangs on them, and their events are counted anew. The source rows stay, as the
    memory that keeps the folder from coming back."""
    first = F.coalesce("removed_at", now)
    sources = mark(tables["sources"], ids, "source_id", "removed_at", first)
    gone = tables["photos"].join(ids.select("source_id").distinct(), "source_id", "left_semi")
    out = {"sources": sources, **{name: purge(tables[name], gone) for name in ("photos", "faces", "bibs", "rejects")}}
    touched = tables["sources"].join(ids.select("source_id").distinct(), "source_id", "left_semi").select("event_id").distinct()
    return {**out, "events": recount(tables["events"], touched, out["photos"], out["faces"])}


def recount(events: DataFrame, ids: DataFrame, photos: DataFrame, faces: DataFrame) -> DataFrame:
    """photo_count and face_count of the events ``ids``, from the rows there are."""
    owned = photos.groupBy("event_id").agg(F.count("*").alias("photos_"))
    found = faces.join(photos.select("photo_id", "event_id"), "photo_id").groupBy("event_id").agg(F.count("*").alias("faces_"))
    new = ids.select("event_id").distinct().join(owned, "event_id", "left").join(found, "event_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = new.select(F.col("event_id").alias("c_event"), n("photos_").alias("photos_"), n("faces_").alias("faces_"))
    joined = events.join(counted, F.col("event_id") == F.col("c_event"), "left")
    of = {"photo_count": "photos_", "face_count": "faces_"}
    return joined.select(*[F.when(F.col("c_event").isNotNull(), F.col(of[c])).otherwise(F.col(c)).cast(events.schema[c].dataType).alias(c) if c in of else F.col(c) for c in events.columns])


def reset_photos(faces: DataFrame, bibs: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, bibs) without what was read from ``photos``; numbers that a person entered stay."""
    return purge(faces, photos), drop_read(bibs, photos)


def write_progress(jobs: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: job_id, done, total, status (null: as before), error and error_set
    (given at all, perhaps as null), updated_at; one row a job."""
    told = patch(jobs, delta.select("job_id", "error", "error_set"), "job_id", ["error"])
    new = delta.select("job_id", "done", "total", "status", "updated_at")
    return upsert(told, new.join(jobs.select("job_id"), "job_id", "left_semi"), ["job_id"], {"done": new_or_old, "total": new_or_old, "status": new_or_old, "updated_at": take_new})


STATUSES = ("draft", "indexing", "ready", "partial")


def patch_events(events: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events after it, refused: event_id, error). A null in delta (event_id, name,
    event_date, status, bibs_enabled, bib_min_digits, bib_max_digits, bib_prefixes,
    bib_prefix_required) leaves a column as it is; an empty prefix list clears it and
    the flag with it. A change is judged by the row it would leave, and refused whole."""
    plain = ["name", "event_date", "status", "bibs_enabled", "bib_min_digits", "bib_max_digits"]
    listed = text.canonical_prefixes(F.col("bib_prefixes"))
    given = delta.withColumns(
        {
            "bad_list": F.col("bib_prefixes").isNotNull() & listed.isNull(),
            "bib_prefixes": F.when(F.col("bib_prefixes").isNotNull(), listed),
            "bib_prefix_required": F.when(F.col("bib_prefixes").isNotNull() & (F.coalesce(listed, F.lit("")) == ""), F.lit(False)).otherwise(F.col("bib_prefix_required")),
        }
    )
    names = [*plain, "bib_prefixes", "bib_prefix_required"]
    joined = events.select("event_id", *[F.col(c).alias(f"o_{c}") for c in names]).join(given, "event_id")
    merged = joined.select("event_id", "bad_list", *[F.coalesce(c, f"o_{c}").alias(c) for c in names])
    rule = text.rule_error(F.coalesce("bib_min_digits", F.lit(3)), F.coalesce("bib_max_digits", F.lit(5)), F.coalesce("bib_prefixes", F.lit("")), F.coalesce("bib_prefix_required", F.lit(False)))
    error = F.when(~F.col("status").isin(*STATUSES), "bad_status").when(F.col("bad_list"), "bad_bib_prefixes").otherwise(rule)
    judged = merged.withColumn("error", error)
    sound = judged.where("error is null").select("event_id", *names)
    return upsert(events, sound, ["event_id"], dict.fromkeys(names, take_new)), judged.where("error is not null").select("event_id", "error")


def purge(child: DataFrame, photos: DataFrame) -> DataFrame:
    return child.join(photos.select("photo_id"), "photo_id", "left_anti")


def patch(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """delta: key and, for each column, the value and ``<column>_set``: whether it
    is given at all, so that null can be told from absent."""
    new = delta.select(F.col(key).alias("p_key"), *[F.col(c).alias(f"p_{c}") for c in columns], *[F.col(f"{c}_set") for c in columns])
    joined = base.join(new, F.col(key) == F.col("p_key"), "left")
    value = lambda c: F.when(F.coalesce(F.col(f"{c}_set"), F.lit(False)), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in columns else F.col(c) for c in base.columns])


def mark(base: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    marked = ids.select(F.col(key).alias("m_key")).distinct().withColumn("m_", F.lit(True))
    return base.join(marked, F.col(key) == F.col("m_key"), "left").select(*[F.when(F.col("m_"), value).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in base.columns])


def fill_blank(base: DataFrame, column: str, value: Column) -> DataFrame:
    blank = F.col(column).isNull() | (F.trim(column) == "")
    return base.withColumn(column, F.when(blank, value).otherwise(F.col(column)))


def finalize(events: DataFrame, photos: DataFrame, faces: DataFrame, short: DataFrame) -> DataFrame:
    """Counts for every event; 'partial' where a source is short, 'ready' otherwise, drafts stay drafts."""
    owned = photos.groupBy("event_id").agg(F.count("*").alias("photos_"))
    found = faces.join(photos.select("photo_id", F.col("event_id").alias("of_")), "photo_id").groupBy(F.col("of_").alias("event_id")).agg(F.count("*").alias("faces_"))
    lacking = short.groupBy("event_id").agg(F.count("*").alias("short_"))
    joined = events.join(owned, "event_id", "left").join(found, "event_id", "left").join(lacking, "event_id", "left")
    status = F.when(F.col("status") == "draft", "draft").when(F.col("short_") > 0, "partial").otherwise("ready")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select("event_id", status.alias("status"), n("photos_").alias("photo_count"), n("faces_").alias("face_count"), n("short_").alias("short_sources"))


def repair_sources(sources: DataFrame, child: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One source (source_id, event_id, folder_id, image_source) per event and
    folder, the least id, 'thumb' if any of them was; ``child`` points to it."""
    key = ["event_id", "folder_id"]
    kept = sources.groupBy(*key).agg(F.min("source_id").alias("source_id"), F.when(F.max((F.col("image_source") == "thumb").cast("int")) == 1, "thumb").otherwise("original").alias("image_source"))
    to = sources.select(F.col("source_id").alias("old_"), *key).join(kept.select(*key, F.col("source_id").alias("new_")), key).select("old_", "new_")
    moved = child.join(to, F.col("source_id") == F.col("old_"), "left").select(*[F.coalesce("new_", c).alias(c) if c == "source_id" else F.col(c) for c in child.columns])
    return kept.select("source_id", *key, "image_source"), moved


def contiguity(shards: DataFrame) -> DataFrame:
    """Per event: rows, and whether its shards (event_id, shard_key, row_base,
    row_count) tile them: 'ok', 'not_contiguous' or 'bad_row_count'."""
    order = Window.partitionBy("event_id").orderBy("row_base", "shard_key")
    before = F.coalesce(F.sum("row_count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = shards.withColumn("gap", F.col("row_base") != before).withColumn("bad", F.col("row_count") <= 0)
    state = F.when(F.max("bad"), "bad_row_count").when(F.max("gap"), "not_contiguous").otherwise("ok")
    return told.groupBy("event_id").agg(F.count("*").alias("shards"), F.sum("row_count").alias("row_count"), state.alias("state"))


def allocate(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Row ranges for requests (event_id, shard_key, row_count, seq): the range a
    shard has if it is long enough, else new rows after all others, in order."""
    old = existing.select("event_id", "shard_key", F.col("row_base").alias("old_base"), F.col("row_count").alias("old_count"))
    top = existing.groupBy("event_id").agg(F.max(F.col("row_base") + F.col("row_count")).alias("top"))
    joined = requests.join(old, ["event_id", "shard_key"], "left").join(top, "event_id", "left")
    reused = F.coalesce(F.col("old_count") >= F.col("row_count"), F.lit(False))
    told = joined.withColumn("reused", reused).withColumn("fresh", F.when(F.col("reused"), 0).otherwise(F.col("row_count")))
    order = Window.partitionBy("event_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.when(F.col("reused"), F.col("old_base")).otherwise(F.coalesce("top", F.lit(0)) + F.coalesce(F.sum("fresh").over(order), F.lit(0)))
    return told.withColumn("row_base", base).select("event_id", "shard_key", "row_base", "row_count", "reused")
