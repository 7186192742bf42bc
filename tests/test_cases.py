"""Rules and invariants of the functions and operators, on generated cases."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import geometry, text, vectors
from tidemark.operators import mutations, reports, search, tokens
from tidemark.sources import shards
from tidemark.streaming import ingest

C = F.col


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.out for r in df.select("i", expr(C("v")).alias("out")).orderBy("i").collect()]


BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stored_form(printed, lenient):
    """The rule of a stored number, a character at a time."""
    inner = (printed or "").strip(BLANKS)
    plain = "".join(c for c in inner if c not in (BLANKS + "#-" if lenient else " -")).upper()
    letters = plain.rstrip("0123456789")
    digits = plain[len(letters) :]
    if not (len(letters) <= 2 and all("A" <= c <= "Z" for c in letters) and 1 <= len(digits) <= 5):
        return ""
    return (letters + "-" if letters else "") + (digits.lstrip("0") or "0")


def printed_numbers(rng, n):
    """Numbers as they may be printed, right ones and wrong ones about evenly."""
    some = lambda chars, most: "".join(rng.choices(chars, k=rng.randint(0, most)))
    out = [None, ""]
    for _ in range(n):
        pad = some(BLANKS, 2) if rng.random() < 0.4 else ""
        lead = some("BHTWbtwé5", 3) if rng.random() < 0.7 else ""
        join = rng.choice(["", "", "-", " ", "#", "--", "\t", "_"])
        count = rng.choice([0, 1, 2, 3, 4, 5, 5, 6])
        body = "0" * rng.randint(0, count) + some("123456789", 6)
        out.append(pad + lead + join + body[:count] + rng.choice(["", "", "", "x", " ", "\u0664"]) + pad)
    return out


def test_numbers(spark):
    given = printed_numbers(random.Random(1), 600)
    for lenient in (True, False):
        got = column(spark, given, lambda v, k=lenient: text.normalize_bib(v, k))
        assert got == [stored_form(v, lenient) for v in given]
        assert sum(map(bool, got)) > 100 < sum(not v for v in got)
    kept = sorted({stored_form(v, True) for v in given} - {""})
    assert column(spark, kept, text.bib_prefix) == [v.partition("-")[0] if "-" in v else "" for v in kept]
    assert column(spark, kept, text.bib_digits) == [v.rpartition("-")[2] for v in kept]


def listed(raw):
    parts = [p.strip(BLANKS).upper() for p in (raw or "").replace(";", ",").split(",")]
    return list(dict.fromkeys(p for p in parts if p.isascii() and p.isalpha() and len(p) <= 2))


def test_prefix_lists(spark):
    rng = random.Random(2)
    raw = [None, "", " \t", *("".join(rng.choices(["h", "B", "tw", "HTW", "7", ",", ";", ", ", "\t", "é"], k=rng.randint(1, 9))) for _ in range(300))]
    assert column(spark, raw, text.parse_prefixes) == [listed(r) for r in raw]
    told = [",".join(listed(r)) if listed(r) else "" if not (r or "").strip(BLANKS) else None for r in raw]
    assert column(spark, raw, text.canonical_prefixes) == told


def gate_open(read, least, prefixes, most, required):
    """A rule's answer by splitting the read, without a pattern."""
    top = min(max(int(most or 5), 1), 5)
    low = min(max(int(least or 3), 1), top)
    read = (read or "").strip(BLANKS)
    letters = [p.upper() for p in prefixes or [] if p.isascii() and p.isalpha() and 1 <= len(p) <= 2]
    digits = read.lstrip("".join(c for c in read if not c.isdigit() or c > "9"))
    lead = read[: len(read) - len(digits)]
    if not (low <= len(digits) <= top and all("0" <= c <= "9" for c in digits)):
        return False
    if not lead:
        return not (required and letters)
    bare = lead[:-1] if lead[-1] == "-" or lead[-1] in " \t\n\x0b\f\r" else lead
    return bare.upper() in letters


def test_gate(spark):
    rng = random.Random(3)
    for _ in range(25):
        least, most = rng.choice([None, -3, 0, 1, 2, 4, 5, 9]), rng.choice([None, -1, 1, 3, 5, 8])
        prefixes, required = rng.choice([None, [], ["H"], ["tw", "H"], ["HTW", "7"], ["B", "TW"]]), rng.random() < 0.4
        reads = [lead + join + "7204615"[:n] + tail for lead in ("", "H", "h", "TW", "B", "X") for join in ("", "-", " ", "--") for n in range(7) for tail in ("", "k") if rng.random() < 0.5]
        got = column(spark, reads, lambda v, r=(least, prefixes, most, required): text.passes_gate(v, *r))
        assert got == [gate_open(r, least, prefixes, most, required) for r in reads], (least, prefixes, most, required)


def test_small_text_functions(spark):
    assert column(spark, ["Café  Ångström!", "--A__b--", None, "x" * 80], text.slugify) == ["cafe-angstrom", "a-b", "", "x" * 60]
    clocks = ["2024:05:01 7:03:09", "2024:05:01 24:03", "x", None, "9:15", "\t21:40 ", "2024:05:01", "9:15 late", "x9:15"]
    assert column(spark, clocks, text.clock_time) == ["07:03", None, None, None, "09:15", "21:40", None, None, None]
    assert column(spark, ["2024-05-01", "2024-05-01T22:10:00Z", "2024-13-01", "soon", None], text.format_date) == ["1 May 2024", "1 May 2024", "2024-13-01", "soon", None]
    links = ["https://x/drive/folders/ab?y", "/folders/a", "open?id=q-1&z", "t" * 20, "t" * 19, "https://photos.google.com/folders/abc", None]
    assert column(spark, links, text.folder_id) == ["ab", "a", "q-1", "t" * 20, None, None, None]
    assert column(spark, ["a/b", ""], lambda v: text.asset_url("", v)) == ["/r2/a/b", None]
    assert column(spark, ["2024-05-01", "soon", None], text.long_date) == ["1 May 2024", None, None]
    assert column(spark, ["<a href=\"x\">&'</a>"], text.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;&lt;/a&gt;"]
    kinds = {"image/webp": "webp", "image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/avif": "avif", "image/gif": None, "": None}
    for pad in ("", " ", "\t", "\u00a0\n"):
        given = [f"{pad}{k.upper()}{pad}; q=1" for k in kinds]
        assert column(spark, [*given, None], text.image_extension) == [*kinds.values(), None]
        mails = [f"{pad}Run.Ner@Club.Example{pad}", f"{pad}two words@club.example", "no-at.example", "a@nodot", f"{'x' * 187}@club.example{pad}", f"{'x' * 188}@club.example"]
        assert column(spark, [*mails, None], text.clean_email) == ["run.ner@club.example", None, None, None, f"{'x' * 187}@club.example", None, None]
    assert column(spark, ["short", "a" * 10, None], text.file_id_ok) == [False, True, False]


def box(spark, b, frame, expr):
    df = spark.createDataFrame([Row(b=Row(x=float(b[0]), y=float(b[1]), w=float(b[2]), h=float(b[3])))], "b struct<x:double,y:double,w:double,h:double>")
    size = [F.lit(v).cast("int") for v in frame]
    return df.select(expr(C("b"), *size).alias("out")).first().out


NAN = float("nan")


INF = float("inf")


def test_boxes_at_every_edge(spark):
    """Fractions are clamped, fits allow a quarter of the long edge: boxes at, just inside and just over each bound."""
    rows = []
    for width, height in ((640, 1200), (1600, 900), (None, 900), (640, 0), (640, None)):
        w, h = width or 640, height or 900
        slack = max(w, h) / 4
        for x in (-slack - 1, -slack, 0.0, w / 3, w + slack - 40, w + slack - 39):
            for y in (-slack - 1, -slack, 7.0, h + slack - 30, h + slack - 29):
                rows.append((x, y, 40.0, 30.0, width, height))
        rows += [(5.0, 5.0, 0.0, 9.0, width, height), (5.0, 5.0, 9.0, -1.0, width, height), (NAN, 5.0, 9.0, 9.0, width, height), (5.0, INF, 9.0, 9.0, width, height), (5.0, 5.0, None, 9.0, width, height)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x double, y double, w double, h double, width int, height int")
    b = F.struct("x", "y", "w", "h")
    got = df.select("i", geometry.box_fraction(b, C("width"), C("height")).alias("part"), geometry.box_fits(b, C("width"), C("height")).alias("fits")).orderBy("i").collect()
    for (x, y, w, h, width, height), r in zip(rows, got, strict=True):
        known = bool(width and height)
        sound = all(v is not None and abs(v) < INF for v in (x, y, w, h))
        if not known or not sound:
            assert r.part is None and r.fits is (not known)
            continue
        clamp = lambda v: max(0.0, min(1.0, v))
        assert tuple(r.part) == pytest.approx((clamp(x / width), clamp(y / height), clamp(w / width), clamp(h / height)))
        slack = max(width, height) / 4
        assert r.fits is (w > 0 and h > 0 and x >= -slack and y >= -slack and x + w <= width + slack and y + h <= height + slack)


def test_similarity_recovers_a_turn(spark):
    source = [(0.0, 0.0), (4.0, 0.0), (1.0, 3.0)]
    target = [(-y * 2 + 5, x * 2 - 1) for x, y in source]
    df = spark.createDataFrame([(source, target)], "s array<struct<x:double,y:double>>, t array<struct<x:double,y:double>>")
    assert tuple(df.select(geometry.similarity(C("s"), C("t")).alias("m")).first().m) == pytest.approx((0, 2, 5, -1))


def test_similarity_of_one_place_is_the_identity(spark):
    df = spark.createDataFrame([([(2.0, 3.0)] * 3, [(1.0, 1.0), (4.0, 0.0), (0.0, 9.0)])], "s array<struct<x:double,y:double>>, t array<struct<x:double,y:double>>")
    assert tuple(df.select(geometry.similarity(C("s"), C("t")).alias("m")).first().m) == (1.0, 0.0, 0.0, 0.0)


def test_sample_is_whole_under_merged_partitions(spark):
    """Wide rows make the planner merge ranges in one branch and not in the other."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        wide = spark.range(40_000).select(C("id"), *[F.sha2((C("id") * k).cast("string"), 512).alias(f"w{k}") for k in (3, 7)])
        got = sorted(r.id for r in reports.systematic_sample(wide, 40_000, 400, "id").collect())
        assert got == list(range(0, 40_000, 100))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


def test_accept_takes_reads_without_a_box(spark):
    rows = [("4 2", 0.9, None), ("42", 0.9, 5.0), ("42", 0.5, None), (" 42\t", 0.7, 20.0)]
    df = spark.createDataFrame(rows, "text string, conf double, width double").withColumn("frame_width", F.lit(2000))
    assert [r.text for r in tokens.accept(df, "^[0-9]{2}$").collect()] == ["4 2", " 42\t"]


def test_misfit_refuses_the_write(spark):
    photos = spark.createDataFrame([(1, 1000, 500), (2, None, 500)], "photo_id long, width int, height int")
    faces = spark.createDataFrame([(1, 1, 0, "[0,0,10,10]")], "event_id long, photo_id long, row_idx long, bbox string")
    good = spark.createDataFrame([(1, 1, 0, "[5,5,10,10]"), (1, 2, 1, "[9000,0,5,5]"), (1, 9, 2, "[9000,0,5,5]")], faces.schema)
    assert mutations.write_checked_faces(faces, good, photos, 1, 0, 3).count() == 3
    for bad in ("[4000,5,10,10]", "[1,2,3]", "x"):
        with pytest.raises(ValueError, match="does not fit"):
            mutations.write_checked_faces(faces, spark.createDataFrame([(1, 1, 0, bad)], faces.schema), photos, 1, 0, 3)


def test_vectors_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(e, i, [i % 100, e]) for e in (1, 2) for i in range(50)], "event_id long, row_idx long, codes array<tinyint>").repartition(4)
    shards.write_vectors(rows, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(tuple(r) for r in back.select("event_id", "row_idx", "codes").collect()) == sorted(tuple(r) for r in rows.collect())


def follows(letter, digits):
    """Whether the number stands after the letter on its line (x1, y1, x2, y2 of each)."""
    w, h, dh = max(letter[2] - letter[0], 1), max(letter[3] - letter[1], 1), max(digits[3] - digits[1], 1)
    gap, row = digits[0] - letter[2], min(letter[3], digits[3]) - max(letter[1], digits[1])
    return letter[0] < digits[0] and letter[2] < digits[2] and -0.8 * w <= gap <= 1.5 * max(w, h) and row >= 0.5 * min(h, dh)


def test_rejoin(spark):
    rng = random.Random(5)
    rows, expect = [], []
    for k in range(400):
        x, y, w, h = rng.randint(0, 200), rng.randint(0, 60), rng.choice([0.5, 20, 90]), rng.choice([0.5, 40, 80])
        near = x + w + rng.choice([-0.8 * w, -0.8 * w - 1, 0, 1.5 * max(w, h, 1), 1.5 * max(w, h, 1) + 1, -w - 5])
        top = y + rng.choice([0, h / 2, h / 2 + 1, h])
        letter, digits = (x, y, x + w, y + h), (near, top, near + rng.choice([3, 120]), top + rng.choice([0.5, h]))
        shown, number = rng.choice(["H", "h- ", "TW", "X", "\tB-"]), rng.choice(["0815", " 77\n", "7a"])
        rows += [(str(k), shown, 0.9, *map(float, letter)), (str(k), number, 0.6, *map(float, digits))]
        name = shown.strip().upper().rstrip("-")
        if name in ("H", "TW", "B") and number.strip().isdigit() and follows(letter, digits):
            expect.append((str(k), f"{name}-{number.strip()}", 0.6))
    df = spark.createDataFrame(rows, "crop_id string, text string, conf double, x1 double, y1 double, x2 double, y2 double")
    out = [(r.crop_id, r.text, r.conf) for r in tokens.rejoin_prefixes(df, ["h", "TW", "B"]).collect()]
    assert sorted(out) == sorted([r[:3] for r in rows] + expect) and len(expect) > 40


def test_prefer_prefixed(spark):
    """A bare number goes if and only if its crop shows the same digits under a prefix."""
    rng = random.Random(6)
    rows = [(str(c), rng.choice(["", "H-", "TW-"]) + str(rng.randint(1, 4)), rng.random()) for c in range(60) for _ in range(rng.randint(1, 4))]
    full = {(c, b.rpartition("-")[2]) for c, b, _ in rows if "-" in b}
    df = spark.createDataFrame(rows, "crop_id string, bib string, conf double")
    assert sorted(map(tuple, tokens.prefer_prefixed(df).collect())) == sorted(r for r in rows if "-" in r[1] or r[:2] not in full)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both, 1e-6)


def test_suppression_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        x, y, w, h = rng.integers(0, 100, 2).tolist() + rng.integers(20, 80, 2).tolist()
        rows.append((k % 9, k, float(k * 7 % 50), 1 + k % 2, float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, "photo_id int, box_id int, score double, scale int, x1 double, y1 double, x2 double, y2 double")
    for two in (False, True):
        expect = set()
        for p in range(9):
            kept = []
            for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3] if two else 0, -r[2], r[1])):
                if (two and r[3] == 1) or all(overlap(r[4:], o[4:]) <= 0.4 for o in kept):
                    kept.append(r)
            expect |= {r[1] for r in kept}
        got = (tokens.merge_scales if two else tokens.suppress)(df, "photo_id")
        assert {r.box_id for r in got.collect()} == expect


def test_limits():
    assert [vectors.clamp_threshold(v) for v in (None, "", "x", "0.5", 7, "nan")] == [0.38, 0.2, 0.38, 0.5, 1.0, 0.38]
    assert [vectors.clamp_limit(v, 40, 60) for v in (None, "", -1, 0, "7.9", 100, "inf")] == [40, 40, 40, 40, 7, 60, 40]


def test_pending_is_a_set_difference(spark):
    ids = lambda p, n: [(f"{p}-{i}",) for i in range(n)]
    folder, known = (spark.createDataFrame(r, "id string") for r in (ids("a", 510), ids("b", 601) + ids("a", 250)))
    assert reports.only_in(folder, known, "id").count() == 260


def test_ties_keep_the_first_row(spark):
    scored = spark.createDataFrame([(i, 16129) for i in range(300)], "row_idx long, score long")
    faces = spark.createDataFrame([(i, i // 2) for i in range(300)], "row_idx long, photo_id long")
    photos = spark.createDataFrame([(i, i % 3) for i in range(150)], "photo_id long, source_id long")
    sources = spark.createDataFrame([(0, True), (1, False), (2, False)], "source_id long, removed boolean")
    got = [(r.photo_id, r.row_idx) for r in search.face_search(scored, faces, photos, sources, 0.38).collect()]
    assert got == [(p, 2 * p) for p in range(100) if p % 3][:60]
    first = search.face_search(scored, faces, photos, sources, 0.38, top_faces=10, live_first=True)
    assert [r.photo_id for r in first.collect()] == [1, 2, 4, 5, 7]


def test_rows_without_a_whole_vector_have_no_score(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.5, None]), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [])]
    table = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    got = search.score_vectors(table, [127, 0], 0, ["id"]).collect()
    assert sorted((r.id, r.score) for r in got) == [(1, 16129), (5, 0)]
    whole = table.select("id", vectors.quantize_index(C("vector")).alias("codes"))
    some = search.scores_of(whole, np.array([[127, 0]]), [9], 1)
    assert sorted(map(tuple, some.collect())) == [(9, 1, 16129)]
    two = whole.where("size(codes) = 2 or codes is null")
    assert sorted((r.query, r.id) for r in search.scores_of_many(two, two, 1).collect()) == [(1, 1), (5, 5)]
    assert search.similar_pairs(two, 0.1, 4).count() == 0
    assert search.score_vectors(table.where("vector is null"), [127, 0], 0, ["id"]).count() == 0


def test_a_replayed_write_changes_nothing(spark):
    bibs = spark.createDataFrame([(1, 1, "7", 0.5, "7", "ocr"), (1, 2, "8", 0.4, "8", "manual")], "event_id long, photo_id long, bib string, conf double, bib_raw string, source string")
    delta = spark.createDataFrame([(1, 1, "7", 0.9, "007", 1), (1, 1, "7", 0.8, "07", 2), (1, 2, "8", 0.9, "x", 3), (1, 3, "9", None, "9", 4)], "event_id long, photo_id long, bib string, conf double, bib_raw string, seq int")
    rejects = spark.createDataFrame([(3, "9")], "photo_id long, bib string")
    once = mutations.write_bibs(bibs, delta, rejects)
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, 1, "7", 0.9, "07", "ocr"), (1, 2, "8", 0.4, "8", "manual")]
    assert sorted(map(tuple, mutations.write_bibs(once, delta, rejects).collect())) == rows
    replaced = mutations.write_bibs(once, delta.limit(0), rejects, spark.createDataFrame([(1,), (2,)], "photo_id long"))
    assert [r.source for r in replaced.collect()] == ["manual"]


def test_shards_through_files(spark, tmp_path):
    (tmp_path / "index").mkdir()
    codes = np.arange(-8, 8, dtype=np.int8).reshape(4, 4)
    (tmp_path / "index" / "a.bin").write_bytes(codes[:3].tobytes())
    (tmp_path / "index" / "b.bin").write_bytes(codes[3:].tobytes()[:2])  # cut short
    listed = spark.createDataFrame([("a", 1, 0, 3), ("b", 1, 3, 1), ("c", 1, 4, 2)], "shard_key string, event_id long, row_base long, row_count long")
    got = shards.explode_shards(shards.read_shards(spark, str(tmp_path / "index")), listed, 4).orderBy("row_idx").collect()
    assert [(r.row_idx, list(r.codes)) for r in got] == [(i, codes[i].tolist()) for i in range(3)]


@pytest.mark.parametrize(("stop", "deadline", "outcome"), [(lambda: False, None, "done"), (lambda: True, None, "stopped"), (lambda: 1 / 0, None, "done"), (lambda: False, 0.0, "time")])
def test_stream_stops_between_batches(spark, tmp_path, stop, deadline, outcome):
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    args = (spark, str(tmp_path / "in/*"), "id long", str(tmp_path / "out"), str(tmp_path / "state"))
    assert ingest.run_stream(*args, stop=stop, deadline=deadline) in {outcome, "done"}
    if outcome == "time":
        assert ingest.committed(spark, str(tmp_path / "out")).count() >= 10
    assert ingest.run_stream(*args) == "done"
    assert sorted(r.id for r in ingest.committed(spark, str(tmp_path / "out")).collect()) == list(range(40))


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = "/root/testdata/sf0.001/events.parquet*"
    live = ingest.replayed(spark, source, events.schema, lambda df: ingest.windowed(df, "1 hour"), "hourly", str(tmp_path / "a"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, ingest.windowed(events, "1 hour").collect()))
    once = ingest.replayed(spark, source, events.schema, lambda df: ingest.first_seen(df, ["user_id"], "1000 days").select("user_id"), "seen", str(tmp_path / "b"), "append")
    assert once.count() == events.select("user_id").distinct().count()
