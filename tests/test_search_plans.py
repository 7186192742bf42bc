"""What searches read and move: the hits go to the tables, filters reach the scan."""

import re

import pytest

from tidemark.operators import search


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.range(3000).selectExpr("id row_idx", "id div 2 photo_id", "concat('[', id % 900, ',5,40,50]') bbox").write.parquet(f"{folder}/faces")
    spark.range(1500).selectExpr("id photo_id", "id % 40 source_id", "1000 width", "800 height", "concat('f', id) file_id", "cast(null as string) thumb_key", "'2024' taken_at").write.parquet(f"{folder}/photos")
    spark.range(40).selectExpr("id source_id", "id % 4 = 0 removed").write.parquet(f"{folder}/sources")
    spark.range(3000).selectExpr("id div 2 photo_id", "concat(if(id % 2 = 0, 'A-', ''), id % 300) bib", "if(id % 5 = 0, null, (id % 10) / 10) conf", "concat('#', id) bib_raw", "id div 300 % 3 event_id").write.parquet(f"{folder}/bibs")
    spark.range(3000).selectExpr("id row_idx", "16129 - id score").write.parquet(f"{folder}/scored")
    spark.range(3).selectExpr("id event_id", "'ready' status", "true bibs_enabled").write.parquet(f"{folder}/events")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("faces", "photos", "sources", "bibs", "scored", "events")}


@pytest.fixture
def no_small_tables(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, table):
    return [line for line in text.splitlines() if "FileScan" in line and f"/{table}]" in line]


@pytest.mark.usefixtures("no_small_tables")
def test_faces_meet_the_hits_before_anything_is_shuffled(stored):
    t = stored
    for df in (search.face_search(t["scored"], t["faces"], t["photos"], t["sources"], 0.2), search.face_answer(t["scored"], t["faces"], t["photos"], t["sources"], 0.2)):
        text = plan(df)
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
        for table in ("faces", "photos", "sources"):
            lines = text.splitlines()
            for i, line in enumerate(lines):
                if "FileScan" in line and f"/{table}]" in line:
                    above = [x for x in lines[:i] if len(x) - len(x.lstrip(" :+-*(0123456789)")) < len(line) - len(line.lstrip(" :+-*(0123456789)"))]
                    first = next(x for x in reversed(above) if re.search("Join|Exchange hash|Exchange range", x))
                    assert "BroadcastHashJoin" in first, (table, first)


@pytest.mark.usefixtures("no_small_tables")
def test_numbers_are_filtered_at_one_scan(stored):
    t = stored
    for df, pushed in (
        (search.bib_hits(t["bibs"], t["photos"], t["sources"], "a42"), "EqualTo(bib,A-42)"),
        (search.bib_lookup(t["events"], t["bibs"], t["photos"], t["sources"], 1, "a42")[0], "EqualTo(bib,A-42)"),
        (search.bib_lookup(t["events"], t["bibs"], t["photos"], t["sources"], 1, "a2", fuzzy=True)[0], "StringStartsWith(bib,A-)"),
    ):
        found = scans(plan(df), "bibs")
        assert len(found) == 1 and pushed in found[0], found


def test_answers_are_right(stored):
    t = stored
    best = search.face_search(t["scored"], t["faces"], t["photos"], t["sources"], 0.2, 10, 10)
    assert [(r.photo_id, r.row_idx) for r in best.collect()] == [(1, 2), (2, 4), (3, 6)]
    rows = [(r.photo_id, r.bib, r.conf, r.bib_raw) for r in t["bibs"].where("event_id = 1 and bib = 'A-42' and photo_id % 40 % 4 > 0").collect()]
    hits, answer = search.bib_lookup(t["events"], t["bibs"], t["photos"], t["sources"], 1, "a42", True)
    assert {r.kind for r in hits.collect()} <= {"exact"} and hits.count() == len({r[0] for r in rows})
    surest = min(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]), default=(None,) * 4)
    assert answer.first().bib_read == surest[3] and answer.first().photos == len({r[0] for r in rows})
