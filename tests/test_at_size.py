"""Queries against their SQL on tables that hold what the small ones do not."""

import re
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import queries
from tidemark.plans import tables as tables_module
from tidemark.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A function that writes tables (name: SQL over the small ones) and returns their folder."""

    def write(**made):
        con = duckdb.connect()
        small = sorted(Path(SMALL).glob("*.parquet"))
        for f in small:
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        for f in small:
            rows = made.get(f.stem, f"SELECT * FROM {f.stem}")
            con.execute(f"COPY ({rows}) TO '{tmp_path}/{f.name}' (FORMAT parquet)")
        return str(tmp_path)

    return write


def both(spark, folder, name):
    """(rows of the query, rows of its SQL), sorted."""
    got = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    expect = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted((tuple(r) for r in got.collect()), key=str), sorted(expect, key=str)


def test_unsure_read_counts_all_photos(spark, tables):
    """A number that 300 photos of the event show."""
    folder = tables(
        customer="SELECT * REPLACE (4 AS c_nationkey, 1.0 AS c_acctbal) FROM customer",
        lineitem="SELECT * REPLACE ('A' AS l_returnflag, 42 AS l_partkey) FROM lineitem WHERE l_orderkey < 400",
    )
    got, expect = both(spark, folder, "bib_unsure_read")
    assert got == expect and expect[0][1] > 200


def test_box_fits_by_the_known_side(spark, tables):
    """Photos without a width whose boxes end far below the frame."""
    folder = tables(lineitem="SELECT * REPLACE (l_orderkey // 50 * 50 AS l_orderkey, 200 + l_suppkey % 30 AS l_suppkey) FROM lineitem WHERE l_orderkey >= 50")
    got, expect = both(spark, folder, "box_fits")
    assert got == expect and {r[3] for r in got} == {True, False}


def test_partitions_grow_with_rows(spark):
    assert queries.parts_for(spark.range(1000), 10) == 100 and queries.parts_for(spark.range(1000)) == 4


def test_number_tables_are_dealt_by_their_rows(spark, tables, monkeypatch):
    """The full join of an upsert takes more partitions than the session's when the lines need them."""
    monkeypatch.setattr(tables_module, "parts_for", lambda df: 37)
    folder = tables()
    for name in ("bib_upsert", "bib_replace", "manual_bib"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("FullOuter") :]
        assert not re.search(r"hashpartitioning\(.*bib.*, 4\)", join) and re.search(r"hashpartitioning\(.*bib.*, 37\)", join)
        got, expect = both(spark, folder, name)
        assert len(got) == len(expect) > 0
        for g, e in zip(got, expect, strict=True):
            assert [x for x in g if not isinstance(x, float)] == [x for x in e if not isinstance(x, float)]
            assert [x for x in g if isinstance(x, float)] == pytest.approx([x for x in e if isinstance(x, float)])
