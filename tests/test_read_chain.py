"""The read chain: one pass over its reads, and trimming as by the pattern of white space."""

import re

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import tokens


def test_prefixed_numbers_are_told_in_one_pass(spark):
    hits = spark.range(40).selectExpr("id % 4 crop_id", "concat(if(id % 3 = 0, 'A-', ''), id % 5) bib", "1.0D conf", "'r' raw")
    found = tokens.prefer_prefixed(hits)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    shown = {(r.crop_id, r.bib) for r in hits.collect()}
    expect = {(c, b) for c, b in shown if "-" in b or (c, f"A-{b}") not in shown}
    assert {(r.crop_id, r.bib) for r in found.collect()} == expect


def test_trimming_takes_all_white_space(spark):
    rows = [(f"{chr(c)} a{chr(c)}b {chr(c)}",) for c in range(1, 0x3100)]
    df = spark.createDataFrame([*rows, (None,), ("",), (" \n",)], "t string")
    by_pattern = F.regexp_replace(F.coalesce("t", F.lit("")), f"^{text.WHITE}+|{text.WHITE}+$", "")
    assert df.where(text.stripped(F.col("t")) != by_pattern).count() == 0
    assert re.search("trim", df.select(text.stripped(F.col("t")))._jdf.queryExecution().optimizedPlan().toString())
