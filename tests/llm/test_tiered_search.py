import math
import random
import re
from collections import Counter

import duckdb
import pytest
from tidemark.llm import oracle, registry, tiered_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score): every document scored for every item."""
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, bag, n in bags:
            m = 100 - 75 + 75 * n * total // length
            found.append((sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t]), d))
        found = sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1] is not None, f[1] or 0))
        out += [(item, k + 1, d, s) for k, (s, d) in enumerate(found[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r)[:4] for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string")


def corpus(rng, n):
    """Documents of common and rare terms; a third of them are one text, and passages are shared."""
    name = lambda: f"{rng.choice('abXé')}{int(rng.paretovariate(0.7)) % 3000}"
    passages = [" ".join(name() for _ in range(25)) for _ in range(6)]
    docs = []
    for i in range(n):
        text = " ".join(name() for _ in range(rng.randint(1, 120)))
        docs.append((i, passages[0] + ". same" if i % 3 == 0 else text + "\n" + rng.choice(passages) if rng.random() < 0.1 else text))
    items = [(k, p) for k, p in enumerate(passages)] + [(10 + k, " ".join(name() for _ in range(rng.randint(1, 12)))) for k in range(20)]
    return docs, [*items, (50, None), (51, "!!"), (52, "no-such-term-anywhere"), (3, passages[3])]


@pytest.mark.parametrize(("first", "second"), [(2, 8), (16, 64), (1, 1), (10**6, 10**6)])
def test_tiers_give_what_all_scores_give(spark, make_docs, make_items, first, second):
    docs, items = corpus(random.Random(first), 400)
    got = tiered_search.ranked(make_docs(docs), make_items(items), first=first, second=second).cache()
    assert rows(got) == brute(docs, items)
    closed = {r.tier for r in got.collect()}
    assert closed == {0} if first > 1000 else len(closed) > 1 or first == 1


def test_residuals_bound_what_lies_below(spark, make_docs):
    docs, _ = corpus(random.Random(9), 300)
    index = tiered_search.build(make_docs(docs), first=4, second=16)
    below = {}
    for r in index.postings.collect():
        for t in range(r.tier):
            below[r.term, t] = max(below.get((r.term, t), 0), r.impact)
    sizes = Counter((r.term, r.tier) for r in index.postings.collect())
    for r in index.terms.collect():
        assert [r[f"residual_{t}"] for t in range(3)] == [below.get((r.term, t), 0) for t in range(3)]
        assert sizes[r.term, 0] + sizes[r.term, 1] + sizes[r.term, 2] == r.df and sizes[r.term, 0] >= min(4, r.df)
    bags = [Counter(terms(t)) for _, t in docs if terms(t)]
    assert {r.term: r.df for r in index.terms.collect()} == dict(Counter(t for b in bags for t in b))
    assert (index.documents, index.length) == (len(bags), sum(b.total() for b in bags))


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted((tuple(map(int, r)) for r in con.execute(oracle.ORACLE_SQL["op11_tiered_search"]).fetchall()), key=str)
    assert rows(registry.op11_tiered_search(spark, sf_dir)) == want and len(want) > 300
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert want == brute(docs, items)


def test_defined_cases(spark, make_docs, make_items):
    long = " ".join(f"t{i}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, "a b ÀÉ"), (3, "a b ÀÉ"), (None, "a c"), (4, "A, b; c"), (5, long), (6, "\x00a\x7fb")]
    items = [(1, "a"), (1, "a"), (2, "ÀÉ b b"), (3, "t59999 t7"), (4, None), (None, "C")]
    with_extra = make_docs(docs).selectExpr("*", "1 AS term", "2 AS row", "3 AS tier")
    assert rows(tiered_search.ranked(with_extra, make_items(items).selectExpr("*", "1 AS item"))) == brute(docs, items)
    none = make_docs(docs).where("false")
    assert rows(tiered_search.ranked(none, make_items(items))) == [] == rows(tiered_search.ranked(make_docs(docs), make_items([])))


def test_long_text_in_pieces(monkeypatch):
    text = ("Ab-c éx " * 700).encode()
    whole = tiered_search.terms_of(text)
    monkeypatch.setattr(tiered_search, "_PIECE", 100)
    monkeypatch.setattr(tiered_search.words, "BLOCK", 100)
    assert tiered_search.terms_of(text) == whole == Counter({b"ab": 700, b"c": 700, "éx".encode(): 700})


def test_unbounded_list_of_terms_is_joined(spark, make_docs, make_items, monkeypatch):
    docs, items = corpus(random.Random(2), 150)
    monkeypatch.setattr(tiered_search, "MOST_SENT", 5)
    assert rows(tiered_search.ranked(make_docs(docs), make_items(items), first=4, second=16)) == brute(docs, items)
