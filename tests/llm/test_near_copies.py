"""Near copies against brute force over all pairs, without any bit radius."""

import re

import numpy as np
import pytest
from tidemark.llm import near_copies, simhash


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute_kept(rows):
    """Ids kept, and the pairs alike at 0.8 as (a, b, bits)."""
    ids, fps, sets = [i for i, _ in rows], [simhash.fingerprint((t or "").encode()) for _, t in rows], [five(t) for _, t in rows]
    root, alike = list(range(len(ids))), []

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near = 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and both > 0
            bits = (fps[i] ^ fps[j]).bit_count()
            if near:
                alike.append((ids[j], ids[i], bits))
            if near or bits <= 3:
                a, b = sorted((top(i), top(j)), key=lambda x: ids[x])
                root[b] = a
    return sorted(ids[x] for x in range(len(ids)) if top(x) == x), alike


#: More bits than fingerprints of near copies mostly differ in.
FAR = 11


def prose(rng, n):
    return [f"w{x}" for x in rng.integers(0, 3000, n)]


def test_pairs_beyond_the_wide_radius_are_joined(spark, make_docs):
    rng, rows = np.random.default_rng(3), []
    while len(rows) < 30:
        one = prose(rng, int(rng.integers(60, 120)))
        two, at, k = list(one), int(rng.integers(0, 40)), int(len(one) * 0.06)
        two[at : at + k] = prose(rng, k)
        a, b = " ".join(one), " ".join(two)
        both = len(five(a) & five(b))
        if (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count() > FAR and 5 * both >= 4 * (len(five(a)) + len(five(b)) - both):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    want, alike = brute_kept(rows)
    assert all(bits > FAR for _, _, bits in alike) and want == list(range(0, 30, 2))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(make_docs(rows)).collect()) == want


@pytest.mark.parametrize("flush", [1 << 16, 50])
def test_hot_shingles_and_sizes(spark, make_docs, monkeypatch, flush):
    """A line that all texts share comes last in the order; short texts made of it still meet."""
    monkeypatch.setattr(near_copies, "FLUSH", flush)
    rng, line = np.random.default_rng(4), prose(np.random.default_rng(0), 30)
    rows = [(k, " ".join(line + prose(rng, k % 50))) for k in range(150)] + [(200, ""), (201, None), (202, "one"), (203, "One ")]
    labels = spark.createDataFrame([(i, i) for i, _ in rows], "id long, label long")
    got = near_copies.join_copies(make_docs(rows), labels, sample=1, hot=20)
    alike = brute_kept(rows)[1]
    linked = {x for a, b, _ in alike for x in (a, b)}
    root = {x: x for x in linked}
    for _ in linked:
        before = dict(root)
        for a, b, _ in alike:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert dict(got.collect()) == root


@pytest.mark.parametrize("large", [3, 40])
def test_large_buckets_in_blocks(spark, make_docs, monkeypatch, large):
    """Texts that share all their first shingles, of many sizes, in blocks of a few members."""
    monkeypatch.setattr(near_copies, "LARGE", large)
    monkeypatch.setattr(near_copies, "STARS", 1)
    line = prose(np.random.default_rng(1), 20)
    rows = [(k, " ".join(line + prose(np.random.default_rng(k // 6), 6 + k // 6) + [f"own{k}"] * (k % 3))) for k in range(200)]
    labels = spark.createDataFrame([(i, i) for i, _ in rows], "id long, label long")
    got = dict(near_copies.join_copies(make_docs(rows), labels, sample=1, hot=1000).collect())
    pairs = brute_kept(rows)[1]
    root = {x: x for a, b, _ in pairs for x in (a, b)}
    for _ in root:
        for a, b, _ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root and len(pairs) > 200


def test_every_pair_of_a_large_bucket_is_told_once(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "LARGE", 20)
    rng = np.random.default_rng(15)
    rows = [(1 if k % 3 else 2, int(rng.integers(0, 150)), k, int(rng.integers(1, 60)), *([0] * len(near_copies.BITS))) for k in range(400)] + [(3, k, 1000 + k, 9, *([0] * len(near_copies.BITS))) for k in range(5)]
    names = ["key", "label", "set", "n", *near_copies.BITS]
    small, large = near_copies._split(spark.createDataFrame(rows, ", ".join(f"{c} long" for c in names)), names)
    assert {r.key for r in small.select("key").distinct().collect()} == {3}
    got = [(r.a, r.b) for r in near_copies._by_bucket(large, near_copies._block_pairs, "a long, b long, need long").collect()]
    want = {(min(a[2], b[2]), max(a[2], b[2])) for a in rows for b in rows if a[0] == b[0] < 3 and a[1] != b[1] and a[2] != b[2] and 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3])}
    assert len(got) == len(set(got)) and set(got) == want


def test_least_common_is_never_above_the_shared_prefix():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        a = set(rng.choice(400, size=int(rng.integers(1, 80)), replace=False).tolist())
        b = set(a)
        for x in list(a)[: int(rng.integers(0, 1 + len(a) // 5))]:
            b.discard(x)
        b |= set(rng.integers(400, 800, int(rng.integers(0, 1 + len(a) // 6))).tolist())
        if b and 5 * len(a & b) >= 4 * len(a | b):
            first = [set(sorted(s)[: near_copies.prefix_size(len(s))]) for s in (a, b)]
            assert len(first[0] & first[1]) >= near_copies.least_common(np.array([len(a)]), np.array([len(b)]))[0] >= 1


def edited(rng, text, k):
    out = list(text)
    for at in rng.choice(len(out), size=k, replace=False):
        out[at] = f"n{rng.integers(1 << 40)}"
    return out


def test_dense_family_leaves_what_all_pairs_leave(spark, make_docs):
    """Copies of one text with scattered edits: more pairs than a bucket's least tree has links."""
    rng = np.random.default_rng(8)
    one = prose(rng, 200)
    rows = [(0, " ".join(one)), *((k, " ".join(edited(rng, one, int(rng.integers(2, 8))))) for k in range(1, 121))]
    want, alike = brute_kept(rows)
    assert len(alike) > 300
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(make_docs(rows)).collect()) == want


def bits(a, b):
    return (simhash.fingerprint(" ".join(a).encode()) ^ simhash.fingerprint(" ".join(b).encode())).bit_count()


def alike(a, b):
    x, y = five(" ".join(a)), five(" ".join(b))
    return 5 * len(x & y) >= 4 * len(x | y)


def test_copies_of_a_dropped_copy_are_joined(spark, make_docs):
    """b falls to a's fingerprint group; c is alike to b but not to a."""
    rng, rows = np.random.default_rng(9), []
    while len(rows) < 24:
        a = prose(rng, 200)
        b, c = (lambda b: (b, edited(rng, b, 3)))(edited(rng, a, 3))
        if bits(a, b) <= 3 and bits(b, c) > 3 and bits(a, c) > 3 and alike(b, c) and not alike(a, c):
            rows += [(len(rows) + k, " ".join(x)) for k, x in enumerate((a, b, c))]
    want, _ = brute_kept(rows)
    assert want == list(range(0, 24, 3))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(make_docs(rows)).collect()) == want


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(10)
    for n in (1, 5, 60, 400, 3000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)]))
        x, y = near_copies.sketch(a), near_copies.sketch(b)
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b)) and len(x) == len(near_copies.BITS)


def test_rows_that_repeat_an_id_stand_for_themselves(spark, make_docs):
    rng = np.random.default_rng(12)
    one, two = prose(rng, 90), prose(rng, 90)
    a, b, c = " ".join(one), " ".join(two), " ".join(edited(rng, two, 1))
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (3, c), (None, b), (None, "alone " + " ".join(prose(rng, 50)))]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one_of_each(make_docs(rows)).collect())
    assert kept == sorted([(1, a), (2, b), (2, b), (0, rows[-1][1])])


def test_odd_tables(spark, make_docs):
    assert simhash.keep_one_of_each(make_docs([])).count() == 0
    rows = [(1, None), (2, ""), (3, "x"), (4, "x"), (5, "long " * 30_000)]
    docs = make_docs(rows).selectExpr("*", "1 as mark", "2 as label", "3 as component_id", "4 as lost_id")
    got = simhash.keep_one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 5]


def test_few_links_take_few_partitions(spark):
    """A small link table is not dealt over all shuffle partitions, each of which writes files in every shuffle."""
    from tidemark.llm.common import fitted
    from tidemark.llm.components import components

    known = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.range(40).selectExpr("id a", "id + 1 b")
        roots = components(chain)
        assert roots.rdd.getNumPartitions() <= 64 + 1  # the links' own, and those of their distinct ends
        assert {tuple(r) for r in roots.collect()} == {(i, 0) for i in range(41)}
        assert fitted(spark.range(0, 100, 1, 64), 30).rdd.getNumPartitions() == 4
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("sent", [1 << 18, 0])
def test_rows_wait_without_sketches_and_are_dealt_once(spark, make_docs, monkeypatch, sent):
    """Sketches are not dealt by bucket with every round where they can be sent; without that the roots are the same."""
    from tidemark.llm import common

    plans, by_bucket = [], near_copies._by_bucket

    def seen(rows, *more):
        out = by_bucket(rows, *more)
        plans.append((near_copies.BITS[0] in rows.columns, "hashpartitioning(key" in out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(near_copies, "_by_bucket", seen)
    monkeypatch.setattr(common, "MOST_SENT", sent)
    line = prose(np.random.default_rng(2), 25)
    rows = [(k, " ".join(line[: k % 26] + prose(np.random.default_rng(k // 3), 40) + [f"own{k}"] * (k % 3))) for k in range(120)]
    labels = spark.createDataFrame([(i, i) for i, _ in rows], "id long, label long")
    got = dict(near_copies.join_copies(make_docs(rows), labels, sample=1, hot=1000).collect())
    pairs = brute_kept(rows)[1]
    root = {x: x for a, b, _ in pairs for x in (a, b)}
    for _ in root:
        for a, b, _ in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root and len(root) > 50
    assert sum(wide for wide, _ in plans) == near_copies.STARS + 1
    if sent:
        assert [dealt for _, dealt in plans] == [True] + [False] * (len(plans) - 1)


def test_rows_without_a_partner_of_their_size_are_left_out():
    rng = np.random.default_rng(7)
    rows = np.unique(np.column_stack([rng.integers(0, 60, 500), rng.integers(0, 6, 500), np.arange(500), rng.integers(1, 90, 500)]), axis=0)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    want = [tuple(a) for a in rows if any(a[0] == b[0] and a[1] != b[1] and 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3]) for b in rows)]
    (got,) = near_copies._mixed(tuple(rows.T))
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [tuple(map(int, a)) for a in want] and 0 < len(want) < 500
