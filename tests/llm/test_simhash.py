import re
import uuid
from collections import Counter

import numpy as np
import pytest
import xxhash
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=3):
    fps = {f for _, f in rows}
    label = {f: min(i for i, g in rows if g == f) for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return Counter((i, f"{f:016x}", label[f]) for i, f in rows)


TEXTS = [None, "", "  \n", "One", "one", "Two words", "É é A b c d", "long word " * 30_000, *[f"the quick brown fox jumps over dog number {'x' * (i // 3)}" for i in range(12)]]


@pytest.mark.parametrize("most", [2048, 3])
def test_groups_match_brute_force(spark, make_docs, sf_dir, most):
    docs = make_docs([*enumerate(TEXTS), (3, "One"), (3, "One")])
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.near_groups(docs, most=most)
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_groups_of_the_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    assert Counter(map(tuple, simhash.near_groups(docs).collect())) == brute_groups(rows)


@pytest.mark.parametrize("positions", [list(range(64)), list(range(0, 64, 2)), list(range(5))])
def test_masks_cover_every_pair_within_the_radius(positions):
    masks = simhash.covering_masks(positions)
    rng = np.random.default_rng(0)
    for _ in range(2000):
        bits = rng.choice(positions, size=min(3, len(positions)), replace=False)
        assert any(all(not m >> int(b) & 1 for b in bits) for m in masks)


@pytest.mark.parametrize("most", [4096, 20])
def test_large_buckets_lose_no_link(spark, most):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    for _ in range(300):
        near = rng.choice(sorted(fps))
        fps.add(int(near) ^ sum(1 << int(b) for b in rng.choice(62, size=rng.integers(1, 5), replace=False)))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = dict(components(simhash.links(nodes, 3, most)).collect())
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            least = min(label[b] for b in fps if (a ^ b).bit_count() <= 3)
            if least < label[a]:
                label[a], changed = least, True
    linked = {f for f in fps if any(f != g and (f ^ g).bit_count() <= 3 for g in fps)}
    assert got == {f: label[f] for f in linked}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def jobs_of(spark, make):
    """The rows that ``make`` gives, and how many Spark jobs it took."""
    group = f"jobs-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        return make().collect(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_take_few_jobs(spark):
    """A long chain in odd order takes no rounds of stars, whose plans fill the driver's memory, as long as one task may have all links."""
    order = [int(x) for x in np.random.default_rng(3).permutation(3000)]
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long").repartition(3)
    got, jobs = jobs_of(spark, lambda: components(chain))
    assert {tuple(r) for r in got} == {(i, 0) for i in range(3000)} and jobs <= 16


@pytest.mark.parametrize("most", [1, 50, 1 << 18])
def test_components_of_many_links_go_by_rounds(spark, most):
    rng = np.random.default_rng(4)
    links = [tuple(x) for x in rng.integers(-150, 150, (140, 2)).tolist()] * 2 + [(i, i + 1) for i in range(1000, 1060)] + [(None, 5), (7, 7)]
    root = {x: x for pair in links if None not in pair and pair[0] != pair[1] for x in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a in root and b in root and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3), most).collect()
    assert len(got) == len(root) and {r.node: r.root for r in got} == root


def test_empty_table_and_extra_columns(make_docs):
    assert simhash.near_groups(make_docs([])).count() == 0
    docs = make_docs([(2, "a b c"), (1, "A b c"), (3, "else where now")]).selectExpr("*", "1 as fp", "2 as component_id")
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def likeness(a, b):
    return len(a & b) / len(a | b)


def brute_keep(rows):
    """Ids kept: least of each group of fingerprints, then of each group of similar texts."""
    fps = {i: brute_fingerprint(t) for i, t in rows}
    texts = dict(rows)
    reps = sorted({c for _, _, c in brute_groups(list(fps.items()))})
    sets = {i: five(texts[i]) for i in reps}
    label = {i: i for i in reps}
    pairs = [(a, b) for a in reps for b in reps if a < b and likeness(sets[a], sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return sorted(i for i in reps if label[i] == i)


def test_near_copies_leave_one_of_each_group(spark, make_docs, sf_dir):
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for k in range(20):
        words = (rows[k][1] or "").split()
        for at in rng.choice(len(words), size=max(1, len(words) // 60), replace=False):
            words[at] = f"new{k}x{at}"
        rows.append((100_000 + k, " ".join(words)))
    kept = [r.doc_id for r in simhash.keep_one_of_each(make_docs(rows)).collect()]
    want = brute_keep(rows)
    assert sorted(kept) == want
    assert sum(i >= 100_000 for i in want) < 18
