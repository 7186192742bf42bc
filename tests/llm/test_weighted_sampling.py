import hashlib
from collections import Counter

import numpy as np
from tidemark.llm import registry, weighted_sampling, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def terms(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    rng, own = np.random.default_rng(0), weighted_sampling.Sampler(512)
    off = []
    for _ in range(40):
        base = rng.choice(list("abcd"), size=rng.integers(1, 200)).tolist()
        other = base[: rng.integers(len(base) + 1)] + rng.choice(list("abcd"), size=40).tolist()
        a, b = " ".join(base), " ".join(other)
        off.append(weighted_sampling.likeness(*own.signatures([a.encode(), b.encode()])) - jaccard(a, b))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04


def test_word_hashes_in_pieces(monkeypatch):
    texts = [b"", b" a ", b"one two\nthree", b"x" * 500, b"w w2 " * 300, b"\t", b"one two\nthree"]
    whole = words.word_hashes(texts)
    monkeypatch.setattr(words, "BLOCK", 64)
    small = words.word_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, small, strict=True))
    assert np.diff(whole[1]).tolist() == [len(t.split()) for t in texts]


def check(docs, got):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expect = Counter()
    for k, (i, t) in enumerate(rows):
        after, m = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - m] + after[:m]
        own, changed, following = weighted_sampling.sampler(64).signatures([x.encode() for x in (t, edited, after)])
        hexes = map(weighted_sampling.to_hex, (own, changed))
        expect[(i, len(t), edited, *hexes, weighted_sampling.likeness(own, changed), weighted_sampling.likeness(own, following))] += 1
    assert Counter(map(tuple, got.collect())) == expect


def test_neighbours_match_brute_force(spark, make_docs, sf_dir):
    many = [(i * i, f"word{i} common words here {'x ' * (i % 50)}é😀") for i in range(300)]
    odd = [(None, "null id text"), (5, None), (5, ""), (7, "a"), (7, "b c"), (10**12, "long " * 50_000), (7, "a")]
    for rows in (many + odd, odd, odd[3:4], odd[:1]):
        docs = make_docs(rows).selectExpr("*", "1 as part", "2 as tail")
        check(docs, weighted_sampling.with_neighbours(docs))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, weighted_sampling.with_neighbours(docs))
    assert weighted_sampling.with_neighbours(make_docs([])).count() == 0


def test_query_and_plain_fingerprints_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = dict(weighted_sampling.fingerprints(docs).collect())
    got = registry.QUERIES["op9_fingerprints"](spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == plain
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.1
