import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tidemark.llm import registry, tandem_runs


def brute(split, least=24, periods=3):
    """(start, length, smallest period) of all runs, every period tried."""
    n, found = len(split), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and split[i] == split[i + q]:
                i += 1
            length = i - begin + q
            if i > begin and length >= max(least, periods * q):
                found.setdefault((begin, length), q)
            i += i == begin
    return sorted((s, length, q) for (s, length), q in found.items())


def noisy(rng, n, letters, most=12):
    out = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        p, s = rng.randint(1, most), rng.randrange(n)
        e = rng.randint(s, n)
        out[s:e] = [out[min(n - 1, s + i % p)] for i in range(e - s)]
    return out


def test_every_run_of_two_periods():
    rng = random.Random(3)
    for _ in range(800):
        w = noisy(rng, rng.randint(1, 70), rng.choice([1, 2, 2, 3, 5]))
        place, length, period = tandem_runs.Tree(np.array(w)).runs()
        assert sorted(zip(place.tolist(), length.tolist(), period.tolist(), strict=True)) == brute(w, 2, 2)


def test_covering_squares_reach_all_others_by_rotation():
    """Every primitive square of the text is in the vocabulary, and nothing else is."""
    rng = random.Random(4)
    for _ in range(200):
        w = noisy(rng, rng.randint(2, 40), 2)
        tree = tandem_runs.Tree(np.array(w))
        low, half = tree.vocabulary()
        got = {tuple(w[tree.sa[r] : tree.sa[r] + 2 * k]) for r, k in zip(low.tolist(), half.tolist(), strict=True)}
        root = lambda x: all(len(x) % d or x != x[:d] * (len(x) // d) for d in range(1, len(x)))
        squares = {tuple(w[i : i + 2 * k]) for k in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * k + 1) if w[i : i + k] == w[i + k : i + 2 * k] and root(w[i : i + k])}
        assert got == squares and len(low) == len(got)


@pytest.mark.parametrize("least", [24, 9, 10])
def test_texts_in_batches(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = [" ".join(map(str, noisy(rng, rng.randint(0, 160), rng.choice([1, 2, 3, 40])))).encode() for _ in range(rng.randint(1, 8))]
        found, n = tandem_runs.find(texts, least)
        assert found == [brute(t.split(), least) for t in texts] and n.tolist() == [len(t.split()) for t in texts]


def test_bounds_of_a_run():
    """23 words or under three periods are none; a neighbour that extends belongs to it."""
    text = lambda n, p: " ".join(f"w{i % p}" for i in range(n)).encode()
    assert tandem_runs.find([text(23, 1), text(24, 1), text(26, 9), text(27, 9), text(24, 8)])[0] == [[], [(0, 24, 1)], [], [(0, 27, 9)], [(0, 24, 8)]]


def expected(doc_id, text):
    split = (text or "").encode().split()
    n = len(split)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        split = [split[i] if i < a else split[a + (i - a) % p] for i in range(n)]
    runs = brute(split)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(split) if i not in dropped)))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, registry.op13_periodic_runs(spark, sf_dir).collect()))
    assert got == sorted(expected(*d) for d in docs)
    assert sum(r[1] > 0 for r in got) > 5


def test_defined_cases(spark, make_docs, tmp_path):
    rows = [(None, "x " * 40), (1, None), (2, ""), (3, " \t\n"), (4, "é\x0bé " * 30), (4, "é\x0bé " * 30), (5, "a b c " * 9), (25, "one two three four"), (14, " ".join(str(i) for i in range(5000)))]
    folder = str(tmp_path)
    make_docs(rows).selectExpr("*", "1 AS runs", "'x' AS best").write.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r))
    assert sorted(map(tuple, registry.op13_periodic_runs(spark, folder).collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tandem_runs.detect(tandem_runs.plant(empty)).count() == 0


def test_long_text(spark):
    """Half a million words: one run over half of it, and one that is as long as it may be short."""
    split = [f"w{i}" for i in range(250_000)] + [f"p{i % 70_001}" for i in range(250_000)] + ["z"] * 24
    assert tandem_runs.find([" ".join(split).encode()])[0] == [[(250_000, 250_000, 70_001), (500_000, 24, 1)]]
