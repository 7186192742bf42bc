import random
import re
from collections import Counter

import pytest
from tidemark.llm import repeats, substring_dedup


def brute(rows, window=20):
    """rows: (doc_id, text), ids distinct."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, out = set(), []
    for i in sorted(words, key=lambda i: (i is not None, i or 0)):
        own, gone = words[i], set()
        for p in range(len(own) - window + 1):
            key = tuple(own[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        out.append((i, len(own), len(gone), " ".join(w for p, w in enumerate(own) if p not in gone)))
    return Counter(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(rng.randint(0, 5)):
            own += [word() for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            s = rng.randint(0, 10)
            own += p[s : len(p) - rng.randint(0, 10)]
        rows.append((i * 3, rng.choice([" ", "\n", "  "]).join(own)))
    copy = rows[5][1]
    return [*rows, (1, copy), (10**12, copy), (None, copy), (2, None), (4, ""), (5, " \t"), (7, "same " * 3000), (8, "same " * 19), (11, "same " * 20)]


@pytest.mark.parametrize("seed", range(3))
def test_removal_matches_brute_force(make_docs, seed, monkeypatch):
    rows = corpus(seed)
    docs = make_docs(rows).selectExpr("*", "1 as anchor", "2 as packed")
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)
    assert all(s.end - s.start >= 20 for r in got for s in r.spans)


def test_long_texts_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "LIMIT", 64)
    rows = corpus(9, 20)
    rep = repeats.Repeats(substring_dedup.words.word_hashes, 20, 6, every=False)
    texts = [(t or "").encode() for _, t in rows]
    windows = sum(int(part[4].sum()) for part in repeats.text_regions(rep, texts))
    assert windows == sum(max(0, len(t.split()) - 19) for t in texts)


def test_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_rows_and_empty_table(make_docs):
    text = " ".join(map(str, range(30)))
    got = substring_dedup.remove_repeats(make_docs([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 30)]
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0


def test_rows_that_repeat_an_id_stand_for_themselves(make_docs):
    text, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    got = substring_dedup.remove_repeats(make_docs([(1, text), (2, text), (2, other), (2, other)])).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept[:2]) for r in got) == [(1, 0, "a0"), (2, 0, "b0"), (2, 0, "b0"), (2, 60, "")]


def test_words_with_equal_polynomial_hashes_stay_apart(make_docs):
    """Two words of 1,024 bytes that any polynomial modulo 2**64 takes for one."""
    import numpy as np
    from tidemark.llm import words

    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    same = [words.polynomial(np.frombuffer(w.encode(), np.uint8).astype(np.uint64), np.array([0]), np.array([1024])) for w in (one, two)]
    assert same[0] == same[1]
    around = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*around[:9], one, *around[9:]])), (2, " ".join([*around[:9], two, *around[9:]])), (3, " ".join([one] * 30)), (4, " ".join([two] * 19 + ["x"]))]
    got = substring_dedup.remove_repeats(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)


@pytest.mark.parametrize("most", [1, 4])
def test_common_seeds_go_window_by_window(make_docs, most):
    rows = corpus(11)
    got = substring_dedup.remove_repeats(make_docs(rows), most=most).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute(rows)


@pytest.mark.parametrize("window", [2, 3, 20, 31])
def test_names_tell_windows_apart(window):
    rng = random.Random(window)
    own = [rng.choice([b"a", b"b"]) for _ in range(300)]
    got = substring_dedup.names(own, window)
    at = range(len(own) - window + 1)
    real = {}
    assert [real.setdefault(tuple(own[i : i + window]), int(got[i])) for i in at] == [int(got[i]) for i in at]
    assert len(set(real.values())) == len(real)
