import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import registry, suffix_dedup
from tidemark.llm.suffix_arrays import Text, permuted_common_prefixes, suffix_array


def test_suffix_arrays_match_sorting():
    rng = random.Random(1)
    for _ in range(800):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(256)), b"\x00\xff"])
        data = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        text = Text(data)
        order = suffix_array(text)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        common = permuted_common_prefixes(text, order, 10)
        for a, b in zip(order[:-1], order[1:], strict=True):
            n = 0
            while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert min(common[b], 10) == min(n, 10)


def brute(rows, window):
    """rows: (doc_id, text), ids distinct."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + window] for _, t in texts for p in range(len(t) - window + 1))
    out = Counter()
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = True
        spans = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[i, len(t), int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest()] += 1
    return out


def digest(r):
    return r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        own = ""
        for _ in range(rng.randint(0, 5)):
            own += " ".join(word() for _ in range(rng.randint(0, 30)))
            p = rng.choice(passages)
            own += p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)]
        rows.append((i * 3, own))
    copy = rows[5][1]
    return [*rows, (1, copy), (10**12, copy), (None, copy), (2, None), (4, ""), (5, " \t"), (7, "same " * 300), (8, "a" * 39), (11, "a" * 41)]


@pytest.mark.parametrize(("seed", "most"), [(0, 256), (1, 256), (2, 3), (3, 3)])
def test_removal_matches_brute_force(make_docs, seed, most):
    rows = corpus(seed)
    docs = make_docs(rows).selectExpr("*", "1 as anchor", "2 as packed", "3 as bytes")
    got = suffix_dedup.remove_repeats(docs, window=40, gram=8, most=most).collect()
    assert Counter(map(digest, got)) == brute(rows, 40)


def test_query_on_the_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = registry.QUERIES["op8_suffix_dedup"](spark, sf_dir).collect()
    assert all(r.removed == (r.n_removed > 0) == bool(r.removed_spans) for r in rows)
    assert Counter(tuple(r)[:5] for r in rows) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_repeated_rows_and_empty_table(make_docs):
    text = "".join(map(str, range(300)))
    got = suffix_dedup.remove_repeats(make_docs([(1, text), (1, text), (2, text[:399])])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, len(text)), (1, len(text)), (2, 0)]
    assert suffix_dedup.remove_repeats(make_docs([])).count() == 0


def test_rows_that_repeat_an_id_stand_for_themselves(make_docs):
    rng = random.Random(3)
    text, other = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(2))
    got = suffix_dedup.remove_repeats(make_docs([(1, text), (2, text), (2, other), (3, other[:300])])).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(1, 0), (2, 0), (2, len(other)), (3, 300)]


def test_arrays_decide_over_digests(spark):
    """Regions said to be the same are covered only where their bytes are."""
    rng = random.Random(6)
    one, two = ("".join(rng.choice("abcdef") for _ in range(100)).encode() for _ in range(2))
    rep = suffix_dedup.Repeats(suffix_dedup.byte_units, 40, 8, True)
    rows = [(5, d, 0, 7, t, [0, 30], [30, 31], [d1, 8], [9, 9]) for d, t, d1 in ((1, one, 3), (2, one[:69] + two[69:], 3))]
    found = suffix_dedup.run_covers(spark.createDataFrame(rows, suffix_dedup.RUN), rep).collect()
    assert sorted((r.doc_id, r.start, r.n) for r in found if r.d1 is None) == [(1, 7, 69), (2, 7, 69)]
    assert [(r.d1, r.d2) for r in found if r.d1 is not None] == [(3, 9), (3, 9)]


def test_text_beyond_one_block(make_docs, monkeypatch):
    """A text of several blocks whose halves repeat each other."""
    from tidemark.llm import repeats

    monkeypatch.setattr(repeats, "LIMIT", 2000)
    rng = random.Random(4)
    half = "".join(rng.choice("abcdefghij ") for _ in range(9000))
    rows = [(1, half + "#" + half), (2, half[4000:4300]), (3, half[100:600])]
    got = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    assert Counter(map(digest, got)) == brute(rows, 400)


def test_two_long_texts_that_share_a_passage_are_many_arrays(spark, make_docs, monkeypatch):
    """A copied text goes to arrays in stretches; the result is that of one array."""
    from tidemark.llm import repeats

    rng = random.Random(5)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(9000))
    rows = [(1, long), (2, "before " + long), (3, long[20_000:30_000] + " after"), (4, "z" * 900)]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 4096)
    rep = repeats.Repeats(repeats.byte_units, 400, 16, every=True)
    narrow_ = repeats.narrow(make_docs(rows), "doc_id", "text")
    groups = repeats.grouped(repeats.paired(narrow_, rep, keep=True)).where("rows > 1")
    sizes = [(r.pair, len(r.bytes)) for r in suffix_dedup.runs(repeats.packed(narrow_), groups, rep).select("pair", "bytes").collect()]
    per = Counter()
    for pair, n in sizes:
        per[pair] += n
    assert len(per) > 10 and max(per.values()) < 4 * 4096
    got = suffix_dedup.remove_repeats(make_docs(rows)).collect()
    assert Counter(map(digest, got)) == brute(rows, 400)


def test_long_repeats_are_sorted_by_their_first_bytes_only(monkeypatch):
    """Copies of one text differ nowhere within a window, so no name of a suffix needs more rounds than a window has."""
    from tidemark.llm import suffix_arrays

    rng = random.Random(8)
    one = bytes(rng.choice(b"abcd") for _ in range(30_000))
    text = Text(one + b"\xff" + one)
    sorts, sort = [], np.sort
    monkeypatch.setattr(suffix_arrays.np, "sort", lambda x: sorts.append(len(x)) or sort(x))
    order = suffix_array(text, 400)
    assert len(sorts) <= 11
    ends = [text.padded[i : i + 400] if i + 400 <= text.n else text.padded[i : text.n] for i in order.tolist()]
    assert ends == sorted(ends) and sorted(order.tolist()) == list(range(text.n))


def test_suffixes_by_a_few_bytes():
    rng = random.Random(9)
    for _ in range(400):
        data = bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(1, 60))) * rng.randint(1, 3)
        depth = rng.randint(1, 12)
        order = suffix_array(Text(data), depth).tolist()
        heads = [data[i : i + depth] for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(len(data)))
