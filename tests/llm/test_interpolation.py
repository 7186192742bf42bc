import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tidemark.llm import interpolation, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
START, END = "<start>", "<end>"


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), END]


def kind(doc_id):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return interpolation.OUT if h % 5 == 1 else interpolation.LEFT if h // 5 % interpolation.DELETED == 0 else interpolation.KEPT


def counted(docs, kinds, order):
    """Counters of n-grams by order; the start counts once a document at each order."""
    out = [Counter() for _ in range(order + 1)]
    for d, text in docs:
        if kind(d) in kinds:
            t = [START] * (order - 1) + tokens(text)
            for n in range(1, order + 1):
                out[n].update(tuple(t[i - n + 1 : i + 1]) for i in range(order - 1, len(t)))
                out[n][(START,) * n] += 1
    return out


def terms(counts, text, order):
    """For each token: (count, context's count) of orders 1, 2, ..."""
    t, total = [START] * (order - 1) + tokens(text), sum(c for g, c in counts[1].items() if g != (START,))
    for i in range(order - 1, len(t)):
        yield [(counts[n][tuple(t[i - n + 1 : i + 1])], counts[n - 1][tuple(t[i - n + 1 : i])] if n > 1 else total) for n in range(1, order + 1)]


def mixture(levels, weights, kinds):
    p = [1 / (kinds + 1)]
    for (c, context), w in zip(levels, weights, strict=True):
        share = w[context.bit_length() - 1] if context else 0.0
        p.append(share * (c / context if context else 0) + (1 - share) * p[-1])
    return p


def brute(docs, order=3, rounds=interpolation.ROUNDS):
    """(weights, rows): token by token, with the steps of expectation and maximisation written out."""
    kept, weights = counted(docs, (interpolation.KEPT,), order), [[0.5] * 64 for _ in range(order)]
    kinds = len(kept[1].keys() - {(START,)})
    events = [e for d, t in docs if kind(d) == interpolation.LEFT for e in terms(kept, t, order)]
    for _ in range(rounds):
        used, came = defaultdict(float), defaultdict(float)
        for levels in events:
            p, reach = mixture(levels, weights, kinds), 1.0
            for n in reversed(range(order)):
                c, context = levels[n]
                if context:
                    b = context.bit_length() - 1
                    came[n, b] += reach
                    use = reach * weights[n][b] * c / context / p[n + 1]
                    used[n, b] += use
                    reach -= use
        new = [w.copy() for w in weights]
        for n in range(order):
            for b in range(64):
                new[n][b] = min(used[n, b] / came[n, b], 1 - 1e-6) if came[n, b] > 0 else new[n][b - 1] if b else new[n][b]
        change = max(abs(x - y) for v, w in zip(new, weights, strict=True) for x, y in zip(v, w, strict=True))
        weights = new
        if change < interpolation.STILL:
            break
    taught = counted(docs, (interpolation.KEPT, interpolation.LEFT), order)
    words = {g[0]: c for g, c in taught[1].items() if g != (START,)}
    total, kinds, rows = sum(words.values()), len(words), []
    for d, text in docs:
        t = tokens(text)
        base = sum(math.log10((words.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        model = sum(math.log10(mixture(e, weights, kinds)[-1]) for e in terms(taught, text, order))
        rows.append((d, kind(d) == interpolation.OUT, len(t), sum(w in words for w in t), total, base, model))
    return weights, rows


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def corpus(seed, n=120):
    rng = random.Random(seed)
    line = [f"w{int(rng.paretovariate(0.8))}" for _ in range(30)]
    docs = []
    for i in range(n):
        body = [f"{rng.choice('wWé')}{int(rng.paretovariate(0.9)) % 500}" for _ in range(rng.randint(0, 60))]
        docs.append((i, " ".join(body + line * (i % 4 == 0))))
    return docs + [(7, docs[7][1]), (7, "other text"), (None, None), (3, ""), (4, " \t")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_and_weights_against_brute_force(make_docs, order):
    docs = corpus(order)
    same(interpolation.score(make_docs(docs), order=order).collect(), brute(docs, order)[1])


def test_small_blocks_segments_and_shards(make_docs, monkeypatch):
    """Documents over several segments and blocks, n-grams over many shards."""
    docs = [*corpus(5, 40), (200, " ".join(f"w{i % 37}" for i in range(1500)))]
    for name, value in (("BLOCK", 50), ("SEGMENT", 20), ("SHARD", 40)):
        monkeypatch.setattr(interpolation, name, value)
    frame = make_docs(docs)
    corpus_ = interpolation.Corpus(frame, "doc_id", "text", 3)
    assert corpus_.shards > 20 and corpus_.blocks.count() > 20
    got = corpus_.learn()
    corpus_.close()
    want, rows = brute(docs)
    np.testing.assert_allclose(got.weights, want, rtol=1e-7, atol=1e-12)
    same(interpolation.score(frame).collect(), rows)


def test_weights_raise_the_likelihood_each_round():
    rng = np.random.default_rng(0)
    context = [np.full(400, 5000), rng.integers(0, 60, 400), rng.integers(0, 9, 400)]
    terms_ = [(rng.integers(0, c + 1), c) for c in context]
    weights, last = interpolation.start_weights(3), -np.inf
    for _ in range(8):
        used, came, likelihood = interpolation.expected(weights, terms_, 900)
        assert likelihood >= last - 1e-9
        weights, last = interpolation.maximised(used, came, weights), likelihood


def test_probabilities_of_all_words_add_to_one():
    docs = corpus(8)
    taught = counted(docs, (interpolation.KEPT, interpolation.LEFT), 3)
    words = [g[0] for g in taught[1] if g != (START,)]
    rng = np.random.default_rng(1)
    weights = interpolation.Weights(rng.random((3, interpolation.BUCKETS)))
    total = sum(taught[1][w,] for w in words)
    for u, v in [(START, START), (START, "w1"), ("w1", "w1"), ("w1", "never"), ("never", "never")]:
        context = [total, taught[1][v,], taught[2][u, v]]
        every = [*words, "unseen"]
        grams = [[(w,) for w in every], [(v, w) for w in every], [(u, v, w) for w in every]]
        terms_ = [(np.array([taught[n + 1][g] for g in grams[n]]), np.full(len(every), context[n])) for n in range(3)]
        assert abs(weights.mixed(terms_, len(words))[-1][2].sum() - 1) < 1e-9


def test_packing_and_grouping():
    rng = np.random.default_rng(2)
    for top in (1 << 63, 1 << 12, 3):  # with keys that only differ in low bits, too
        for n in (0, 1, 2, 5000):
            keys = rng.integers(0, top, n).astype(np.uint64)
            distinct, group = interpolation.grouped(keys)
            assert np.array_equal(distinct, np.unique(keys)) and np.array_equal(distinct[group], keys)
    for n in (1, 7, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(interpolation.unpacked_keys(*interpolation.packed_keys(keys)), keys)
        values = rng.integers(0, 1 << 32, n)
        assert np.array_equal(interpolation.unpacked(interpolation.packed(values)), values)
        assert np.array_equal(interpolation.unpacked64(interpolation.packed64(values << 20)), values << 20)
    one = np.array([3], np.uint64)
    assert np.array_equal(interpolation.unpacked_keys(*interpolation.packed_keys(one)), one)


def test_query_and_held_out_gain(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op12_interpolation(spark, sf_dir).collect()
    same(got, brute(docs)[1])
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_defined_cases(spark, make_docs):
    empty = make_docs([(1, "a")]).where("false")
    assert interpolation.score(empty).collect() == []
    held = next(i for i in range(100) if kind(i) == interpolation.OUT)
    alone = interpolation.score(make_docs([(held, "a b a")]).selectExpr("*", "1 AS class", "2 AS block")).collect()
    assert [tuple(r) for r in alone] == [(held, True, 4, 0, 0, 0.0, 0.0)]
    assert "tidemark_blocks" not in " ".join(t.name for t in spark.catalog.listTables())
