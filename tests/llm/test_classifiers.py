"""Importance resampling against brute force, toxicity by held-out accuracy, and the pipeline."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tidemark.llm import importance, mixing, registry, toxicity


def draws(ids, seed):
    out = []
    for i in ids:
        h = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        out.append((int(h[:12], 16) + 0.5) / (1 << 48))
    return out


def test_selection_matches_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), registry.labels(spark, sf_dir)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    grams = {i: np.bincount(importance.ngrams([t])[0], minlength=importance.BUCKETS) for i, t in rows}
    target, raw = sum(g for i, g in grams.items() if i in good), sum(grams.values())
    smooth = lambda c: (c + 0.5) / (c.sum() + 0.5 * importance.BUCKETS)
    ratio = np.log(smooth(target)) - np.log(smooth(raw))
    weight = {i: importance.LENGTH * float(g @ ratio) / max(1, g.sum()) for i, g in grams.items()}
    level = sorted(weight[i] for i in good if i in weight)[len(good) // importance.SPARED] - math.log(importance.SURE)
    k = round(sum(1 - math.exp(-math.exp(min(50, w - level))) for w in weight.values()))
    key = {i: weight[i] - math.log(-math.log(u)) for i, u in zip(weight, draws(weight, importance.SEED), strict=True)}
    expect = sorted(key, key=key.get, reverse=True)[:k]
    got = {r.doc_id: r.sample_key for r in importance.select(docs, labels).collect()}
    assert set(got) == set(expect)
    assert all(v == pytest.approx(key[i]) for i, v in got.items())


def test_sampling_follows_the_weights(spark):
    """Over many seeds the k largest keys are samples without replacement in proportion to the weights."""
    weights, k, seeds = [0.0, 1.0, 2.0, 3.0, 4.0, -3.0], 2, 600
    rows = spark.createDataFrame([(i, w, s) for i, w in enumerate(weights) for s in range(seeds)], "i long, w double, s long")
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("key")))
    keyed = rows.withColumn("key", importance.gumbel_key(F.col("w"), F.concat_ws("/", "i", "s"), 3))
    got = Counter(r.i for r in keyed.withColumn("rank", rank).where(f"rank <= {k}").collect())
    p = np.exp(weights) / np.exp(weights).sum()
    expect = [p[i] + sum(p[j] * p[i] / (1 - p[j]) for j in range(len(p)) if j != i) for i in range(len(p))]
    for i, e in enumerate(expect):
        assert abs(got[i] / seeds - e) < 4 * math.sqrt(e * (1 - e) / seeds) + 0.005


def test_seeds_and_shares_change_what_is_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), registry.labels(spark, sf)
    n = docs.count()
    kept = [{r.doc_id: r.log_weight for r in importance.select(docs, labels, seed=s, share=0.5).collect()} for s in (1, 2)]
    assert [len(x) for x in kept] == [round(n / 2)] * 2
    both, one = set(kept[0]) & set(kept[1]), set(kept[0]) ^ set(kept[1])
    assert len(one) > 20 and len(both) > 20
    mean = lambda ids: np.mean([{**kept[0], **kept[1]}[i] for i in ids])
    assert mean(both) > mean(one)


def test_bad_documents_go_and_good_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in registry.QUERIES["op6_importance"](spark, sf).collect()}
    quality = {r.doc_id: r.quality for r in registry.labels(spark, sf).collect()}
    good, bad = ([i for i, q in quality.items() if q == v] for v in (1, 0))
    assert np.mean([i in kept for i in good]) > 0.98
    assert np.mean([i in kept for i in bad]) < 0.5


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "GATHER", 5)
    values = [float(i % 97) for i in range(1000)] + [1e9, -1e9]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 500, 1002):
        assert importance.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_selection_of_odd_tables(spark, make_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "A good text."), (2, None), (3, ""), (None, "x"), (3, "")]).selectExpr("*", "1 as c0", "2 as log_weights", "3 as k_id", "4 as key", "5 as k_mark")
    assert set(importance.select(docs, labels).columns) == {*docs.columns, "log_weight", "sample_key"}
    assert importance.select(make_docs([]), labels).count() == 0
    assert importance.select(docs, labels.limit(0)).count() == 5


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in registry.labels(spark, sf).collect() if r.toxic is not None}
    rows = [r for r in registry.QUERIES["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    y, p = np.array([toxic[r.doc_id] for r in rows]), np.array([r.predicted for r in rows])
    assert len(rows) > 200
    assert (p[y == 1]).mean() > 0.9 and (p[y == 0]).mean() < 0.03


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(rng.normal(size=toxicity.FEATURES), -0.3, rng.normal(size=(2, 2)))
    features, text, _, _ = toxicity.featurize([b"one two three four", b"five six", b""])
    p, expected = field.marginals(features, text, want_pairs=True)
    score, at, pairs = field.weights[features].sum(axis=1) + field.bias, 0, np.zeros((2, 2))
    for n in (4, 2):
        total, hit = 0.0, np.zeros(n)
        for code in range(2**n):
            tags = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(score[at + i] * t for i, t in enumerate(tags)) + sum(field.pair[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            total += w
            hit += w * np.array(tags)
        assert np.allclose(p[at : at + n], hit / total)
        for i in range(n - 1):
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a, b] += sum(
                        math.exp(sum(score[at + j] * (c >> j & 1) for j in range(n)) + sum(field.pair[c >> j & 1, c >> (j + 1) & 1] for j in range(n - 1)))
                        for c in range(2**n)
                        if c >> i & 1 == a and c >> (i + 1) & 1 == b
                    ) / total
        at += n
    assert np.allclose(expected, pairs)


@pytest.mark.parametrize("stretch", [1, 2, 3, 5])
def test_chains_run_through_stretches(monkeypatch, stretch):
    """Marginals and pairs do not depend on how a chain is laid out."""
    rng = np.random.default_rng(stretch)
    field = toxicity.Field(rng.normal(size=toxicity.FEATURES), -0.3, 2 * rng.normal(size=(2, 2)))
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 90, n)).encode() for n in (1, 10, 0, 7, 31, 2, 15)]
    features, text, _, _ = toxicity.featurize(texts)
    whole = field.marginals(features, text, want_pairs=True)
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    parts = field.marginals(features, text, want_pairs=True)
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_long_texts_are_featurized_in_parts(monkeypatch):
    texts = ["é word, (another) " * 40, "", "x", "  two words  " * 9]
    whole = toxicity.featurize([t.encode() for t in texts])
    monkeypatch.setattr(toxicity.words, "BLOCK", 50)
    assert all((a == b).all() for a, b in zip(whole, toxicity.featurize([t.encode() for t in texts]), strict=True))


def test_toxicity_of_odd_tables(spark, make_docs):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, "you vile worm" if i % 2 else "a calm day é") for i in range(60)] + [(None, "x"), (1, None), (2, "")]).selectExpr("*", "1 as l_id", "2 as toxic")
    for own in (labels, labels.limit(0)):
        got = toxicity.detect(docs, toxicity.fit(docs, own)).collect()
        assert len(got) == 63 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.detect(make_docs([]), toxicity.fit(docs, labels)).count() == 0


def test_offsets_are_code_points(make_docs, spark):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = make_docs([(i, "é😀 you vile worm" if i % 2 else "é😀 a calm day") for i in range(400)])
    got = {r.doc_id: r for r in toxicity.detect(docs, toxicity.fit(docs, labels)).collect()}
    spans = {"é😀 you vile worm"[s.start : s.end] for s in got[1].offending}
    assert spans and spans <= {"you", "vile", "worm"} and not got[0].offending and got[1].score > 0.9 > 0.1 > got[0].score


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out.cache()
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] > 0
    kept = docs.collect()
    near = Counter(r.doc_id for r in kept)
    assert max(near.values()) <= 3
    final = corpus_pipeline.run(spark, sf_dir)
    assert Counter(r.doc_id for r in final.collect()) == near
    taken = {r.doc_id: r.copies for r in mixing.mix(docs.dropDuplicates(["doc_id"])).collect()}
    assert set(near) == set(taken)


def test_pipeline_of_odd_tables(spark, make_docs, tmp_path):
    rows = [(1, "A good text of some words."), (2, None), (3, ""), (None, "No id has this one."), (4, "A good text of some words."), (5, "No source.", None), (6, "long text " * 20_000), (7, " \t")]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", make_docs(rows).selectExpr("*", "1 as key", "2 as mark", "3 as m_id")), ("none", make_docs([]))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in got} <= {4, None, 5, 6} and (name == "none") == (not got)
