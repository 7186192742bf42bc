"""Toxicity by a linear-chain conditional random field over words.

Documents carry labels, words do not, so labelled words are made first: in the
documents that train the tagger, a word form or prefix that occurs in toxic
documents too often for chance marks its words toxic there; words of clean
documents are clean. The field has two tags, scores a word by its form and its
prefixes of 3 to 6 bytes (hashed), and scores tag pairs. Forward-backward
marginals give each word's probability to be toxic, a logistic regression on
their aggregates, fitted on documents the tagger did not see, turns them into a
document score, and words over one half are the offending offsets.

Only rows whose crc32(doc_id) mod 4 is not 2 teach, at most ``LABELLED`` of them
(those of least hashed id), two thirds for the tagger, one for the score. A chain
runs through a whole document. For speed it is laid out in stretches of ``STRETCH``
words: a stretch's effect on a message is one two by two matrix, messages are
carried from stretch to stretch by these, and then spread inside all stretches at
once, which gives the chain's own marginals.

Defined cases: a null or empty text has no words and gets the regression's
intercept; without toxic labels every score is the base rate; rows that repeat
an id are scored each for itself; a null id is not held out; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

FEATURES = 1 << 18
PREFIXES = (3, 4, 5, 6)
LABELLED = 6_000
STRETCH = 64
STEPS = 25
#: Bytes of the sample that training works on at once.
CHUNK = 1 << 18
TRIM = np.zeros(256, bool)
TRIM[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4) == 2


def featurize(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(features words x (1 + prefixes), text of each word, byte starts and ends in its
    text). Texts go through in blocks, a long one cut at white space."""
    out: list[tuple[np.ndarray, ...]] = []
    block: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        for part in words.pieces(t):
            block.append((i, at, part))
            at += len(part)
            size += len(part)
            if size > words.BLOCK:
                out.append(_featurize(block))
                block, size = [], 0
    out.append(_featurize(block))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _featurize(block: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of parts of texts: (text, the part's place in it, the part)."""
    data = LOWER[np.frombuffer(b" ".join(b for _, _, b in block), np.uint8)]
    starts, ends = words.bounds(data)
    edges = np.cumsum([0] + [len(b) + 1 for _, _, b in block])
    part = np.searchsorted(edges, starts, side="right") - 1
    left, right = starts.copy(), ends.copy()
    for _ in range(2):  # quotes, commas and stops around a word
        right -= ((right - left > 1) & TRIM[data[right - 1]]) if len(right) else 0
        left += ((right - left > 1) & TRIM[data[left]]) if len(left) else 0
    values, columns = data.astype(np.uint64), []
    for k in (None, *PREFIXES):
        stop = right if k is None else np.minimum(left + k, right)
        h = words.polynomial(values, left, stop) + np.uint64(k or 0)
        columns.append((words.mix(h) >> np.uint64(46)).astype(np.int32))
    text, base = (np.array([b[i] for b in block], np.int64) for i in range(2))
    shift = base[part] - edges[part] if len(part) else part
    return np.stack(columns, axis=1), text[part] if len(part) else part, starts + shift, ends + shift


def stretches(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each word in a table of sequences."""
    n = len(text)
    first = np.concatenate([[True], text[1:] != text[:-1]]) if n else np.zeros(0, bool)
    at = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    return np.cumsum(at % STRETCH == 0) - 1, at % STRETCH


@dataclass
class Field:
    """weights by feature; pair[a, b] scores tag b after tag a."""

    weights: np.ndarray
    bias: float
    pair: np.ndarray

    def marginals(self, features: np.ndarray, text: np.ndarray, want_pairs: bool = False):
        """P(toxic) of each word; with ``want_pairs`` also expected tag pairs. Words of a
        text are consecutive."""
        row, col = stretches(text)
        if not len(row):
            return np.zeros(0), np.zeros((2, 2))
        rows, width = row[-1] + 1, col.max() + 1
        score = np.zeros((width, rows))
        score[col, row] = sum(self.weights[f] for f in features.T) + self.bias
        real = np.zeros((width, rows), bool)
        real[col, row] = True
        first = np.flatnonzero(col == 0)
        goes_on = np.concatenate([[False], text[first][1:] == text[first][:-1]])  # a stretch that continues the one before it
        pair, e = self.pair, np.exp(self.pair)

        def step(odds: np.ndarray, table: np.ndarray) -> np.ndarray:
            """Log odds of toxic over clean after one tag pair."""
            q = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            return np.log(((1 - q) * table[0, 1] + q * table[1, 1]) / ((1 - q) * table[0, 0] + q * table[1, 0]))

        fore, back = np.zeros((width, rows)), np.zeros((width, rows))
        into, after = np.zeros(rows), np.zeros(rows)
        if goes_on.any():
            into, after = self._carried(score, real, goes_on)
        fore[0] = score[0] + np.where(goes_on, step(into, e), 0.0)
        for t in range(1, width):
            fore[t] = score[t] + step(fore[t - 1], e)
        last = np.concatenate([goes_on[1:], [False]])  # a stretch that is continued: whole, so its last word is in the last place
        back[width - 1] = np.where(last, after, 0.0)
        for t in range(width - 2, -1, -1):
            back[t] = np.where(real[t + 1], step(back[t + 1] + score[t + 1], e.T), 0.0)
        p = 1 / (1 + np.exp(-np.clip(fore + back, -60, 60)))
        expected = np.zeros((2, 2))
        if want_pairs:
            links = [(fore[t][real[t + 1]], (back[t + 1] + score[t + 1])[real[t + 1]]) for t in range(width - 1)]
            links.append((fore[width - 1][last], (back[0] + score[0])[goes_on]))
            for a, b in links:
                joint = np.stack([np.full_like(a, pair[0, 0]), pair[0, 1] + b, pair[1, 0] + a, pair[1, 1] + a + b])
                joint = np.exp(joint - joint.max(axis=0)) if len(a) else joint
                expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        return p[col, row], expected

    def _carried(self, score: np.ndarray, real: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per stretch, the forward message of the word before it and the backward
        message at its last word. A stretch takes log odds f to log((a e^f + b) / (c e^f + d));
        a, b, c, d are kept as logarithms."""
        pair, (width, rows) = self.pair, score.shape
        zero, none = np.zeros(rows), np.full(rows, -np.inf)
        add = np.logaddexp

        def apply(m: tuple[np.ndarray, ...], at: np.ndarray, f: np.ndarray) -> np.ndarray:
            a, b, c, d = (x[at] for x in m)
            return add(a + f, b) - add(c + f, d)

        def scaled(m: list[np.ndarray]) -> tuple[np.ndarray, ...]:
            top = np.maximum.reduce(m)
            return tuple(x - top for x in m)

        fore = back = (zero, none, none, zero)
        for t in range(width):
            s, (a, b, c, d) = score[t], fore
            m = [s + add(pair[1, 1] + a, pair[0, 1] + c), s + add(pair[1, 1] + b, pair[0, 1] + d), add(pair[1, 0] + a, pair[0, 0] + c), add(pair[1, 0] + b, pair[0, 0] + d)]
            if t == 0:  # a text's first word follows none
                m = [np.where(goes_on, x, y) for x, y in zip(m, (none, s, none, zero), strict=True)]
            fore = scaled([np.where(real[t], x, y) for x, y in zip(m, fore, strict=True)])
        for t in range(width - 1, -1, -1):
            s, (a, b, c, d) = score[t], back
            m = [add(pair[1, 1] + s + a, pair[1, 0] + c), add(pair[1, 1] + s + b, pair[1, 0] + d), add(pair[0, 1] + s + a, pair[0, 0] + c), add(pair[0, 1] + s + b, pair[0, 0] + d)]
            back = scaled([np.where(real[t], x, y) for x, y in zip(m, back, strict=True)])
        at = np.arange(rows)
        depth = at - np.maximum.accumulate(np.where(goes_on, 0, at))  # a stretch's number in its text
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        into, out, after = np.zeros(rows), np.zeros(rows), np.zeros(rows)
        for k in range(depth.max() + 1):
            now = order[edges[k] : edges[k + 1]]
            into[now] = out[now - 1] if k else 0.0
            out[now] = apply(fore, now, into[now])
        for k in range(depth.max(), 0, -1):
            now = order[edges[k] : edges[k + 1]]
            after[now - 1] = apply(back, now, after[now])
        return into, after


@dataclass
class Chunk:
    """Some whole documents of the sample; ``tags`` is 0/1 per word."""

    features: np.ndarray
    text: np.ndarray
    toxic: np.ndarray
    tags: np.ndarray


def chunked(texts: list[bytes], toxic: np.ndarray) -> list[Chunk]:
    """The sample in parts of about CHUNK bytes, so that working memory stays small."""
    out = []
    for s, e in words.slices(texts, CHUNK):
        features, text, _, _ = featurize(texts[s:e])
        out.append(Chunk(features, text.astype(np.int32), toxic[s:e], np.zeros(len(text))))
    return out


def label_words(chunks: list[Chunk]) -> None:
    """Sets tags from document labels. A form or prefix tells if so many of its
    documents are toxic that chance would not do that to any of the candidates:
    n KL(its toxic share || the base share) > ln(candidates) + 2."""
    n, bad = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    for c in chunks:
        found = np.unique(c.text.repeat(c.features.shape[1]).astype(np.int64) * FEATURES + c.features.ravel())
        doc, feature = found // FEATURES, found % FEATURES
        n += np.bincount(feature, minlength=FEATURES)
        bad += np.bincount(feature[c.toxic[doc] == 1], minlength=FEATURES)
    toxic = np.concatenate([c.toxic for c in chunks]) if chunks else np.zeros(0)
    base = np.clip(toxic.mean() if len(toxic) else 0.5, 1e-6, 1 - 1e-6)
    share = np.clip(bad / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    telling = (share > max(0.5, base)) & (surprise > np.log(max(1, (n > 0).sum())) + 2)
    for c in chunks:
        c.tags = (telling[c.features].any(axis=1) & (c.toxic[c.text] == 1)).astype(np.float64)


def train_field(chunks: list[Chunk], steps: int = STEPS) -> Field:
    """Maximum likelihood by Adagrad over all sequences, with a small L2 penalty."""
    n, marked = sum(len(c.tags) for c in chunks), sum(c.tags.sum() for c in chunks)
    field = Field(np.zeros(FEATURES), float(np.log((marked + 0.5) / (n - marked + 0.5))) if n else -3.0, np.zeros((2, 2)))
    if not marked:
        return field
    seen = np.zeros((2, 2))
    for c in chunks:
        linked = c.text[1:] == c.text[:-1]
        np.add.at(seen, (c.tags[:-1][linked].astype(int), c.tags[1:][linked].astype(int)), 1)
    power_w, power_p, power_b = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(steps):
        grad, pair_grad, bias_grad = -0.01 * field.weights, seen - 0.01 * field.pair, 0.0
        for c in chunks:
            p, expected = field.marginals(c.features, c.text, want_pairs=True)
            gap = c.tags - p
            for column in c.features.T:
                grad += np.bincount(column, gap, FEATURES)
            pair_grad -= expected
            bias_grad += gap.sum()
        power_w += grad**2
        field.weights += 0.5 * grad / np.sqrt(power_w)
        power_p += pair_grad**2
        field.pair += 0.2 * pair_grad / np.sqrt(power_p)
        power_b += bias_grad**2
        field.bias += 0.2 * bias_grad / power_b**0.5
    return field


def aggregates(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, log odds of the likeliest word, log(1 + expected toxic words)."""
    top = np.full(n, 1e-6)
    np.maximum.at(top, text, np.clip(p, 1e-6, 1 - 1e-6))
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(np.bincount(text, p, n))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -2, 2)
    return beta


@dataclass
class Model:
    field: Field
    beta: np.ndarray

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        """(scores, offending words as code point spans) of the texts."""
        scores, spans = [], []
        for s, e in words.slices(texts):
            features, text, starts, ends = featurize(texts[s:e])
            p, _ = self.field.marginals(features, text)
            x = aggregates(p, text, e - s)
            scores.append(1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30))))
            found: list[list[dict]] = [[] for _ in range(e - s)]
            hit = np.flatnonzero(p > 0.5)
            for t in np.unique(text[hit]).tolist():
                # code points before each byte of the text: bytes that begin one
                before = np.concatenate([[0], np.cumsum((np.frombuffer(texts[s + t], np.uint8) & 0xC0) != 0x80)])
                own = hit[slice(*np.searchsorted(text[hit], [t, t + 1]))]
                found[t] = [{"start": a, "end": b} for a, b in zip(before[starts[own]].tolist(), before[ends[own]].tolist(), strict=True)]
            spans += found
        return (np.concatenate(scores) if scores else np.zeros(0)), spans


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> Model:
    """``labels`` has doc_id and toxic. The sample comes to the driver."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("l_id"), "l_id")
        .limit(labelled)
    )
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = plain.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("l_id", "text", "toxic").toArrow()  # at most `labelled` ids
    order = np.argsort(words.mix(got.column("l_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
    texts, toxic = words.as_bytes(got.column("text").combine_chunks()), got.column("toxic").to_numpy()
    del got
    rest = order[::3]
    tag = np.setdiff1d(order, rest)
    chunks = chunked([texts[i] for i in tag], toxic[tag])
    label_words(chunks)
    field = train_field(chunks)
    del chunks
    x = [np.zeros((0, 3))]
    for c in chunked([texts[i] for i in rest], toxic[rest]):
        x.append(aggregates(field.marginals(c.features, c.text)[0], c.text, len(c.toxic)))
    return Model(field, fit_logistic(np.concatenate(x), toxic[rest].astype(float)) if len(rest) else np.array([-2.0, 0.0, 0.0]))


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, offending (spans in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for b in batches for x in words.few_texts(b, 1)):
            scores, spans = shared.value.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, span_type)], ["doc_id", "score", "offending"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,end:int>>")
