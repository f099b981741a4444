"""Toxicity scores from subword bags.

A word is the bag of its character n-grams (with word-boundary marks) and itself, each
with an embedding; a window of words is the average of its words, and a linear softmax
over two classes reads it.  Embeddings and softmax are trained jointly, in numpy.
A document's evidence is its most toxic window, so that one passage in a long text counts
in full; training alternates between picking these windows and fitting them.

As everything before the softmax is an average, a trained model folds into one number for
each n-gram bucket, and scoring is table look-ups and prefix sums over the raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import _BYTE, ALNUM, _powers, lean, mix, pieces, small_batches, steps, word_hashes, words

#: Labelled documents of each class to train on at most, those of the smallest hash of doc_id, and their bytes.
TRAIN_DOCS = 3000
TRAIN_BYTES = 4_000_000
#: Places of the hash that picks them, so many that the bound holds for any number of rows.
PLACES = 1 << 62
BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
#: Words of a window.
WINDOW = 8
EPOCHS, BATCH, RATE = 6, 512, 0.1
_U = np.uint64


def buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every subword: the words themselves and their n-grams with boundary marks."""
    parts = [(lo, *_buckets(*x)) for lo, _, *x in pieces(data, starts, ends)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate([lo + owner for lo, owner, _ in parts]).astype(np.int32), np.concatenate([x for _, _, x in parts])


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = _powers(len(data) + 1)
    n = len(starts)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE[data] * p[: len(data)], dtype=_U, out=total[1:])
        owner, out = [np.arange(n, dtype=np.int32)], [(mix((total[ends] - total[starts]) * q[starts]) % _U(BUCKETS)).astype(np.int32)]
        size = ends - starts
        for k in GRAMS:
            each = np.maximum(size - k + 1, 0)
            word = np.repeat(np.arange(n, dtype=np.int32), each)
            at = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each) + starts[word]
            h = (total[at + k] - total[at]) * q[at]
            h += (at == starts[word]).astype(_U) * _U(0x51ED270B) + (at + k == ends[word]).astype(_U) * _U(0xA3B1957D) + _U(k)
            owner.append(word)
            out.append((mix(h) % _U(BUCKETS)).astype(np.int32))
    return np.concatenate(owner), np.concatenate(out)


class Model:
    """The folded model: a number for each bucket, a bias, and the usual score of a clean text's word, which pads short texts."""

    def __init__(self, table: np.ndarray, bias: float, usual: float = 0.0):
        self.table, self.bias, self.usual = table.astype(np.float32), float(bias), float(usual)

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._word_scores(*x) for _, _, *x in pieces(data, starts, ends))])

    def _word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        p, q = _powers(len(data) + 1)
        size = ends - starts
        with np.errstate(over="ignore"):
            total = np.zeros(len(data) + 1, dtype=_U)
            np.cumsum(_BYTE[data] * p[: len(data)], dtype=_U, out=total[1:])
            sums = self.table[(mix((total[ends] - total[starts]) * q[starts]) % _U(BUCKETS)).astype(np.int64)].astype(np.float64)
            kinds = np.ones(len(starts))
            for k in GRAMS:
                if len(data) < k:
                    continue
                h = (total[k:] - total[:-k]) * q[: len(data) - k + 1]
                mark = np.full(len(h), k, dtype=_U)
                mark[starts[starts < len(h)]] += _U(0x51ED270B)
                stop = ends[ends >= k] - k
                mark[stop] += _U(0xA3B1957D)
                value = np.zeros(len(h) + 1)
                np.cumsum(self.table[(mix(h + mark) % _U(BUCKETS)).astype(np.int64)], dtype=np.float64, out=value[1:])
                each = np.maximum(size - k + 1, 0)
                ok = each > 0
                sums[ok] += value[starts[ok] + each[ok]] - value[starts[ok]]
                kinds += each
        return sums / kinds

    def score(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 of each row's most toxic window; rows without words count as all usual words."""
        out = []
        for _, _, data, offs in steps(column):
            starts, ends, at = words(data, offs, ALNUM)
            out.append(window_max(self.word_scores(data, starts, ends), at, self.usual)[0])
        logit = np.concatenate(out) if out else np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(logit + self.bias, -30, 30)))


def window_max(value: np.ndarray, at: np.ndarray, pad: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(largest mean of WINDOW neighbouring words, where it starts) of each row; a shorter row is one window, filled up with `pad`."""
    n = np.diff(at)
    total = np.concatenate([[0.0], np.cumsum(value)])
    first, best = np.zeros(len(n)), at[:-1].copy()
    short = n <= WINDOW
    first[short] = ((total[at[1:]] - total[at[:-1]]) + (WINDOW - n) * pad)[short] / WINDOW
    rows = np.flatnonzero(~short)
    if len(rows):
        means = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
        # reduceat over [first start, last start + 1) of each long row
        bounds = np.stack([at[:-1][rows], at[1:][rows] - WINDOW + 1], axis=1).reshape(-1)
        padded = np.append(means, -np.inf)
        first[rows] = np.maximum.reduceat(padded, bounds)[::2]
        peak = np.repeat(first[rows], np.diff(bounds)[::2])
        span = np.concatenate([np.arange(a, b) for a, b in bounds.reshape(-1, 2)])
        hit = span[means[span] >= peak]
        owner = np.searchsorted(bounds[::2], hit, "right") - 1
        u, i = np.unique(owner, return_index=True)
        best[rows[u]] = hit[i]
    return first, best


def train(texts: list[str], labels: list[int], toxic_share: float | None = None, seed: int = 7) -> Model:
    """Fit on whole texts; with one class only, the model gives that class's share to everything.

    toxic_share is the share of label 1 in all labels where the texts are a sample with another one.
    """
    y = np.array(labels)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    docs = []  # of each step: words and their subwords
    for lo, hi, data, offs in steps(pa.array(texts, pa.string())):
        starts, ends, at = words(data, offs, ALNUM)
        h = word_hashes(data, starts, ends)
        docs.append((lo, hi, data, starts, ends, at, h))
    # a vocabulary of distinct words, each a bag of buckets
    every = np.concatenate([d[6] for d in docs])
    vocabulary, first, ids = np.unique(every, return_index=True, return_inverse=True)
    base = 0
    owner_all, bucket_all = [], []
    for _, _, data, starts, ends, _, h in docs:
        mine = np.flatnonzero((first >= base) & (first < base + len(h)))
        mine = mine[np.argsort(first[mine])]  # in the order of their places
        own = first[mine] - base
        owner, bucket = buckets(data, starts[own], ends[own])
        owner_all.append(mine.astype(np.int32)[owner])
        bucket_all.append(bucket)
        base += len(h)
    owner, bucket = np.concatenate(owner_all), np.concatenate(bucket_all)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    ids = ids.astype(np.int32)
    del every, order, owner_all, bucket_all
    bag_at = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    doc_at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(d[5]) for d in docs]))])
    v = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, DIM)
    bias = 0.0
    seen_v, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full(DIM, 1e-8), 1e-8  # squared gradients so far, for step sizes

    def fold() -> np.ndarray:
        return (v @ w.astype(np.float32)).astype(np.float64)

    def vocabulary_scores() -> np.ndarray:
        s = fold()[bucket]
        total = np.concatenate([[0.0], np.cumsum(s)])
        return (total[bag_at[1:]] - total[bag_at[:-1]]) / np.maximum(np.diff(bag_at), 1)

    # every fifth document of each class is kept from the fit and calibrates the probabilities
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    apart = np.concatenate([toxic[::5], clean[::5]]) if min(len(toxic), len(clean)) >= 20 else np.arange(len(y))
    if len(apart) < len(y):
        toxic, clean = np.setdiff1d(toxic, apart), np.setdiff1d(clean, apart)

    def some_windows(rows: np.ndarray, each: int) -> np.ndarray:
        n = np.diff(doc_at)[rows]
        rows, n = np.repeat(rows, np.minimum(each, np.maximum(1, n // WINDOW))), np.repeat(n, np.minimum(each, np.maximum(1, n // WINDOW)))
        return doc_at[rows] + (rng.random(len(rows)) * np.maximum(n - WINDOW + 1, 1)).astype(np.int64)

    ends_of = np.repeat(doc_at[1:], np.diff(doc_at))
    for epoch in range(EPOCHS):
        if epoch == 0:
            pos, neg = some_windows(toxic, 24), some_windows(clean, 12)
        else:
            _, at = window_max(vocabulary_scores()[ids], doc_at)
            pos = at[toxic]
            neg = np.concatenate([at[clean], some_windows(clean, 6)])
            pos = np.tile(pos, max(1, min(8, len(neg) // (2 * max(1, len(pos))))))
        at = np.concatenate([pos, neg])
        want = np.repeat([1.0, 0.0], [len(pos), len(neg)])
        ok = at < doc_at[-1]
        at, want = at[ok], want[ok]
        weight = np.where(want == 1, 0.5 * len(want) / max(1, want.sum()), 0.5 * len(want) / max(1, (1 - want).sum())) if epoch == 0 else np.ones(len(want))
        for go in range(2):
            shuffled = rng.permutation(len(at))
            for b in range(0, len(at), BATCH):
                pick = shuffled[b : b + BATCH]
                n = np.minimum(ends_of[at[pick]] - at[pick], WINDOW)
                window = np.repeat(np.arange(len(pick)), n)
                place = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + at[pick][window]
                terms, inverse = np.unique(ids[place], return_inverse=True)
                size = bag_at[terms + 1] - bag_at[terms]
                sub = np.repeat(np.arange(len(terms)), size)
                flat = bucket[np.arange(len(sub)) - np.repeat(np.cumsum(size) - size, size) + bag_at[terms][sub]]
                start = np.cumsum(size) - size
                vectors = np.add.reduceat(v[flat], start, axis=0) / size[:, None]
                x = np.zeros((len(pick), DIM))
                np.add.at(x, window, vectors[inverse] / WINDOW)
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ w + bias, -30, 30)))
                g = (p - want[pick]) * weight[pick]
                gx = g[:, None] * w[None, :]
                gw = x.T @ g
                seen_w += gw * gw
                w -= RATE * gw / np.sqrt(seen_w)
                seen_b += g.sum() ** 2
                bias -= RATE * g.sum() / np.sqrt(seen_b)
                gt = np.zeros((len(terms), DIM))
                np.add.at(gt, inverse, gx[window] / WINDOW)
                used, slot = np.unique(flat, return_inverse=True)
                gv = np.zeros((len(used), DIM))
                np.add.at(gv, slot, np.repeat(gt / size[:, None], size, axis=0))
                seen_v[used] += (gv * gv).mean(axis=1)
                v[used] -= (RATE * gv / np.sqrt(seen_v[used])[:, None]).astype(np.float32)
    # calibrate scale and bias of the folded logit on documents, by Newton steps on two parameters
    table = fold()
    value = vocabulary_scores()[ids]
    usual = float(value[np.repeat(y == 0, np.diff(doc_at))].mean()) if (y == 0)[np.repeat(np.arange(len(y)), np.diff(doc_at))].any() else 0.0
    doc = window_max(value, doc_at, usual)[0][apart]
    y = y[apart]
    share = y.mean() if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    a, c = 1.0, bias
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * doc + c, -30, 30)))
        g = np.array([(weight * (p - y) * doc).sum() + 0.05 * a, (weight * (p - y)).sum()])
        s = weight * p * (1 - p) + 1e-9
        hess = np.array([[(s * doc * doc).sum() + 0.05, (s * doc).sum()], [(s * doc).sum(), s.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
    return Model(table * a, c, usual * a)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the texts of docs(doc_id, text) that labels(doc_id, toxic) marks; rows with a null label, text or id are ignored.

    Of each class at most about TRAIN_DOCS ids are used, those of the smallest hash of
    doc_id, and at most TRAIN_BYTES characters; the rest of the labels is not needed.  Ids alone are
    joined first, and only the chosen ones meet the texts.  Equal rows count once.
    """
    marked = labels.where("toxic in (0, 1)").select("doc_id", "toxic").distinct()
    known = docs.where("text is not null").select("doc_id").join(marked, "doc_id")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(PLACES))
    some = F.lit(False)
    for label, n in counts.items():
        some = some | ((F.col("toxic") == label) & (place < int(PLACES * min(1.0, TRAIN_DOCS / n))))
    chosen = F.broadcast(marked.where(some))  # about TRAIN_DOCS rows of each class
    sample = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").distinct()
    texts: list[str] = []
    marks: list[int] = []
    size = {k: 0 for k in counts}
    for r in sample.orderBy(place, "doc_id", "text").toLocalIterator():
        if size[r["toxic"]] < TRAIN_BYTES:
            size[r["toxic"]] += len(r["text"])
            texts.append(r["text"])
            marks.append(int(r["toxic"]))
        elif min(size.values()) >= TRAIN_BYTES:
            break
    return train(texts, marks, counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text of docs(doc_id, text), between 0 and 1.

    A null or empty text has the score of no evidence; rows keep their number, null
    and repeated ids too; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(b.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")
