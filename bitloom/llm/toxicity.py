"""Toxicity with classifier chains.

Categories are predicted one after another by linear models; each also reads the probabilities of the
categories before it. In training these come out of fold: a row's earlier probabilities are from a
model that hasn't seen the row, so later models learn from predictions as good as they'll get.

Features: which of ``n_words`` selected words (lower-cased, hashed) a text has anywhere in its whole
length. Words are selected by the significance of their difference between the labels of a category.

Training reads at most about ``max_labels`` labelled rows, taken by a hash of the id (the bound is the
only sample); their distinct word hashes and labels are what the driver gets. Every document is scored.

Null and empty texts have no features: they get the models' base rate and flag. Null labels leave a row
out of training; without labels of both kinds a category's probability is the share of ones (0 if there
are no labels). Repeated ids: each row is scored; a label row trains on the smallest text of its id, and a
repeated one counts once more. doc_id passes. Without documents there are no rows, and without labels or
labelled documents every probability is 0. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

_FEATURES = "doc_id long, labels array<double>, words array<long>"


def text_words(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct word hashes of each row. Marks around a word don't count."""
    for _, data, off in T.pieces(column):
        data = _PLAIN[data]
        s, e, first = T.words(data, off)
        h = T.word_hashes(data, s, e, lower=True)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(h[a:b])


#: ASCII punctuation parts words here.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Selected word hashes, and a weight vector (words, earlier categories, bias) for each category."""

    def __init__(self, categories: list[str]):
        self.categories, self.words, self.weights = categories, np.zeros(0, np.uint64), []

    def matrix(self, texts: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words)))
        if len(self.words):
            for i, t in enumerate(texts):
                at = np.minimum(np.searchsorted(self.words, t), len(self.words) - 1)
                x[i, at[self.words[at] == t]] = 1
        return x

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for w in self.weights:
            z = np.hstack((x, out, np.ones((len(x), 1)))) @ w
            out = np.hstack((out, 1 / (1 + np.exp(-np.clip(z, -30, 30)))[:, None]))
        return out

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, n_words: int, folds: int, ridge: float) -> Chain:
        self.words = _select(texts, labels, n_words)
        x = self.matrix(texts)
        earlier = np.zeros((len(x), 0))
        for c in range(labels.shape[1]):
            y, z = labels[:, c], np.hstack((x, earlier))
            if len(y) == 0 or y.min() == y.max():
                w = np.zeros(z.shape[1] + 1)
                rate = float(y.mean()) if len(y) else 0.0
                w[-1] = 30.0 if rate == 1 else -30.0
                self.weights.append(w)
                out = np.full(len(x), rate)
            else:
                self.weights.append(_logistic(z, y, ridge))
                out = np.full(len(x), y.mean())
                for f in range(folds):
                    test = fold == f
                    if test.any() and 0 < y[~test].mean() < 1:
                        w = _logistic(z[~test], y[~test], ridge)
                        out[test] = 1 / (1 + np.exp(-np.clip(np.hstack((z[test], np.ones((int(test.sum()), 1)))) @ w, -30, 30)))
            earlier = np.hstack((earlier, out[:, None]))
        return self


def _select(texts: list[np.ndarray], labels: np.ndarray, n_words: int) -> np.ndarray:
    """The words whose presence differs most between the labels, by a two-proportion z-score."""
    if not texts:
        return np.zeros(0, np.uint64)
    values, at = np.unique(np.concatenate(texts), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    seen = np.bincount(at, minlength=len(values))
    best = np.zeros(len(values))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        n1, n = y.sum(), len(y)
        if not 0 < n1 < n:
            continue
        with1 = np.bincount(at, weights=y[row], minlength=len(values))
        share = seen / n
        gap = with1 / n1 - (seen - with1) / (n - n1)
        z = np.abs(gap) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / (n - n1)))
        best = np.maximum(best, np.where(seen >= 5, z, 0))
    order = np.argsort(-best, kind="stable")[:n_words]
    return np.sort(values[order[best[order] > 3.0]])


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_labels: int = 8000, n_words: int = 300, folds: int = 5, ridge: float = 0.3) -> Chain:
    """labels: (id_col, a 0/1 column for each category)."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.array(*(F.col(c).cast("double") for c in categories)).alias("labels"))
    named = named.filter("doc_id is not null and not exists(labels, x -> x is null)")
    n = named.count()
    if n > max_labels:
        named = named.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_labels / n * (1 << 30)))
    named = named.withColumn("n", F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(named), "doc_id")  # at most about max_labels small rows
    rows = rows.groupBy("doc_id", "n").agg(F.min("labels").alias("labels"), F.min("text").alias("text")).drop("n")  # a text a label row

    rows = rows.select("doc_id", "labels", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [x.view(np.int64) for x in text_words(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["labels"].cast(pa.list_(pa.float64())), pa.array(w, pa.list_(pa.int64()))], names=["doc_id", "labels", "words"])

    got = rows.mapInArrow(features, _FEATURES).toArrow().sort_by("doc_id")
    texts = [np.array(w, dtype=np.int64).view(np.uint64) for w in got["words"].to_pylist()]
    y = np.array(got["labels"].to_pylist(), dtype=float).reshape(-1, len(categories))
    fold = (T.mix(got["doc_id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(folds)).astype(int)
    return Chain(categories).fit(texts, y, fold, n_words, folds, ridge)


def score_toxicity(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(chain)  # n_words x categories, whatever the input
    cats = chain.categories
    schema = ", ".join(["doc_id long", *(f"`p_{c}` double" for c in cats), *(f"`is_{c}` boolean" for c in cats)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in batches:
            p = model.predict(model.matrix(list(text_words(b["text"]))))
            cols = [p[:, c] for c in range(len(cats))] + [p[:, c] >= threshold for c in range(len(cats))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, cols)], names=["doc_id", *(f"p_{c}" for c in cats), *(f"is_{c}" for c in cats)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
