"""Toxicity by a classifier chain.

Categories are predicted one after the other.  Each has a linear (logistic)
model over the presence of words and word beginnings, and the probabilities of
the categories before it.  For training, those probabilities are out-of-fold:
every sampled document gets them from models that have not seen it, so later
models learn from what they will meet.  The last category is the label
``toxic`` itself; the ones before it are learned from the toxic documents of the
sample and the words that mark them (MARKS times as frequent as elsewhere):
``kind_1`` and ``kind_2`` are two clusters of those documents by the marking
words they use, the larger first, and ``dense`` are those that use more of them
than the median one.

A model's words are chosen by how much more often they stand in documents of
the category, on the same rows the model learns from.  Probabilities of the
last model are calibrated (Platt) and its threshold set on the out-of-fold
scores.

Defined results: a null or wordless text has no features and gets the score of
that; texts are read whole; a null id is held out; null labels are not learned
from; without two kinds of labels every score is the share of toxic ones (0
without any) and nothing is predicted unless all are toxic; repeated rows are
scored alike; of several labels or texts of one id the
least label and the least features are learned from;
long documents are learned from like others, by at most SAMPLE_FEATURES of
their features; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, held_out, map_texts, one_per_key

CATEGORIES = ("kind_1", "kind_2", "dense", "toxic")
MARKS = 4.0  # times as frequent in toxic documents as in others
ROUNDS = 20  # of clustering
SAMPLE = 6000  # labelled documents learned from, about
SAMPLE_FEATURES = 16_384  # of a sampled document; of more, those with the least numbers, the same ones in every document
FOLDS = 4
BEGINNINGS = (4, 5, 6)  # letters
WORDS_USED = 400  # features of a model, at most
MIN_DOCUMENTS = 4  # a feature must stand in
RIDGE = 1.0
KNOWN = 300_000  # words whose features are remembered by a task

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Numbers of a word and of its beginnings, 32 bits each."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(b"\0" + word[:n].encode()) for n in BEGINNINGS if len(word) >= n]


def features(text: str | None) -> np.ndarray:
    return np.array(sorted({f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}), np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Logistic model: weights of chosen features, then of earlier categories' probabilities, then a constant."""

    chosen: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    before: np.ndarray
    constant: float

    def logits(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return x @ self.weights + before @ self.before + self.constant


def frequent(docs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Documents as places in the sorted features that enough of them have to be chosen, and those features."""
    values, at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *docs]), return_inverse=True, return_counts=True)
    often = n >= MIN_DOCUMENTS
    place = np.where(often, np.cumsum(often) - 1, -1)[at]
    ends = np.cumsum([len(f) for f in docs])[:-1]
    return [p[p >= 0] for p in np.split(place, ends)] if docs else [], values[often]


def choose(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features that tell the kinds apart best, by smoothed log odds times the root of how many documents have them."""
    flat = np.concatenate([np.zeros(0, np.int64), *docs])  # small numbers: places in the frequent features
    count = np.bincount(flat)
    p = np.bincount(flat, weights=np.repeat(y, [len(f) for f in docs]))
    n, k = len(y), y.sum()
    gain = np.abs(np.log((p + 0.5) / (k + 1)) - np.log((count - p + 0.5) / (n - k + 1))) * np.sqrt(count)
    gain[count < MIN_DOCUMENTS] = -1
    best = np.argsort(-gain, kind="stable")[:WORDS_USED]
    return np.sort(best[gain[best] >= 0])


def presence(docs: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(docs), len(chosen)))
    if len(chosen):
        flat = np.concatenate([np.zeros(0, np.int64), *docs])
        column = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
        hit = chosen[column] == flat
        x[np.repeat(np.arange(len(docs)), [len(f) for f in docs])[hit], column[hit]] = 1
    return x


def fit(docs: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression by Newton steps."""
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(before.shape[1]), float(np.log(share / (1 - share))))
    chosen = choose(docs, y)
    x = np.hstack([presence(docs, chosen), before, np.ones((len(y), 1))])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, x.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    k = len(chosen)
    return Linear(chosen, w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear]
    scale: tuple[float, float] = (1.0, 0.0)  # of the last logit
    threshold: float = 0.5
    chosen: np.ndarray = field(init=False)  # features of any model

    def __post_init__(self):
        self.chosen = np.unique(np.concatenate([m.chosen for m in self.models])) if self.models else np.zeros(0, np.int64)
        self._at = [np.searchsorted(self.chosen, m.chosen) for m in self.models]

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        """A row per document (by ``chosen``), a column per category; each model reads the ones before it."""
        out = np.zeros((len(present), len(self.models)))
        last = np.zeros(len(present))
        for k, (m, at) in enumerate(zip(self.models, self._at, strict=True)):
            last = m.logits(present[:, at], out[:, :k])
            out[:, k] = sigmoid(last)
        out[:, -1] = sigmoid(self.scale[0] * last + self.scale[1])
        return out


def two_kinds(x: np.ndarray) -> np.ndarray:
    """0 or 1 for every row: spherical k-means of two centres, the larger cluster is 0."""
    rows = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    apart = rows - rows.mean(axis=0)
    side = (apart @ np.linalg.svd(apart, full_matrices=False)[2][0] > 0) if min(rows.shape) else np.zeros(len(rows), bool)
    centres = np.stack([rows[side == c].sum(axis=0) for c in (False, True)])  # the halves along the widest direction
    for _ in range(ROUNDS):
        at = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[at == c].sum(axis=0) for c in (0, 1)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return at if 2 * at.sum() <= len(at) else 1 - at


def categories_of(docs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Labels of the sample, a column per category."""
    out = np.zeros((len(docs), len(CATEGORIES)))
    out[:, -1] = toxic
    if not 0 < toxic.sum() < len(toxic):
        return out
    docs, _ = frequent(docs)
    chosen = choose(docs, toxic)
    x, bad = presence(docs, chosen), toxic > 0
    marking = (x[bad].sum(axis=0) + 0.5) / (bad.sum() + 1) > MARKS * (x[~bad].sum(axis=0) + 0.5) / ((~bad).sum() + 1)
    x = x[bad][:, marking]
    kind, uses = two_kinds(x), x.sum(axis=1)
    out[bad, 0], out[bad, 1], out[bad, 2] = kind == 0, kind == 1, uses > np.median(uses)
    return out


def train(docs: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...] = CATEGORIES, seed: int = 1) -> Chain:
    """A chain over the columns of ``labels`` in their order."""
    n, kinds = labels.shape
    docs, names = frequent(docs)
    fold = np.random.default_rng(seed).permutation(n) % FOLDS
    before = np.zeros((n, 0))  # out-of-fold probabilities of the categories so far
    x = np.zeros(n)  # out-of-fold logits of the last one
    models = []
    for k in range(kinds):
        x = np.zeros(n)
        for f in range(FOLDS):
            seen, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(rest):
                continue
            m = fit([docs[i] for i in seen], before[seen], labels[seen, k])
            x[rest] = m.logits(presence([docs[i] for i in rest], m.chosen), before[rest])
        models.append(fit(docs, before, labels[:, k]))
        before = np.hstack([before, sigmoid(x)[:, None]])
    for m in models:
        m.chosen = names[m.chosen]
    chain = Chain(categories, models)
    y = labels[:, -1]
    if 0 < y.sum() < n:
        platt = fit([np.zeros(0, np.int64)] * n, x[:, None], y)
        chain.scale = (float(platt.before[0]), platt.constant)
        p = sigmoid(chain.scale[0] * x + chain.scale[1])
        bounds = np.linspace(0.05, 0.95, 91)
        f1 = [2 * (y * (p >= b)).sum() / max(y.sum() + (p >= b).sum(), 1) for b in bounds]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        chain.threshold = float(bounds[best[len(best) // 2]])
    return chain


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL")
    src = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = hashed_sample(known.where(~held_out("id")), "id", SAMPLE)
    rows = src.join(F.broadcast(sample), "id")  # SAMPLE rows, about; encoded where they are read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py())[:SAMPLE_FEATURES] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "y", "x"])

    found = map_texts(rows.select(F.col("id").cast("string").alias("id"), "y", "text"), run, "id string, y int, x array<long>")
    got = one_per_key(found, "id").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["id"][i].as_py() or "", got["y"][i].as_py()))
    docs_ = [got["x"][i].values.to_numpy() for i in order]
    toxic = np.array([got["y"][i].as_py() for i in order], float)
    if not len(toxic):
        none = Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), -30.0)
        return Chain(CATEGORIES, [Linear(none.chosen, none.weights, np.zeros(k), -30.0) for k in range(len(CATEGORIES))])
    return train(docs_, categories_of(docs_, toxic))


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           chain: Chain | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, a probability per
    category before the last, score (of ``toxic``), predicted (int) and toxic (boolean)."""
    chain = chain or learn(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    earlier = list(chain.categories[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        column = {int(f): i for i, f in enumerate(known.chosen)}
        words: dict[str, list[int]] = {}  # columns a word turns on
        for batch in batches:
            present = np.zeros((batch.num_rows, len(column)))
            for i, text in enumerate(batch.column(2)):
                for w in set(_WORD.findall((text.as_py() or "").lower())):
                    on = words.get(w)
                    if on is None:
                        on = [column[f] for f in word_features(w) if f in column]
                        if len(words) >= KNOWN:
                            words.clear()
                        words[w] = on
                    if on:
                        present[i, on] = 1
            p = known.probabilities(present)
            hit = p[:, -1] >= known.threshold
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(p[:, k]) for k in range(len(earlier))), pa.array(p[:, -1]),
                                              pa.array(hit.astype(np.int32)), pa.array(hit)], ["doc_id", "held_out", *earlier, "score", "predicted", "toxic"])

    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return map_texts(src, run, f"doc_id {kind}, held_out boolean, " + "".join(f"{c} double, " for c in earlier) + "score double, predicted int, toxic boolean")
