"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (PASSAGE_WORDS words each).  A passage is
encoded from how its bytes follow each other by class (lower, upper, digit,
space, symbol, ...), how many of its words are new and how long they are; a
learned layer makes a vector of that.  Gated attention, learned from document
labels only, weighs the passages, and a linear layer scores the weighted mean.
Everything is trained in numpy by Adam on a bounded sample of labelled
documents; what is sent for training are passage encodings, not texts.

Defined results: a null, empty or blank text is one passage of zeros; texts of
any length are encoded whole; a null id is held out; null labels are not
learned from; without a label, or with one kind only, every score is the share
of label 1 (0.5 without any); repeated rows are scored alike; of several labels
or texts of one id the least is learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, held_out, map_texts, one_per_key

PASSAGE_WORDS = 64
SAMPLE = 4000  # labelled documents learned from, about
SAMPLE_CHARS = 30_000  # of these, longer documents are passed over
PIECE = 1 << 20  # bytes encoded at once
HIDDEN, GATES = 24, 12
THRESHOLD = 0.3

_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)  # bytes beyond ASCII, and control characters
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\x0b\x0c\r", b"\n", b".,;:", b"!?", b"#*$%&|<>", b"\"'()[]{}-_/\\+=@^~`")):
    _CLASS[list(_chars)] = _k
WIDTH = _CLASSES * _CLASSES + 5


def passages(text: str | None) -> np.ndarray:
    """Encodings of the passages of one text, a row each."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    n = -(-len(words) // PASSAGE_WORDS)
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, WIDTH), np.float32)
    # a passage begins with its first word; what stands before the first word belongs to the first passage
    space = np.isin(raw, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))[::PASSAGE_WORDS]
    begins[0] = 0
    pairs = np.zeros(n * _CLASSES * _CLASSES, np.int64)
    for at in range(0, len(raw), PIECE):
        kinds = _CLASS[raw[at:at + PIECE + 1]].astype(np.int64)
        which = np.searchsorted(begins, np.arange(at, at + max(len(kinds) - 1, 0)), side="right") - 1
        pairs += np.bincount((which * _CLASSES + kinds[:-1]) * _CLASSES + kinds[1:], minlength=len(pairs))
    pairs = pairs.reshape(n, -1)
    out[:, :-5] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    for k in range(n):
        part = words[k * PASSAGE_WORDS:(k + 1) * PASSAGE_WORDS]
        lengths = [len(w) for w in part]
        out[k, -5:] = (len(set(part)) / len(part), np.log1p(len(part)) / 4, np.log1p(sum(lengths) / len(part)) / 2,
                       np.log1p(max(lengths)) / 4, sum([a == b for a, b in zip(part, part[1:])]) / len(part))
    return out


@dataclass
class MilModel:
    """h = relu(x A + a); attention over h by (tanh(h V) * sigmoid(h U)) w; score = sigmoid(mean . c + b)."""

    weights: dict[str, np.ndarray]
    share: float = 0.5  # of label 1; the score if nothing could be learned

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(sizes), self.share)
        return forward(self.weights, x, sizes)[0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray):
    """Scores of bags whose passages stand one after the other in ``x``, and what the gradient needs."""
    at = np.cumsum(sizes) - sizes
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.maximum(x @ w["A"] + w["a"], 0)
    t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    e = (t * g) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    att = e / np.add.reduceat(e, at)[bag]
    z = np.add.reduceat(att[:, None] * h, at, axis=0)
    p = sigmoid(z @ w["c"] + w["b"])
    return p, (bag, at, h, t, g, att, z)


def gradient(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, (bag, at, h, t, g, att, z) = forward(w, x, sizes)
    d = (p - y) / len(y)
    dz = d[:, None] * w["c"]
    datt = (dz[bag] * h).sum(axis=1)
    de = att * (datt - np.add.reduceat(att * datt, at)[bag])
    dt, dg = de[:, None] * w["w"] * g * (1 - t * t), de[:, None] * w["w"] * t * g * (1 - g)
    dh = (att[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (h > 0)
    return {"A": x.T @ dh, "a": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "b": d.sum(keepdims=True)}


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 1, steps: int = 1500, batch: int = 64, rate: float = 3e-3) -> MilModel:
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return MilModel({}, share)
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, (1 / shape[0]) ** 0.5, shape)
    w = {"A": start(WIDTH, HIDDEN) * 2, "a": np.zeros(HIDDEN), "V": start(HIDDEN, GATES), "U": start(HIDDEN, GATES), "w": start(GATES),
         "c": start(HIDDEN), "b": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    order, at = rng.permutation(len(bags)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(bags)), 0
        rows = order[at:at + batch]
        at += batch
        chosen = [bags[i] for i in rows]
        grads = gradient(w, np.concatenate(chosen), np.array([len(b) for b in chosen]), labels[rows])
        lr = rate * (1 - step / steps) + rate / 50
        for k, grad in grads.items():
            grad = grad + 1e-4 * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] = w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return MilModel(w, share)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> MilModel:
    """A model from about SAMPLE labelled documents that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IS NOT NULL")
    src = (docs.where(~held_out(id_col)).where(F.coalesce(F.length(text_col), F.lit(0)) <= SAMPLE_CHARS)
           .select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    # ids are sampled before texts are joined to them
    sample = hashed_sample(known.where(~held_out("id")), "id", SAMPLE)
    rows = one_per_key(src.join(F.broadcast(sample), "id"), "id")  # SAMPLE rows, about

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passages(t.as_py()).ravel() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float32()))], ["id", "y", "x"])

    got = map_texts(rows.select(F.col("id").cast("string").alias("id"), "y", "text"), run, "id string, y int, x array<float>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["id"][i].as_py() or "", got["y"][i].as_py(), len(got["x"][i])))
    bags = [got["x"][i].values.to_numpy().reshape(-1, WIDTH) for i in order]
    return train(bags, np.array([got["y"][i].as_py() for i in order], float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = THRESHOLD, model: MilModel | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                x = passages(text.as_py())
                scores[i] = known.scores(x, np.array([len(x)]))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return map_texts(src, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
