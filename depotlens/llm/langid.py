"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams (1 to 4) of its lower-cased letters and
word gaps, hashed into buckets.  Every bucket has an embedding; the mean over
all n-grams of the whole text goes through a linear layer and a softmax.
Embeddings and layer are trained by stochastic gradient descent in numpy on a
bounded sample of labelled documents; what the executors send for training
are bucket counts, not texts.  On a part of the sample that training did not
see, a temperature is fitted to the scores, and the rejection bound is set.

A softmax must choose among the languages it knows, so rejection asks something
else: how surprising a text's buckets are to the language they surprise least
(mean negative log of a bucket's share in the training texts, short texts drawn
to the usual value by PRIOR n-grams).  The bound is calibrated by leaving each
language out in turn: it lies halfway between the most surprising held-back text
of a known language and the median text of a left-out one.  If the first is
above the second, or only one language is known, nothing is rejected by it.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and rejected; without any labelled document every text is ``und``, and only
those without a letter are rejected; null languages are not learned from; a null id is held out; ties take the first
language by code point; repeated rows are scored alike; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, held_out, map_texts

BUCKETS = 1 << 14
GRAMS = (1, 2, 3, 4)
DIM = 16
SAMPLE = 3000  # labelled documents learned from, about
CALIBRATION_SHARE = 0.25
PRIOR = 200  # n-grams of usual surprise that each text is counted with
PIECE = 1 << 20  # bytes hashed at once

# bytes as the features see them: letters in lower case, everything else a gap
_FOLD = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _FOLD[_b] = _b


def letters(text: str) -> bytes:
    """Lower-cased text in UTF-8, all but letters (and bytes of other characters) as single gaps."""
    folded = _FOLD[np.frombuffer(text.lower().encode("utf-8"), np.uint8)]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0x20) | (folded[:-1] != 0x20)
    return folded[keep].tobytes()


def buckets(piece: np.ndarray, starts: int) -> np.ndarray:
    """Bucket numbers of the n-grams that start in the first ``starts`` bytes."""
    piece, out = piece.astype(np.uint32), []
    value = np.zeros(len(piece), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(piece) < n:
            break
        value = value[:len(piece) - n + 1] * np.uint32(257) + piece[n - 1:]
        hashed = (value[:starts] + np.uint32(n)) * np.uint32(2654435761)
        out.append(hashed >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(out).astype(np.int64)


def counts(text: str | None) -> np.ndarray | None:
    """How often the text has each bucket; None without a letter."""
    if not text or not any(c.isalpha() for c in text):
        return None
    folded = np.frombuffer(b" " + letters(text) + b" ", np.uint8)
    total = 0
    for at in range(0, len(folded), PIECE):  # long texts a piece at a time
        total = total + np.bincount(buckets(folded[at:at + PIECE + max(GRAMS) - 1], PIECE), minlength=BUCKETS)
    return total


@dataclass
class LanguageModel:
    languages: list[str]
    embedding: np.ndarray  # BUCKETS x DIM
    layer: np.ndarray  # DIM x languages
    bias: np.ndarray
    surprisal: np.ndarray  # BUCKETS x languages
    temperature: float = 1.0
    usual: float = 0.0  # surprise of a held-back text, the median
    reject_above: float = np.inf

    def logits(self, shares: np.ndarray) -> np.ndarray:
        return shares @ self.embedding @ self.layer + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bucket shares from (buckets, counts) of a few documents."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (hit, n) in enumerate(rows):
        out[i, hit] = n / n.sum()
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 1, steps: int = 900, rate: float = 2.0, batch: int = 32) -> LanguageModel:
    """SGD on mean embeddings and layer; a share is held back to calibrate."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back = order[: int(len(y) * CALIBRATION_SHARE)]
    learn = order[len(back):]
    model = LanguageModel(languages, rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages)),
                          surprisals([docs[i] for i in learn], y[learn], len(languages)))
    done = 0
    while done < steps and len(learn):
        rng.shuffle(learn)
        for at in range(0, len(learn), batch):
            rows = learn[at:at + batch]
            x = dense([docs[i] for i in rows])
            mean = x @ model.embedding
            error = softmax(mean @ model.layer + model.bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            lr = rate * max(0.0, 1 - done / steps) / len(rows)
            back_mean = error @ model.layer.T
            model.layer -= lr * mean.T @ error
            model.bias -= lr * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            model.embedding[used] -= lr * 50 * x[:, used].T @ back_mean  # a bucket's share is small
            done += 1
    if len(back):
        calibrate(model, np.concatenate([model.logits(dense([docs[i] for i in back[at:at + 64]])) for at in range(0, len(back), 64)]), y[back])
        set_bound(model, [docs[i] for i in back], y[back])
    return model


def calibrate(model: LanguageModel, logits: np.ndarray, y: np.ndarray) -> None:
    """Temperature of least log loss on rows that training did not see."""
    rows = np.arange(len(y))
    grid = np.exp(np.linspace(-8, 4, 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])


def surprisals(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: int) -> np.ndarray:
    """Negative log of each bucket's share in the texts of each language."""
    total = np.full((BUCKETS, languages), 0.5)
    for (hit, n), k in zip(docs, y, strict=True):
        total[hit, k] += n
    return -np.log(total / total.sum(axis=0))


def drawn_in(surprise, grams, usual: float):
    """Mean surprise of a text that PRIOR n-grams of usual surprise are added to."""
    return (grams * surprise + PRIOR * usual) / (grams + PRIOR)


def set_bound(model: LanguageModel, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """The rejection bound from held-back texts, each language left out in turn."""
    grams = np.array([n.sum() for _, n in docs])
    each = np.stack([(n / n.sum()) @ model.surprisal[hit] for hit, n in docs])
    model.usual = float(np.median(each.min(axis=1)))
    known = drawn_in(each.min(axis=1), grams, model.usual).max()
    each[np.arange(len(y)), y] = np.inf
    left_out = np.median(drawn_in(each.min(axis=1), grams, model.usual))
    model.reject_above = float((known + left_out) / 2) if left_out > known else np.inf


def features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and the non-zero bucket counts of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(len(columns))]
            hit = [None if c is None else np.flatnonzero(c).astype(np.int32) for c in found]
            n = [None if c is None else c[h].astype(np.int32) for c, h in zip(found, hit, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(hit, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], [*columns, "bucket", "n"])

    head = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes)
    return map_texts(docs.select(*columns, "text"), run, f"{head}, bucket array<int>, n array<int>")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from about SAMPLE labelled documents that are not held out, one per id."""
    src = (docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
           .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id")))
    found = features(hashed_sample(src, "id", SAMPLE), ["lang", "id"]).where("bucket IS NOT NULL").toArrow()
    if not found.num_rows:
        return None
    rows = sorted(zip(*(found[c].to_pylist() for c in ("id", "lang")), range(found.num_rows), strict=True), key=lambda r: (r[0] or "", r[1]))
    sparse = [tuple(found[c][i].values.to_numpy() for c in ("bucket", "n")) for _, _, i in rows]
    return train(sparse, [lang for _, lang, _ in rows])


def verdicts(model: LanguageModel | None):
    """A function from Arrow texts to (lang_pred, score, rejected) lists."""
    # what each bucket adds to the logits, and to the surprise of each language
    weights = None if model is None else np.hstack([model.embedding @ model.layer, model.surprisal])

    def judge(texts: pa.Array) -> tuple:
        out = []
        for text in texts:
            n = counts(text.as_py())
            if n is None or model is None:
                out.append(("und", 0.0, n is None))
                continue
            hit, grams, kinds = np.flatnonzero(n), int(n.sum()), len(model.languages)
            sums = (n[hit] / grams) @ weights[hit]
            p = softmax((sums[:kinds] + model.bias) / model.temperature)
            best = int(p.argmax())
            rejected = drawn_in(sums[kinds:].min(), grams, model.usual) > model.reject_above
            out.append((model.languages[best], float(p[best]), bool(rejected)))
        return tuple(zip(*out, strict=True)) if out else ((), (), ())

    return judge


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             model: LanguageModel | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = verdicts(sent.value)
        for batch in batches:
            lang, score, rejected = judge(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return map_texts(src, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def without_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns as they are; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = verdicts(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not r for r in judge(batch.column(text_col))[2]], pa.bool_()))

    return map_texts(docs, run, docs.schema)
