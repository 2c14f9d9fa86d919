"""Quality classifier: gradient, held-out accuracy and defined results."""
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from depotlens.llm import quality_mil as Q
from depotlens.llm.common import table


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    w = {"A": rng.normal(size=(Q.WIDTH, 4)), "a": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3),
         "c": rng.normal(size=4), "b": rng.normal(size=1)}
    x, sizes, y = rng.random((9, Q.WIDTH)), np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])

    def loss(w):
        p = Q.forward(w, x, sizes)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    g = Q.gradient(w, x, sizes, y)
    for k in w:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in w[k].shape)
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[k][i]) < 1e-5


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    got = Q.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_attention_finds_the_bad_passage():
    """One bad passage among many good ones decides."""
    rng = np.random.default_rng(1)
    good = [np.stack([rng.random(Q.WIDTH) * 0.1 for _ in range(rng.integers(1, 12))]) for _ in range(300)]
    labels = rng.integers(0, 2, 300).astype(float)
    for bag, y in zip(good, labels):
        if not y:
            bag[rng.integers(len(bag)), 3] = 1.0
    model = Q.train(good[:240], labels[:240])
    p = model.scores(np.concatenate(good[240:]), np.array([len(b) for b in good[240:]]))
    assert ((p > 0.5) == labels[240:]).mean() > 0.95


def test_passages(monkeypatch):
    text = "  Zwölf Boxkämpfer jagen Viktor.\n" * 200 + " X"
    whole = Q.passages(text)
    assert whole.shape == (-(-len(text.split()) // Q.PASSAGE_WORDS), Q.WIDTH)
    monkeypatch.setattr(Q, "PIECE", 101)
    assert np.allclose(Q.passages(text), whole)
    assert not Q.passages(None).any() and not Q.passages(" \n").any() and len(Q.passages("a")) == 1


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "word " * 200_000), (None, "a b"), (4, "###"), (4, "###")]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(3, 1, 5), (4, 0, 5), (4, None, 5), (None, 1, 5), (77, 0, 5)], "doc_id long, quality int, text int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 4}) == 1
    empty = labels.limit(0)
    assert {r.score for r in Q.classify(docs, empty).collect()} == {0.5}
    assert {r.score for r in Q.classify(docs, labels.withColumn("quality", F.lit(1))).collect()} == {1.0}
    assert Q.classify(docs.limit(0), labels).collect() == []
