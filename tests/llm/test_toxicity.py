"""Classifier chain: held-out accuracy, the chain itself and defined results."""
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID
from depotlens.llm import toxicity as T
from depotlens.llm.common import table

SF_LARGE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF_LARGE, "documents"), table(spark, SF_LARGE, "labels")
    held = T.detect(docs, labels).withColumnRenamed("toxic", "hit").join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in held if r.toxic]
    assert sum(r.hit for r in toxic) / len(toxic) > 0.9
    assert sum(r.hit for r in held if not r.toxic) / sum(not r.toxic for r in held) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.hit) for r in held)


def test_later_models_read_earlier_categories():
    """The second category is the first one and a word: the chain's weight on the first category carries over."""
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 60, rng.integers(5, 30))) for _ in range(900)]
    first = np.array([3 in d or 4 in d for d in docs], float)
    second = first * np.array([7 in d for d in docs])
    chain = T.train(docs[:700], np.stack([first, second], axis=1)[:700], ("first", "second"))
    assert chain.models[1].before[0] > 0.2
    p = chain.probabilities(T.presence(docs[700:], chain.chosen))
    assert ((p[:, 0] > 0.5) == first[700:]).mean() > 0.97
    assert ((p[:, 1] > 0.5) == second[700:]).mean() > 0.93


def test_out_of_fold_scores_do_not_leak():
    """On noise, out-of-fold inputs tell the next model nothing."""
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 400, 40)) for _ in range(500)]
    y = rng.integers(0, 2, 500).astype(float)
    chain = T.train(docs, np.stack([y, y], axis=1), ("a", "b"))
    assert chain.models[1].before[0] < 0.3  # scores of seen rows would agree with the labels and get a large weight


def test_whole_texts_and_upper_case(spark):
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    chain = T.learn(docs, labels)
    clean = docs.join(labels.where("toxic = 0 AND quality = 1"), "doc_id").where("lang = 'en' AND length(text) > 3000").first().text
    words = "idiot worthless moron stupid loser"
    rows = [(1, clean), (2, clean + " " + words), (3, clean * 20 + words.upper()), (4, words.replace(" ", "!! ") + clean)]
    got = {r.doc_id: r for r in T.detect(spark.createDataFrame(rows, "doc_id long, text string"), labels, chain=chain).collect()}
    assert not got[1].toxic and got[2].toxic and got[3].toxic and got[4].toxic


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "1 2 3 !"), (None, "idiot"), (4, "é " * 100_000), (4, "é " * 100_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, toxic int, kind_1 string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    got = T.detect(docs, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert not any(r.toxic for r in T.detect(docs, labels.limit(0)).collect())
    assert not any(r.toxic for r in T.detect(docs, labels.withColumn("toxic", F.lit(0))).collect())
    assert T.detect(docs.limit(0), labels).collect() == []


def test_scores_equal_a_plain_scorer(spark):
    """Each row against the learned models, one document and one category after the other."""
    docs, labels = table(spark, SF_MID, "documents"), table(spark, SF_MID, "labels")
    chain = T.learn(docs, labels)
    got = {r.doc_id: r for r in T.detect(docs, labels, chain=chain).collect()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for r in docs.select("doc_id", "text").collect():
        have, before = set(T.features(r.text).tolist()), []
        for m in chain.models:
            logit = sum(w for f, w in zip(m.chosen.tolist(), m.weights) if f in have) + sum(p * w for p, w in zip(before, m.before)) + m.constant
            before.append(sigmoid(logit))
        score = sigmoid(chain.scale[0] * logit + chain.scale[1])
        assert np.allclose([*before[:-1], score], [*(got[r.doc_id][c] for c in T.CATEGORIES[:-1]), got[r.doc_id].score], atol=1e-9)
        assert got[r.doc_id].toxic == (got[r.doc_id].score >= chain.threshold)


def test_long_documents_are_learned_from(spark):
    """Labels whose documents are all long teach as well as short ones."""
    rows = [(i, "plain words of a text " * 3000 + (f"you are an awful wretch {i}" if i % 2 else f"good day {i}")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in T.detect(docs, labels).collect()}
    assert got == {i: bool(i % 2) for i, _ in rows}


def test_categories_are_clusters_of_marking_words():
    """Two groups of toxic documents with words of their own, and clean ones: the groups are found, and the denser half."""
    rng = np.random.default_rng(2)
    docs, want = [], []
    for i in range(600):
        own = {0: np.arange(1000, 1012), 1: np.arange(2000, 2012)}.get(i % 6, np.zeros(0, int))
        mine = rng.permutation(own)[: 3 + i % 8]
        docs.append(np.unique(np.concatenate([rng.integers(0, 300, 30), mine])).astype(np.int64))
        want.append((i % 6, len(mine)))
    toxic = np.array([float(k < 2) for k, _ in want])
    got = T.categories_of(docs, toxic)
    assert (got[:, 3] == toxic).all() and (got[toxic == 0] == 0).all()
    assert (got[:, 0] + got[:, 1] == toxic).all()
    groups = {k: {tuple(got[i, :2]) for i, (j, _) in enumerate(want) if j == k} for k in (0, 1)}
    assert len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1]
    many, few = ([got[i, 2] for i, (k, n) in enumerate(want) if k < 2 and test(n)] for test in (lambda n: n >= 8, lambda n: n <= 4))
    assert all(many) and not any(few)


def test_categories_of_one_kind_of_label():
    assert (T.categories_of([np.zeros(0, np.int64)] * 3, np.ones(3)) == [0, 0, 0, 1]).all()
    assert (T.two_kinds(np.zeros((4, 0))) == 0).all()
