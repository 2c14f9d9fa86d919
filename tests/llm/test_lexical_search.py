"""Ranked search against a plain count of every document, and what a block's bound promises."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from depotlens.llm import lexical_search as L
from depotlens.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    N, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = set()
    for item, text in set(items):
        ask, rows = Counter(terms(text)), []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * N) // total
            score = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, n in ask.items() if t in c)
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_documents(spark):
    docs, items = table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(L.lexical_search(docs, items)) == want
    # the same by many blocks of items and many shards
    assert got(L.lexical_search(docs, items, vocabulary=60)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 1 << 12)  # some dozen documents a shard
    rnd = random.Random(seed)
    words = ["Ärger", "the", "THE", "x1", "été", "qua", "naïve", "日本", "b", "zz"] + [f"w{i}" for i in range(40)]
    text = lambda: rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, weights=[1 / (i + 1) for i in range(50)], k=rnd.randint(0, 60)))
    rows = [(i, text()) for i in range(300)] + [(None, "w1 w2 the"), (None, None), (7, ""), (8, "--- !!")]
    rows += [(1000 + i, "w3 w4 the the x1") for i in range(200)]  # a large group of equal texts: ties
    items = [(i, text()) for i in range(12)] + [(3, "w3 w3 x1"), (50, "w3 w3 x1"), (50, "w3 w3 x1"), (60, None), (61, "nosuchterm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    assert got(L.lexical_search(docs, asked)) == brute(rows, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.lexical_search(docs, items.limit(0)).collect() == []
    assert L.lexical_search(docs.limit(0), items).collect() == []


def test_blocks_are_skipped_and_bounds_hold():
    rng = np.random.default_rng(5)
    asked = L.Asked([b"t0 t1 t2", b"t3 t4", b"t1 t5 t5"])
    n, terms_ = 400, len(asked.vocabulary)
    dense = rng.random((n, terms_)) * (rng.random((n, terms_)) < 0.4)
    dense[:3] = 1.0  # found early, they set what has to be reached
    impact = (dense * 1e6).astype(np.int64)
    doc, term = np.nonzero(impact)
    best = L.Best(3, 3)
    calls = []
    add = best.add
    best.add = lambda item, scores, ids, null: (calls.append(len(scores)), add(item, scores, ids, null))
    L.search_shard(asked, True, np.arange(n), np.zeros(n, bool), doc, term, impact[doc, term], best)
    for q in range(3):
        w = np.zeros(terms_, np.int64)
        w[asked.rows[q]] = asked.times[q]
        scores = impact @ w
        order = sorted((-s, i) for i, s in enumerate(scores.tolist()))[:3]
        assert [(s, i) for s, _, i in best.found[q]] == order
    assert sum(calls) < 3 * n  # not every document was evaluated for every item
