"""Removal of repeated byte strings against counting every window."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from depotlens.llm import span_dedup as S
from depotlens.llm.common import table


def brute(rows, length=S.LENGTH):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(np.sum(np.diff(np.concatenate([[False], gone]).astype(int)) == 1))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, anchor long, twin int, list string").repartition(parts)
    return sorted((tuple(r)[:5] for r in S.remove_repeats(df).collect()), key=str)


def planted(seed, docs=40):
    rng = random.Random(seed)
    alphabet = "abcdefgh é\n"

    def junk(n):
        return "".join(rng.choice(alphabet) for _ in range(n))
    shared = [junk(n) for n in (150, 199, 200, 201, 207, 216, 350, 900)]
    rows = [(i, "".join(junk(rng.randrange(0, 300)) + rng.choice(shared) for _ in range(rng.randrange(0, 4))) + junk(rng.randrange(50))) for i in range(docs)]
    base = junk(1500)
    for k in range(12):  # near copies: one byte changed here and there
        b = list(base)
        for _ in range(k % 4):
            b[rng.randrange(len(b))] = "Z"
        rows.append((1000 + k, "".join(b)))
    p = junk(230)
    rows += [(2000, "x" * 700), (2001, "ab" * 400), (2002, "abcdefg" * 60), (2003, "x" * 199), (2004, "x" * 200), (2005, None), (2006, ""),
             (2007, base), (2007, base), (None, base[:400]), (None, "null id " + base[300:700]), (2008, p + "-" + p), (2009, p[:199]), (2010, "é" * 300), (2011, p[1:201])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_counting(spark, seed):
    rows = planted(seed)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("limits", [{"MAX_CONTEXTS": 1}, {"MAX_CONTEXTS": 3, "SYMBOLS": 64}, {"SEGMENT": 256}, {"GRAM": 16}])
def test_bounds_change_cost_only(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    rows = planted(7)
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if "SEGMENT" in limits or "GRAM" in limits:  # these are read on the executors: test the functions there
        for i, t in rows:
            data = (t or "").encode()
            a, low, n, off = S.contexts(data)
            assert n.sum() == max(0, len(data) - S.LENGTH + 1)
            assert all(0 <= o <= S.LENGTH - S.GRAM for o in off) and (low + off <= max(len(data) - S.GRAM, 0)).all()
    else:
        assert sorted((tuple(r)[:5] for r in S.remove_repeats(docs).collect()), key=str) == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 105, 900).astype(np.uint8).tobytes()
    for length in (200, 400, 900):
        seen = []
        for pad in (0, 1, 77, 333):
            data = rng.integers(97, 105, pad).astype(np.uint8).tobytes() + passage[:length] + rng.integers(97, 105, 50).astype(np.uint8).tobytes()
            by_window = {}
            for a, low, n, off in zip(*S.contexts(data)):
                for s in range(low, low + n):
                    by_window[s - pad] = (a, low + off - s)
            seen.append([by_window[s] for s in range(length - 199)])
        assert all(x == seen[0] for x in seen)


def test_given_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = sorted((tuple(r)[:5] for r in S.remove_repeats(docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert S.remove_repeats(docs.limit(0)).collect() == []


def test_outputs(spark):
    rows = planted(5)
    for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 and len(r.kept_text) == r.n_bytes - r.n_removed
        assert sum(s.after - s.first for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_equal_ids_of_colliding_32_bit_hashes(spark):
    """Two texts of one null id whose Spark hash() is equal: each loses its own spans only."""
    rng = random.Random(11)
    passage, other = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (400, 260))
    n = spark.range(200_000)
    a = n.select(F.concat(F.col("id").cast("string"), F.lit(passage)).alias("a"))
    b = n.select(F.concat(F.col("id").cast("string"), F.lit(other)).alias("b"))
    pair = a.join(b, F.hash(F.col("a").cast("binary")) == F.hash(F.col("b").cast("binary"))).orderBy("a", "b").first()
    rows = [(None, pair.a), (None, pair.b), (7, "x" + passage)]
    assert run(spark, rows) == brute(rows)


def test_equal_rows_share_one_list(spark, monkeypatch):
    rows = [(i, t) for i, t in planted(4) for _ in range(9 if i is None or i >= 2007 else 1)]
    assert run(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "cut_out", lambda joined: joined)
    for r in S.remove_repeats(docs).collect():
        assert len(r.list or []) == len({(s.low, tuple(s.first), tuple(s.last)) for s in r.list or []})
