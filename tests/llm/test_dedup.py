"""Exact and SimHash dedup against brute force."""
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from depotlens.llm import simhash as S
from depotlens.llm.common import connected_components
from depotlens.llm.exact_dedup import CountingQuotientFilter, exact_dedup, partition_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2) for i, t in rows], SCHEMA).repartition(3)


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), keep == i, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


EDGE = [(1, "a b"), (2, "a b"), (3, "a  b"), (4, None), (5, ""), (5, ""), (6, "x" * 300000), (7, "x" * 300000),
        (None, "a b"), (None, "q"), (8, "é"), (9, "é"), (10, "A b")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = EDGE + [(100 + k, "hot") for k in range(200)]
    fp = F.length(F.coalesce("text", F.lit(""))).cast("long") % 2 if weak else None
    got = exact_dedup(frame(spark, rows), fingerprint=fp).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    pool = np.concatenate([rng.integers(0, 2**64, 3000, np.uint64), np.arange(50, dtype=np.uint64), np.array([2**64 - 1], np.uint64)])
    parts = [rng.choice(pool, n) for n in (5000, 1, 700)]
    by_range = {}
    for p in parts:
        for r, raw in partition_filters(p, 4):
            by_range.setdefault(r, []).append(CountingQuotientFilter.from_bytes(raw))
    merged = [CountingQuotientFilter.merge(x).items() for _, x in sorted(by_range.items())]
    want, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(np.concatenate([m[0] for m in merged]), want)
    assert np.array_equal(np.concatenate([m[1] for m in merged]), counts)


def brute_fp(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash(spark):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ÀB", "Ab"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (5, "One"), (None, "null id"), (7, "two words")]
    for c in range(6):
        base = [rng.choice(vocab) for _ in range(400)]
        for v in range(12):
            w = list(base)
            for _ in range(v % 4):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((10 + c * 20 + v, rng.choice([" ", "\n", "  "]).join(w)))
    got = sorted((tuple(r) for r in S.simhash_dedup(frame(spark, rows)).collect()), key=str)
    fps = [brute_fp(t, 3) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps, 2)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    assert S.simhash_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("distance,block", [(0, 64), (1, 64), (2, 64), (2, 3), (1, 3)])
def test_near_links(spark, monkeypatch, distance, block):
    """Chains, dense clusters (also above the block bound) and random values."""
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    rng = random.Random(distance + block)
    fps = {0, 2**64 - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            if rng.random() < .5:
                x ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub} | {hub ^ 1 << i for i in range(0, 64, 3)}
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    roots = dict(map(tuple, connected_components(S.near_links(df, distance), "a", "b").collect()))
    comp = brute_components(list(range(len(fps))), fps, distance)
    got = [roots.get(S._signed(f), S._signed(f)) for f in fps]
    assert len(set(zip(got, comp))) == len(set(got)) == len(set(comp))


def test_allocation():
    assert S.allocate([[0, 5, 9, 99], [0, 1, 2, 30], [0, 4, 50, 60]], 3) == (6, [-1, 1, 0])
    sample = np.random.default_rng(0).integers(0, 2**64, 512, np.uint64)
    for rows in (10, 10**6, 10**12):
        plan = S.plan_probes(sample, rows, 2)
        assert sum(t + 1 for _, t in plan) == 3
    assert len(S.plan_probes(sample, 10**6, 2)) == 3  # three plain probes, 21 bits each
    assert sorted(b for g in S.group_bits(sample, 5) for b in g) == list(range(64))


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)}
