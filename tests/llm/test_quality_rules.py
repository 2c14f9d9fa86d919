"""Measures against plain Python, and what the host prior does."""
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from depotlens.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, source string, host string, n_words int, words array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, None) for i, t, s in rows], SCHEMA).repartition(3)


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


EDGE = [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (4, "a b"), (5, "a b c"), (6, "a b c a b c"), (7, "a a a a"), (8, "x\nx\n\nx y\n x\n"),
        (9, "é 日本 # ** <|> é 日本 #"), (10, "w " * 60000), (None, "a b c a b"), (11, "  a b"), (12, "a b c d a b c e b c d"), (12, "a b c d a b c e b c d")]


def test_measures(spark):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(["s", None, "q"])) for i, t in EDGE]
    rows += [(100 + i, "".join(rng.choice(["a", "b", "c", "é", "#"]) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(rng.randrange(200))), "hot") for i in range(80)]
    got = Q.quality_rules(frame(spark, rows))
    want = [(i, *brute(t)) for i, t, _ in rows]
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(want, key=str)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_failed)
    assert Q.quality_rules(frame(spark, []).limit(0)).collect() == []


def test_hosts_shrink_towards_the_prior(spark):
    """A large host is judged by itself, a host of one document by the corpus."""
    rows = [("bad", i < 195) for i in range(200)] + [("one", True)] + [(f"h{k}", i == 0) for k in range(40) for i in range(20)] + [(None, False)] * 30
    v = {r.host: r for r in Q.host_verdicts(spark.createDataFrame(rows, "host string, r boolean"), ["r"], 0.8).collect()}
    assert v["bad"].host_failed and v["bad"].r_rate > 0.9
    assert not v["one"].host_failed and v["one"].r_rate < 0.8
    assert 0.03 < v["h3"].r_rate < 0.3 and not v[None].host_failed


def test_equal_rates_and_no_failures(spark):
    rows = [(h, False) for h in "abc" for _ in range(5)]
    v = Q.host_verdicts(spark.createDataFrame(rows, "host string, r boolean"), ["r"], 0.8).collect()
    assert all(x.r_rate == 0 and not x.host_failed for x in v)


def test_a_failing_host_drops_its_clean_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    rows = [(i, "too short", "spam") for i in range(300)] + [(1000, good, "spam")] + [(2000 + i, good, "ham") for i in range(50)]
    got = {r.doc_id: r for r in Q.quality_rules(frame(spark, rows)).collect()}
    assert not got[1000].base_failed and got[1000].host_failed and not got[1000].kept
    assert all(got[2000 + i].kept for i in range(50))


def test_no_python_and_one_evaluation(spark):
    plan = Q.measures(frame(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("regexp_extract_all") == 1
