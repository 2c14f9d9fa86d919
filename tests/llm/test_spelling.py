"""Spelling groups against a plain Python version, and what the signatures promise."""
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from depotlens.llm import spelling as S
from depotlens.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def words_of(rows, letters=6, least=5):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def near_of(words):
    """word -> its near words, by the words with one letter replaced by a blank or left out."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(rows):
    n = words_of(rows)
    near, form = near_of(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_given_documents(spark):
    docs = table(spark, SF_SMALL, "documents")
    assert got(S.spelling_groups(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("group", [2, 64])
def test_planted_words(spark, group):
    rnd = random.Random(3)
    base = ["letter", "lettering", "tellering", "anagrams", "margansa", "éàçñöü", "Aaaaaa", "aaaaaaa", "aaaaaaaa", "straße", "naïveté"]
    spelled = []
    for w in base:
        spelled += [w] * 400
        for _ in range(6):
            i = rnd.randrange(len(w))
            c = rnd.choice("abcéz")
            spelled += [rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])] * rnd.choice([3, 5, 17, 80])
    # chains of forms: each some 5 times as frequent as the one before
    for k, w in enumerate(["chainxxx", "chaixxxx", "chaaxxxx", "chabxxxx"]):
        spelled += [w] * 5 * 6**k
    rnd.shuffle(spelled)
    rows = [(i, " ".join(spelled[i * 50:i * 50 + 50])) for i in range(len(spelled) // 50 + 1)]
    rows += [(None, "letter lettre"), (None, None), (5, ""), (5, "letter, LETTER;letter")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    want = brute(rows)
    assert got(S.spelling_groups(docs, group=group)) == want
    assert any(root not in (w, form) for w, form, root, *_ in want)  # some chain has two steps


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_groups(docs).collect() == []


@pytest.mark.parametrize("first,second", [(1, 6), (2, 3), (3, 1)])
def test_near_words_share_a_signature(spark, first, second):
    rnd = random.Random(first)
    pairs = []
    for _ in range(200):
        w = "".join(rnd.choices("abcdeé", k=rnd.randint(6, 14)))
        i, c = rnd.randrange(len(w)), rnd.choice("abcx")
        pairs.append((w, rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])))
    sig = lambda c: S.signatures(S.letter_parts(F.col(c), first * second), first, second)
    df = spark.createDataFrame(pairs, "a string, b string").select(F.arrays_overlap(sig("a"), sig("b")).alias("shared"))
    assert df.where("shared").count() == 200
    with pytest.raises(ValueError):
        S.signatures(F.lit(None), 1, 2)
