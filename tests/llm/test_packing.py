"""Packing: every id once, ids as the tokenizers library has them, no padding, neighbours together."""
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from depotlens.llm import packing as P
from depotlens.llm.common import table


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, pieces, tokenizer, window=1024):
    """The contract of ``pieces`` for documents ``rows`` of distinct ids; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_given_documents(spark, tokenizer):
    docs = table(spark, SF_SMALL, "documents")
    pieces = P.pack(docs)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check([(r.doc_id, r.text) for r in docs.collect()], pieces.collect(), tokenizer) == 0


@pytest.mark.parametrize("shard,part", [(300, 900), (1 << 19, 1 << 22)])
def test_small_shards_and_odd_texts(spark, tokenizer, shard, part):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "Zeit", "été", "x", "don't", "   ", "\n\n", "日本語", "12345", "<|endoftext|>", "ﬁn", "🙂", "…", "—"])
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a" * 5000), (103, "word " * 3000), (104, " " * 4000), (None, "null id")]
    rows += [(200 + i, "the same text again and again") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("clash")).repartition(3)
    assert check(rows, P.pack(docs, shard=shard, part=part).collect(), tokenizer) == 0


def test_equal_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, None)], "doc_id long, text string")
    assert P.pack(docs).agg(F.sum("length")).first()[0] == 3 + 3 + 1


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_are_those_of_tokenizers(tokenizer):
    own = P.Encoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rnd = random.Random(9)
    steady = [chr(c) for c in [*range(0, 0x250), *range(0x2010, 0x2028), 0x20AC]]
    for k in range(3000):
        text = "".join(rnd.choices(steady if k % 2 else steady[:128], k=rnd.randint(0, 40)))
        assert not P.STEADY.search(text)
        assert own.fast.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
    for text in ["日本語", "a͸b", "𐐀𐐁 x", "ⅷ ⅸ"]:
        assert own.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_scores_are_bm25():
    rnd = np.random.default_rng(1)
    ids = [rnd.integers(0, 30, rnd.integers(1, 50)) for _ in range(40)]
    idf, mean = rnd.random(30), 20.0
    got = P.Shard(ids, idf, mean).scores(np.unique(ids[3]))
    for k, doc in enumerate(ids):
        want = sum(idf[t] * (doc == t).sum() * (P.K1 + 1) / ((doc == t).sum() + P.K1 * (1 - P.B + P.B * len(doc) / mean))
                   for t in np.unique(ids[3]) if (doc == t).any())
        assert abs(got[k] - want) < 1e-9


def test_a_window_holds_the_neighbours_of_its_seed():
    rnd = np.random.default_rng(2)
    topics = [rnd.integers(50 * k, 50 * k + 50, (30, 100)) for k in range(4)]
    rows = [((k, None), 0, topics[k][i]) for i in range(30) for k in range(4)]
    df = np.bincount(np.concatenate([np.unique(x) for _, _, x in rows]), minlength=200)
    packer = P.Packer(np.log1p((120 - df + 0.5) / (df + 0.5)), 100.0, 500)
    packer.shard(rows)
    packer.end()
    out = packer.take()
    assert sum(len(ids) for s in out for _, _, ids in s) == 12000
    same = [len({doc[0] for doc, _, _ in s}) == 1 for s in out]
    assert sum(same) >= 0.8 * len(out)  # random filling would leave about none


def test_ranking_and_used_rests():
    """The first are found without sorting all, and an index without the used rests scores the others as before."""
    rnd = np.random.default_rng(3)
    scores = rnd.integers(0, 9, 300).astype(float)
    assert list(P.ranking(scores)) == list(np.argsort(-scores, kind="stable"))
    ids = [rnd.integers(0, 40, rnd.integers(1, 50)) for _ in range(50)]
    index, unused = P.Shard(ids, rnd.random(41), 20.0), rnd.random(50) < 0.5
    want, size = index.scores(np.unique(ids[0])), len(index.doc)
    index.drop(unused)
    assert len(index.doc) < size and (index.scores(np.unique(ids[0]))[unused] == want[unused]).all()


def test_signatures_of_a_batch():
    """Equal rests have equal signatures wherever they lie; empty ones have 0."""
    rests = [[5, 6, 7], [], [5], [5, 6, 7], [9], [], [5, 6], [5]]
    got = P.signatures(np.array(sum(rests, []), np.int32), np.array([len(r) for r in rests]))
    assert got[0] == got[3] and got[2] == got[7] and got[1] == got[5] == 0 and len(set(got.tolist())) == 5
