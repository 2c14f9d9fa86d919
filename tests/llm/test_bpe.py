"""The transducer against tiktoken, and streaming decode against bytes.decode."""
import hashlib
import random

import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF_SMALL
from depotlens.llm import bpe as B
from depotlens.llm.common import table

RANKS = B.read_ranks()
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = B.Codec(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    assert CODEC.encode(text) == WANT.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeinorst hl'é-#0", max_size=400))
def test_merging_text(text):
    assert CODEC.encode(text) == WANT.encode_ordinary(text)


def test_every_token_and_pairs_of_tokens():
    """Any bytes as one piece, also pieces that the pattern would split."""
    rng, words = random.Random(1), list(RANKS)
    for a in words[::7]:
        piece = a + rng.choice(words) + rng.choice(words)
        t = CODEC.transducer
        want = [RANKS[piece]] if piece in RANKS else [RANKS[p] for p in t.merge(piece)]
        assert list(t.encode(piece)) == want


def test_every_character():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(2)
    for at in range(0, len(chars), 3000):
        text = "".join(c + rng.choice(["a", " ", "1", "'s ", "\n", "", " ."]) for c in chars[at:at + 3000])
        assert CODEC.encode(text) == WANT.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(256)], max_size=80))
def test_latin_text(text):
    """Texts of Latin-1 characters are split by plain character sets."""
    assert CODEC.encode(text) == WANT.encode_ordinary(text)


def test_every_latin_character_beside_others():
    rng = random.Random(5)
    for c in map(chr, range(256)):
        text = "".join(c + rng.choice(["a", " ", "1", "'s ", "\n", "", " .", "  ", "\xa0", "é"]) for _ in range(40))
        assert CODEC.encode(text) == WANT.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "a" * 5000, "ab" * 3000, " " * 999 + "x", "\x1c\x1d a", "I'll don't 'S", "<|endoftext|>", "日本語" * 400])
def test_edges(text):
    assert CODEC.encode(text) == WANT.encode_ordinary(text)
    assert "".join(CODEC.decode(CODEC.encode(text))) == text


def test_small_tables(monkeypatch):
    monkeypatch.setattr(B, "STATES", 50)
    monkeypatch.setattr(B, "PIECES", 5)
    own = B.Codec(RANKS)
    for text in ["the quick brown fox" * 9, "Thntblere of then, edtioner", "çéoi eauenaux"] * 2:
        assert own.encode(text) == WANT.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(), st.lists(st.integers(0, 5), min_size=1, max_size=50))
def test_utf8_stream(text, sizes):
    raw, s, out, at, k = text.encode(), B.Utf8Stream(), "", 0, 0
    while at < len(raw):
        n = sizes[k % len(sizes)] + (k % len(sizes) == 0)
        out += s.feed(raw[at:at + n])
        assert len(s.open) <= 3
        at, k = at + n, k + 1
    assert out + s.end() == text


def test_decode_of_bad_bytes():
    ids = [RANKS[b"\xe6"], RANKS[b"a"], RANKS[b"\xff"]]
    assert "".join(CODEC.decode(ids)) == "�a�"


def test_query(spark):
    docs = table(spark, SF_SMALL, "documents")
    extra = spark.createDataFrame([(None, None, 1), (7, "", 1), (7, "", 1), (8, "x y" * 40000, 2)], "doc_id long, text string, n_tokens int")
    for df in (docs, extra, extra.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = []
        for i, t in rows:
            ids = WANT.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted(map(tuple, B.bpe_round_trip(df).collect()), key=str) == sorted(want, key=str)
        back = B.bpe_decode(B.bpe_encode(df))
        assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


@pytest.mark.parametrize("n", [200_000, 2_000_000])
def test_an_unbroken_piece_takes_linear_time(n, monkeypatch):
    """Random letters without a gap, encoded amid a table that overflows again and again."""
    import time
    monkeypatch.setattr(B, "STATES", 60_000)
    text = "".join(random.Random(n).choices("abcdefghijklmnopqrstuvwxyz", k=n))
    own, start = B.Codec(RANKS), time.monotonic()
    got = own.encode(text)
    assert time.monotonic() - start < 20 + n / 10_000
    assert got == WANT.encode_ordinary(text)
    assert len(own.transducer.steps) <= B.STATES + 1


def test_a_long_piece_of_few_letters():
    text = "".join(random.Random(3).choices("ab", k=5_000_000))
    assert B.Codec(RANKS).encode(text) == WANT.encode_ordinary(text)
