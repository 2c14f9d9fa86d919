"""Byte-level BPE as a lazily determinised finite-state transducer.

The merges are compiled into a transducer that reads a piece of text byte by
byte and emits a token as soon as no continuation can change it.  It rests on
a property of BPE: a token sequence is the encoding of its bytes exactly if
every two neighbours stay apart when their own bytes are encoded alone.  So
the encoding of a prefix is found from shorter prefixes by looking for the one
token that may follow; only prefixes in which a token that is still growing
could start have to be remembered.  A state is (last token emitted, bytes not
yet emitted); states and transitions are made when text first needs them and
kept in a bounded table.  Lookahead is bounded by the longest token.

Decoding streams: token bytes pass through an incremental UTF-8 state machine
that holds back at most three bytes of an unfinished character.

Defined results: null text encodes like empty text, to no tokens; texts of any
length are taken whole; ids that are not in the vocabulary raise KeyError on
decoding; bytes that are no UTF-8 decode to U+FFFD; repeated rows give repeated
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
NEVER = 1 << 62  # above every rank
STATES = 350_000  # transitions kept; the table starts anew beyond
PAIRS = 120_000  # pairs of tokens of which is kept whether they stay apart
PIECES = 200_000  # pieces whose tokens are kept, twice

# Characters that the regex module's newer Unicode tables call letters or numbers
# and the tables of tiktoken's engine do not; there they are neither.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2,
    0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """States are numbers.  Of a state are kept: ``after``, a last token emitted
    (None: none that matters); ``held``, the bytes read since; and ``paths``,
    for every prefix of ``held`` in which a growing token could start, the
    tokens that lead to it.  Two states are one if they hold the same bytes and
    the same merges could still reach across the border before them.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.growing: dict[bytes, int] = {}  # proper prefixes of tokens, with the least rank that begins so
        for b, r in ranks.items():
            for n in range(1, len(b)):
                if r < self.growing.get(b[:n], NEVER):
                    self.growing[b[:n]] = r
        self.byte = [bytes((i,)) for i in range(256)]
        self._sides: dict[int, tuple | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.steps: dict[int, int] = {}  # state * 256 + byte -> state, or its complement if tokens are emitted
        self.outs: dict[int, tuple[int, ...]] = {}  # by the same key: the tokens emitted
        self.after: list[int | None] = [None]
        self.held: list[bytes] = [b""]
        self.paths: list[tuple[tuple[int, tuple[int, ...]], ...]] = [((0, ()),)]
        self.borders: dict[tuple, int] = {(): 0}
        self.numbers: dict[tuple[int, bytes], int] = {(0, b""): 0}

    def border(self, after: int, held: bytes) -> tuple:
        """What of the token before ``held`` could still merge with the bytes
        after the border: parts of its right side, each followed by the rank at
        which it is merged itself."""
        ranks, growing, out = self.ranks, self.growing, []
        for part, until in self.sides(after)[2]:
            if growing.get(part + held, NEVER) < until or any(
                    [ranks.get(part + held[:n], NEVER) < until for n in range(1, len(held) + 1)]):
                out.append(part)
                out.append(until)
        return tuple(out)

    def merge(self, piece: bytes) -> list[bytes]:
        """The definition: join the neighbours of least rank, the first of equals, as long as any can be joined."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def sides(self, token: int) -> tuple | None:
        """What the token's first and what its last byte grow into, merge by
        merge, up to the token, and the latter with the ranks at which they
        grow; None if its bytes do not encode to the token."""
        if token not in self._sides:
            whole = self.tokens[token]
            parts, left, right = [whole[i:i + 1] for i in range(len(whole))], [whole[:1]], [whole[-1:]]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append(parts[0])
                if i == len(parts) - 1:
                    right.append(parts[-1])
            until = [self.ranks[r] for r in right[1:]] + [NEVER]
            self._sides[token] = (left, right, list(zip(right, until, strict=True))) if len(parts) == 1 else None
        return self._sides[token]

    def apart(self, a: int, b: int) -> bool:
        """True if the bytes of two tokens encode to these two tokens: at no
        time is a merge across their border due before the next one on either
        side of it (the left one goes first among equals)."""
        known = self._apart.get((a, b))
        if known is not None:
            return known
        right, left = self.sides(a)[1], self.sides(b)[0]
        rank, never, i, j, out = self.ranks.get, NEVER, 0, 0, True
        while True:
            next_a = rank(right[i + 1]) if i + 1 < len(right) else never
            next_b = rank(left[j + 1]) if j + 1 < len(left) else never
            across = rank(right[i] + left[j], never)
            if across < next_a and across <= next_b and across < never:
                out = False
                break
            if next_a == never == next_b:
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._apart) > PAIRS:
            self._apart.clear()
        self._apart[a, b] = out
        return out

    def step(self, state: int, byte: int) -> int:
        """Makes and keeps a transition; returns the next state."""
        held, ranks, growing, after = self.held[state] + self.byte[byte], self.ranks, self.growing, self.after[state]
        path, live = None, []
        for at, before in self.paths[state]:
            tail = held[at:]
            if tail in growing:
                live.append((at, before))
            if path is None:
                token = ranks.get(tail)
                if token is not None and self.sides(token) is not None:
                    last = before[-1] if before else after
                    if last is None or self.apart(last, token):
                        path = (*before, token)
        if path is None:
            raise ValueError("the vocabulary lacks single bytes")
        sure = len(path)  # tokens that all paths share
        for _, p in live:
            n = 0
            while n < sure and n < len(p) and p[n] == path[n]:
                n += 1
            sure = n
        live.append((len(held), path))
        out = path[:sure]
        if sure:
            after = path[sure - 1]
            cut = sum([len(self.tokens[t]) for t in out])
            held = held[cut:]
            live = [(at - cut, p[sure:]) for at, p in live]
        border = 0 if after is None else self.borders.setdefault(self.border(after, held), len(self.borders))
        number = self.numbers.get((border, held))
        if number is None:
            number = self.numbers[border, held] = len(self.after)
            self.after.append(after if border else None)
            self.held.append(held)
            self.paths.append(tuple(live))
        key = state * 256 + byte
        if out:
            self.outs[key], number = out, ~number
        self.steps[key] = number
        return number

    def _anew(self, state: int) -> int:
        """Starts the table anew with ``state`` in it; returns its number."""
        after, held, paths = self.after[state], self.held[state], self.paths[state]
        self._reset()
        border = 0 if after is None else self.borders.setdefault(self.border(after, held), len(self.borders))
        number = self.numbers.setdefault((border, held), len(self.after))
        if number == len(self.after):
            self.after.append(after if border else None)
            self.held.append(held)
            self.paths.append(paths)
        return number

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out, known, outs = 0, [], self.steps.get, self.outs
        for byte in piece:
            key = state * 256 + byte
            state = known(key)
            if state is None:
                state = key >> 8
                if len(self.steps) > STATES:  # also amid a piece, however long it is
                    state = self._anew(state)
                    known, outs = self.steps.get, self.outs
                    key = state * 256 + byte
                state = self.step(state, byte)
            if state < 0:
                state = ~state
                out.extend(outs[key])
        out.extend(self.paths[state][-1][1])
        return out


class Utf8Stream:
    """Incremental UTF-8: feed() returns the characters that are complete; an
    unfinished one stays in the state, at most three bytes."""

    def __init__(self):
        self.open = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many of the last bytes begin a character that they do not end."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:  # a lead byte; it needs this many bytes in all
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = self.unfinished(data)
        self.open = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


# What the classes of the pattern hold of Latin-1; texts of no other characters are split by plain character sets.
LATIN = {r"\s": r"\t-\r \x85\xa0", r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾"}


def latin_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` with its classes written out for Latin-1 texts, None if it has other classes."""

    def in_set(found: re.Match) -> str:
        out = found[0]
        for name, chars in LATIN.items():
            out = out.replace(name, chars)
        return out

    pattern = re.sub(r"\[[^\]]*\]", in_set, pattern)
    pattern = pattern.replace(r"\S", f"[^{LATIN[r'\s']}]")
    for name, chars in LATIN.items():
        pattern = pattern.replace(name, f"[{chars}]")
    return None if r"\p" in pattern else re.compile(pattern)


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Encoder and decoder for whole texts."""

    CHUNK = 1 << 16  # tokens decoded at once

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.plain = latin_pattern(pattern)
        self.newer = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}  # what was known before the last overflow; used pieces move back
        self.token_bytes = self.transducer.tokens

    def split(self, text: str) -> list[str]:
        if latin(text):
            return (self.plain or self.pattern).findall(text)
        if not self.newer.search(text):
            return self.pattern.findall(text)
        masked = self.newer.sub("\uffff", text)  # as long, and neither letter nor number
        return [text[m.start():m.end()] for m in self.pattern.finditer(masked)]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, encode = self.known, self.transducer.encode
        for piece in self.split(text or ""):
            tokens = known.get(piece)
            if tokens is None:
                tokens = self.older.get(piece)
                if tokens is None:
                    tokens = encode(piece.encode("utf-8"))
                if len(known) >= PIECES:
                    self.older, known = known, {}
                    self.known = known
                if len(piece) <= 64:
                    known[piece] = tokens
            out += tokens
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text, in parts."""
        ids, stream = list(ids), Utf8Stream()
        for at in range(0, len(ids), self.CHUNK):
            yield stream.feed(b"".join([self.token_bytes[i] for i in ids[at:at + self.CHUNK]]))
        yield stream.end()


ARROW = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _rows(src: DataFrame, fn, path: str, **columns: str) -> DataFrame:
    """All columns of ``src`` but the last, and ``columns`` (name: type), which ``fn(codec, value)`` makes of the last."""
    ranks = src.sparkSession.sparkContext.broadcast(read_ranks(path))  # one vocabulary, some MB
    passed = src.columns[:-1]
    types = [ARROW[t] for t in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the tables live as long as the task: a reused worker does not hold them through other stages
        own = Codec(ranks.value)
        gc.disable()  # nothing here makes cycles, and a collection would walk the whole tables again and again
        try:
            for batch in batches:
                rows = [fn(own, value.as_py()) for value in batch.column(len(passed))]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
                made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(passed)], *made], [*passed, *columns])
        finally:
            gc.enable()

    head = "".join(f"`{c}` {t}, " for c, t in src.dtypes[:-1])
    return map_texts(src, run, head + ", ".join(f"{n} {t}" for n, t in columns.items()))


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids)"""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _rows(src, lambda c, text: (c.encode(text),), path, token_ids="array<int>")


def bpe_decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text); null ids decode to empty text."""
    src = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("token_ids"))
    return _rows(src, lambda c, ids: ("".join(c.decode(ids or [])),), path, text="string")


DECIMAL = [str(i) for i in range(1 << 17)]


def round_trip(own: Codec, text: str | None) -> tuple[list[int], int, str, str]:
    """Of one text: ids, their number, their digest, and the digest of what they decode to."""
    ids = own.encode(text)
    decoded = hashlib.sha256()
    for part in own.decode(ids):
        decoded.update(part.encode("utf-8"))
    return ids, len(ids), hashlib.sha256(" ".join([DECIMAL[i] for i in ids]).encode()).hexdigest(), decoded.hexdigest()


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in one pass."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _rows(src, lambda c, text: round_trip(c, text)[1:], path, n_tokens="bigint", ids_sha256="string", decoded_sha256="string")


def tokenised(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All columns of ``docs`` but the text, and token_ids, n_tokens, ids_sha256
    and decoded_sha256 (columns of these names are replaced)."""
    made = ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    src = docs.select(*[c for c in docs.columns if c not in [*made, text_col]], text_col)
    return _rows(src, round_trip, path, **dict(zip(made, ["array<int>", "bigint", "string", "string"], strict=True)))
