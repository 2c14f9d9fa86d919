"""Lexical retrieval packing: token sequences of at most ``WINDOW`` ids filled
with the neighbours that a sharded BM25 index finds for a seed document.

A document is its token ids and a last id 0.  Every full window of it is a
sequence of its own; what is left (at most ``WINDOW`` - 1 ids) is packed with
the rests of other documents.  The rests are range-partitioned and sorted by a
min-hash of their token pairs, so that similar ones meet, and row numbers tell
apart equal ones, so that a group of copies of any size is divided.  A task
cuts its rows into shards of ``SHARD`` ids and gives each an inverted index of
token ids with BM25 weights, whose document frequencies and mean length are
those of all rests.  Then it packs greedily: the next unused rest is the seed
of a window; the index is asked for the seed's terms, and the unused neighbours
fill the window in order of score (ties, and rests that share no term, in shard
order).  The rest that does not fit is cut; what remains of it is the next
seed.  A window that a shard leaves open is filled from the next one.  The last
window of a task is cut at powers of two, which need no padding.

Token ids are those of the ``tokenizers`` library with special tokens' strings
read as ordinary text.  Texts whose characters old and new Unicode tables class
alike are encoded by tiktoken with the same vocabulary, which gives the same
ids faster; others by tokenizers itself.

Defined results: a null or empty text is the id 0 alone; repeated rows and
equal ids are documents of their own; texts of any length are encoded whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WINDOW = 1024
END = 0  # the id that ends a document
SHARD = 1 << 19  # token ids of an index
PART = 1 << 22  # token ids of a task
K1, B = 1.2, 0.75
#: Latin letters, Latin-1 signs and common punctuation: no Unicode version moves them between classes.
STEADY = re.compile("[^\u0000-ɏ‐-‧€]")


def token_bytes(token: str) -> bytes:
    """The bytes a byte-level BPE file writes as printable characters: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    return bytes(_byte_of()[c] for c in token)


@functools.cache
def _byte_of() -> dict[str, int]:
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Token ids of texts by the vocabulary file whose content is ``spec``."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(spec)
        self.slow.encode_special_tokens = True
        ranks = {token_bytes(t): i for t, i in json.loads(spec)["model"]["vocab"].items() if not t.startswith("<|")}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if STEADY.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def signatures(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each rest (``n`` ids of ``flat``) a hash of the min-hash of its
    neighbouring ids (0 if it has none): rests with like pairs often have the same."""
    out = np.zeros(len(n), np.uint64)
    if len(flat):
        ends = np.cumsum(n)
        pairs = flat.astype(np.uint64)
        pairs[:-1] = pairs[:-1] << np.uint64(32) | pairs[1:]
        single = ends[n == 1] - 1
        pairs[single] = flat[single]
        pairs += np.uint64(1)
        pairs *= np.uint64(0x9E3779B97F4A7C15)
        pairs ^= pairs >> np.uint64(29)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
        pairs[ends[n > 1] - 1] = np.iinfo(np.uint64).max  # the last id of a rest starts no pair
        out[n > 0] = np.minimum.reduceat(pairs, (ends - n)[n > 0]) * np.uint64(0x94D049BB133111EB)
    return out.view(np.int64)


def lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Lists of ``n`` values each."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(flat))


def distinct(term: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, doc) of ``rows`` documents in order, and how often each occurs."""
    bits = max(1, rows - 1).bit_length()
    kind = np.int32 if len(term) and int(term.max()) >> 31 - bits == 0 else np.int64  # the shorter are sorted faster
    key = term.astype(kind) << kind(bits) | doc.astype(kind)
    key.sort()
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
    one = key[at]
    return one >> kind(bits), one & kind((1 << bits) - 1), np.diff(np.r_[at, len(key)])


def rests(docs: DataFrame, id_col: str, text_col: str, path: str, window: int) -> DataFrame:
    """One row per document: row, doc_id, doc_tokens, full (crc32 of each full
    window), start and ids of the rest, sig."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, some MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(spec.value)
        for batch in batches:
            encoded = [own.encode(text or "") for text in batch.column(1).to_pylist()]
            for ids in encoded:
                ids.append(END)
            n = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat = np.fromiter(itertools.chain.from_iterable(encoded), np.int32, n.sum())
            begin, start = np.cumsum(n) - n, n // window * window
            full = [crc(flat[b + at:b + at + window]) for b, upto in zip(begin, start, strict=True) if upto for at in range(0, upto, window)]
            if full:
                flat = flat[np.arange(len(flat)) >= np.repeat(begin + start, n)]
            made = [pa.array(n), lists(np.array(full, np.int64), start // window), pa.array(start), lists(flat, n - start),
                    pa.array(signatures(flat, n - start))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "doc_tokens", "full", "start", "ids", "sig"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = map_texts(src, run, f"doc_id {src.dtypes[0][1]}, doc_tokens long, full array<long>, start long, ids array<int>, sig long")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


def frequencies(rows: DataFrame) -> DataFrame:
    """(term, df): in how many rests a token id is.  A task sends at most one row per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1, np.int64)
        for batch in batches:
            term = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            got = np.bincount(distinct(term, doc, batch.num_rows)[0])
            df = np.pad(df, (0, max(0, len(got) - len(df))))
            df[:len(got)] += got
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df[terms], pa.int64())], ["term", "df"])

    return rows.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """Inverted index of a shard's rests: BM25 weights by term."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        n = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(len(ids)), n)
        term, doc, tf = distinct(np.concatenate(ids), doc, len(ids))
        self.doc = doc.astype(np.intp)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[self.doc] / mean))
        self.starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(idf)))]
        self.rows = len(ids)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 of every rest for distinct ``terms``."""
        starts, n = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        return np.bincount(self.doc[at], self.weight[at], self.rows)

    def drop(self, unused: np.ndarray) -> None:
        """Forgets the rests that are not ``unused``."""
        keep = unused[self.doc]
        self.starts = np.r_[0, np.cumsum(keep)][self.starts]
        self.doc, self.weight = self.doc[keep], self.weight[keep]


def ranking(scores: np.ndarray, first: int = 16) -> Iterator[int]:
    """Positions by descending score, equal ones in order; the ``first`` are found without sorting all."""
    done = 0
    if len(scores) > 4 * first:
        top = np.flatnonzero(scores >= np.partition(scores, -first)[-first])
        done = len(top)
        yield from top[np.argsort(-scores[top], kind="stable")]
    if done < len(scores):
        yield from np.argsort(-scores, kind="stable")[done:]


class Packer:
    """Fills windows from one shard after another.  A piece is (document, start,
    ids); ``closed`` holds the finished sequences."""

    def __init__(self, idf: np.ndarray, mean: float, window: int):
        self.idf, self.mean, self.window = idf, mean, window
        self.open: list[tuple] = []
        self.free, self.asked = window, np.zeros(0, np.int64)
        self.closed: list[list[tuple]] = []

    def put(self, doc, start: int, ids: np.ndarray) -> np.ndarray:
        """Places what fits of ``ids`` and returns the rest of them."""
        now = ids[:self.free]
        if not self.open:
            self.asked = np.unique(ids)
        self.open.append((doc, start, now))
        self.free -= len(now)
        if not self.free:
            self.closed.append(self.open)
            self.open, self.free = [], self.window
        return ids[len(now):]

    def shard(self, rows: list[tuple]) -> None:
        """``rows``: (document, start, ids) of the shard, all of them placed."""
        index = Shard([ids for _, _, ids in rows], self.idf, self.mean)
        unused = np.ones(len(rows), bool)
        seed, held = 0, len(rows)
        while True:
            if not self.open:
                while seed < len(rows) and not unused[seed]:
                    seed += 1
                if seed == len(rows):
                    return
                unused[seed] = False
                self.put(*rows[seed])
                if not self.open:
                    continue
            left = np.flatnonzero(unused)
            if not len(left):
                return
            if len(left) < 0.8 * held:
                index.drop(unused)
                held = len(left)
            for at in ranking(index.scores(self.asked)[left]):
                k = left[at]
                unused[k] = False
                doc, start, ids = rows[k]
                rest = self.put(doc, start, ids)
                if len(rest):
                    self.put(doc, start + len(ids) - len(rest), rest)  # the next seed
                if rest.size or not self.open:
                    break

    def end(self) -> None:
        """The open window as sequences whose lengths are powers of two."""
        held = self.open
        self.open, left, self.free = [], self.window - self.free, self.window
        while left:
            self.free = 1 << left.bit_length() - 1
            left -= self.free
            now, held = held, []
            for at, (doc, start, ids) in enumerate(now):
                rest = self.put(doc, start, ids)
                if not self.open:  # closed: what is left belongs to the next one
                    held = ([(doc, start + len(ids) - len(rest), rest)] if len(rest) else []) + now[at + 1:]
                    break

    def take(self) -> list[list[tuple]]:
        out, self.closed = self.closed, []
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, window: int = WINDOW,
         shard: int = SHARD, part: int = PART) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = written(rests(docs, id_col, text_col, path, window), "rests")
    kind = dict(rows.dtypes)["doc_id"]
    some = rows.where(F.size("ids") > 0).select("row", "doc_id", "doc_tokens", "start", "ids", "sig")
    n, total = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in frequencies(some).collect()}  # at most one row an id of the vocabulary
    found = np.zeros(max(df, default=0) + 1)
    found[list(df)] = list(df.values())
    idf = docs.sparkSession.sparkContext.broadcast(np.log1p((n - found + 0.5) / (found + 0.5)))
    mean = total / max(n, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size, sequence = Packer(idf.value, mean, window), [], 0, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]
        doc_kind = pa.int64()

        def out() -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in names]
            for pieces in packer.take():
                offset = 0
                for (doc, tokens), start, ids in pieces:
                    for col, value in zip(cols, (doc, start, len(ids), crc(ids), tokens, sequence, offset), strict=True):
                        col.append(value)
                    offset += len(ids)
                sequence += 1
            kinds = [doc_kind, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            doc_kind = batch.column(0).type
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(batch.column(3).offsets.to_numpy()))
            for doc, tokens, start, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                               np.split(flat, ends[:-1]), strict=True):
                held.append(((doc, tokens), start, ids))
                size += len(ids)
                if size >= shard:
                    packer.shard(held)
                    held, size = [], 0
                    yield out()
        if held:
            packer.shard(held)
        packer.end()
        yield out()

    parts = max(1, -(-total // part))
    packed = (some.repartitionByRange(parts, "sig", "row").sortWithinPartitions("sig", "row").select("doc_id", "doc_tokens", "start", "ids")
              .mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"))
    # even numbers are packed sequences, by task and count; odd ones full windows
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = packed.withColumn("sequence_id", (F.spark_partition_id().cast("long") * (1 << 33) + F.col("sequence")) * 2).select(*names)
    full = rows.select("doc_id", "doc_tokens", F.posexplode("full").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)
