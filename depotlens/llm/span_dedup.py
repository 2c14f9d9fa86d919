"""Removal of byte strings that occur more than once, with suffix arrays.

A byte goes if it is covered by a string of LENGTH bytes that also starts
somewhere else, in any document.  The work is cut so that no task needs more
than a bounded piece of the corpus:

1. Anchors.  Every window of LENGTH bytes has one anchor, its k-gram of least
   hash (the first of equals), so equal windows have equal anchors at equal
   places.  A run of windows with one anchor is a context.  A context is sent
   on as two hashes and a place, never as text, and only if its anchor occurs
   twice.
2. Equal contexts are counted; all windows of a context that occurs twice are
   repeated, whatever the size of its group.
3. Where different contexts share an anchor, one text of each is fetched.
   Contexts are cut into blocks of 8 bytes aligned to the anchor, and the
   suffix array of the blocks (linear grouping, see gsaca) brings together
   suffixes that agree in 24 blocks; equal windows are told apart from near
   ones by the bytes at both ends.  Anchors with more than MAX_CONTEXTS
   contexts are divided by window: their windows are counted by a 128-bit hash.
4. Window ranges are joined back to the occurrences of their context, merged
   per document and cut out.

Defined results: a null text is empty; texts under LENGTH bytes stay whole;
repeated rows are occurrences of their own, so each loses what the other has;
rows of equal id are told apart by a 128-bit digest of their text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, written
from .gsaca import suffix_array

LENGTH = 200
GRAM = 48  # bytes of an anchor
BLOCK = 8
FULL = LENGTH // BLOCK  # blocks of a window that starts at a block
MAX_CONTEXTS = 1 << 14  # of one anchor, for one suffix array
SYMBOLS = 1 << 17  # blocks of contexts sorted at once, of several anchors
SEGMENT = 1 << 22  # bytes of a long text whose anchors are searched at once
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place, equal for equal bytes."""
    base = 0x9E3779B97F4A7C15
    powers = {1: data.astype(np.uint64) + np.uint64(1)}
    size = 1
    while 2 * size <= GRAM:
        h = powers[size]
        powers[2 * size] = h[:len(h) - size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    out, have = powers[size], size
    while have < GRAM:  # the rest of GRAM from the powers of two made before
        size = max(s for s in powers if s <= GRAM - have)
        rest = powers[size]
        out = out[:len(data) - have - size + 1] * np.uint64(pow(base, size, 1 << 64)) + rest[have:have + len(data) - have - size + 1]
        have += size
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x94D049BB133111EB)


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    size, low = 1, keys
    while 2 * size <= width:
        low = np.minimum(low[:len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[:len(low) - (width - size)], low[width - size:]) if size < width else low


def contexts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each context: hash of the anchor, first window, number of windows, and the anchor's distance from the first window."""
    anchors, lows, counts, offsets = [], [], [], []
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = whole[at:at + SEGMENT + LENGTH - 1]
        hashes = _gram_hashes(part)
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_window_min(keys, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        anchors.append(hashes[place[first]])
        lows.append(first + at)
        counts.append(np.diff(np.append(first, len(place))))
        offsets.append(place[first] - first)
    if not anchors:
        return (np.zeros(0, np.int64),) * 4
    return np.concatenate(anchors).view(np.int64), np.concatenate(lows), np.concatenate(counts), np.concatenate(offsets)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, anchor, ctx, low, windows, offset) of every context of ``docs(doc_id, twin: binary, text: binary)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            at, parts, ctx = [], [], []
            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                if data is None or len(data) < LENGTH:
                    continue
                found = contexts(data)
                ctx += [digest(data[a:a + n + LENGTH - 1]) for a, n in zip(found[1].tolist(), found[2].tolist(), strict=True)]
                parts.append(found)
                at.append(np.full(len(found[0]), i))
            if not parts:
                continue
            anchor, low, n, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor),
                 pa.array(np.array(ctx, np.uint64).view(np.int64)), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32))],
                ["doc_id", "twin", "anchor", "ctx", "low", "windows", "offset"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_texts(docs, run, f"doc_id {kind}, twin binary, anchor long, ctx long, low int, windows int, offset int")


def repeated_windows(texts: list[bytes], windows: list[int], offsets: list[int]) -> list[np.ndarray]:
    """Of each context (its bytes, number of windows, anchor place): which of its windows equal another one.

    Only windows whose anchors are at the same place are compared, which is all
    that can be equal.
    """
    skip = [o % BLOCK for o in offsets]  # bytes before the first block that is aligned to the anchor
    blocks, left, owner, where = [], [], [], []
    for k, text in enumerate(texts):
        n = (len(text) - skip[k]) // BLOCK
        blocks.append(np.frombuffer(text, "<u8", n, skip[k]))
        blocks.append(np.array([k], np.uint64))  # the end of a context, unlike any block
        left.append(np.concatenate([np.zeros(n, bool), [True]]))
        owner.append(np.full(n + 1, k))
        where.append(skip[k] + BLOCK * np.arange(n + 1))
    names = np.concatenate(blocks)
    ends, owner, where = np.concatenate(left), np.concatenate(owner), np.concatenate(where)
    symbols = np.empty(len(names), np.int64)
    symbols[ends] = np.arange(len(texts))
    symbols[~ends] = len(texts) + np.unique(names[~ends], return_inverse=True)[1]
    order = suffix_array(symbols)
    # classes of suffixes that agree in all but the last block of a window
    padded = np.concatenate([symbols, np.full(FULL, -1)])
    same = np.ones(len(order), bool)
    same[0] = False
    for j in range(FULL - 1):
        a = padded[order + j]
        same[1:] &= a[1:] == a[:-1]
    classes = np.cumsum(~same)
    size = np.bincount(classes)
    rows = order[size[classes] > 1]
    classes = classes[size[classes] > 1]
    out = [np.zeros(w, bool) for w in windows]
    if not len(rows):
        return out
    # a window starts x bytes before its first block: x bytes there and 8 - x after the 24 blocks decide
    data = b"".join([b"\0" * BLOCK, *texts, b"\0" * 2 * BLOCK])
    base = np.cumsum([BLOCK] + [len(t) for t in texts])[:-1]
    raw = np.frombuffer(data, np.uint8)
    total = np.array([len(t) for t in texts])
    many = np.array(windows)
    k, at = owner[rows], where[rows]
    begin = base[k] + at
    found_k, found_s = [], []
    for x in range(BLOCK):
        s = at - x
        fits = (s >= 0) & (s < many[k]) & (s + LENGTH <= total[k])
        if not fits.any():
            continue
        b = begin[fits]
        edge = np.zeros(len(b), np.uint64)
        for j in range(BLOCK):
            place = b - x + j if j < x else b + LENGTH - BLOCK + (j - x)
            edge = (edge << np.uint64(8)) | raw[place]
        by = np.lexsort((edge, classes[fits]))
        c, e = classes[fits][by], edge[by]
        twin = (c[1:] == c[:-1]) & (e[1:] == e[:-1])
        hit = np.zeros(len(by), bool)
        hit[1:] |= twin
        hit[:-1] |= twin
        found_k.append(k[fits][by][hit])
        found_s.append(s[fits][by][hit])
    if found_k:
        ks, ss = np.concatenate(found_k), np.concatenate(found_s)
        for c in np.unique(ks):
            out[c][ss[ks == c]] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


RANGES = "anchor long, ctx long, first array<int>, last array<int>"


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of whole anchors, sorted by anchor as they come, until SYMBOLS blocks are together."""
    rows, done, size = [], 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["anchor"] != rows[-1]["anchor"]:
                if size >= SYMBOLS:
                    yield rows
                    rows, size = [], 0
            rows.append(row)
            size += len(row["bytes"]) // BLOCK + 1
    if rows:
        yield rows


def by_suffix_array(texts: DataFrame) -> DataFrame:
    """Repeated window ranges of contexts (anchor, ctx, windows, offset, bytes); anchors meet in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_groups(batches):
            flags = repeated_windows([r["bytes"] for r in rows], [r["windows"] for r in rows], [r["offset"] for r in rows])
            hit = [(r, *_ranges(f)) for r, f in zip(rows, flags, strict=True) if f.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["anchor"] for r, _, _ in hit], pa.int64()), pa.array([r["ctx"] for r, _, _ in hit], pa.int64()),
                 pa.array([a for _, a, _ in hit], pa.list_(pa.int32())), pa.array([b for _, _, b in hit], pa.list_(pa.int32()))],
                ["anchor", "ctx", "first", "last"])

    return texts.repartition("anchor").sortWithinPartitions("anchor", "ctx").mapInArrow(run, RANGES)


def by_window(texts: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts: every window by itself, counted by its hash, in any number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for r in batch.to_pylist():
                hashes = np.frombuffer(b"".join([digest(r["bytes"][s:s + LENGTH]) for s in range(r["windows"])]), np.int64).reshape(-1, 2)
                n = len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array([r["anchor"]] * n, pa.int64()), pa.array([r["ctx"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                                                  pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], ["anchor", "ctx", "s", "h1", "h2"])

    windows = texts.mapInArrow(run, "anchor long, ctx long, s int, h1 long, h2 long")
    many = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    hit = windows.join(many, ["h1", "h2"]).groupBy("anchor", "ctx").agg(F.sort_array(F.collect_set("s")).alias("s"))
    return hit.select("anchor", "ctx", F.col("s").alias("first"), F.col("s").alias("last"))


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the contexts in ``wanted`` (doc_id, twin, list of contexts) from the rows they stand in.

    Rows of equal id and text lie next to each other after the merge join; the first speaks for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for doc_id, twin, data, wanted_here in zip(*batch.columns, strict=True):
                row, before = (doc_id.as_py(), twin.as_py()), last
                last = row
                if row == before:
                    continue
                data = data.as_py()
                out += [(c["anchor"], c["ctx"], c["windows"], c["offset"], c["contexts"], data[c["low"]:c["low"] + c["windows"] + LENGTH - 1]) for c in wanted_here.as_py()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                                             ["anchor", "ctx", "windows", "offset", "contexts", "bytes"])

    joined = _by_row(docs, wanted, "inner")
    return map_texts(joined.select("doc_id", "twin", "text", "list"), run, "anchor long, ctx long, windows int, offset int, contexts long, bytes binary")


def _by_row(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the list of each row; texts go through the same exchange each time."""
    lists = lists.select(F.col("doc_id").alias("id"), F.col("twin").alias("tw"), "list").hint("merge")
    return docs.join(lists, docs.doc_id.eqNullSafe(lists.id) & (docs.twin == lists.tw), how)


def cut_out(joined: DataFrame) -> DataFrame:
    """Removes the spans in ``list`` (low, first, last) from ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, gone, kept = value.as_py() or b"", [], []
                rows = [(r["low"] + a, r["low"] + b + LENGTH) for r in spans.as_py() or [] for a, b in zip(r["first"], r["last"], strict=True)]
                for a, b in sorted(rows):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                at = 0
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept,
                            [{"first": a, "after": b} for a, b in gone]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"])

    kind = dict(joined.dtypes)["doc_id"]
    return map_texts(
        joined.select("doc_id", "text", "list"), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary, spans array<struct<first: long, after: long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    src = src.select("doc_id", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("twin"), "text")
    occ = occurrences(src)
    # counts are written before they are joined: the join then reads two plain shuffles and can split a hot anchor
    many = written(occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    occ = written(occ.join(many.hint("merge"), "anchor", "left_semi"), "occurrences")
    ctx = occ.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "twin", "low", "windows", "offset")).alias("at"))
    ctx = written(ctx.select("anchor", "ctx", "n", "at.*"), "contexts")
    shared = written(ctx.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), "shared_anchors")
    # all windows of a context that occurs twice are repeated
    whole = ctx.where("n > 1").select("anchor", "ctx", F.array(F.lit(0)).alias("first"), F.array(F.col("windows") - 1).alias("last"))
    # contexts that share their anchor with others are compared with them
    wanted = (ctx.join(shared.hint("merge"), "anchor").groupBy("doc_id", "twin")
              .agg(F.collect_list(F.struct("anchor", "ctx", "low", "windows", "offset", "contexts")).alias("list")))
    texts = written(fetch(src, wanted), "context_texts")
    found = (by_suffix_array(texts.where(F.col("contexts") <= MAX_CONTEXTS)).unionByName(by_window(texts.where(F.col("contexts") > MAX_CONTEXTS)))
             .unionByName(whole))
    # a set: rows of equal id and text have the same spans and share one list of them
    lists = (occ.join(found.hint("merge"), ["anchor", "ctx"]).groupBy("doc_id", "twin")
             .agg(F.collect_set(F.struct("low", "first", "last")).alias("list")))
    return cut_out(_by_row(src, lists, "left"))
