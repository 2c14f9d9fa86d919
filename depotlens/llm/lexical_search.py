"""Ranked lexical search with per-term geometric blocking.

Scores are sums of integer impacts (see ``impacts``), so a document is a sparse
vector and an item's score its inner product with the item's term counts.  The
documents are held as tables of the searched terms' occurrences, cut into
shards that one task walks through.  In a shard

* the posting list of every term is clustered by document similarity: pivots
  are spread over the list and every document joins the pivot whose random
  projection is most like its own;
* every cluster (block) keeps a summary, the coordinatewise maximum of its
  documents' vectors over the terms of the items that ask for the term;
* an item's inner product with a summary bounds the scores in the block, and
  the block is skipped only if that bound is below the item's k-th best score
  so far, which starts at nothing and is carried on through the task's shards.

A document that belongs to the answer is in a block of each of its terms, and
the bounds of those blocks are not below its score, so nothing is lost; equal
scores are kept, as the smaller id wins.  Every task returns at most k
documents per item.  Items are taken in blocks of at most ``VOCABULARY``
distinct terms (an item of more is a block by itself); a block is what the
tasks are sent, and the texts are read once per block.

Defined results: null texts and texts without a term are no documents; of
equal scores the smaller id comes first, null ids last; repeated rows are
documents of their own; equal item rows count once; an item without a term, or
an empty table, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, written

VOCABULARY = 4096  # distinct terms in a block of items
CELLS = 1 << 23  # of a shard's matrix, documents x terms
SHARDS = 3  # of a task
BLOCK = 32  # documents of a block on average
SKETCH = 16  # dimensions of the projection that blocks are clustered by
SALTS = 64  # parts of an item's candidates that are ranked apart first
#: Bytes that are no part of a term become blanks, A-Z become a-z.
TERMS = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Fixed values of the score: a = 75 parts of a hundred go by length, 8 is the saturation.
BY_LENGTH, SATURATION, SCALE, UNIT = 75, 8, 1000, 1_000_000_000


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What one occurrence of a term in an item adds to the score of a
    document: all 64-bit integers.  ``length``: all terms of all documents."""
    m = 100 - BY_LENGTH + (BY_LENGTH * n * documents) // length
    return w * ((UNIT * tf) // (SCALE * tf + SATURATION * m))


class Asked:
    """A block of items: their distinct terms, and how often each item has each."""

    def __init__(self, texts: list[bytes]):
        self.counts = [Counter(terms_of(t)) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}
        self.items_of: list[list[int]] = [[] for _ in self.vocabulary]
        for q, c in enumerate(self.counts):
            for t in c:
                self.items_of[self.vocabulary[t]].append(q)
        self.rows = [np.array([self.vocabulary[t] for t in c], np.int64) for c in self.counts]
        self.times = [np.array(list(c.values()), np.int64) for c in self.counts]

    def around(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the items that ask for ``term``: their numbers, their distinct
        terms, and the counts as a matrix (terms x items)."""
        items = np.array(self.items_of[term])
        cols = np.unique(np.concatenate([self.rows[q] for q in items]))
        counts = np.zeros((len(cols), len(items)), np.int64)
        for k, q in enumerate(items):
            counts[np.searchsorted(cols, self.rows[q]), k] = self.times[q]
        return items, cols, counts


def clusters(sketch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the rows of ``sketch`` dealt to about len / size
    pivots by greatest inner product, as runs of ``order``."""
    pivots = sketch[::size]
    mine = (sketch @ pivots.T).argmax(axis=1) if len(pivots) > 1 else np.zeros(len(sketch), np.int64)
    order = np.argsort(mine, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(mine[order]) > 0])


class Best:
    """The k best documents of every item so far, and the scores to reach."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)  # scores above 0 count
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]  # (-score, id is null, id)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        rows = self.found[item] + list(zip((-scores).tolist(), null.tolist(), ids.tolist(), strict=True))
        rows.sort()
        self.found[item] = rows[:self.k]
        if len(rows) >= self.k:
            self.least[item] = -rows[self.k - 1][0]


def search_shard(asked: Asked, exact: bool, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray,
                 impact: np.ndarray, best: Best) -> None:
    """Adds what the documents of one shard have to ``best``.  ``doc``,
    ``term``, ``impact``: the entries of their vectors, by document."""
    kind = np.float64 if exact else np.int64  # sums below 2^53 are exact in doubles
    x = np.zeros((len(ids), len(asked.vocabulary)), kind)
    x[doc, term] = impact
    signs = np.random.default_rng(0).standard_normal((x.shape[1], SKETCH)).astype(np.float32)
    sketch = x.astype(np.float32) @ signs
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(term, kind="stable")
    posted = np.r_[np.searchsorted(term[by_term], np.arange(x.shape[1])), len(term)]
    seen = np.zeros((len(ids), len(asked.counts)), bool)
    top = np.zeros(x.shape[1], np.int64)
    np.maximum.at(top, term, impact)
    for t in np.argsort(-top, kind="stable"):  # rare terms first: they raise the scores to reach
        if not top[t]:
            break
        rows = doc[by_term[posted[t]:posted[t + 1]]]
        items, cols, counts = asked.around(t)
        counts = counts.astype(kind)
        order, starts = clusters(sketch[rows], BLOCK)
        rows = rows[order]
        part = x[np.ix_(rows, cols)]
        bounds = np.maximum.reduceat(part, starts, axis=0) @ counts
        open_ = bounds >= best.least[items]  # blocks x items
        wanted = open_.any(axis=0)
        if not wanted.any():
            continue
        items, counts, open_ = items[wanted], counts[:, wanted], open_[:, wanted]
        inside = np.repeat(open_, np.diff(np.r_[starts, len(rows)]), axis=0)
        some = inside.any(axis=1)
        rows, part, inside = rows[some], part[some], inside[some]
        scores = (part @ counts).astype(np.int64)
        fresh = inside & ~seen[np.ix_(rows, items)]
        seen[np.ix_(rows, items)] |= inside
        good = fresh & (scores >= best.least[items])
        for k in np.flatnonzero(good.any(axis=0)):
            r = rows[good[:, k]]
            best.add(int(items[k]), scores[good[:, k], k], ids[r], null[r])


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: all its terms
    counted, and how often it has each term of ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                n.append(len(words))
                found = Counter(x for x in map(get, words) if x is not None)
                terms.append(list(found))
                tfs.append(list(found.values()))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, kind), pa.array(tfs, kind)],
                                             ["doc_id", "n", "terms", "tfs"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_texts(src, run, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def blocks_of(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The rows of ``items`` (id, text as bytes) in blocks of at most ``most`` distinct terms."""
    block, terms = [], set()
    for row in items.toLocalIterator():
        own = set(terms_of(row[1]))
        if block and len(terms | own) > most:
            yield block
            block, terms = [], set()
        block.append((row[0], bytes(row[1])))
        terms |= own
    if block:
        yield block


def search_block(docs: DataFrame, texts: list[bytes], k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, doc_id, score): at most k rows per task and item; the k best of all are among them."""
    asked = Asked(texts)
    postings = written(occurrences(docs, asked.vocabulary, id_col, text_col), "occurrences")
    documents, length = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row a searched term
    w = np.zeros(len(asked.vocabulary), np.int64)
    for row in df:
        w[row["term"]] = weight(documents, row["count"])
    most = max((int(c.sum()) for c in asked.times), default=0) * int(w.max(initial=0)) * (UNIT // SCALE)
    exact, shard = most < 1 << 53, max(BLOCK, CELLS // max(1, len(w)))
    sent = docs.sparkSession.sparkContext.broadcast((texts, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, w = sent.value
        asked, best = Asked(texts), Best(len(texts), k)
        for batch in batches:
            for at in range(0, batch.num_rows, shard):
                part = batch.slice(at, shard)
                lists = part.column(2)
                each = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), each)
                term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = part.column(1).to_numpy(zero_copy_only=False)
                search_shard(asked, exact, part.column(0).fill_null(0).to_numpy(zero_copy_only=False),
                             part.column(0).is_null().to_numpy(zero_copy_only=False), doc, term,
                             impacts(w[term], tf, n[doc], documents, length), best)
        rows = [(q, None if null else i, -s) for q, found in enumerate(best.found) for s, null, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    # a task has as many documents at every size of the input
    tasks = max(1, -(-documents // (SHARDS * shard)))
    return postings.where(F.size("terms") > 0).repartition(tasks).mapInArrow(run, "item long, doc_id long, score long")


def best_of(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best rows by ``by`` with their rank; parts of an item are ranked first."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))).where(F.col("rank") <= k)
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .where(F.col("rank") <= k).drop("part"))


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item its k best documents with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("binary"), F.lit(b"")).alias("text")).distinct()
    out = None
    for block in blocks_of(asked, vocabulary):
        names = spark.createDataFrame([(i, row[0]) for i, row in enumerate(block)], f"item long, item_id {asked.dtypes[0][1]}")
        best = best_of(search_block(docs, [text for _, text in block], k, id_col, text_col), k, "item")
        found = written(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "found")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return asked.sparkSession.createDataFrame([], f"item_id {asked.dtypes[0][1]}, rank int, doc_id long, score long")
    return out
