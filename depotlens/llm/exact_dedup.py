"""Exact dedup with counting quotient filters.

Every partition of the documents builds counting quotient filters over the
64-bit fingerprints of its texts, one filter per range of quotients.  Filters
of one range are shuffled together and merged without loss by walking their
sorted remainders, so a text with a third of all rows travels as one counter
per partition.  Only fingerprints whose merged count is above one go on: their
documents are compared by the bytes of the text itself.

Defined results: a null text counts as empty; empty texts are equal; the
largest id of a group stays, a null id only when the whole group has null ids;
repeated rows (same id, same text) are group members like any other, and all
rows that carry the surviving id are marked as kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RANGE_FINGERPRINTS = 1 << 20  # fingerprints of one range of quotients: some 12 MB when merged
MAX_RANGES = 1 << 20
MIN_RANGES = 1 << 8
SALTS = 32  # tasks that share the rows of one repeated fingerprint


@dataclass
class CountingQuotientFilter:
    """The multiset of the 64-bit fingerprints in one range of quotients.

    A fingerprint is split into a quotient (its high bits) and a remainder.
    Stored are: ``occupied``, one bit per quotient of the range that has a run;
    ``run_end``, one bit per slot that ends a run; the remainders, sorted in
    each run; and a counter per slot.  Quotient and remainder together are the
    whole fingerprint, so counts are exact and merging loses nothing.
    """

    first: int  # first quotient of the range
    quotient_bits: int
    occupied: np.ndarray  # bool, by quotient - first
    run_end: np.ndarray  # bool, by slot
    remainders: np.ndarray  # uint64, by slot
    counts: np.ndarray  # int64, by slot

    @classmethod
    def from_counts(cls, fps: np.ndarray, counts: np.ndarray, first: int, span: int, quotient_bits: int):
        """``fps``: sorted, distinct fingerprints of the range."""
        rest = np.uint64(64 - quotient_bits)
        q = (fps >> rest).astype(np.int64) - first if quotient_bits else np.zeros(len(fps), np.int64)
        occupied = np.zeros(span, bool)
        occupied[q] = True
        run_end = np.ones(len(fps), bool)
        run_end[:-1] = q[1:] != q[:-1]
        mask = np.uint64((1 << (64 - quotient_bits)) - 1)
        return cls(first, quotient_bits, occupied, run_end, fps & mask, counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        quotients = np.flatnonzero(self.occupied) + self.first
        run = np.cumsum(self.run_end) - self.run_end  # the run of each slot
        high = quotients[run].astype(np.uint64) << np.uint64(64 - self.quotient_bits) if self.quotient_bits else np.uint64(0)
        return high | self.remainders, self.counts

    @classmethod
    def merge(cls, parts: list["CountingQuotientFilter"]):
        """One filter of the sum of the multisets: the sorted remainders of all
        parts are merged, counters of equal ones are added."""
        items = [p.items() for p in parts]
        fps, counts = np.concatenate([f for f, _ in items]), np.concatenate([c for _, c in items])
        order = np.argsort(fps, kind="stable")  # merges sorted runs
        fps, counts = fps[order], counts[order]
        new = np.ones(len(fps), bool)
        new[1:] = fps[1:] != fps[:-1]
        at = np.flatnonzero(new)
        head = parts[0]
        total = np.add.reduceat(counts, at) if len(at) else counts
        return cls.from_counts(fps[at], total, head.first, len(head.occupied), head.quotient_bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.first, self.quotient_bits, len(self.occupied), len(self.remainders)], np.int64)
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_end), self.remainders, self.counts))

    @classmethod
    def from_bytes(cls, raw: bytes):
        first, bits, span, n = (int(x) for x in np.frombuffer(raw, np.int64, 4))
        at = 32
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, -(-span // 8), at), count=span).astype(bool)
        at += -(-span // 8)
        run_end = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        return cls(first, bits, occupied, run_end, np.frombuffer(raw, np.uint64, n, at), np.frombuffer(raw, np.int64, n, at + 8 * n))


def partition_filters(fps: np.ndarray, range_bits: int, slot_bits: int = 6) -> Iterator[tuple[int, bytes]]:
    """(range, filter) for the ranges that ``fps`` touch.  A range has
    2**slot_bits quotients."""
    values, counts = np.unique(fps, return_counts=True)
    ranges = (values >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    for f, c in zip(np.split(values, cuts), np.split(counts, cuts), strict=True):
        if len(f):
            r = int(f[0] >> np.uint64(64 - range_bits)) if range_bits else 0
            cqf = CountingQuotientFilter.from_counts(f, c, r << slot_bits, 1 << slot_bits, range_bits + slot_bits)
            yield r, cqf.to_bytes()


def repeated_fingerprints(fps: DataFrame, column: str, range_bits: int) -> DataFrame:
    """(fp, n): the 64-bit values of ``column`` that occur more than once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(held[-1])
            if n >= RANGE_FINGERPRINTS:  # a partition of any size in bounded memory
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def pack(held):
        rows = list(partition_filters(np.concatenate(held), range_bits))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["part", "cqf"])

    def merged(filters):
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(b.as_py()) for b in filters["cqf"]])
        values, counts = whole.items()
        many = counts > 1
        return pa.table({"fp": values[many].view(np.int64), "n": counts[many]})

    filters = fps.select(column).mapInArrow(build, "part long, cqf binary")
    return filters.groupBy("part").applyInArrow(merged, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fingerprint: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``fingerprint``: a long of the text, ``xxhash64`` unless given (tests give
    weak ones, so that different texts meet and the byte comparison decides).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fp = F.xxhash64(text) if fingerprint is None else fingerprint
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), fp.alias("fp"))
    narrow = written(keyed.select("doc_id", "fp", F.unhex(F.sha2("text", 256)).alias("sha")), "fingerprints")
    ranges = max(1, narrow.count() // RANGE_FINGERPRINTS)
    bits = math.ceil(math.log2(min(MAX_RANGES, max(MIN_RANGES, ranges))))
    repeated = (repeated_fingerprints(narrow, "fp", bits).select("fp")
                .withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))))
    # byte comparison: rows of a fingerprint meet in SALTS tasks, are grouped by the text itself,
    # and one text per salt and group goes on
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    classes = (salted.join(repeated.hint("merge"), ["fp", "salt"])  # one plan at every size: small sides would be broadcast
               .groupBy("fp", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
               .groupBy("fp", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
               .where("group_size > 1")
               .select("fp", F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    # two texts of one class key would be two rows here; the digest and the fingerprint tell them apart
    out = narrow.join(written(classes, "classes"), ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
