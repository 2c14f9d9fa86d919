"""SimHash near-dedup by the general pigeonhole principle.

A document's fingerprint is the bitwise majority of the hashes of its word
shingles.  The 64 bits are grouped into partitions of correlated bits, and
every partition gets a threshold of its own (-1: not probed).  If the sum of
(threshold + 1) is the distance bound + 1, two fingerprints within the bound
are within the threshold of at least one partition, so probing each partition
for values within its threshold finds every pair.  The number of partitions
and the thresholds are chosen by dynamic programming on the candidate counts
that a bounded sample of fingerprints predicts; that choice moves cost only,
never results.

Equal fingerprints are collapsed first.  A block (documents that share a
probed value) is verified pair by pair inside its group and gives a spanning
forest of its links, never all pairs.  Members of a block above BLOCK_ROWS are
linked instead by one-flip keys: two fingerprints are within two bits exactly
if some 64-bit value is within one bit of both, so every fingerprint emits
itself and its 64 one-bit neighbours, and each key links at most 65 members.

Defined results: null and empty texts (no words) have fingerprint zero and are
linked like any other; component_id is the smallest non-null id that can be
reached (null if there is none); repeated rows appear once each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hashed_sample, map_texts, written

BITS = 64
SEED = 42
CHUNK = 1 << 15  # shingles whose bits are unpacked at once
SAMPLE = 2048  # fingerprints the plan is estimated on
BLOCK_ROWS = 64  # largest block verified pair by pair
ROW_COST, PAIR_COST = 1.0, 0.2  # of a probe row and of a verified pair
MAX_PARTITIONS = 6


def fingerprint(text: bytes | None, words: int) -> int:
    """Bit i is set if it is set in over half of the shingle hashes."""
    parts = (text or b"").lower().split()  # bytes: A-Z only, and white space is 09-0D and 20
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        starts = list(accumulate((len(p) + 1 for p in parts), initial=0))
        spans = zip(starts, (s - 1 for s in starts[words:]), strict=False)
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[at:at + CHUNK], axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(raw), CHUNK))
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_texts(src, run, src.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` nearly equal groups; correlated bits go together."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    centred = bits - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0))
    corr = np.abs(centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        inside = corr[np.ix_(free, free)]
        group = [free.pop(int((inside.sum(axis=0) - inside.diagonal()).argmax()))]
        while len(group) < size:
            group.append(free.pop(int(corr[np.ix_(group, free)].sum(axis=0).argmax())))
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost with sum(threshold + 1) == total;
    ``costs[i][t + 1]`` is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra, more in enumerate(row[: total - used + 1]):
                if used + extra not in step or cost + more < step[used + extra][0]:
                    step[used + extra] = (cost + more, [*chosen, extra - 1])
        best = step
    return best[total]


def plan_probes(sample: np.ndarray, rows: int, distance: int) -> list[tuple[list[int], int]]:
    """[(bits of a partition, threshold)] of least estimated cost."""
    a, b = np.triu_indices(len(sample), 1)
    differ = sample[a] ^ sample[b]
    choice = (float("inf"), [])
    for parts in range(1, MAX_PARTITIONS + 1):
        groups, costs = group_bits(sample, parts), []
        for group in groups:
            mask = np.uint64(sum(1 << i for i in group))
            apart = np.bitwise_count(differ & mask)
            row = [0.0]
            for t in range(distance + 1):
                near = max(float((apart <= t).mean()) if len(a) else 0.0, 2.0 ** -len(group))
                row.append(ROW_COST * rows * (1 + (len(group) if t else 0)) + PAIR_COST * rows * rows / 2 * near)
            costs.append(row)
        cost, thresholds = allocate(costs, distance + 1)
        if cost < choice[0]:
            choice = (cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0])
    return choice[1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def probe_keys(part: int, bits: list[int], threshold: int) -> list[Column]:
    """The keys a fingerprint probes in one partition: its own value, and for
    thresholds of 1 and 2 the values one bit away (two fingerprints within 2
    bits there share one of these)."""
    own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << i for i in bits))))
    flips = [own.bitwiseXOR(F.lit(_signed(1 << i))) for i in bits] if threshold else []
    return [F.struct(F.lit(part).alias("part"), v.alias("value")) for v in [own, *flips]]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``distance`` of each other."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        x, y = find(int(i)), find(int(j))
        if x != y:
            root[y] = x
            links.append((int(fps[i].view(np.int64)), int(fps[j].view(np.int64))))
    return links


def verified_links(groups: DataFrame, distance: int) -> DataFrame:
    """(a, b) from rows that hold an array ``fps`` of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for fps in batch.column(0) for x in forest(np.array(fps.as_py(), np.int64).view(np.uint64), distance)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def near_links(distinct: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that chains of
    distances up to ``distance`` (0 to 2) connect.  ``distinct``: column fp."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    rows = distinct.count()
    sample = np.array([r.fp for r in hashed_sample(distinct.select("fp"), "fp", SAMPLE).collect()], np.int64)
    if rows < 2:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    plan = plan_probes(sample.view(np.uint64), rows, distance)
    keys = [k for part, (bits, t) in enumerate(plan) for k in probe_keys(part, bits, t)]
    probes = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.part", "key.value")
    sizes = probes.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = written(probes.join(sizes, ["part", "value"]), "blocks")
    small = (blocks.where(F.col("n") <= BLOCK_ROWS).groupBy("part", "value")
             .agg(F.collect_list("fp").alias("fps")))
    # both are within one bit of some key: exact for distances up to 2; the forest checks the distance
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    large = (blocks.where(F.col("n") > BLOCK_ROWS).select("fp").distinct()
             .select("fp", F.explode(flips).alias("key")).groupBy("key")
             .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    return verified_links(small.select("fps").unionByName(large.select("fps")), distance)


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(near_links(distinct, distance), "a", "b")
    members = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = members.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(members.join(low, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
