"""Mixing sources to target weights by Pareto order sampling.

Sources share the total size by their weights, up to ``cap`` times their own
size; what a capped source leaves is shared again.  Inside a source a document
is expected to be taken in proportion to its weight, at most ``cap`` times; the
weight is a column or, without one, the bits of the document's number of words,
so that longer documents are likelier.  The whole part of that number is allocated as
certain copies.  The rest is an inclusion probability p: documents are ranked
by u / (1 - u) divided by p / (1 - p), u a number drawn from the document's id,
its text and, of rows alike in both, a number of the row, and the source takes documents in that order until the words it still needs
are reached.  Two targets met by one order: documents of larger p come first,
and any sample is fixed by the seed.

The cut is found without sorting a source in one task: words are summed by
steps of the rank score, the step in which the target falls is cut into steps
again, and only that last step is ordered.

Defined results: a null text or one without words has size 0 and is taken 0
words; sources are ordered by code point, null last; rows of equal or null id
are documents of their own, repeated rows too; a source whose target is
its cap takes every document ``cap`` times; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
STEPS = 4096


def n_words(text: Column) -> Column:
    """Number of words: starts of words are counted, no word is made."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source, source_size, target) from (key, source, source_size), a row per source.

    Rounds of sharing: full sources keep cap * size, the rest is shared by
    weight among the others, until no share is above its cap.  A round reads
    two numbers on the driver.
    """
    # the one place where sources are numbered: a row per source, ordered by code point
    k = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int"))
    t = written(sizes.select("key", "source", "source_size", weight.alias("weight"), F.lit(False).alias("full")), "sources")
    size = F.col("source_size")
    while True:
        words, left = t.agg(F.sum(F.when(F.col("full"), size * (1 - cap)).otherwise(size)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        share = F.lit(float(words or 0)) * F.col("weight") / F.lit(float(left or 1))
        full = F.col("full") | (share > size * cap)
        t = written(t.select("key", "source", "source_size", "weight", full.alias("full"), (full & ~F.col("full")).alias("new"),
                             F.when(full, (size * cap).cast("double")).otherwise(share).alias("target")), "targets")
        if not t.where("new").head(1):
            return t.select("key", "source", "source_size", "target")


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the columns: 52 bits of a digest."""
    text = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def numbered(rows: DataFrame, *same: str) -> DataFrame:
    """``rows`` with ``nth``, which tells rows alike in ``same`` apart (from 0).

    The rows are numbered inside their partition and the counts of the
    partitions before are added, so that no group, however large, is gathered.
    """
    rows = written(rows.withColumn("part", F.spark_partition_id()), "parts")
    inside = F.row_number().over(W.partitionBy(*same, "part").orderBy("part")) - 1
    counts = rows.groupBy(*same, "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = W.partitionBy(*same).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where("before > 0")
    alike = None
    numbers = rows.withColumn("inside", inside).alias("r")
    for c in (*same, "part"):
        one = F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
        alike = one if alike is None else alike & one
    return (numbers.join(before.alias("b"), alike, "left")
            .select(*[F.col(f"r.{c}") for c in rows.columns if c != "part"],
                    (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("nth")))


def pareto_score(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds, mapped to (0, 1) in the same order."""
    q = (u / (1 - u)) / (p / (1 - p))
    return q / (1 + q)


def _boundary(rows: DataFrame, need: DataFrame, step: Column) -> DataFrame:
    """(key, step, need): the step in which each source's words reach its need, and what is then still needed."""
    sums = rows.groupBy("key", step.alias("step")).agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("key").orderBy("step").rowsBetween(W.unboundedPreceding, -1)  # at most STEPS rows a source
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    hit = (F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))
    return sums.join(need, "key").where(hit).select("key", "step", (F.col("need") - F.col("before")).alias("need"))


def cuts(ranked: DataFrame, need: DataFrame) -> DataFrame:
    """(key, cut, whole): documents with a score below ``cut`` are taken, and
    those at the cut if ``whole`` (if that is nearer to the need).

    ``ranked``: key, size, score in [0, 1); ``need``: key, need.
    """
    for power in (1, 2):
        step = F.floor(F.col("score") * float(STEPS**power))
        at = written(_boundary(ranked, need, step), "steps")
        ranked = (ranked.withColumn("step", step).join(at.select("key", "step"), ["key", "step"], "left_semi")
                  .select("key", "size", "score"))
        need = at.select("key", "need")
    # equal scores are one unit
    units = ranked.groupBy("key", "score").agg(F.sum("size").alias("words"))
    units = units.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("score"))).join(need, "key")
    over = F.col("upto") - F.col("need")
    return (units.where((over >= 0) & (over < F.col("words")))
            .select("key", F.col("score").alias("cut"), (over <= F.col("words") - over).alias("whole")))


def expected_copies(rows: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``rows`` with ``copies``: how often the mix should take each on average.

    Copies are in proportion to ``weight`` inside a source, at most ``cap``;
    words that full documents leave go to the others by weight, in rounds over
    the words of each weight.  A source that is its cap has ``cap`` of each.
    """
    all_full = F.col("target") >= cap * F.col("source_size")
    classes = written(rows.groupBy("key", "weight").agg(F.sum("size").alias("size")), "weights")
    rate = written(targets.select("key", F.lit(0.0).alias("rate")), "rates")
    while True:
        full = F.col("weight") * F.col("rate") >= cap
        sums = classes.join(rate, "key").groupBy("key").agg(
            F.sum(F.when(full, F.col("size"))).alias("full"), F.sum(F.when(~full, F.col("size") * F.col("weight"))).alias("rest"))
        new = F.when(F.col("rest") > 0, (F.col("target") - cap * F.coalesce("full", F.lit(0))) / F.when(F.col("rest") > 0, F.col("rest")))
        step = written(targets.join(sums, "key").join(rate, "key")
                       .select("key", F.greatest("rate", F.coalesce(new, "rate")).alias("rate"), F.col("rate").alias("old")), "rates")
        rate = step.select("key", "rate")
        if not step.where("rate > old * (1 + 1e-12)").head(1):
            rate = rate.join(targets.select("key", all_full.alias("all_full")), "key")
            copies = F.when(F.col("all_full"), float(cap)).otherwise(F.least(F.col("weight") * F.col("rate"), F.lit(float(cap))))
            return rows.join(rate, "key").withColumn("copies", copies).drop("rate", "all_full")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, weight_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, digest.

    ``copies`` is how often the mix has the document, ``taken`` its words in
    it, ``digest`` the MD5 of its text.  ``weight_col``: positive weights of
    documents inside their source (null: 1); without it the bits of their number of words.
    """
    size = n_words(F.col(text_col))
    weight = F.length(F.bin("size")).cast("double") if weight_col is None else F.col("given")
    given = F.lit(1.0) if weight_col is None else F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0))
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
                       size.alias("size"), given.alias("given"),
                       F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"))
    rows = numbered(rows, "doc_id", "digest", "key", "given").withColumn("weight", weight)
    rows = written(rows.drop("given"), "sizes")
    targets = source_targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, cap)
    rows = expected_copies(rows, targets, cap)
    rows = rows.withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
    rows = rows.withColumn("score", F.when(F.col("p") > 0, pareto_score(uniform(F.col("doc_id"), F.col("digest"), F.col("nth")), F.when(F.col("p") > 0, F.col("p")))))
    rows = written(rows, "ranked")
    certain = rows.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = targets.join(certain, "key").select("key", (F.col("target") - F.col("certain")).alias("need")).where("need > 0")
    cut = cuts(rows.where("score IS NOT NULL").select("key", "size", "score"), need).withColumnRenamed("whole", "at_cut")
    drawn = F.coalesce((F.col("score") < F.col("cut")) | ((F.col("score") == F.col("cut")) & F.col("at_cut")), F.lit(False))
    copies = F.col("whole") + drawn.cast("long")
    return (rows.join(targets.select("key", "source_size", "target"), "key").join(written(cut, "cuts"), "key", "left")
            .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "digest"))
