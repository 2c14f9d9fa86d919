"""Spelling variant grouping with PartEnum signatures.

A word is the multiset of its letters, written as a binary vector: coordinate
(letter, i) is set if the word has the letter at least i times.  Two words that
differ by one inserted or deleted letter differ in one coordinate, by one
replaced letter in two, so near words are within Hamming distance 2.  PartEnum
makes that an equi-join: the coordinates are dealt to ``FIRST`` partitions, and
vectors within distance k are within floor(k / FIRST) in one of them; each
partition is dealt again to ``SECOND`` parts, and vectors within distance j in a
partition agree on some ``SECOND`` - j of its parts.  A signature is the
coordinates of one such choice of parts, so near words share one at least.
Words that share a signature are verified by their edit distance inside the
join.  The coordinates are dealt by a hash, the same for every word.

Words of a signature that more than ``GROUP`` words share are not paired with
each other: they are joined by the words with one letter left out (two words
that differ by a replaced letter are equal without it, and at most one word a
letter of the alphabet is; a word less one letter is the shorter word), which is
exact and has no large groups.

Defined results: null texts have no words; a null id counts as empty text in
the hash; repeated rows are occurrences of their own; ties of a form go to the
smallest word; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = "[A-Za-zÀ-ÿ]+"
SLIP = 199  # one run in so many loses a letter
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
DISTANCE, FIRST, SECOND = 2, 1, 6
GROUP = 64  # largest signature group that is paired directly
ROUNDS = 5  # n grows five-fold along forms: a 64-bit n allows 27 steps, five doublings reach 32


def without(word: Column, at: Column) -> Column:
    """``word`` less its code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(run): every run of letters after its slip, if it has one."""
    low = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(h, F.length("run")).cast("int")
    return rows.select(F.when(h % SLIP == 0, without(F.col("run"), at)).otherwise(F.col("run")).alias("run"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS,
               occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n): the words of enough code points and occurrences."""
    n = F.count(F.lit(1))
    return (runs(docs, id_col, text_col).where(F.length("run") >= letters)
            .groupBy(F.col("run").alias("word")).agg(n.alias("n")).where(F.col("n") >= occurrences))


def letter_parts(word: Column, count: int) -> Column:
    """array<string>: the set coordinates of the word's letters, dealt to ``count`` parts."""
    letters = F.sort_array(F.split(word, ""))
    # in the sorted letters an occurrence's number is its distance from the letter's first place
    marks = F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x) + 1).cast("string")))
    dealt = F.transform(marks, lambda m: F.struct(F.pmod(F.xxhash64(F.lit("part"), m), F.lit(count)).alias("part"), m.alias("mark")))

    def part(p: int) -> Column:
        return F.array_join(F.transform(F.filter(dealt, lambda x: x["part"] == p), lambda x: x["mark"]), " ")

    return F.array(*[part(p) for p in range(count)])


def signatures(parts: Column, first: int = FIRST, second: int = SECOND, distance: int = DISTANCE) -> Column:
    """array<long>: hashes of the PartEnum signatures of ``letter_parts(word, first * second)``."""
    agree = second - distance // first
    if agree < 1:
        raise ValueError("the second level needs more parts than the distance left to a partition")
    chosen = [[i * second + p for p in c] for i in range(first) for c in combinations(range(second), agree)]
    return F.array(*[F.xxhash64(F.lit(k), *[parts[p] for p in c]) for k, c in enumerate(chosen)])


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b), both ways: words that differ by one inserted, deleted or replaced code point."""
    parts = words.select("word", letter_parts(F.col("word"), FIRST * SECOND).alias("parts"))
    signed = written(parts.select("word", F.explode(F.array_distinct(signatures(F.col("parts")))).alias("sig")), "signatures")
    sizes = written(signed.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "signature_sizes")
    small = signed.join(sizes.where(F.col("members") <= group).select("sig"), "sig", "left_semi")
    a, b = small.select("sig", F.col("word").alias("a")), small.select("sig", F.col("word").alias("b"))
    one = F.levenshtein("a", "b", 1) == 1
    pairs = a.join(b.hint("merge"), ["sig"]).where((F.col("a") < F.col("b")) & one).select("a", "b")

    crowded = written(signed.join(sizes.where(F.col("members") > group).select("sig"), "sig", "left_semi").select("word").distinct(), "crowded")
    places = F.sequence(F.lit(0), F.length("word") - 1)
    less = F.transform(places, lambda i: F.struct(i.alias("at"), without(F.col("word"), i).alias("rest")))
    cut = crowded.select("word", F.explode(less).alias("less")).select("word", "less.at", "less.rest")
    other = cut.withColumnRenamed("word", "b")
    replaced = cut.withColumnRenamed("word", "a").join(other, ["at", "rest"]).where("a < b").select("a", "b")
    shorter = (cut.select("word", "rest").distinct().join(crowded.select(F.col("word").alias("rest")), "rest")
               .select(F.least("word", "rest").alias("a"), F.greatest("word", "rest").alias("b")))
    links = written(pairs.unionByName(replaced).unionByName(shorter).distinct(), "near_words")
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
                    letters: int = LETTERS, occurrences: int = OCCURRENCES, group: int = GROUP) -> DataFrame:
    """One row per word: word, form (its near word of largest n, if that is
    ``ratio`` times its own), root (the last of the forms from it), n, n_near, form_n."""
    words = written(vocabulary(docs, id_col, text_col, letters, occurrences), "words")
    near = near_words(words, group).join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b").alias("form"))).alias("best"))
    formed = F.col("best.less") * -1 >= F.col("n") * ratio
    rows = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    # the last of the forms, by doubling: after r rounds a word knows the word 2^r forms ahead of it
    ahead = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ROUNDS):
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(ahead.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(ahead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
