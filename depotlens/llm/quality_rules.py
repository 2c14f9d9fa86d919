"""Host-level quality rules.

Every document is measured natively (arrays of its own words, no exploded
rows).  Rule failures are summed by host; each rule's host rates give an
empirical beta prior by moments, and a host's rate is shrunk towards it by the
prior's strength, so a host of few documents is judged by the corpus and a
large one by itself.  A host fails when the shrunk rate of a rule is above
``host_limit``; the verdict is joined back, and a document is kept if neither
it nor its host fails.

Defined results: a null text has no words and fails as too short; a text under
three words has no window; documents without a host form a host of their own;
repeated rows count each; an empty table gives an empty result; other columns
are ignored.  Windows are compared by 64-bit hashes of their words within a
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written

GAPS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3
HOST_LIMIT = 0.8  # a host fails when more than this share of its documents fails a rule
MIN_STRENGTH, MAX_STRENGTH = 10.0, 1e6  # documents a prior weighs as, when host rates are extreme or all alike


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words).

    Steps are columns of their own where a later step reads them more than
    once; Catalyst then evaluates each once per row.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, GAPS, "")) > 0)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", "host",
                 F.length(F.translate(text, GAPS, "")).cast("long").alias("word_chars"),
                 (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 lines.alias("lines"),
                 F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"))
    d = d.select("doc_id", "host", "word_chars", "n_symbols",
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 "words", F.size("words").alias("n"), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)).alias("windows"))
    # one hash per window: words folded in one after the other
    window = F.slice("words", F.lit(1), F.col("windows"))
    for k in range(1, WINDOW):
        window = F.zip_with(window, F.slice("words", F.lit(k + 1), F.col("windows")), lambda a, b: F.xxhash64(a, b))
    rest = ["doc_id", "host", "word_chars", "n_symbols", "n_dup_lines", "n"]
    d = d.select(*rest, F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))),
                       lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    d = d.select(*rest, found.alias("at"))
    # words covered: each found window adds its words up to the next one
    steps = F.zip_with(F.slice("at", F.lit(2), F.size("at")), F.slice("at", F.lit(1), F.greatest(F.size("at") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("at") > 0, F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0))
    return d.select("doc_id", "host", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def rules() -> dict[str, Column]:
    """Rule -> condition under which a document fails it."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 5 * F.col("n_dup_lines") > F.col("n_words"),
    }


BASE = ("short", "repeats")  # rules that drop a document by themselves


def host_verdicts(failures: DataFrame, names: list[str], host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, docs, <rule>_rate for every rule, host_failed) from documents with a boolean column per rule.

    Prior by moments, hosts weighted by their documents: with mean m and
    variance v of the host rates, strength s = m (1 - m) / v - 1 (at least
    MIN_STRENGTH), and a host with k of n failures has the rate (k + m s) / (n + s).
    """
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(F.col(r).cast("long")).alias(r) for r in names))
    hosts = written(hosts, "hosts")
    moments = []
    for r in names:  # exact sums: the same prior for every order of addition
        moments += [F.sum(r).alias(f"k_{r}"), F.sum((F.col(r) * F.col(r)).cast("double") / F.col("docs")).alias(f"q_{r}")]
    row = hosts.agg(F.sum("docs").alias("n"), *moments).first()  # one row of sums
    out, failed = hosts, F.lit(False)
    for r in names:
        n = row["n"] or 1
        m = (row[f"k_{r}"] or 0) / n
        v = max((row[f"q_{r}"] or 0.0) / n - m * m, 0.0)
        s = min(max(m * (1 - m) / v - 1, MIN_STRENGTH), MAX_STRENGTH) if v > 0 else MAX_STRENGTH
        rate = (F.col(r) + F.lit(m * s)) / (F.col("docs") + F.lit(s))
        out = out.withColumn(f"{r}_rate", rate)
        failed = failed | (F.col(f"{r}_rate") > host_limit)
    return out.select("host", "docs", *(f"{r}_rate" for r in names), failed.alias("host_failed"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, host_failed, kept."""
    names = list(rules())
    m = written(measures(docs, id_col, text_col, host_col), "measures")
    verdicts = host_verdicts(m.select("host", *(c.alias(r) for r, c in rules().items())), names, host_limit)
    verdicts = verdicts.select(F.col("host").alias("h"), "host_failed")
    base = rules()[BASE[0]] | rules()[BASE[1]]
    return (m.join(verdicts, m.host.eqNullSafe(verdicts.h), "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), "host_failed", (~base & ~F.col("host_failed")).alias("kept")))
