"""Licence scan by a trained paragraph classifier.

Paragraphs end at lines without a letter or digit.  Their statements are scored
by a sparse multinomial logistic regression over hashed word n-grams (one and
two words): every sentence of every line, and every sentence that is wrapped
over several lines as a whole, so that a paragraph can name several licences
and a notice may be wrapped at any width, with comment signs before its lines.
A statement of more than ``WINDOW`` words is read in windows that overlap by
half.  The model knows the licence families below and an unknown class; its
probabilities are calibrated by a temperature on variants it was not trained
on, and a family below ``SURE`` becomes unknown.  Statements without a key word
are passed over: the key words are all words of the templates but ``GLUE``,
n-grams of glue alone have no weight, and without a weight the unknown class is
the likeliest.  A predicted family is confirmed if the statement holds enough of
the word pairs of one of its templates.

Scanning uses DataFrame functions only.  The model is trained in numpy on the
driver from the templates and a bounded sample of the corpus' own paragraphs:
variants of a template (words left out, other text around it) are its family;
plain paragraphs, with or without a statement's words, and templates with half of their
words replaced are unknown.  Only n-grams of templates have weights, so text
around a licence line does not count against it.

Defined results: null and empty texts have no paragraph; a paragraph of any
length is read whole; a wrapped sentence is reported beside those of its lines
that have a key word; repeated rows and repeated paragraphs are reported each;
an empty table gives an empty result and is no obstacle to training; a null id
is reported with its null; other columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

# Fixed texts: statements by which works name their licence.
TEMPLATES = {
    "All-Rights-Reserved": [
        "All rights reserved.",
        "This work is proprietary and confidential; all rights are reserved by the copyright holder.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": [
        "CC0 1.0",
        "CC0 1.0 Universal Public Domain Dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it under the terms of the GNU General Public License version 2.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
}
# Identifiers of the families in one-line headers.
for _family, _ids in {"Apache-2.0": ["Apache-2.0"], "BSD-3-Clause": ["BSD-3-Clause"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
                      "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC0-1.0": ["CC0-1.0"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later"],
                      "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later"], "MIT": ["MIT"]}.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {i}" for i in _ids]
UNKNOWN = "unknown"
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
# Words that say nothing about a licence; n-grams of nothing else have no weight.
GLUE = frozenset("""
    2 3 4 a above agreed all an and any are as basis binary by can charge conditions either except extent file files
    following for form forms from has holder in included is it its kind later law may met name names neither nor not of
    on only or other person possible prior program related required shall source specific terms that the this to under
    unless use used with without work writing written you
""".split())
# Texts that state rights; the plain paragraphs learned from have none of them.
STATED = r"licen[cs]e|redistribut|copyright|permission is hereby|\bspdx\b|creative commons|rights reserved|\bcc0\b|public domain|provided \W?as is"
BUCKETS = 1 << 20
SAMPLE_DOCS = 300  # documents whose paragraphs teach the unknown class, about
SAMPLE_CHARS = 2000  # of these, longer paragraphs are passed over
VARIANTS = 60  # of each template
SURE = 0.5
SIMILAR = 0.8  # share of a template's word pairs
WINDOW = 128  # words of a statement read at once
# Boundaries: of paragraphs, of sentences in them, and of sentences or lines.
BLANK = r"\n[^\p{L}\p{N}]*\n"
SENTENCE = r"(?<=[.!?])\s+"
FRAGMENT = r"\n|(?<=[.!?])\s+"


PIECES = "array<struct<paragraph: bigint, statement: bigint, wrapped: boolean, line: string>>"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def grams(words: list[str]) -> set[str]:
    return set(words) | pairs_of(words)


KEYWORDS = sorted({w for texts in TEMPLATES.values() for t in texts for w in tokens(t)} - GLUE)
# for lower-cased lines: every word that the model can weigh is among these
KEY = rf"(?i){STATED}|(?<![a-z0-9])(?:{'|'.join(map(re.escape, KEYWORDS))})(?![a-z0-9])"


def weighable(gram: str) -> bool:
    return not GLUE.issuperset(gram.split())


def bucket(gram: str) -> int:
    """As the scan computes it: xxhash64 of the text, modulo the buckets."""
    return xxhash.xxh64_intdigest(gram.encode(), 42) % BUCKETS


def variants(plain: list[str], seed: int) -> list[tuple[list[str], str]]:
    """Training paragraphs as words, with their class."""
    rng = random.Random(seed)
    pool = [w for p in plain for w in tokens(p)] or ["text"]

    def around(words):
        return rng.choices(pool, k=rng.randrange(0, 25)) + words + rng.choices(pool, k=rng.randrange(0, 25))
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = tokens(text)
            out.append((words, family))
            for _ in range(VARIANTS):
                left = rng.choice([0, 0, 0.1, 0.2])
                out.append((around([w for w in words if rng.random() >= left]), family))
                half = [w if rng.random() < 0.5 else rng.choice(pool) for w in words]
                half = rng.sample(half, len(half))
                if len(pairs_of(words) & pairs_of(half)) < SIMILAR * len(pairs_of(words)):  # a short text may come out whole
                    out.append((around(half), UNKNOWN))
    for p in plain:
        out.append((tokens(p), UNKNOWN))
        out.append((around([rng.choice(["license", "licence", "licensed", "copyright", "permission", "released under", "version"])]), UNKNOWN))
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(plain: list[str], seed: int = 1, steps: int = 400, rate: float = 0.5, sparse: float = 2e-4):
    """(classes, {bucket: weights}, constants, temperature)."""
    classes = [*sorted(TEMPLATES), UNKNOWN]
    known = sorted({bucket(g) for texts in TEMPLATES.values() for t in texts for g in grams(tokens(t)) if weighable(g)})
    column = {b: i for i, b in enumerate(known)}
    rows = variants(plain, seed)
    random.Random(seed).shuffle(rows)
    x = np.zeros((len(rows), len(known)))
    for i, (words, _) in enumerate(rows):
        x[i, [column[b] for b in map(bucket, grams(words)) if b in column]] = 1
    y = np.array([classes.index(c) for _, c in rows])
    back = len(rows) // 4  # held back to calibrate
    # equal rows count together
    xt, at = np.unique(np.hstack([x[back:], y[back:, None]]), axis=0, return_counts=True)
    xt, onehot, at = xt[:, :-1], np.eye(len(classes))[xt[:, -1].astype(int)], at[:, None] / (len(y) - back)
    w, c = np.zeros((len(known), len(classes))), np.zeros(len(classes))
    for _ in range(steps):
        d = (softmax(xt @ w + c) - onehot) * at
        w -= rate * 8 * xt.T @ d
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)  # most weights end at zero
        c -= rate * d.sum(axis=0)
    c[-1] = c.max()  # a paragraph without a weight is unknown
    logits = x[:back] @ w + c
    grid = np.exp(np.linspace(-2, 2, 41))
    loss = [-np.log(softmax(logits / t)[np.arange(back), y[:back]] + 1e-12).mean() for t in grid]
    return classes, {b: w[i] for i, b in enumerate(known) if np.any(w[i])}, c, float(grid[int(np.argmin(loss))])


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, statement, wrapped, line): the statements with a key
    word, which are all that can have a weight; only those become rows.
    ``line`` is a statement's text, ``statement`` its place in the paragraph
    among those of its kind (wrapped over lines, or inside one)."""
    def pieces(paragraph: Column, i: Column) -> Column:
        def numbered(pattern: str, wrapped: bool) -> Column:
            return F.transform(F.split(paragraph, pattern, -1), lambda x, k: F.struct(
                i.cast("long").alias("paragraph"), k.cast("long").alias("statement"), F.lit(wrapped).alias("wrapped"), x.alias("line")))
        whole = F.when(paragraph.contains("\n"), F.filter(numbered(SENTENCE, True), lambda x: x.line.contains("\n")))
        return F.concat(numbered(FRAGMENT, False), F.coalesce(whole, F.array().cast(PIECES)))
    keyed = F.transform(F.split(F.col(text_col), BLANK, -1), lambda x, i: F.when(F.lower(x).rlike(KEY), pieces(x, i)))
    found = F.filter(F.flatten(F.filter(keyed, lambda x: x.isNotNull())), lambda x: F.lower(x.line).rlike(KEY))
    return (docs.where(F.lower(F.col(text_col)).rlike(KEY)).select(F.col(id_col).alias("doc_id"), F.explode(found).alias("p"))
            .select("doc_id", "p.paragraph", "p.statement", "p.wrapped", "p.line"))


def plain_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Paragraphs that state nothing about rights, of about SAMPLE_DOCS documents."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= 10 * SAMPLE_CHARS)
    line = hashed_sample(src, "id", SAMPLE_DOCS).select("id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    line = line.where(~F.lower("line").rlike(STATED) & (F.length("line") <= SAMPLE_CHARS) & F.col("line").rlike("[A-Za-z0-9]"))
    return [r.line for r in sorted(line.collect(), key=lambda r: (str(r.id), r.i))]


def _logit(k: int, constant: float, temperature: float) -> Column:
    """Of class ``k``: its constant and the weights of the paragraph's buckets."""
    return F.aggregate("hits", F.lit(constant), lambda total, w: total + F.element_at(w, k + 1)) / temperature


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """A row per statement with a key word: doc_id, paragraph and statement
    (places in the text and the paragraph), wrapped, window (first word),
    family, probability, template_similarity, confirmed."""
    classes, weights, constants, temperature = model or train(plain_paragraphs(docs, id_col, text_col))
    place = ["doc_id", "paragraph", "statement", "wrapped", "window"]
    words = F.regexp_extract_all(F.lower("line"), F.lit(TOKEN), F.lit(0))
    p = paragraphs(docs, id_col, text_col).withColumn("words", words).drop("line")
    last = F.greatest(F.size("words") - WINDOW // 2, F.lit(1))  # a window that starts later would add nothing
    p = p.withColumn("window", F.explode(F.sequence(F.lit(1), last, F.lit(WINDOW // 2))))
    p = p.withColumn("one", F.size("words") <= WINDOW).withColumn("words", F.slice("words", F.col("window"), F.lit(WINDOW)))
    n = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), n), F.slice("words", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    p = p.select(*place, "one", "words", F.array_distinct(pairs).alias("pairs"))
    # the model's few hundred rows as a constant map: bucket -> weights, read for the buckets that it has only
    rows = sorted(weights.items())
    known = F.map_from_arrays(F.array(*(F.lit(b) for b, _ in rows)), F.array(*(F.array(*(F.lit(float(v)) for v in w)) for _, w in rows)))
    hashed = F.transform(F.array_union("words", "pairs"), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))
    hashed = F.filter(hashed, lambda b: b.isin([b for b, _ in rows])) if rows else F.array().cast("array<int>")
    hits = p.select(*place, "one", "pairs", F.array_distinct(hashed).alias("buckets"))
    hits = hits.where(F.col("one") | (F.size("buckets") > 0))  # of a long statement, the windows with a weight
    hits = hits.withColumn("hits", F.transform("buckets", lambda b: F.element_at(known, b))).drop("buckets", "one")
    logits = [_logit(k, float(c), temperature) for k, c in enumerate(constants)]
    scored = hits.select(*place, "pairs", F.array(*logits).alias("logits"))
    top = F.array_max("logits")
    total = F.aggregate(F.transform("logits", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda s, x: s + x)
    best = F.element_at(F.array(*map(F.lit, classes)), F.array_position("logits", F.col("top")).cast("int"))
    scored = scored.withColumn("top", top).withColumn("probability", 1 / total).withColumn("guess", best)
    family = F.when(F.col("probability") >= SURE, F.col("guess")).otherwise(F.lit(UNKNOWN))
    likeness = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        shares = []
        for t in texts:
            own = sorted({f"{a} {b}" for a, b in zip(tokens(t), tokens(t)[1:])})
            shares.append(F.size(F.array_intersect("pairs", F.array(*map(F.lit, own)))) / F.lit(len(own)))
        likeness = F.when(F.col("family") == name, F.greatest(*shares)).otherwise(likeness)
    return (scored.withColumn("family", family).withColumn("template_similarity", likeness)
            .select(*place, "family", "probability", "template_similarity",
                    ((F.col("family") != UNKNOWN) & (F.col("template_similarity") >= SIMILAR)).alias("confirmed")))
