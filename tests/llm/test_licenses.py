"""Licence scan: the native scoring against plain Python, unseen variants, and defined results."""
import random
import re

import numpy as np
import pytest
import regex

from conftest import SF_MID
from depotlens.llm import licenses as L
from depotlens.llm.common import table


@pytest.fixture(scope="module")
def model(spark):
    return L.train(L.plain_paragraphs(table(spark, SF_MID, "documents")))


def statements(text):
    """(paragraph, statement, wrapped, line) of a text, without any filter."""
    for i, paragraph in enumerate(regex.split(r"\n[^\p{L}\p{N}]*\n", text or "")):
        for k, line in enumerate(regex.split(r"\n|(?<=[.!?])\s+", paragraph)):
            yield i, k, False, line
        for k, sentence in enumerate(regex.split(r"(?<=[.!?])\s+", paragraph)):
            if "\n" in sentence:
                yield i, k, True, sentence


def brute(rows, model):
    classes, weights, constants, temperature = model
    out = []
    for i, t in rows:
        for paragraph, k, wrapped, line in statements(t):
            if not re.search(L.KEY, line):
                continue
            every = L.tokens(line)
            for start in range(0, max(len(every) - L.WINDOW // 2, 1), L.WINDOW // 2):
                words = every[start:start + L.WINDOW]
                on = {L.bucket(g) for g in L.grams(words)} & set(weights)
                if len(every) > L.WINDOW and not on:
                    continue
                logits = np.array(constants) + sum((weights[b] for b in on), np.zeros(len(classes)))
                p = L.softmax(logits[None] / temperature)[0]
                family = classes[int(p.argmax())] if p.max() >= L.SURE else L.UNKNOWN
                pairs = set(zip(words, words[1:]))
                likeness = max((len(pairs & set(zip(w, w[1:]))) / len(set(zip(w, w[1:]))) for w in map(L.tokens, L.TEMPLATES.get(family, []))), default=0.0)
                out.append((i, paragraph, k, wrapped, start + 1, family, round(float(p.max()), 6), round(likeness, 6), family != L.UNKNOWN and likeness >= L.SIMILAR))
    return sorted(out, key=str)


def scan(spark, rows, model):
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, family string, paragraph int").repartition(3)
    return sorted(((*r[:6], round(r[6], 6), round(r[7], 6), r[8]) for r in L.license_scan(df, model=model).collect()), key=str)


def mixed(seed):
    rng = random.Random(seed)
    prose = "the night was long and the river ran below its banks while people slept".split()
    rows = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "\n\nlicense\nLICENSE"), (4, "we lost our driving licence today"),
            (5, "word " * 50000 + "Licensed under CC BY-NC 4.0."), (6, "MIT licence\nMIT licence"), (6, "MIT licence\nMIT licence"), (7, "© copyright 2020 ACME"),
            (8, "# Released under\n# the MIT License. Some parts\n#\n# Licensed under the\n * Apache License, Version 2.0!\n \n\n--\nend\n"),
            (9, "law " * 127 + "Released under the MIT License " + "word " * 300 + "license"), (10, "\n" * 50000 + "GPL" + " .\n" * 50000)]
    for i in range(120):
        t = rng.choice(rng.choice(list(L.TEMPLATES.values())))
        words = [w for w in t.split() if rng.random() > rng.choice([0, 0.3])]
        rows.append((100 + i, "\n".join([" ".join(rng.choices(prose, k=9)), " ".join(rng.choices(prose, k=5) + words + rng.choices(prose, k=8)), "end"])))
    return rows


def test_scan_equals_plain_python(spark, model):
    rows = mixed(1)
    assert scan(spark, rows, model) == brute(rows, model)
    assert scan(spark, [], model) == []


def test_every_template_is_confirmed(spark, model):
    rows = [(i, f"Intro line\nSome words before: {t.upper() if i % 2 else t} And after.\n") for i, t in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    families = [f for f, ts in L.TEMPLATES.items() for _ in ts]
    got = scan(spark, rows, model)
    for i, family in enumerate(families):
        assert {r[5] for r in got if r[0] == i and r[8]} == {family}, rows[i]


def test_unknown(spark, model):
    rows = [(1, "we lost our driving licence at the station"), (2, "Licensed premises, no minors"), (3, "a general license for public work under the version of events"),
            (4, "copyright 2019 by the authors"), (5, "the permission is hereby withdrawn")]
    assert not any(r[8] for r in scan(spark, rows, model))


def test_unseen_variants(model):
    """Accuracy on variants of another seed than the training's."""
    classes, weights, constants, _ = model
    rows = L.variants(["other prose that the model never saw", "und noch ein Satz"], seed=99)
    right = 0
    for words, y in rows:
        logits = np.array(constants) + sum((weights[b] for b in {L.bucket(g) for g in L.grams(words)} if b in weights), np.zeros(len(classes)))
        right += classes[int(logits.argmax())] == y
    assert right / len(rows) > 0.93


def test_weights_are_sparse_and_templates_have_keys(model):
    assert all(re.search(L.KEY, t) for ts in L.TEMPLATES.values() for t in ts)
    everything = np.array([w for w in model[1].values()])
    assert (everything == 0).mean() > 0.3


def test_given_documents(spark):
    docs = table(spark, SF_MID, "documents")
    got = L.license_scan(docs)
    place = ["doc_id", "paragraph", "statement", "wrapped"]
    short = L.paragraphs(docs).where(f"size(regexp_extract_all(lower(line), '{L.TOKEN}', 0)) <= {L.WINDOW}".replace("\\", "\\\\"))
    assert short.select(place).exceptAll(got.where("window = 1").select(place)).count() == 0 and got.where("confirmed").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


STATEMENTS = ["All rights reserved.", "ALL RIGHTS RESERVED", "CC0 1.0", "Released under the MIT", "the Apache, Version 2.0", "is provided under the GPL",
              "permission granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]


def test_every_line_the_model_weighs_has_a_row(spark, model):
    """Against a list of statements, and against scoring each line without any filter."""
    rows = [(i, f"and of the\n{t}\nend") for i, t in enumerate(STATEMENTS)]
    got = scan(spark, rows + mixed(1), model)
    lines = {r[:4]: r for r in got}
    first = [lines[i, 0, 1, False] for i in range(3)]
    assert [r[5] for r in first] == ["All-Rights-Reserved", "All-Rights-Reserved", "CC0-1.0"] and first[0][8] and first[1][8]
    classes, weights, constants, temperature = model
    assert int(np.argmax(constants)) == len(classes) - 1 or max(constants) == constants[-1]
    for i, t in rows + mixed(1):
        for *place, line in statements(t):
            if any(L.bucket(g) in weights for g in L.grams(L.tokens(line))):
                assert (i, *place) in lines, line


HEADERS = [
    ("MIT", "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal"),
    ("BSD-3-Clause", "# Redistribution and use in source and binary\n# forms, with or without modification, are permitted\n# provided that the following conditions\n# are met:"),
    ("GPL-3.0", " * This program is free software: you can redistribute it\n * under the terms of the GNU General Public\n * License version 3."),
    ("Apache-2.0", "// Licensed under the Apache\n// License, Version 2.0 (the \"License\"); you may not\n// use this file"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of\nits contributors may be used to endorse or promote products\nderived from this "
                     "software without specific prior written\npermission."),
    ("MIT", "The above copyright notice and this permission\nnotice shall be included in all copies or\nsubstantial portions of the Software."),
    ("Apache-2.0", "/* SPDX-License-Identifier: Apache-2.0 */"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later"), ("MIT", "# SPDX-License-Identifier: MIT"),
]


def test_wrapped_and_several(spark, model):
    """Notices wrapped at any width, and two licences in one paragraph."""
    rows = [(i, f"Some title\n\n{t}\n\nand prose follows\nhere") for i, (_, t) in enumerate(HEADERS)]
    two = "Released under the MIT License. Portions licensed under the Apache License, Version 2.0."
    rows += [(100, two), (101, two.replace("License", "\nLicense"))]
    got = scan(spark, rows, model)
    for i, (family, t) in enumerate(HEADERS):
        assert {r[5] for r in got if r[0] == i and r[8]} == {family}, t
    for i in (100, 101):
        assert {r[5] for r in got if r[0] == i and r[8]} == {"MIT", "Apache-2.0"}


def test_statements_of_the_given_tables(spark):
    """Each whole-line statement in the table, listed without KEY, has a row."""
    named = {"all rights reserved.", "released under the mit license.", "licensed under cc by-nc 4.0.", "licensed under the apache license, version 2.0.",
             "this work is licensed under the gnu general public license, version 3."}
    docs = table(spark, SF_MID, "documents")
    listed = {(r.doc_id, i, k) for r in docs.collect() for i, k, wrapped, line in statements(r.text) if not wrapped and line.strip().lower() in named}
    got = {(r.doc_id, r.paragraph, r.statement) for r in L.license_scan(docs).where("confirmed AND NOT wrapped").collect()}
    assert listed and listed <= got
