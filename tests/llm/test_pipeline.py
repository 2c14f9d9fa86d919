"""The pipeline's stages against plain Python."""
import pytest
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from conftest import SF_SMALL
from depotlens.llm import bpe, langid
from depotlens.llm.common import table
from test_dedup import brute_components, brute_fp
from test_mixing import brute, u


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF_SMALL, "documents"), []
    for _, stage in C.STAGES:
        after = stage(spark, docs, SF_SMALL).cache()
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    assert all(b.columns == a.columns for a, b in stages[:-1])


def test_language(stages):
    docs, after = stages[0]
    rejected = langid.identify(docs).where("rejected").count()
    assert after.count() == docs.count() - rejected and rejected <= 2


def test_exact(stages):
    docs, after = stages[1]
    last = {}
    for r in docs.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert ids(after) == sorted(last.values())


def test_near(stages):
    docs, after = stages[2]
    rows = docs.collect()
    comp = brute_components([r.doc_id for r in rows], [brute_fp(r.text, 3) for r in rows], 2)
    assert ids(after) == sorted(set(comp))


def test_mix(stages):
    docs, after = stages[3]
    rows = [(r.doc_id, r.text, r.source, 1.0) for r in docs.collect()]
    want = [i for i, size, _, _, taken in brute(rows) for _ in range(taken // size if size else 0)]
    sized = [i for i in ids(after) if i in {r[0] for r in rows}]
    assert sized == sorted(want) and u(1, "a", 0) != u(2, "a", 0)


def test_encode(stages):
    docs, after = stages[4]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    want = sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in docs.collect())
    assert sorted((r.doc_id, r.token_ids) for r in after.collect()) == want
    assert "text" not in after.columns and "source" in after.columns


def test_odd_rows(spark):
    """Nulls, repeated rows, clashing names and an empty table run through every stage."""
    rows = [(None, None, None, None, None, 1), (None, "null id", "en", None, 1, 1), (1, "the cat", "en", "a", 7, 1), (1, "the cat", "en", "a", 7, 1),
            (2, "the cat", None, "b", 7, 1), (3, "", "fr", "b", 0, 1), (4, "le chat " * 50000, "fr", "b", 0, 1), (5, "le chat noir", "fr", "a", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int")
    for part in (df, df.limit(0)):
        docs = part
        for _, stage in C.STAGES:
            docs = C.written(stage(spark, docs, ""), "odd")
        assert {r.doc_id for r in docs.collect()} <= {None, 2, 4, 5}
        assert docs.columns[-4:] == ["token_ids", "n_tokens", "ids_sha256", "decoded_sha256"] and "copies" in docs.columns
    mid = C.one_of_equal_texts(spark, df, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in mid) == [(0, "null id"), (2, "the cat"), (3, ""), (4, "le chat " * 50000), (5, "le chat noir")]


def test_null_ids_do_not_shield_each_other(spark):
    """A third of the ids null: near copies go all the same, one of each group stays, and clean documents stay."""
    import random
    rnd = random.Random(5)
    rows, groups = [], {}
    for g in range(60):
        base = [f"w{rnd.randrange(4000)}" for _ in range(600)]
        for c in range(3 if g % 2 else 1):
            text = " ".join(base + [f"tail{c}"])
            rows.append((None if (g + c) % 3 == 0 else 1000 * g + c, text, "en", "s", 1))
            groups[text] = g
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __key int")
    comp = brute_components(list(range(len(rows))), [brute_fp(r[1], 3) for r in rows], 2)
    kept = C.one_of_near_texts(spark, df, "").collect()
    assert len(kept) == len(set(comp)) < len(rows)
    of = {r[1]: c for r, c in zip(rows, comp, strict=True)}
    assert len({of[r["text"]] for r in kept}) == len(kept)  # one of each component
    best = {}
    for (i, text, *_), c in zip(rows, comp, strict=True):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    assert all((r.doc_id is None, r.doc_id or 0) == best[of[r["text"]]] for r in kept)
    assert {r["__key"] for r in kept} == {1}


def test_nothing_is_lost_without_labels(spark):
    """Without a language to learn, or with long documents only, texts with letters stay."""
    rows = [(i, f"word{i} and more text " * 2000, None if i % 2 else "en") for i in range(20)] + [(90, None, None), (91, "12 34", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for docs in (df, df.selectExpr("doc_id", "text", "cast(null as string) lang")):
        assert ids(C.known_language(spark, docs, "")) == list(range(20))
    got = langid.identify(df).where("doc_id < 20").collect()
    assert {r.lang_pred for r in got} == {"en"}
