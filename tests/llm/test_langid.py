"""Language identification: held-out accuracy, calibration and defined results."""
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from depotlens.llm import langid as L
from depotlens.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, SF_MID, "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    assert got.count() == docs.count()


def test_only_text_decides(spark):
    """Other columns and the id never change a prediction, whole texts count."""
    docs = table(spark, SF_MID, "documents")
    model = L.learn(docs)
    texts = [r.text for r in docs.where("doc_id % 5 = 0 AND lang IN ('fr', 'de')").limit(6).collect()]
    rows = [(i, t, None, s, 0.5) for i, t in enumerate(texts) for s in ("a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    assert len({(r.lang_pred, r.score) for r in L.identify(df, model=model).collect()}) <= len(set(texts))
    long = spark.createDataFrame([(1, "the and of " + 4000 * texts[0])], "doc_id long, text string")
    assert L.identify(long, model=model).first().lang_pred in ("fr", "de")


def test_defined_results(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 +- \n", "fr"), (None, "é", None), (5, "the", "en"), (5, "the", "en"), (6, "chat", "fr"), (7, "!日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((tuple(r) for r in L.identify(df).collect()), key=str)
    und = {r[0] for r in got if r[2] == "und"}
    assert und == {1, 2, 3} and all(r[3] == 0 and r[4] for r in got if r[2] == "und")
    assert [r for r in got if r[0] == 5][0] == [r for r in got if r[0] == 5][1]
    assert L.identify(df.limit(0)).collect() == []
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}


def test_pieces_of_long_texts(monkeypatch):
    text = "The quick brown fox; l'été à Zürich. " * 300
    whole = L.counts(text)
    monkeypatch.setattr(L, "PIECE", 97)
    assert np.array_equal(L.counts(text), whole)


def test_calibration_fits_the_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 1, (4000, 3))
    p = L.softmax(logits)
    y = np.array([rng.choice(3, p=q) for q in p])
    model = L.LanguageModel(["a", "b", "c"], None, None, None, None)
    L.calibrate(model, logits * 4, y)  # four times too sure
    assert 3 < model.temperature < 5


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。"]


def test_unlearned_languages_are_rejected(spark):
    """Texts of five languages that no label names go, held-out documents of the learned ones stay."""
    docs = table(spark, SF_MID, "documents")
    model = L.learn(docs)
    assert np.isfinite(model.reject_above)
    foreign = spark.createDataFrame([(i, t + "\n" + t) for i, t in enumerate(FOREIGN)], "doc_id long, text string")
    assert all(r.rejected for r in L.identify(foreign, model=model).collect())
    held = L.identify(docs, model=model).where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r.rejected for r in held) <= 0.005 * len(held)


def test_a_left_out_language_is_rejected(spark):
    """Without the labels of one language of the data, most of its documents go and the others stay."""
    docs = table(spark, SF_MID, "documents")
    model = L.learn(docs.where("lang <> 'de'"))
    got = L.identify(docs, model=model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL").collect()
    left, rest = [r.rejected for r in got if r.lang == "de"], [r.rejected for r in got if r.lang != "de"]
    assert sum(left) >= 0.8 * len(left) and sum(rest) <= 0.01 * len(rest)


def test_one_language_or_inseparable_ones_reject_nothing():
    rng = np.random.default_rng(3)
    docs = [(np.unique(rng.integers(0, L.BUCKETS, 50)), None) for _ in range(80)]
    docs = [(hit, np.ones(len(hit), np.int32)) for hit, _ in docs]
    assert L.train(docs, ["en"] * 80, steps=5).reject_above == np.inf
    assert L.train(docs, ["en", "fr"] * 40, steps=5).reject_above == np.inf  # the same noise in both


def test_rows_equal_a_plain_scorer(spark):
    """Each row against the learned model, one n-gram after the other in plain Python."""
    docs = table(spark, SF_SMALL, "documents").where("text IS NOT NULL")
    model = L.learn(docs)
    got = {r.doc_id: r for r in L.identify(docs, model=model).collect()}
    logit, bits = model.embedding @ model.layer, L.BUCKETS.bit_length() - 1
    for r in docs.select("doc_id", "text").collect():
        if not any(c.isalpha() for c in r.text):
            assert got[r.doc_id].lang_pred == "und"
            continue
        folded = bytearray(b" ")
        for b in r.text.lower().encode():
            b = b if b >= 0x80 or chr(b).isalpha() else 0x20
            if b != 0x20 or folded[-1] != 0x20:
                folded.append(b)
        if r.text[0].isascii() and not r.text[0].isalpha():
            folded.insert(0, 0x20)  # the gap that the text begins with
        folded.append(0x20)
        count = Counter()
        for n in L.GRAMS:
            for i in range(len(folded) - n + 1):
                value = 0
                for b in folded[i:i + n]:
                    value = (value * 257 + b) % 2**32
                count[((value + n) * 2654435761 % 2**32) >> (32 - bits)] += 1
        total = sum(count.values())
        x = sum(logit[k] * (c / total) for k, c in count.items()) + model.bias
        p = L.softmax(x / model.temperature)
        surprise = min(sum(model.surprisal[k] * (c / total) for k, c in count.items()))
        row = got[r.doc_id]
        assert row.lang_pred == model.languages[int(p.argmax())] and abs(row.score - p.max()) < 1e-9
        drawn = (total * surprise + L.PRIOR * model.usual) / (total + L.PRIOR)
        assert row.rejected == (drawn > model.reject_above) or abs(drawn - model.reject_above) < 1e-9
