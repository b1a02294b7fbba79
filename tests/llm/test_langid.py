import random

import numpy as np
from pyspark.sql import types as T

from perilframe.llm import langid

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_pred", T.StringType())])
SYLLABLES = {"aa": "the and ing tion of her wh", "bb": "der die ung sch ein ich zu", "cc": "que les eux oui ment là é", "dd": "ción los ñez rr ado en ll", "ee": "ście prz owa nie się do w", "ff": "och att för en inte är på"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, None, None) for i, t, x in rows], SCHEMA)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 20):
        c = langid.codes(n)
        d = (c[:, None] != c[None]).sum(axis=2) + 99 * np.eye(n, dtype=int)
        assert c.shape[0] == n and d.min() >= (1 if n == 2 else 2) and all(0 < (c[:, b] > 0).sum() < n for b in range(c.shape[1]))
    assert langid.codes(4).shape == (4, 7)


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, x, rng.randint(3, 80)), x) for i in range(500) for x in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", None), (1003, prose(rng, "bb", 30), None), (1003, prose(rng, "bb", 30), None), (None, prose(rng, "aa", 20), "aa"), (1004, "the " * 200_000, "aa")]
    docs = frame(spark, rows)
    docs = docs.select("doc_id", "text", "lang", "score", "lang_pred")
    out = langid.identify(docs.select("doc_id", "text", "lang")).collect()
    assert len(out) == len(rows)
    truth = {i: x for i, _, x in rows}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert len(held) > 60 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb" and by[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out) and by[None].held_out is False


def test_clashing_columns_and_edges(spark):
    rows = [(1, "abc", "aa"), (2, "xyz", "bb"), (3, "abc abc", "aa"), (4, "xyz xyz", "bb")] * 3
    assert langid.identify(frame(spark, rows)).count() == 12
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(frame(spark, [(i, "abc", "aa") for i in range(9)])).collect()} == {"aa"}


def test_no_letters_in_any_plane_and_clashing_names(spark):
    model = langid.train(frame(spark, [(i, "abc" if i % 2 else "xyz", "aa" if i % 2 else "bb") for i in range(20)]))
    rows = [(1, "\U0001f600 \U0001f680!", None), (2, "\U00010400\U00010401 abc", None), (3, "12 \u2014 34", None)]
    out = langid.predict(frame(spark, rows), model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "ambiguous"]
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "und", 2: "aa", 3: "und"}


def test_more_languages_than_64(spark):
    names = [f"l{i:02d}" for i in range(70)]
    rows = [(i, " ".join(chr(0x4E00 + 40 * k + j) * 2 for j in range(20)), names[k]) for i in range(700) for k in [i % 70]]
    out = [r for r in langid.identify(frame(spark, rows)).collect() if r.held_out]
    assert len({r.lang_pred for r in out}) > 60 and np.mean([r.lang_pred == names[r.doc_id % 70] for r in out]) > 0.99


def test_sample_is_bounded_and_decoding_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, x, 20), x) for i in range(400) for x in ["aa" if i % 4 else "bb"]]
    model = langid.train(frame(spark, rows), sample=30)
    texts = [t for _, t, _ in rows[:40]]
    margins, _ = model.margins(texts)
    for text, m, best in zip(texts, margins, model.decode(margins)[0]):
        p, total, n = langid.points(text), 0, 0
        for _, g in langid.grams(p):
            for bucket in g.tolist():
                total, n = total + model.weights[bucket].astype(float), n + 1
        assert np.allclose(total / n / model.scale, m)
        losses = [sum(w * np.log1p(np.exp(-c * x * 4)) for w, c, x in zip(trust, code, m)) for trust, code in zip(model.trust, model.code)]
        assert int(np.argmin(losses)) == best
