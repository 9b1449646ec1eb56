"""Language and toxicity: held-out accuracy and odd rows."""

import math
import random

import numpy as np
import pytest

from lumenframe.llm import language_id, toxicity

LANGS = {"en": ["the", "and", "with", "house", "think", "water"], "de": ["der", "und", "nicht", "haus", "denken", "wasser"], "fr": ["le", "et", "avec", "maison", "penser", "eau"]}


def corpus(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        words = [rng.choice(LANGS[lang]) for _ in range(rng.randint(3, 40))]
        bad = rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "nastything"]))
        rows.append((i, " ".join(words), lang, int(bad)))
    return rows


def test_language(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.langs == ["de", "en", "fr"]
    odd = [(9001, None, "en"), (9002, "", "en"), (9003, "12 34 !? ½ ² ① Ⅳ _", "en"), (9004, "x" * 200_000, None), (None, "the and with", None)]
    out = language_id.predict(spark.createDataFrame([*[r[:3] for r in rows], *odd], docs.schema), model).collect()
    truth = {r[0]: r[2] for r in rows}
    from zlib import crc32

    held = [r for r in out if r["doc_id"] in truth and crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9001]["score"] == 0
    assert by[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in out)
    assert (model.weights == 0).mean() > 0.5  # the penalties leave most weights at 0


def test_language_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in language_id.predict(docs, language_id.train(docs)).collect()] == [("und", 0.0)]
    assert language_id.predict(docs.where("false"), language_id.train(docs.where("false"))).count() == 0


def test_only_rows_outside_the_held_out_fifth_are_learned(spark):
    from zlib import crc32

    rows = [(i, "zz yy", "held" if crc32(str(i).encode()) % 5 == 0 else "seen") for i in range(60)]
    assert language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["seen"]


def test_toxicity(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(7777, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(9001, None, None), (9002, "", None), (9003, "the nastyword", None)], docs.schema)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs.unionByName(odd), model).collect()}
    from zlib import crc32

    held = [r for r in rows if crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((out[r[0]] >= 0.5) == bool(r[3]) for r in held) / len(held) > 0.97
    assert out[9001] == out[9002] < 0.5 < out[9003]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).first()["toxicity"] < 1e-9


def test_more_languages_than_fit_are_an_error_and_none_is_left_out(spark):
    rows = [(i, f"word{i % 9} text", f"l{i % 9}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        language_id.train(docs, max_langs=8)
    assert len(language_id.train(docs, max_langs=9).langs) == 9


def test_rows_that_repeat_are_learned_from_once(spark):
    rows = [(1, "the and with", "en")] * 500 + [(i, "der und nicht", "de") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = language_id.learnable(docs, "doc_id", "text", "lang")
    sample = language_id.bounded_sample(usable, 600, 10, 6000).collect()
    assert sum(r["label"] == "en" for r in sample) <= 1 and sum(r["label"] == "de" for r in sample) > 20


def test_weights_are_those_of_a_dense_ftrl():
    rng = np.random.default_rng(4)
    n = 40
    rows = []
    for i in range(60):
        at = np.sort(rng.choice(n, 6, replace=False))
        rows.append(("ab"[int(at[0] < 4)], at, rng.integers(1, 4, 6)))
    idf = rng.uniform(1, 3, n)
    model = language_id.fit(rows, idf)
    # the same, one coordinate and one row at a time
    langs = sorted({r[0] for r in rows})
    z, g2 = [[0.0] * 2 for _ in range(n + 1)], [[0.0] * 2 for _ in range(n + 1)]

    def weight(j, k):
        if abs(z[j][k]) <= language_id.L1:
            return 0.0
        return -(z[j][k] - math.copysign(language_id.L1, z[j][k])) / ((language_id.BETA + math.sqrt(g2[j][k])) / language_id.ALPHA + language_id.L2)

    train = [r for i, r in enumerate(rows) if i % 5]
    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(train)):
            lang, at, tf = train[i]
            x = {int(j): (1 + math.log(t)) * idf[j] for j, t in zip(at, tf, strict=True)}
            norm = math.sqrt(sum(v * v for v in x.values()))
            x = {j: v / norm for j, v in x.items()} | {n: 1.0}
            w = {j: [weight(j, k) for k in range(2)] for j in x}
            e = [math.exp(sum(v * w[j][k] for j, v in x.items())) for k in range(2)]
            for k in range(2):
                p = e[k] / sum(e) - (langs[k] == lang)
                for j, v in x.items():
                    g = v * p
                    z[j][k] += g - (math.sqrt(g2[j][k] + g * g) - math.sqrt(g2[j][k])) / language_id.ALPHA * w[j][k]
                    g2[j][k] += g * g
    dense = np.array([[weight(j, k) for k in range(2)] for j in range(n + 1)])
    assert np.allclose(model.weights, dense[:-1], atol=1e-5) and np.allclose(model.bias, dense[-1], atol=1e-8)


def test_ratios_are_those_of_plain_counts(spark):
    rows = corpus(200)
    texts = spark.createDataFrame([(r[3], r[1]) for r in rows], "label int, text string")
    got, counts = toxicity.ratios(texts)
    grams = lambda t: {int(g) for a in toxicity.gram_ids(toxicity.codes(t), toxicity.GRAMS, toxicity.BITS) for g in a}
    n, total = {}, [0, 0]
    for _, text, _, label in rows:
        total[label] += 1
        for g in grams(text):
            n.setdefault(g, [0, 0])[label] += 1
    assert counts == {0: total[0], 1: total[1]}
    ratio = lambda g: math.log((n[g][1] + 0.5) / (total[1] + 1) / ((n[g][0] + 0.5) / (total[0] + 1)))
    assert len(got) > 100 and all(r == pytest.approx(ratio(g)) for g, r in got)
    assert {g for g, _ in got} == {g for g in n if sum(n[g]) >= toxicity.LEAST_TEXTS}


def test_clashing_columns_give_way_and_others_stay(spark):
    docs = spark.createDataFrame([r[:3] for r in corpus(60)], "doc_id long, text string, lang string").selectExpr("*", "'x' AS Score", "'x' AS lang_pred", "'x' AS toxicity", "'kept' AS `a.b`")
    out = language_id.predict(docs, language_id.train(docs))
    assert out.columns == ["doc_id", "text", "lang", "toxicity", "a.b", "lang_pred", "score"] and out.first()["a.b"] == "kept"
    out = toxicity.score(docs, toxicity.Model())
    assert out.columns.count("toxicity") == 1 and out.first()["toxicity"] < 0.5


def test_toxic_words_outside_the_sample_are_features(spark):
    # of 600 toxic texts 40 hold a word of their own; the sample of 30 rows holds few of them
    rows = [(i, "the nastyword house" if i % 15 else "the vilething house", 1) for i in range(600)] + [(i, "the quiet house with water", 0) for i in range(600, 1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, per_label=30)
    assert len(model.present("vilething")) > 5
