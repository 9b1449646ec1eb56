"""Models of language and toxicity come from all rows that may be learned from, however many there are."""

import random
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F
from test_classifiers import LANGS

from lumenframe.llm import chargrams, common, language_evidence, language_id, toxicity

STRANGE = ["kwzqk", "jjxvj", "qpkzw"]


def words(rng, lang):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(3, 12)))


def late(spark, rows, above):
    """Of rows (id, text) those that may be learned from and whose hash is above a bound: samples by least hash leave them out."""
    found = spark.createDataFrame(rows, "id long, text string").where(~common.held_out("id")).withColumn("u", common.unit_hash("id", "text", seed=11))
    return [(r["id"], r["text"]) for r in found.where(F.col("u") > above).collect()]


def corpus(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, lang), lang) for i in range(3600) for lang in [("de", "en", "fr")[i % 3]]]
    strange = [(10_000 + i, " ".join(rng.choice(STRANGE) for _ in range(8))) for i in range(400)]
    return rows + [(i, t, "en") for i, t in late(spark, strange, 0.8)]


def test_language_weights_and_shares_come_from_all_rows(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = chargrams.bounded_sample(language_id.learnable(docs, "doc_id", "text", "lang"), 600, 10, 6000)
    assert sample.where("id >= 10000").count() == 0 < sum(r[0] >= 10_000 for r in rows)
    model = language_id.train(docs)
    at, _ = language_id.counts_of(" ".join(STRANGE))
    assert (model.weights[at] != 0).any(1).mean() > 0.8
    assert all(model.predict(w)[0] == "en" for w in STRANGE)
    evidence = language_evidence.train(docs)
    assert evidence.weights[language_evidence.trigrams(STRANGE[0])].min() > evidence.weights.min() + 1


def test_shares_and_floors_are_those_of_plain_counts(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_evidence.train(docs)
    found = chargrams.hashed(language_id.learnable(docs, "doc_id", "text", "lang"))
    counts = chargrams.different(found, 10)
    split = chargrams.with_held(found, counts).collect()
    assert sum(counts.values()) == len(split) == sum(crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    weights = np.full(1 << language_evidence.BITS, -np.inf)
    for lang in LANGS:
        df, n = np.zeros(len(weights)), 0
        for r in split:
            if r["label"] == lang and not r["_held"]:
                df[np.unique(language_evidence.trigrams(r["text"]))] += 1
                n += 1
        assert 0.7 < n / counts[lang] < 0.9
        weights = np.maximum(weights, np.log((df + 0.5) / (n + 1.0)))
    assert np.allclose(got.weights, weights, atol=1e-5)
    floors = []
    for lang in LANGS:
        texts = [r["text"] for r in split if r["label"] == lang and r["_held"]]
        own = [weights[language_evidence.trigrams(t)] for t in texts]
        means = np.array([w.mean() for w in own])
        noise = np.median([weights[language_evidence.shuffled(t)].mean() for t in texts])
        floors.append((np.median(means), noise, (1.4826 * np.median(np.abs(means - np.median(means)))) ** 2, np.median([w.var() for w in own])))
    assert np.allclose(sorted(got.floors), sorted(floors), atol=1e-3)


def test_toxicity_weights_come_from_all_rows(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, "en") + (" nastyword" if i % 2 else ""), i % 2) for i in range(14_000)]
    vile = late(spark, [(20_000 + i, words(rng, "en") + " vilething") for i in range(1500)], 0.8)
    rows += [(i, t, 1) for i, t in vile]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    texts = docs.join(labels, "doc_id").where(~common.held_out()).selectExpr("doc_id AS id", "toxic AS label", "text")
    assert len(vile) > 100 and chargrams.bounded_sample(texts, 4000, 2, 8000).where("text LIKE '%vilething%'").count() == 0
    model = toxicity.train(docs, labels)
    assert model.score("the house and vilething") > 0.5 > model.score("the house and water")


def test_models_of_many_shards_depend_on_the_rows_alone(spark, monkeypatch):
    for module in (language_id, toxicity):
        monkeypatch.setattr(module, "SHARD_ROWS", 100)
    monkeypatch.setattr(language_id, "LEAST_PER_LANG", 20)
    monkeypatch.setattr(toxicity, "LEAST_PER_LABEL", 20)
    rng = random.Random(6)
    rows = [(i, words(rng, lang) + (" nastyword" if i % 7 == 0 else ""), lang, int(i % 7 == 0)) for i in range(1500) for lang in ["fr" if i % 60 == 0 else ("de", "en")[i % 2]]]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    one, other = language_id.train(docs.coalesce(1)), language_id.train(docs.orderBy("lang").repartition(7))
    assert (one.weights == other.weights).all() and (one.bias == other.bias).all() and one.temperature == other.temperature
    assert sum(one.predict(r[1])[0] == r[2] for r in rows) / len(rows) > 0.98
    bad, same = toxicity.train(docs.coalesce(1), labels), toxicity.train(docs.repartition(7), labels)
    assert (bad.weights == same.weights).all() and bad.bias == same.bias
    assert all((bad.score(r[1]) >= 0.5) == bool(r[3]) for r in rows)


def test_shards_hold_all_rows_and_every_label(spark):
    rows = [(i, "big" if i % 50 else "rare", f"text {i}") for i in range(2000)] + [(1, "big", "text 1")] * 5
    found = chargrams.hashed(spark.createDataFrame(rows, "id long, label string, text string"))
    counts = chargrams.different(found, 2)
    assert counts == {"big": 1960, "rare": 40}
    dealt = chargrams.dealt(found, counts, 200, 10).collect()
    assert {(r["id"], r["label"]) for r in dealt} == {(i, label) for i, label, _ in rows}
    shards = {r["_shard"] for r in dealt}
    assert len(shards) == 10
    rare = [len({r["id"] for r in dealt if r["_shard"] == s and r["label"] == "rare"}) for s in shards]
    assert min(rare) >= 4 and sum(r["label"] == "big" for r in dealt) == 1965
