"""What the pipeline's language stage rejects, with few and with more learned languages."""

import random

import corpus_pipeline as p
import pytest
from test_classifiers import LANGS
from test_pipeline import SCHEMA

MORE = {**LANGS, "es": ["el", "y", "con", "casa", "pensar", "agua"]}
OUT = {
    9001: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    9002: "Все люди рождаются свободными и равными в своем достоинстве и правах",
    9003: "xqj zkvw qpxz jjgk wvvq bzkx pqfj zzxk vqwj kxqz jqpv",
    9004: None,
    9005: "12 34 !?",
}


@pytest.mark.parametrize("k", [1, 2, 4])
def test_unlearned_languages_and_noise_go(spark, k):
    rng, langs = random.Random(k), dict(list(MORE.items())[:k])
    rows = []
    for i in range(400):
        lang = rng.choice(list(langs))
        rows.append((i, " ".join(rng.choice(langs[lang]) for _ in range(rng.randint(3, 60))), lang, "a", 1))
    mixed = [(5000 + i, " ".join(rng.choice(rng.choice(list(langs.values()))) for _ in range(40)), None, "a", 1) for i in range(20)]
    out = [(i, t, None, "a", 1) for i, t in OUT.items()]
    docs = spark.createDataFrame([*rows, *mixed, *out], SCHEMA)
    kept = {r["doc_id"] for r in p.stage_language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows} | {r[0] for r in mixed}
