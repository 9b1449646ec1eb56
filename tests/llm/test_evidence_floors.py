"""Floors of the language evidence are made of all characters of all held-out rows."""

import numpy as np
import pytest

from lumenframe.llm import language_evidence as le


@pytest.fixture(scope="module")
def weights():
    return np.random.default_rng(1).normal(-5, 1, 1 << le.BITS).astype(np.float32)


def test_noise_is_of_whole_texts(spark, weights):
    text = "abcd " * 1000 + "wxyz uvst " * 1000
    ((own, noise, _, _),) = le.floors_of(spark.createDataFrame([("a", text)] * 9, "label string, text string"), weights)
    assert noise == pytest.approx(weights[le.shuffled(text)].astype(float).mean(), abs=1e-4)
    assert own == pytest.approx(weights[le.trigrams(text)].astype(float).mean(), abs=1e-4)


def test_languages_with_few_rows_have_a_floor_together(spark, weights):
    rows = [("a", f"some words {chr(97 + i)}") for i in range(20)] + [("b", "rarely met"), ("c", "seldom seen")]
    floors = le.floors_of(spark.createDataFrame(rows, "label string, text string"), weights)
    assert len(floors) == 2
