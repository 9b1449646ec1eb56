"""Components of similar documents against all pairs."""

import random

from lumenframe.llm import components, ngram_join

SCHEMA = "doc_id long, text string, cls string, label long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(n=25, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    boiler = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "a b c d", "é É", "  x"]
    for _ in range(n):
        base = [word() for _ in range(rng.randint(5, 90))] + (boiler if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 8)):  # copies with more and more changes: chains of links
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 2)):
                base[rng.randrange(len(base))] = word()
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    got = ngram_join.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_pivots_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "MORE_PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "SEND_SHINGLES", 500)
    rows = corpus(15, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(docs).collect())) == brute(rows)


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (7, "a b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect() if r["n_shingles"])
    assert got == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5)]
    assert ngram_join.jaccard_components(docs.where("false")).count() == 0


def test_connected(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (50, 40)]
    got = {r["node"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and got[50] == 40
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
