"""Every link between different texts against all pairs."""

from test_ngram_join import corpus, shingles

from lumenframe.llm import ngram_join


def test_links_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    rows = corpus(15, 9)
    near = [f"w{i}" for i in range(60)]  # a group in which every text links with every other
    rows += [(2000 + k, " ".join([*near, f"end{k}"])) for k in range(20)] + [(2100, " ".join([*near, "end3"]))]
    links, members = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {frozenset(shingles(t)) for _, t in rows if shingles(t)}
    linked = lambda a, b: a != b and 100 * len(a & b) >= 75 * len(a | b)
    want = {s: sum(linked(s, o) for o in texts) for s in texts}
    assert links.count() == links.distinct().count() == sum(want.values()) // 2 >= 190
    got = {r["doc_id"]: r for r in members.collect()}
    least = {}
    for k, t in rows:
        s = frozenset(shingles(t))
        least[s] = min(least.get(s, k), k)
    for k, t in rows:
        s = frozenset(shingles(t))
        assert (got[k]["n_links"], got[k]["n_shingles"], got[k]["class_id"]) == (want.get(s, 0), len(s), least[s] if s else k)
