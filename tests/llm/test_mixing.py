"""Mixing against a plain computation of targets, and the tree's draws against their distribution."""

import dataclasses
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rows = []
    for k, (source, n, size) in enumerate([("a", 60, 40), ("b", 5, 10), ("c", 200, 30), (None, 20, 25), ("big", 3, 900), ("none", 4, 0)]):
        rows += [(1000 * k + i, " ".join(["w"] * (size + i % 3 if size else 0)), "en", source, 1) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), rows[0], rows[0]], SCHEMA)


@pytest.fixture(scope="module")
def mix(spark):
    """narrow and plan of the corpus, as other tests leave them."""
    narrow = mixing.narrow_documents(corpus(spark))
    return narrow, mixing.plan(narrow, shard_words=1500)


def targets(sizes):
    """Shares by weight, what is above three times a source's size shared again until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    free, out = set(order), {}
    while free:
        left = sum(sizes.values()) - sum(out.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 3 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def test_targets_and_taken(spark, mix):
    docs = corpus(spark)
    narrow, plan = mix
    assert plan.shards >= 8
    rows = mixing.taken_words(narrow, plan).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    again = mixing.taken_words(narrow, mixing.plan(narrow, shard_words=1500)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_sizes(spark):
    t = "a  b\tc\x0bd e\n"
    got = spark.createDataFrame([(t,), (None,), ("",)], "text string").select(mixing.n_words(F.col("text"))).collect()
    assert [r[0] for r in got] == [len(re.findall("[^\\x20\\x09-\\x0D]+", t)), 0, 0]


def test_tree_is_exact_and_even(spark):
    quotas = {"a": 700, "c": 41, "d": 1, "e": 300, "f": 3}
    one = spark.createDataFrame([([(k, n) for k, n in quotas.items()],)], "quotas array<struct<source:string,n:bigint>>")
    rows = mixing.split_quotas(one, 8).collect()
    assert len(rows) == 8 and all(q["n"] > 0 for r in rows for q in r["quotas"])
    by = [{q["source"]: q["n"] for q in r["quotas"]} for r in rows]
    assert {k: sum(r.get(k, 0) for r in by) for k in quotas} == quotas
    totals = [sum(r.values()) for r in by]
    assert max(totals) - min(totals) <= 3
    assert len({r["a"] for r in by}) > 1


def test_taken_is_what_the_draws_take(spark, mix):
    narrow, plan = mix
    blocks = plan.blocks.collect()
    draws = Counter((b["_key"], b["_block"], d["copy"]) for b in blocks for d in b["drawn"] or [])
    assert set(draws.values()) == {1}  # no block is drawn twice in a round
    for b in blocks:
        want = b["rounds"] + (b["room"] > 0) if b["block_words"] else 0
        assert [d["copy"] for d in b["drawn"] or []] == list(range(1, want + 1))
    # replay: rows of a block in order, each draw takes whole blocks or the words before the cut
    rows = [r.asDict() for r in mixing.attach(narrow, plan).collect()]
    want = Counter()
    for b in blocks:
        inside = sorted((r for r in rows if (r["_key"], r["_block"]) == (b["_key"], b["_block"])), key=lambda r: (r["_u"], r["doc_id"] or -1, r["size"]))
        for d in b["drawn"] or []:
            left = b["block_words"] if d["copy"] <= b["rounds"] else b["room"]
            for r in inside:
                want[r["doc_id"], r["size"]] += min(left, r["size"])
                left -= min(left, r["size"])
    got = Counter()
    for r in mixing.taken_words(narrow, plan).collect():
        got[r["doc_id"], r["size"]] += r["taken"]
    assert +got == +want


def test_without_its_draws_a_block_gives_nothing(spark, mix):
    narrow, plan = mix
    plan = dataclasses.replace(plan, blocks=plan.blocks.withColumn("drawn", F.when(F.col("_key") != "sa", F.col("drawn"))))
    rows = mixing.taken_words(narrow, plan).collect()
    assert not any(r["taken"] for r in rows if r["source"] == "a") and any(r["taken"] for r in rows)


def test_draws_are_hypergeometric(spark):
    n, k, d = 60, 25, 20
    rows = spark.range(4000).select(F.expr(mixing.hypergeometric(f"{n}L", f"{k}L", f"{d}L", "(id + 0.5D) / 4000")).alias("x")).groupBy("x").count().collect()
    for r in rows:
        p = math.comb(k, r["x"]) * math.comb(n - k, d - r["x"]) / math.comb(n, d)
        assert abs(r["count"] / 4000 - p) < 0.001


CLASHING = ["size", "shards", "target", "words", "rounds", "room", "bits", "drawn", "block_words", "_key", "_u", "_copy", "_row", "_block", "a.b"]


def test_mixed_rows(spark):
    docs = corpus(spark)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    out = mixing.mix_documents(docs, shard_words=4000)
    assert out.columns == docs.columns
    words = Counter()
    times = Counter()
    for r in out.collect():
        assert [r[c] for c in CLASHING] == [f"mine {c}" for c in CLASHING]
        words[r["source"]] += len((r["text"] or "").split())
        times[r["doc_id"]] += 1
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for s, want in targets(sizes).items():
        assert abs(words[s] - want) <= 0.5 * (902 if s == "big" else 45)


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "en", "a", 1), (2, "x y", "en", "b", 1)], SCHEMA)
    narrow = mixing.narrow_documents(docs)
    rows = {r["doc_id"]: r for r in mixing.taken_words(narrow, mixing.plan(narrow)).collect()}
    assert rows[1]["size"] == 400_000 and abs(rows[1]["taken"] - rows[1]["target"]) <= 1 and rows[2]["taken"] == 6


def test_blocks_grow_with_the_words(mix):
    narrow, plan = mix
    many = mixing.plan(narrow, shard_words=1 << 22, block_words=40).blocks.where("_key = 'sc'").count()
    assert many > plan.blocks.where("_key = 'sc'").count()


def test_empty_table(spark):
    docs = corpus(spark).where("false")
    narrow = mixing.narrow_documents(docs)
    assert mixing.taken_words(narrow, mixing.plan(narrow)).count() == 0
    assert mixing.mix_documents(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    narrow = mixing.narrow_documents(blank)
    assert [(r["size"], r["taken"]) for r in mixing.taken_words(narrow, mixing.plan(narrow)).collect()] == [(0, 0)]
