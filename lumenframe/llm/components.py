"""Connected components of an edge table by alternating stars; tables of edges only, cut to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node in its reach."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the least node that it reaches. Loops and repeats are fine."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.write_shared(now, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        now = common.write_shared(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components are not stable after {MAX_ROUNDS} rounds")
    labelled = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
