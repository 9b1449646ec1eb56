"""Exact top-k inner-product search: a ball tree in each shard, branch and bound with a shared k-th score.

Candidates are dealt into shards by a hash of their id. Each shard's ball tree is built once and kept, with its vectors, as
one row of a table in the shared folder. Queries visit shards in three rounds: a home shard by a hash of their id, then
the next few (the root of all shards), then all others. After each round the k-th score that a query has found anywhere
is its floor in the next: whole balls are left out whose upper bound (q . centre + |q| * radius, never above that of the
ball around it) stays under it. Within a shard each query takes its best open balls, one at first, then up to MOST_BALLS
at a time: a ball that isn't a leaf is replaced by its two halves, a leaf is searched and may raise the floor; it is
done when no open ball reaches the floor. Bounds are widened against rounding, and balls that could only tie are searched, so results are exact with ties
to the smaller id.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of another
length than a query's count as padded with zeros, and empty ones as zeros. Components may have any finite size: where a
product could leave the whole numbers that doubles hold, scores are added up in whole numbers of any size; one beyond
64 bits counts as the nearest that 64 bits hold. Rows that share the query's id are not its
candidates; rows that repeat are candidates each; several query rows of one id are one query, whose ranks cover all of
them. An empty table gives an empty one. Extra columns are left out of the result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Vectors of a shard: a task holds one, and its tree.
SHARD_ROWS = 32768
#: Queries that meet a copy of a shard, and those that are searched at a time.
BLOCK_QUERIES = 65536
CHUNK = 1024
LEAF = 256
#: Open balls that a query takes at a time, at most.
MOST_BALLS = 32
#: No score at all, and the largest one.
NONE, MOST = -(1 << 63), (1 << 63) - 1


class BallTree:
    """Balls over rows of whole numbers; nodes in arrays, children after parents. first[n] is a node's first child or -1."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(vectors))
        centres, radii, first, spans = [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            a, b, parent = todo.pop(0)
            x = vectors[order[a:b]]
            with np.errstate(over="ignore", invalid="ignore"):
                centre = x.mean(0)
                away = np.nan_to_num(np.sqrt(((x - centre) ** 2).sum(1)), nan=np.inf)
            node = len(centres)
            centres.append(centre)
            radii.append(away.max())
            first.append(-1)
            spans.append((a, b))
            if parent >= 0 and first[parent] < 0:
                first[parent] = node  # its second child comes next
            if b - a <= leaf or away.max() == 0:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                one = x[away.argmax()]
                two = x[((x - one) ** 2).sum(1).argmax()]
                half = np.argpartition(np.nan_to_num(x @ (two - one)), (b - a) // 2)
            order[a:b] = order[a:b][half]
            middle = a + (b - a) // 2
            todo += [(a, middle, node), (middle, b, node)]
        self.vectors, self.ids = vectors[order], ids[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.first, self.spans = np.array(first, np.int32), np.array(spans, np.int32)

    def pack(self) -> dict[str, bytes]:
        return {"vectors": self.vectors.tobytes(), "ids": self.ids.tobytes(), "centres": self.centres.tobytes(), "radii": self.radii.tobytes(), "first": self.first.tobytes(), "spans": self.spans.tobytes()}

    @classmethod
    def unpack(cls, packed: dict, width: int) -> BallTree:
        tree = cls.__new__(cls)
        tree.vectors, tree.centres = (np.frombuffer(packed[k]).reshape(-1, width) for k in ("vectors", "centres"))
        tree.ids, tree.radii, tree.first = np.frombuffer(packed["ids"], np.int64), np.frombuffer(packed["radii"]), np.frombuffer(packed["first"], np.int32)
        tree.spans = np.frombuffer(packed["spans"], np.int32).reshape(-1, 2)
        return tree

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: slice) -> np.ndarray:
        """Upper bounds of the inner products of queries with the rows of nodes."""
        c = self.centres[nodes]
        with np.errstate(over="ignore", invalid="ignore"):
            out = queries @ c.T + norms[:, None] * self.radii[nodes]
            out += 1e-9 * (np.abs(out) + norms[:, None] * np.sqrt((c**2).sum(1))) + 1e-6
        return np.where(np.isnan(out), np.inf, out)


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best scores and ids of a shard for each query, as far as they reach its floor; id -1 for none. And the leaves searched.

    All products are whole numbers that doubles hold.
    """
    n, nodes = len(queries), len(tree.radii)
    best, who = np.full((n, k), NONE), np.full((n, k), -1, np.int64)
    floor, searched = floors.copy(), 0
    norms = np.sqrt((queries**2).sum(1))
    open_ = np.full((n, nodes), -np.inf)  # bounds of the balls that are neither searched nor replaced
    open_[:, :1] = tree.bounds(queries, norms, slice(0, 1))
    live, most = np.arange(n), 1
    while len(live):
        # each query's best open balls: one at first, then more at a time, so that queries meet at the same balls
        take = min(most, nodes)
        node = np.argpartition(-open_[live], take - 1, axis=1)[:, :take]
        bound = np.take_along_axis(open_[live], node, 1)
        going = (bound > -np.inf) & (bound >= floor[live, None])
        who_asks, node, bound = np.repeat(live, take)[going.ravel()], node[going], bound[going]
        live, most = live[going.any(1)], min(2 * most, MOST_BALLS)
        open_[who_asks, node] = -np.inf
        by = np.argsort(node, kind="stable")
        edges = np.flatnonzero(np.diff(node[by], prepend=-1, append=-1)) if len(by) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            qs, top, at = who_asks[by[i:j]], bound[by[i:j]], int(node[by[i]])
            still = top >= floor[qs]
            qs, top = qs[still], top[still]
            if not len(qs):
                continue
            child = tree.first[at]
            if child >= 0:
                halves = slice(child, child + 2)
                open_[qs, halves] = np.minimum(tree.bounds(queries[qs], norms[qs], halves), top[:, None])
                continue
            a, b = tree.spans[at]
            searched += len(qs)
            scores = (queries[qs] @ tree.vectors[a:b].T).astype(np.int64)
            scores[tree.ids[a:b] == query_ids[qs][:, None]] = NONE
            better = scores.max(1) >= floor[qs]
            qs, scores = qs[better], scores[better]
            every = np.concatenate([best[qs], scores], 1)
            names = np.concatenate([who[qs], np.where(scores == NONE, -1, tree.ids[a:b])], 1)
            first = np.lexsort((names, -every.astype(np.float64)), axis=1)[:, :k]
            best[qs], who[qs] = np.take_along_axis(every, first, 1), np.take_along_axis(names, first, 1)
            floor[qs] = np.maximum(floor[qs], best[qs][:, -1])
    return best, who, searched


def search_wide(tree: BallTree, query: np.ndarray, query_id: int, floor: int, k: int) -> list[tuple[int, int]]:
    """The same for one query in whole numbers of any size: (score, id), a heap of balls by their bounds."""
    q, norms = [int(x) for x in query], np.array([math.sqrt(sum(float(x) ** 2 for x in query)) if np.abs(query).max(initial=0) < 1e150 else np.inf])
    heap, found = [(-tree.bounds(query[None], norms, slice(0, 1))[0, 0], 0)], []
    while heap:
        bound, at = heapq.heappop(heap)
        if -bound < floor:
            break
        child = int(tree.first[at])
        if child >= 0:
            halves = tree.bounds(query[None], norms, slice(child, child + 2))[0]
            for c, value in enumerate(np.minimum(halves, -bound)):
                heapq.heappush(heap, (-value, child + c))
            continue
        a, b = tree.spans[at]
        for x, i in zip(tree.vectors[a:b], tree.ids[a:b].tolist(), strict=True):
            if i != query_id:
                found.append((max(NONE + 1, min(sum(v * int(y) for v, y in zip(q, x, strict=True)), MOST)), i))
        found = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        if len(found) == k:
            floor = max(floor, found[-1][0])
    return found


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        v = x.values.to_numpy(zero_copy_only=False)
        out[i, : len(v)] = v
    return out


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): scaled and floored vectors of the rows that take part, as doubles that are whole numbers."""
    v = F.col(vector_col)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(scale) * x.cast("double")) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)  # noqa: E731  larger doubles are whole
    scaled = F.transform(v, lambda x: whole(F.lit(scale) * x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(ok).select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def packed_shards(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, width, largest, and the parts of its tree): a row a shard."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        width = max(1, max(len(x) for x in rows.column("v")))
        vectors = _matrix(rows.column("v"), width)
        packed = BallTree(vectors, rows.column("id").to_numpy()).pack()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()), "largest": [float(np.abs(vectors).max())], **{c: pa.array([x], pa.binary()) for c, x in packed.items()}})

    dealt = rows.withColumn("shard", F.pmod(common.stable_hash("id", seed=3), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInArrow(build, "shard int, width int, largest double, vectors binary, ids binary, centres binary, radii binary, first binary, spans binary")
    return common.write_shared(built, "ball-trees")


def meet(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each query of asked (id, v, floor, shard, block) finds in its shard."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            shard = {c: left.column(c)[0].as_py() for c in left.column_names}
            tree = BallTree.unpack(shard, shard["width"])
            width = max(shard["width"], max(len(x) for x in right.column("v")))
            if width > shard["width"]:
                pad = ((0, 0), (0, width - shard["width"]))
                tree.vectors, tree.centres = np.pad(tree.vectors, pad), np.pad(tree.centres, pad)
            for at in range(0, right.num_rows, CHUNK):
                part = right.slice(at, CHUNK)
                queries, names = _matrix(part.column("v"), width), part.column("id").to_numpy()
                floors = part.column("floor").to_numpy(zero_copy_only=False)
                if width * shard["largest"] * np.abs(queries).max() < 1 << 53:
                    best, who, _ = search(tree, queries, names, floors, k)
                    there = who >= 0
                    out += [(q, i, s) for q, i, s in zip(np.repeat(names, k)[there.ravel()].tolist(), who[there].tolist(), best[there].tolist(), strict=True)]
                else:
                    out += [(q, i, s) for q, x, f in zip(names.tolist(), queries, floors.tolist(), strict=True) for s, i in search_wide(tree, x, q, f, k)]
        return pa.table({c: pa.array([x[i] for x in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return trees.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for each of queries, two tables of (id, vector)."""
    rows, asked = integers(vectors, id_col, vector_col, scale), integers(queries, id_col, vector_col, scale)
    shards, blocks = max(1, math.ceil(rows.count() / shard_rows)), max(1, math.ceil(asked.count() / block_queries))
    trees = packed_shards(rows, shards)
    block = F.pmod(common.stable_hash("id", seed=4), F.lit(blocks)).cast("int")
    home = F.pmod(common.stable_hash("id", seed=5), F.lit(shards)).cast("int")
    asked = common.write_shared(asked.withColumn("block", block).withColumn("home", home), "top-queries")
    copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    few = min(shards, 1 + math.ceil(math.sqrt(shards)))
    lowest = F.lit(NONE).cast("long")
    found = None
    for start, stop in ((0, 1), (1, few), (few, shards)):
        if start >= stop:
            continue
        known = asked.withColumn("floor", lowest)
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            known = asked.join(kth, "id", "left").withColumn("floor", F.coalesce("kth", lowest)).drop("kth")
        step = F.explode(F.sequence(F.lit(start), F.lit(stop - 1)))
        visits = known.withColumn("step", step).withColumn("shard", F.pmod(F.col("home") + F.col("step"), F.lit(shards)).cast("int"))
        more = meet(copies, visits.select("id", "v", "floor", "shard", "block"), k)
        every = more if found is None else found.drop("rank").unionByName(more)
        found = common.write_shared(ranked(every, k), "top-found")
    return found.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
