"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Executors count in how many texts of either label each hashed n-gram occurs, over all labelled rows that may be learned
from; the ratio of the two, in logarithms, scales the n-gram's presence, and the FEATURES n-grams that tell the labels
apart best are kept. Logistic regression with an L2 penalty sets the weights on all of those rows: they are dealt by hash
to shards of some SHARD_ROWS, each with LEAST_PER_LABEL rows of either label or all there are; shards are fitted side by
side and their weights averaged by rows, in whole numbers, so the model depends on the rows alone. Rows that repeat are
fitted once. Labels are learned from alone; a score sees the text only.

Null and empty texts get a score from no n-grams. If there is nothing to learn from, every score is 0. Repeated rows get
the same score. Rows whose id is null count as held out. Texts are read whole, however long they are. A column of the
new one's name gives way to it, all others stay. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common
from .chargrams import bounded_sample, codes, dealt, different, gram_ids, hashed, once

BITS = 20
GRAMS = range(4, 7)
#: Rows that are fitted together, and those of either label among them.
SHARD_ROWS = 8192
LEAST_PER_LABEL = 1000
#: Features of rows that are fitted together; a shard of more is fitted part by part.
PART_FEATURES = 2_000_000
#: Parts of one in which averages are added up.
UNIT = float(1 << 24)
FEATURES = 8192
SMOOTHING, LEAST_TEXTS = 0.5, 4
STEPS, RATE, L2 = 300, 0.3, 1e-4


@dataclass
class Model:
    """ids (sorted) with the weight of each one's presence."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0

    def __post_init__(self) -> None:
        self.place: np.ndarray | None = None

    def present(self, text: str | None) -> np.ndarray:
        """Which features occur in a text."""
        if self.place is None:
            self.place = np.full(1 << BITS, -1, np.int16)
            self.place[self.ids] = np.arange(len(self.ids))
        found = [p[p >= 0] for p in (self.place[g] for g in gram_ids(codes(text), GRAMS, BITS))]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int16)

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1.0 / (1.0 + np.exp(-min(max(z, -500.0), 500.0))))


def ratios(texts: DataFrame) -> tuple[list[tuple[int, float]], dict[int, int]]:
    """(id, log-count ratio) of the features, and the number of texts of each label; texts has (label int, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << BITS) + 1), np.int32)
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for g in gram_ids(codes(x.as_py()), GRAMS, BITS):
                    n[label, np.unique(g)] += 1
                n[label, -1] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[0, at], pa.int64()), pa.array(n[1, at], pa.int64())], names=["id", "n0", "n1"])

    counts = texts.mapInArrow(common.tidy(run), "id long, n0 long, n1 long").groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = common.write_shared(counts, "gram-counts")
    all_ = counts.where(F.col("id") == 1 << BITS).first()
    if all_ is None or not all_["n0"] or not all_["n1"]:
        return [], {}
    p, q = (F.col("n1") + SMOOTHING) / (all_["n1"] + 2 * SMOOTHING), (F.col("n0") + SMOOTHING) / (all_["n0"] + 2 * SMOOTHING)
    usable = counts.where((F.col("id") < 1 << BITS) & (F.col("n0") + F.col("n1") >= LEAST_TEXTS)).select("id", F.log(p / q).alias("r"), ((p - q) * F.log(p / q)).alias("gain"))
    return [(x["id"], x["r"]) for x in usable.orderBy(F.desc("gain"), "id").limit(FEATURES).collect()], {0: all_["n0"], 1: all_["n1"]}


def fit(labels: np.ndarray, rows: list[np.ndarray], r: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of labels on presence times r, rows weighted; AdaGrad over all rows at a time."""
    at = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    value = r[at]
    w, b = np.zeros(len(r)), 0.0
    g2, b2 = np.full(len(r), 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(STEPS):
        z = np.bincount(owner, value * w[at], len(rows)) + b
        e = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels)
        g = np.bincount(at, value * e[owner], len(r)) + L2 * w
        g2 += g * g
        b2 += e.sum() ** 2
        w -= RATE * g / np.sqrt(g2)
        b -= RATE * e.sum() / np.sqrt(b2)
    return w * r, b


def balance(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights of rows by which either label counts as much as it does in the whole."""
    return np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum()))


def fit_all(texts: DataFrame, bare: Broadcast, r: np.ndarray, counts: dict[int, int]) -> Model:
    """A model from all of texts (id, label, text): the mean of the weights of shards; bare has the features' ids."""
    texts = hashed(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(r) + 2, np.int64)  # weights, bias, rows
        shard, y, rows, size = None, [], [], 0

        def close() -> None:
            labels = np.array(y, np.float64)
            w, b = fit(labels, rows, r, balance(labels, counts))
            total[:-1] += np.rint(np.append(w, b) * (len(rows) * UNIT)).astype(np.int64)
            total[-1] += len(rows)

        for s, label, text in once(batches):
            if rows and (s != shard or size > PART_FEATURES):
                close()
                y, rows, size = [], [], 0
            shard = s
            y.append(label)
            rows.append(bare.value.present(text))
            size += len(rows[-1])
        if rows:
            close()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "w"])

    parts = dealt(texts, different(texts, 2), SHARD_ROWS, LEAST_PER_LABEL).mapInArrow(common.tidy(run), "at long, w long")
    total = np.zeros(len(r) + 2)
    for x in parts.groupBy("at").agg(F.sum("w").alias("w")).collect():  # a row a feature
        total[x["at"]] = x["w"]
    w = total[:-1] / (UNIT * max(1.0, total[-1]))
    return Model(bare.value.ids, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int | None = None) -> Model:
    """A model from labels (id, 0 or 1) and the texts of docs; an id that has both labels counts as toxic.

    All labelled rows that may be learned from are fitted; with per_label, a sample of as many of either label.
    """
    common.bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~common.held_out("id") & F.col("label").isin(0, 1))
    known = known.groupBy("id").agg(F.max(F.col("label").cast("int")).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = common.sized_join(rows, known, "id").select("id", "label", "text")
    found, counts = ratios(texts.select("label", "text"))
    if not found:
        return Model()
    best = sorted(found)
    bare = docs.sparkSession.sparkContext.broadcast(Model(np.array([i for i, _ in best], np.int32), np.zeros(len(best)), 0.0))
    r = np.array([x for _, x in best])
    if per_label is None:
        return fit_all(texts, bare, r, counts)
    sample = bounded_sample(texts, per_label, 2, 2 * per_label, counts)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([bare.value.present(x.as_py()).astype("<i2").tobytes() for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), found], names=["id", "label", "at"])

    rows = sample.mapInArrow(common.tidy(featurise), "id string, label int, at binary").collect()  # bounded by the sample
    rows.sort(key=lambda x: (len(x["id"]), x["id"], x["label"], bytes(x["at"])))
    y = np.array([x["label"] for x in rows], np.float64)
    weights, bias = fit(y, [np.frombuffer(x["at"], "<i2") for x in rows], r, balance(y, counts))
    return Model(bare.value.ids, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """docs with out_col; all other columns stay."""
    common.bounded_batches(docs.sparkSession)
    where = docs.columns.index(text_col)
    kept, fields = common.others(docs, out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = pa.array([m.score(x.as_py()) for x in batch.column(where)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), found], names=[*(f.name for f in fields), out_col])

    return common.map_rows(docs, run, StructType([*fields, StructField(out_col, DoubleType())]))


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns as they are."""
    common.bounded_batches(docs.sparkSession)
    where = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    return common.filter_rows(docs, lambda: lambda batch: [shared.value.score(x.as_py()) < threshold for x in batch.column(where)])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
