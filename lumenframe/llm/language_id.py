"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Learning sees all rows that may be learned from: document frequencies of hashed n-grams are counted over all of them;
a fifth of each language's rows is kept for the temperature that calibrates the scores, and all others are fitted with
follow-the-regularised-leader and elastic-net penalties, which keep most weights at 0. Rows are dealt by hash to shards of
some SHARD_ROWS, each with LEAST_PER_LANG rows of every language or all there are; shards are fitted side by side and
their weights averaged by rows, in whole numbers, so the model depends on the rows alone. Rows that repeat are fitted once.
Only text and a non-null lang are learned from; a prediction sees the text alone.

A null text, or one without a letter, is "und" with score 0, and so is every text if there is nothing to learn from.
Ties go to the language first in order. Repeated rows get the same result; rows whose id is null count as held out. A text
is read whole, however long it is. Columns named lang_pred and score give way to the new ones, all others stay. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import common
from .chargrams import bounded_sample, codes, dealt, different, gram_ids, hashed, once, with_held

BITS = 15
GRAMS = range(1, 4)
#: Rows that are fitted one after another, and those of each language among them.
SHARD_ROWS = 4096
LEAST_PER_LANG = 600
#: Bytes of features that a task holds; a shard of more is fitted part by part.
PART_BYTES = 48 << 20
#: Rows in all where a caller asks for a sample (per_lang).
SAMPLE_ROWS = 150_000
#: Parts of one in which averages and losses are added up.
UNIT = float(1 << 20)
#: Temperatures to choose from.
GRID = np.geomspace(0.05, 5.0, 60)
#: Languages up to which the weights fit the driver; more are an error, none is left out.
MAX_LANGS = 1024
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.002, 0.0005
UND = "und"
_LETTER = regex.compile(r"\p{L}")


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text's n-grams and how often each occurs."""
    ids = gram_ids(codes(text), GRAMS, BITS)
    tf = np.bincount(np.concatenate(ids), minlength=1 << BITS) if ids else np.zeros(1 << BITS, np.int64)
    at = np.flatnonzero(tf)
    return at, tf[at]


def vector(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(tf)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (vector(at, tf, self.idf) @ self.weights[at] + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UND, 0.0
        p = softmax(self.logits(*counts_of(text)))
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram occurs, and the number of texts; each task sends one count an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                df[counts_of(x.as_py())[0]] += 1
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["id", "n"])

    out = np.zeros((1 << BITS) + 1, np.int64)
    for r in texts.mapInArrow(common.tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most 2^BITS + 1 rows
        out[r["id"]] = r["n"]
    return out[:-1], int(out[-1])


class Ftrl:
    """FTRL-proximal with elastic net; the last of n + 1 features is the bias."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.state = np.zeros((n + 1, 2 * k))  # z, and the root of the sum of squared gradients
        self.rng = np.random.default_rng(7)

    def weights(self, state: np.ndarray) -> np.ndarray:
        z = state[:, : self.k]
        return (np.clip(z, -L1, L1) - z) / ((BETA + state[:, self.k :]) / ALPHA + L2)

    def learn(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """EPOCHS turns over (language, ids, values)."""
        k = self.k
        for _ in range(EPOCHS):
            for i in self.rng.permutation(len(rows)):
                y, at, x = rows[i]
                old = self.state.take(at, 0)
                w = self.weights(old)
                p = softmax(x @ w)
                p[y] -= 1.0
                g = np.multiply.outer(x, p)
                root = old[:, k:]
                more = np.sqrt(root * root + g * g)
                w *= (more - root) / ALPHA
                g -= w
                old[:, :k] += g
                old[:, k:] = more
                self.state[at] = old

    def model(self, langs: list[str], idf: np.ndarray) -> Model:
        w = self.weights(self.state)
        return Model(langs, idf, w[:-1].astype(np.float32), w[-1])


def log_chances(logits: np.ndarray) -> np.ndarray:
    """The log of each language's chance at each temperature of GRID."""
    return np.log(softmax(logits[None, :] / GRID[:, None]) + 1e-300)


def best_temperature(own: np.ndarray, all_: np.ndarray, n: int, k: int) -> float:
    """From the sums over n rows of log_chances of each row's language and of all languages."""
    low = 1.0 / (n + 2)  # smoothed, or faultless rows would ask for certainty
    return float(GRID[int(np.argmin(-(low * (all_ - own) + (1.0 - (k - 1) * low) * own)))])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """FTRL over (lang, ids, counts) in one process, then a temperature from every fifth row."""
    langs = sorted({r[0] for r in rows})
    at_lang = {x: k for k, x in enumerate(langs)}
    n, k = len(idf), len(langs)
    data = [(at_lang[lang], np.append(at, n), np.append(vector(at, tf, idf), 1.0)) for lang, at, tf in rows]
    learner = Ftrl(n, k)
    learner.learn([d for i, d in enumerate(data) if i % 5] or data)
    model = learner.model(langs, idf)
    held = [d for i, d in enumerate(data) if i % 5 == 0]
    if held and k > 1:
        w = learner.weights(learner.state)
        chances = [(y, log_chances(x @ w[at])) for y, at, x in held]
        model.temperature = best_temperature(sum(c[:, y] for y, c in chances), sum(c.sum(1) for _, c in chances), len(held), k)
    return model


def fit_all(rows: DataFrame, idf: np.ndarray, max_langs: int) -> Model:
    """A model from all of rows (id, label, text): the mean of the shards' weights, and a temperature from all held rows."""
    rows = hashed(rows)
    counts = different(rows, max_langs)
    langs = sorted(counts)
    n, k = len(idf), len(langs)
    if not k:
        return fit([], idf)
    rows = with_held(rows, counts)
    fitted = {x: c if c == 1 else c - -(-c // 5) for x, c in counts.items()}
    at_lang = {x: i for i, x in enumerate(langs)}
    shared = rows.sparkSession.sparkContext.broadcast(idf)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, total = shared.value, np.zeros((n + 1) * k + 1, np.int64)
        learner, shard, seen, held, size = Ftrl(n, k), None, 0, [], 0

        def close() -> None:
            learner.learn(held)
            for i in range(0, n + 1, 4096):
                total[i * k : min(i + 4096, n + 1) * k] += np.rint(learner.weights(learner.state[i : i + 4096]).ravel() * (seen * UNIT)).astype(np.int64)
            total[-1] += seen

        for s, lang, text in once(batches):
            if s != shard and seen:
                close()
                learner, seen, held, size = Ftrl(n, k), 0, [], 0
            shard = s
            at, tf = counts_of(text)
            held.append((at_lang[lang], np.append(at, n).astype(np.uint16), np.append(vector(at, tf, idf), 1.0).astype(np.float32)))
            seen, size = seen + 1, size + 6 * len(at)
            if size > PART_BYTES:
                learner.learn(held)
                held, size = [], 0
        if seen:
            close()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "w"])

    parts = dealt(rows.where("NOT _held"), fitted, SHARD_ROWS, LEAST_PER_LANG).mapInArrow(common.tidy(run), "at long, w long")
    found = parts.groupBy("at").agg(F.sum("w").alias("w")).toArrow()  # at most the weights, and the number of rows
    total = np.zeros((n + 1) * k + 1)
    total[found.column("at").to_numpy()] = found.column("w").to_numpy()
    w = (total[:-1] / (UNIT * max(1.0, total[-1]))).reshape(n + 1, k)
    model = Model(langs, idf, w[:-1].astype(np.float32), w[-1])
    if k > 1:
        model.temperature = calibrated(rows.where("_held"), model)
    return model


def calibrated(held: DataFrame, model: Model) -> float:
    """The temperature at which the model's chances fit all held rows (label, text) best."""
    shared = held.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a language
    at_lang = {x: i for i, x in enumerate(model.langs)}
    t = len(GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * t + 1, np.int64)
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = np.rint(log_chances(shared.value.logits(*counts_of(x.as_py()))) * UNIT).astype(np.int64)
                sums[:t] += c[:, at_lang[lang]]
                sums[t : 2 * t] += c.sum(1)
                sums[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * t + 1), pa.int64()), pa.array(sums, pa.int64())], names=["at", "x"])

    sums = np.zeros(2 * t + 1)
    for r in held.select("label", "text").mapInArrow(common.tidy(run), "at long, x long").groupBy("at").agg(F.sum("x").alias("x")).collect():  # a row a temperature
        sums[r["at"]] = r["x"]
    n = int(sums[-1])
    return best_temperature(sums[:t] / UNIT, sums[t : 2 * t] / UNIT, n, len(model.langs)) if n else 1.0


def learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, label, text) of the rows that may be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    return rows.where(~common.held_out("id") & F.col("label").isNotNull() & F.col("text").isNotNull())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int | None = None, max_langs: int = MAX_LANGS) -> Model:
    """A model from all rows of docs that may be learned from; with per_lang, fitted on a sample of as many a language."""
    common.bounded_batches(docs.sparkSession)
    usable = learnable(docs, id_col, text_col, lang_col)
    df, total = document_frequencies(usable.select("text"))
    idf = (np.log((1.0 + total) / (1.0 + df)) + 1.0).astype(np.float32)
    if per_lang is None:
        return fit_all(usable, idf, max_langs)
    chosen = bounded_sample(usable, per_lang, max_langs, SAMPLE_ROWS)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([t.astype("<i4").tobytes() for _, t in found], pa.binary())], names=["id", "lang", "at", "tf"])

    rows = chosen.mapInArrow(common.tidy(featurise), "id string, lang string, at binary, tf binary").collect()  # bounded by the sample
    rows.sort(key=lambda r: (len(r["id"]), r["id"], r["lang"], bytes(r["at"]), bytes(r["tf"])))
    return fit([(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["tf"], "<i4")) for r in rows], idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; text_col stays, other columns too."""
    common.bounded_batches(docs.sparkSession)
    where = docs.columns.index(text_col)
    kept, fields = common.others(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(x.as_py()) for x in batch.column(where)]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *new], names=[*(f.name for f in fields), "lang_pred", "score"])

    return common.map_rows(docs, run, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")
