"""Whether a text is in any of the learned languages at all, apart from which of them fits best.

The scores of a classifier add up to 1, so the best of few languages looks good on any text. Here a text's evidence is
the mean, over its letter trigrams, of the log of the share of a language's texts that hold the trigram, in the
language where that share is largest; a text of several learned languages so loses nothing. Shares are counted on four
fifths of all rows that may be learned from, and the floor is set on all others: halfway from the median of a language to that of the same rows with their
letters shuffled, or SPREAD deviations under the median where that is lower, as it is for texts of few trigrams (the
deviations are those between texts, by the median deviation, so junk rows don't widen them, and those of a mean over few
trigrams). The lowest floor of all languages counts. It doesn't depend on how many languages there are.

Only rows that models may learn from are seen, and all of them. Medians are exact to DIGITS places. Without a row to set it on there is no floor. Texts without a letter have
no evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import common
from .chargrams import by_label, codes, different, gram_ids, hashed, with_held
from .language_id import MAX_LANGS, UND, Model, learnable

BITS = 17
SPREAD = 6.0
#: Neighbouring trigrams share letters, so a mean over n of them varies as one over n / 3 would.
OVERLAP = 3.0
#: Held-out rows that a language needs to have a floor of its own, unless none has as many; languages with fewer have one together.
LEAST_ROWS = 8
TOGETHER = ""
#: Decimal places to which values are rounded before their medians are taken.
DIGITS = 4
#: Languages whose counts a task holds at a time.
HELD_LANGS = 64
_OTHER = re.compile(r"[\W\d_]+")
#: Runs that are no words of any language: keys, hashes, addresses.
_CODE = re.compile(r"(?<!\S)[^\s\d@_]*[\d@_]\S*")


def letters_of(text: str | None) -> str:
    """The words of a text; anything else counts as white space. Runs with a digit, @ or _ count where there is nothing else."""
    return _OTHER.sub(" ", _CODE.sub(" ", text or "")).strip() or _OTHER.sub(" ", text or "").strip()


def trigrams(text: str | None) -> np.ndarray:
    """The hashed id of each letter trigram of a text."""
    letters = letters_of(text)
    return trigrams_of(codes(letters)) if letters else np.zeros(0, np.int32)


def trigrams_of(shown: np.ndarray) -> np.ndarray:
    ids = gram_ids(shown, range(3, 4), BITS)
    return ids[0] if ids else np.zeros(0, np.int32)


def shuffled(text: str | None) -> np.ndarray:
    """The trigrams of a text after its letters and spaces changed places, always in the same way."""
    return trigrams_of(np.random.default_rng(5).permutation(codes(letters_of(text))))


@dataclass
class Evidence:
    weights: np.ndarray
    floors: list[tuple[float, float, float, float]]  # median, that of shuffled letters, variances between texts and of a trigram

    def of(self, text: str | None) -> tuple[float, int]:
        ids = trigrams(text)
        return (float(self.weights[ids].mean()), len(ids)) if len(ids) else (-np.inf, 0)

    def floor(self, n: int) -> float:
        return min((min((m + s) / 2, m - SPREAD * float(np.sqrt(a + OVERLAP * b / n))) for m, s, a, b in self.floors), default=-np.inf)

    def known(self, text: str | None) -> bool:
        value, n = self.of(text)
        return n > 0 and value >= self.floor(n)


def shares(texts: DataFrame) -> np.ndarray | None:
    """The log of the share of a language's texts that hold each trigram, where it is largest; texts has (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(at), np.int32))), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["label", "at", "n"])
            counts.clear()

        last = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = trigrams(x.as_py())
                if len(ids):
                    if lang not in counts and len(counts) == HELD_LANGS:
                        yield from flush()
                    n = counts.setdefault(lang, np.zeros((1 << BITS) + 1, np.int32))
                    places = np.arange(len(ids))
                    last[ids] = places
                    n[ids[last[ids] == places]] += 1  # each trigram at its last place alone
                    n[-1] += 1
        yield from flush()

    counts = texts.mapInArrow(common.tidy(run), "label string, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n"))
    counts = common.write_shared(counts, "trigram-counts")
    totals = {r["label"]: float(r["n"]) for r in counts.where(F.col("at") == 1 << BITS).collect()}  # a row a language
    if not totals:
        return None
    of_each = by_label(counts.where(F.col("at") < 1 << BITS), totals, "total", DoubleType())
    best = of_each.groupBy("at").agg(F.max(F.log((F.col("n") + 0.5) / (F.col("total") + 1.0))).alias("w")).toArrow()  # 2^BITS at most
    weights = np.full(1 << BITS, max(np.log(0.5 / (n + 1.0)) for n in totals.values()), np.float32)
    at = best.column("at").to_numpy()
    weights[at] = np.maximum(weights[at], best.column("w").to_numpy().astype(np.float32))
    return weights


def floors_of(held: DataFrame, weights: np.ndarray) -> list[tuple[float, float, float, float]]:
    """For each language, those with few held rows (label, text) taken together, what its floor is made of: all characters of all rows."""
    shared = held.sparkSession.sparkContext.broadcast(weights)  # 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for lang, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = x.as_py()
                own, noise = shared.value[trigrams(text)].astype(float), shared.value[shuffled(text)].astype(float)
                if len(own):
                    found.append((lang, own.mean(), noise.mean() if len(noise) else None, own.var()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), *(pa.array([f[i] for f in found], pa.float64()) for i in (1, 2, 3))], names=["label", "own", "noise", "within"])

    values = common.write_shared(held.select("label", "text").mapInArrow(common.tidy(run), "label string, own double, noise double, within double"), "evidence")
    middle = lambda c: F.percentile(F.round(c, DIGITS), 0.5)
    made_of = lambda rows: rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(middle(F.col(c)).alias(c) for c in ("own", "noise", "within"))).collect()  # noqa: E731, a row a language
    found = made_of(values)
    few = [r["label"] for r in found if r["n"] < LEAST_ROWS]
    if few and len(few) < len(found):
        values = values.withColumn("label", F.when(F.col("label").isin(few), TOGETHER).otherwise(F.col("label")))
        found = made_of(values)
    if not found:
        return []
    apart = by_label(values, {r["label"]: r["own"] for r in found}, "middle", DoubleType())
    between = dict(apart.groupBy("label").agg(middle(F.abs(F.col("own") - F.col("middle")))).collect())  # a row a language
    return [(r["own"], r["own"] if r["noise"] is None else r["noise"], (1.4826 * between[r["label"]]) ** 2, r["within"]) for r in found]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_langs: int = MAX_LANGS) -> Evidence:
    """Evidence from all rows of docs that may be learned from and have a letter."""
    common.bounded_batches(docs.sparkSession)
    rows = hashed(learnable(docs, id_col, text_col, lang_col).where(F.col("text").rlike(r"\p{L}")))
    rows = with_held(rows, different(rows, max_langs))
    weights = shares(rows.where("NOT _held").select("label", "text"))
    if weights is None:
        return Evidence(np.full(1 << BITS, -np.inf, np.float32), [])
    return Evidence(weights, floors_of(rows.where("_held"), weights))


def accepted(docs: DataFrame, model: Model, evidence: Evidence, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text the model gives a language, and which is in a learned language at all, or in several.

    One Arrow function reads each text once for both, so that a task has one Python worker. Columns stay as they are.
    """
    common.bounded_batches(docs.sparkSession)
    where = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model, evidence))  # 2^BITS weights a language, and 2^BITS in all

    def both(batch: pa.RecordBatch) -> list[bool]:
        m, e = shared.value
        return [e.known(x) and m.predict(x)[0] != UND for x in (v.as_py() for v in batch.column(where))]

    return common.filter_rows(docs, lambda: both)
