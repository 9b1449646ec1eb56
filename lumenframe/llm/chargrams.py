"""Hashed character n-grams of whole texts in NumPy, and how labelled rows are dealt to the tasks that learn from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

from . import common

_SPACES = re.compile(r"\s+")
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Different rows up to which a label's held fifth is exact, not a fifth by hash.
FEW_ROWS = 1000


def codes(text: str | None) -> np.ndarray:
    """Code points of a text in lower case, runs of white space as one space, a space at either end."""
    shown = " " + _SPACES.sub(" ", (text or "").lower()).strip() + " "
    return np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_ids(c: np.ndarray, sizes: range, bits: int) -> list[np.ndarray]:
    """For each size of n-gram the hashed id of the one that starts at each place."""
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, sizes.stop):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * _P
        h ^= h >> np.uint64(31)
        if n >= sizes.start:
            out.append(((h + np.uint64(n)) * _Q >> np.uint64(64 - bits)).astype(np.int32))
    return out


def bounded_sample(rows: DataFrame, per_label: int, most_labels: int, most_rows: int, counts: dict | None = None) -> DataFrame:
    """A sample of rows (id, label, text); counts has the number of rows of each label, where that is known.

    Each label gives as many different rows, by a hash of id and text, as per_label and its share of most_rows allow. A
    first threshold on the hash, from the label's count, leaves a few times as many rows as are kept, so no label's
    rows meet in one task; rows that repeat are one before they meet. More than most_labels labels are an error: none
    is left out in silence.
    """
    if counts is None:
        counts = dict(rows.groupBy("label").agg(F.count(F.lit(1))).limit(most_labels + 1).collect())
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels: raise the parameter for more memory of the driver, or map them first")
    each = max(1, min(per_label, most_rows // max(1, len(counts))))
    shares = rows.sparkSession.createDataFrame([(k, (2.0 * each + 50) / n) for k, n in counts.items()], StructType([StructField("label", rows.schema["label"].dataType), StructField("_share", DoubleType())]))
    drawn = rows.withColumn("_u", common.unit_hash("id", "text", seed=11)).join(F.broadcast(shares), "label").where("_u <= _share")  # most_labels rows
    once = drawn.groupBy("label", "id", "text").agg(F.min("_u").alias("_u"))
    order = Window.partitionBy("label").orderBy("_u", "id")
    return once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("id", "label", "text")


def by_label(rows: DataFrame, values: dict, column: str, kind: DataType) -> DataFrame:
    """rows with a column that has the value of each row's label; values has all labels."""
    table = rows.sparkSession.createDataFrame(list(values.items()), StructType([StructField("label", rows.schema["label"].dataType), StructField(column, kind)]))
    return rows.join(F.broadcast(table), "label")  # a row a label


def hashed(rows: DataFrame) -> DataFrame:
    """rows (id, label, text) with _u, a hash of id and text in [0, 1)."""
    return rows.withColumn("_u", common.unit_hash("id", "text", seed=11))


def different(rows: DataFrame, most_labels: int) -> dict:
    """The number of different rows of each label. More than most_labels labels are an error: none is left out in silence."""
    counts = dict(rows.select("label", "_u").distinct().groupBy("label").agg(F.count(F.lit(1))).limit(most_labels + 1).collect())
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels: raise the parameter for more memory of the driver, or map them first")
    return counts


def with_held(rows: DataFrame, counts: dict) -> DataFrame:
    """rows (of hashed) with _held: true for a fifth of each label's different rows, at least one and not all of two or more."""
    limits = {k: 0.2 if n > 1 else -1.0 for k, n in counts.items()}
    few = {k: 0.0 for k, n in counts.items() if 1 < n <= FEW_ROWS}
    if few:
        some = by_label(rows.select("label", "_u").distinct(), few, "_few", DoubleType())
        limits |= dict(some.groupBy("label").agg(F.expr("element_at(sort_array(collect_list(_u)), int(ceil(count(1) / 5)))")).collect())  # FEW_ROWS a label
    return by_label(rows, limits, "_limit", DoubleType()).withColumn("_held", F.col("_u") <= F.col("_limit")).drop("_limit")


def dealt(rows: DataFrame, counts: dict, per_shard: int, least: int) -> DataFrame:
    """All rows (of hashed), dealt by hash to shards of about per_shard rows and sorted by _shard, _u, label, id.

    The shards depend on the rows alone, not on how they are stored. Each sees about least different rows of every label,
    or all there are: rows of labels that have too few for all shards go to several. A shard is in one task; rows that
    repeat follow each other.
    """
    shards = max(1, -(-sum(counts.values()) // max(per_shard, 2 * least * len(counts))))
    copies = {k: min(shards, -(-least * shards // n)) for k, n in counts.items()}
    turn = F.lit(0)
    if any(n > 1 for n in copies.values()):
        rows = by_label(rows, copies, "_copies", IntegerType()).withColumn("_turn", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
        turn = F.col("_turn")
    rows = rows.withColumn("_shard", F.pmod(common.stable_hash("id", "text", seed=13) + turn, F.lit(shards)).cast("int"))
    return rows.select("_shard", "_u", "label", "id", "text").repartition(shards, "_shard").sortWithinPartitions("_shard", "_u", "label", "id")


def once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, str | None]]:
    """(shard, label, text) of each different row that dealt() gives a task."""
    last = None
    for batch in batches:
        for shard, u, label, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            if last != (shard, u, label, i):
                last = (shard, u, label, i)
                yield shard, label, text.as_py()
