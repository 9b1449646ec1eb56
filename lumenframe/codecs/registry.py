"""Codecs by transfer syntax and priority, and how frames go through them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from . import jpeg_baseline, jpeg_lossless, rle

DEFAULT, NATIVE, USER = 50, 100, 200
Info = tuple[int, int, int, int]  # rows, cols, bits, samples


@dataclass(frozen=True)
class Codec:
    name: str
    syntax: str
    priority: int
    decode: Callable[[bytes, Info], bytes] | None
    encode: Callable[[bytes, Info], bytes] | None
    lossy: bool = False


BUILTIN = [
    Codec("rle", dims.RLE_SYNTAX, DEFAULT, lambda d, i: rle.decode(d, *i), lambda f, i: rle.encode(f, *i)),
    Codec("jpeg-lossless", dims.JPEG_LOSSLESS, DEFAULT, lambda d, i: jpeg_lossless.decode(d)[0], lambda f, i: jpeg_lossless.encode(f, *i)),
    Codec("jpeg-baseline", dims.JPEG_BASELINE, DEFAULT, lambda d, i: jpeg_baseline.decode(d)[0], lambda f, i: jpeg_baseline.encode(f, i[0], i[1], i[3]), True),
]


class Registry:
    """The codec of the highest priority of each syntax; on a tie the one that came first stays."""

    def __init__(self, codecs: list[Codec] | None = None):
        self.all = list(BUILTIN if codecs is None else codecs)

    def register(self, codec: Codec) -> None:
        self.all.append(codec)

    def get(self, syntax: str) -> Codec | None:
        own = [c for c in self.all if c.syntax == syntax]
        return max(own, key=lambda c: c.priority) if own else None

    def can_decode(self, syntax: str) -> bool:
        c = self.get(syntax)
        return c is not None and c.decode is not None

    def can_encode(self, syntax: str) -> bool:
        c = self.get(syntax)
        return c is not None and c.encode is not None

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, c.name, c.syntax, c.priority, c.decode is not None, c.encode is not None, c.lossy) for i, c in enumerate(self.all)], "position int, name string, ts_uid string, priority int, decodes boolean, encodes boolean, lossy boolean")


def best(codecs: DataFrame) -> DataFrame:
    """The codec of each syntax in a table of them."""
    return codecs.groupBy("ts_uid").agg(F.min_by(F.struct("name", "priority"), F.struct((-F.col("priority")).alias("p"), "position")).alias("b")).select("ts_uid", "b.name", "b.priority")


def transcode(frames: DataFrame, source: str | None, target: str | None, registry: Registry | None = None) -> DataFrame:
    """frames (frame binary, rows, cols, bits, samples) decoded from a syntax and encoded in another; None: plain pixels.

    Adds codec_error; a frame that fails keeps its bytes.
    """
    r = registry or Registry()
    back = r.get(source).decode if source else None
    there = r.get(target).encode if target else None
    names = frames.columns
    at = [names.index(c) for c in ("frame", "rows", "cols", "bits", "samples")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for data, *info in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                try:
                    plain = back(data, tuple(info)) if back else data
                    out.append(there(plain, tuple(info)) if there else plain)
                    errors.append(None)
                except (ValueError, KeyError, IndexError) as e:
                    out.append(data)
                    errors.append(str(e))
            columns = list(batch.columns)
            columns[at[0]] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(errors, pa.string())], names=[*names, "codec_error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields), "codec_error string"])
    return frames.mapInArrow(run, schema)
