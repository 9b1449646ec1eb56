"""Frames: slicing, redaction regions and redaction of pixels.

Geometry is columns; pixels are changed in Arrow batches with NumPy, a frame at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def region(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return region(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def bars(top: int, bottom: int, cols: Column, rows: Column) -> Column:
    """Bars over the whole width at the top and at the bottom."""
    zero = F.lit(0)
    return F.array(region(zero, zero, cols, F.lit(top)), region(zero, rows - bottom, cols, F.lit(bottom)))


def corners(width: int, height: int, cols: Column, rows: Column) -> Column:
    at = [(F.lit(0), F.lit(0)), (cols - width, F.lit(0)), (F.lit(0), rows - height), (cols - width, rows - height)]
    return F.array(*[region(x, y, F.lit(width), F.lit(height)) for x, y in at])


def suggested_regions(modality: Column, cols: Column, rows: Column) -> Column:
    """Regions in which a modality is known to write text; an empty array for others."""
    m = F.upper(F.trim(modality))
    none = F.array().cast("array<struct<x:int,y:int,width:int,height:int>>")
    return F.when(m == "US", bars(50, 30, cols, rows)).when(m == "ES", bars(40, 40, cols, rows)).when(m.isin("SC", "XC"), corners(200, 50, cols, rows)).otherwise(none)


def clip(r: Column, cols: Column, rows: Column) -> Column:
    """A region cut to the picture; width or height 0 where they don't meet."""
    x, y = F.greatest(r["x"], F.lit(0)), F.greatest(r["y"], F.lit(0))
    return region(x, y, F.greatest(F.lit(0), F.least(r["x"] + r["width"], cols) - x), F.greatest(F.lit(0), F.least(r["y"] + r["height"], rows) - y))


def area(r: Column) -> Column:
    return r["width"].cast("long") * r["height"]


def frame(data: Column, number: Column, size: Column) -> Column:
    """Bytes of a frame (from 0) of pixel data whose frames have size bytes."""
    return F.substring(data, (number * size + 1).cast("int"), size.cast("int"))


def explode_frames(instances: DataFrame, data: str = "data", size: str = "frame_size", count: str = "n_frames") -> DataFrame:
    """One row a frame: frame_no from 0 and its bytes."""
    rows = instances.withColumn("frame_no", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    return rows.withColumn("frame", frame(F.col(data), F.col("frame_no"), F.col(size))).drop(data)


def redact(frames: DataFrame, fill: int = 0) -> DataFrame:
    """frames (frame binary, rows, cols, samples, bits int, encapsulated boolean, regions array) with redacted pixels.

    Adds n_regions (those that met the picture) and status: redacted, unchanged or skipped (compressed frames). A fill
    of three samples is packed as 0xRRGGBB.
    """
    names = frames.columns
    at = {c: names.index(c) for c in ("frame", "rows", "cols", "samples", "bits", "encapsulated", "regions")}

    def one(data: bytes, rows: int, cols: int, samples: int, bits: int, regions: list[dict]) -> tuple[bytes, int]:
        kind = np.dtype("u1") if bits <= 8 else np.dtype("<u2") if bits <= 16 else np.dtype("<u4")
        picture = np.frombuffer(data, kind, rows * cols * samples).reshape(rows, cols, samples).copy()
        value = [fill >> 16 & 255, fill >> 8 & 255, fill & 255] if samples == 3 and bits <= 8 else fill & (1 << 8 * kind.itemsize) - 1
        met = 0
        for r in regions or ():
            x0, y0 = max(r["x"], 0), max(r["y"], 0)
            x1, y1 = min(r["x"] + r["width"], cols), min(r["y"] + r["height"], rows)
            if x0 < x1 and y0 < y1:
                picture[y0:y1, x0:x1] = value
                met += 1
        return picture.tobytes() + data[picture.nbytes :], met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, met, status = [], [], []
            for data, rows, cols, samples, bits, sealed, regions in zip(*(batch.column(at[c]).to_pylist() for c in at), strict=True):
                if sealed:
                    made, n, s = data, 0, "skipped"
                else:
                    made, n = one(data, rows, cols, samples, bits, regions)
                    s = "redacted" if n else "unchanged"
                out.append(made)
                met.append(n)
                status.append(s)
            columns = list(batch.columns)
            columns[at["frame"]] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(met, pa.int32()), pa.array(status, pa.string())], names=[*names, "n_regions", "status"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields), "n_regions int, status string"])
    return frames.mapInArrow(run, schema)


def redaction_summary(redacted: DataFrame) -> DataFrame:
    return redacted.agg(F.sum("n_regions").alias("regions"), F.count(F.lit(1)).alias("frames"), F.count_if(F.col("status") == "redacted").alias("modified"), F.count_if(F.col("status") != "skipped").alias("successes"))
