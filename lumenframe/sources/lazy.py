"""Pixel data left where it is: rows carry file, offset and length, and bytes are read by range when they are wanted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reader
from .parse import PIXELS


def locate(content: DataFrame, options: reader.ReadOptions | None = None) -> DataFrame:
    """(file, offset, length) of native pixel data, wherever its file has it as it is: deflated files have no such place."""
    e = reader.elements(content, options=options).where((F.col("tag") == PIXELS) & (F.col("depth") == 0) & F.col("value_pos").isNotNull())
    return e.select("file", F.col("value_pos").alias("offset"), F.col("len").alias("length"))


def load(places: DataFrame) -> DataFrame:
    """places with data, read by range from files that pyarrow.fs opens; rows of one file that follow each other open it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        last, f = None, None
        for batch in batches:
            out = []
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != last:
                    fs, path = pafs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
                    last, f = name, fs.open_input_file(path)
                out.append(f.read_at(length, offset))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=["file", "offset", "length", "data"])

    return places.select("file", "offset", "length").mapInArrow(run, "file string, offset long, length long, data binary")
