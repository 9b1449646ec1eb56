"""DICOM files as DataFrames: instances, elements and frames, parsed in Arrow batches from Spark's own binary reader.

A file is parsed where it is read. Files that can't be parsed are rows with parse_error (permissive), go (dropmalformed)
or fail the job (failfast). elements() and frames() are separate plans, so that neither pays for the other's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import KEYWORD
from .encode import Node, encode, encode_flat
from .parse import DicomError, DicomFile, Element, ReadOptions, iter_frames, parse

#: Text attributes that instances has as columns.
PROMOTED = {
    "patient_id": "PatientID", "patient_name": "PatientName", "study_uid": "StudyInstanceUID", "series_uid": "SeriesInstanceUID", "sop_uid": "SOPInstanceUID", "sop_class_uid": "SOPClassUID",
    "modality": "Modality", "study_date": "StudyDate", "acquisition_date": "AcquisitionDate", "accession": "AccessionNumber", "description": "StudyDescription", "image_type": "ImageType",
}
COUNTED = {"n_rows": "Rows", "n_cols": "Columns", "bits": "BitsAllocated", "bits_stored": "BitsStored", "samples": "SamplesPerPixel", "n_frames": "NumberOfFrames", "pixel_representation": "PixelRepresentation"}
INSTANCE_SCHEMA = "file string, length long, ts_uid string, meta map<string,string>, " + ", ".join(f"{c} string" for c in PROMOTED) + ", " + ", ".join(f"{c} int" for c in COUNTED) + ", parse_error string"
ELEMENT_SCHEMA = "file string, item_path array<struct<tag:bigint,item:int>>, depth int, tag bigint, group_no int, elem_no int, vr string, len bigint, raw binary, values array<string>, ints array<bigint>, nums array<double>, pos bigint, value_pos bigint"
FRAME_SCHEMA = "file string, frame_no int, ts_uid string, rows int, cols int, bits int, samples int, encapsulated boolean, frame binary"


def files(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.dcm") -> DataFrame:
    """(file, length, modified, content) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), "content")


def _each(mode: str, options: ReadOptions, name: str, content: bytes) -> DicomFile | None:
    try:
        return parse(content, options)
    except DicomError as e:
        if mode == "failfast":
            raise DicomError(f"{name}: {e}") from None
        return None if mode == "dropmalformed" else DicomFile(error=str(e))


def instances(content: DataFrame, mode: str = "permissive", options: ReadOptions | None = None) -> DataFrame:
    """A row a file (file, length, content)."""
    options = options or ReadOptions(pixel_data="skip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, length, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                f = _each(mode, options, name.as_py(), data.as_py() or b"")
                if f is not None:
                    meta = [(f"{e.tag:08X}", e.text) for e in f.meta if e.values is not None]
                    at = f.first()
                    rows.append((name.as_py(), length.as_py(), f.syntax, meta, *(f.text(KEYWORD[k], at) for k in PROMOTED.values()), *(f.number(KEYWORD[k], at) for k in COUNTED.values()), f.error))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), *[pa.string()] * len(PROMOTED), *[pa.int32()] * len(COUNTED), pa.string()]
            names = ["file", "length", "ts_uid", "meta", *PROMOTED, *COUNTED, "parse_error"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return content.select("file", "length", "content").mapInArrow(run, INSTANCE_SCHEMA)


#: Rows of elements that go to Spark at once.
ELEMENT_BATCH = 20_000


def _number_columns(e: Element, columns: set[str]) -> tuple[list[int] | None, list[float] | None]:
    if not columns & {"ints", "nums"}:
        return None, None
    n = e.numbers
    return (n if n is not None and e.vr not in ("FL", "FD", "UV") else None), ([float(x) for x in n] if n is not None else None)


def _patient(f: DicomFile) -> str | None:
    """The patient of a file, as text; of several elements the least."""

    def shown(e: Element) -> str:
        return "\\".join(e.values if e.values is not None else map(str, e.numbers)) if e.values is not None or e.numbers is not None else e.raw.hex().upper()

    return min((shown(e) for e in f.elements if e.tag == KEYWORD["PatientID"] and not e.path), default=None)


def elements(content: DataFrame, mode: str = "permissive", options: ReadOptions | None = None, columns: list[str] | None = None) -> DataFrame:
    """A row an element, items of sequences included; of ELEMENT_SCHEMA and patient_id the columns asked for, the schema's if none are."""
    options = options or ReadOptions(pixel_data="skip")
    path_kind = pa.list_(pa.struct([("tag", pa.int64()), ("item", pa.int32())]))
    kinds = [pa.string(), path_kind, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.string()]
    types = dict(c.split(" ") for c in (ELEMENT_SCHEMA + ", patient_id string").replace("array<struct<tag:bigint,item:int>>", "path").split(", "))
    kind_of = dict(zip(types, kinds, strict=True))
    names = columns or list(types)[:-1]
    wanted = set(names)
    schema = ", ".join(f"{n} {types[n]}" for n in names).replace(" path", " array<struct<tag:bigint,item:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), kind_of[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)
            rows.clear()
            return made

        of = {
            "item_path": lambda e: [{"tag": t, "item": i} for t, i in e.path], "depth": lambda e: len(e.path), "tag": lambda e: e.tag, "group_no": lambda e: e.tag >> 16, "elem_no": lambda e: e.tag & 0xFFFF,
            "vr": lambda e: e.vr, "len": lambda e: e.length, "raw": lambda e: e.raw, "values": lambda e: e.values, "ints": lambda e: _number_columns(e, wanted)[0], "nums": lambda e: _number_columns(e, wanted)[1],
            "pos": lambda e: e.pos, "value_pos": lambda e: e.body if e.body >= 0 else None,
        }
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                f = _each(mode, options, name.as_py(), data.as_py() or b"")
                if f is None:
                    continue
                same = {"file": name.as_py(), "patient_id": _patient(f) if "patient_id" in wanted else None}
                get = [(lambda e, v=same[n]: v) if n in same else of[n] for n in names]
                rows.extend(tuple([g(e) for g in get]) for e in f.elements)
                if len(rows) >= ELEMENT_BATCH:
                    yield batch_of()
        if rows:
            yield batch_of()

    return content.select("file", "content").mapInArrow(run, schema)


def frames(content: DataFrame, mode: str = "permissive") -> DataFrame:
    """A row a frame; frames of compressed files as they are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in FRAME_SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                f = _each(mode, ReadOptions(), name.as_py(), data.as_py() or b"")
                if f is None:
                    continue
                head = (f.number(0x00280010), f.number(0x00280011), f.number(0x00280100), f.number(0x00280002) or 1, f.fragments is not None)
                rows = [(name.as_py(), i, f.syntax, *head, x) for i, x in iter_frames(f)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return content.select("file", "content").mapInArrow(run, FRAME_SCHEMA)


def fragments(content: DataFrame, mode: str = "permissive") -> DataFrame:
    """(file, n_fragments, fragment_bytes, n_offsets) of the files with encapsulated pixel data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                f = _each(mode, ReadOptions(), name.as_py(), data.as_py() or b"")
                if f is not None and f.fragments is not None:
                    rows.append((name.as_py(), len(f.fragments.fragments), f.fragments.size, len(f.fragments.offsets)))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["file", "n_fragments", "fragment_bytes", "n_offsets"])

    return content.select("file", "content").mapInArrow(run, "file string, n_fragments int, fragment_bytes long, n_offsets int")


def encode_rows(elements: DataFrame, syntax: str) -> DataFrame:
    """(file, content): files made of flat element rows (file, tag, vr, value). A file's rows meet in one task."""
    shaped = elements.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("tag", "vr", "value"))).alias("rows"))  # one file's elements

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .typed import to_bytes

        for batch in batches:
            out = [encode([Node(r["tag"], r["vr"], to_bytes(r["vr"], r["value"])) for r in rows.as_py()], syntax) for rows in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["file", "content"])

    return shaped.mapInArrow(run, "file string, content binary")


def encode_sets(files: DataFrame, syntax: str) -> DataFrame:
    """(file, content): files made of sets (file, elements: array of tag, vr, value); of several values of a tag and representation the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .typed import to_bytes

        for batch in batches:
            of_each, out = batch.column(1), []
            flat = of_each.flatten()
            tag, vr, value = (flat.field(i).to_pylist() for i in range(3))
            at = 0
            for n in of_each.value_lengths().to_pylist():
                rows = sorted(((tag[i], vr[i], value[i] is None, value[i] or "") for i in range(at, at + (n or 0))))
                at += n or 0
                out.append(encode_flat([(r[0], r[1], to_bytes(r[1], r[3])) for k, r in enumerate(rows) if not k or rows[k - 1][:2] != r[:2]], syntax))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["file", "content"])

    return files.select("file", "elements").mapInArrow(run, "file string, content binary")


def write_files(content: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files of a folder that pyarrow.fs opens; a row a file with its bytes or its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        there: set[str] = set()  # folders of this task's files
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    at = f"{base}/{name}".rpartition("/")[0]
                    if at not in there:
                        fs.create_dir(at, recursive=True)
                        there.add(at)
                    with fs.open_output_stream(f"{base}/{name}.part") as f:
                        f.write(data.as_py())
                    fs.move(f"{base}/{name}.part", f"{base}/{name}")
                    rows.append((name, len(data.as_py()), None))
                except OSError as e:
                    rows.append((name, 0, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["name", "bytes", "error"])

    return content.select("name", "content").mapInArrow(run, "name string, bytes long, error string")
