"""De-identified files from files: every element decided on as rows, the files rewritten with the decisions.

The rows of elements leave pixel data out; what changes comes back to its file as (place, new value) and the file is parsed
once more where it is rewritten, so nested items, fragments and untouched bytes stay as they were. Decisions of a file
meet its bytes by a join on its name. Where a sequence goes, or is emptied, its items go with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import tags
from ..operators import deid
from . import reader
from .encode import Node, encode, tree
from .parse import PIXELS, DicomError, Element, ReadOptions, parse
from .typed import to_bytes


def element_rows(content: DataFrame, mode: str = "permissive", options: ReadOptions | None = None) -> DataFrame:
    """Elements as the operators take them: (file, patient_id, item_path, tag, vr, value, pos), values as text."""
    rows = reader.elements(content, mode, options, ["file", "patient_id", "item_path", "tag", "vr", "len", "raw", "values", "ints", "nums", "pos"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "\\")
    other = F.when(F.col("len") == 0, "").when(F.length("raw") > 0, F.hex("raw")).otherwise("unread")  # sequences and pixel data have something
    value = F.when(tags.is_string(F.col("vr")), F.array_join("values", "\\")).otherwise(F.coalesce(joined("ints"), joined("nums"), other))
    return rows.withColumn("value", value).select("file", "patient_id", "item_path", "tag", "vr", "value", "pos")


def changes(content: DataFrame, table: DataFrame, options: deid.DeidOptions, read: ReadOptions | None = None) -> DataFrame:
    """(file, edits): place, new value (null where the element goes) and representation of what changes in each file."""
    done = deid.apply(deid.decide(element_rows(content, options=read), table, options), options)
    # not by a filter, which would be moved below and make new values once more
    changed = F.when(~F.col("new_value").eqNullSafe(F.col("value")), F.struct("pos", "vr", "new_value"))
    return done.groupBy("file").agg(F.collect_list(changed).alias("edits"))  # of one file


def marker_nodes(options: deid.DeidOptions) -> list[Node]:
    """What says how a data set was de-identified, the sequence of coded methods included."""
    flat = deid.marker_values(options)
    coded = [[Node(0x00080100, "SH", c.encode()), Node(0x00080102, "SH", b"DCM"), Node(0x00080104, "LO", dims.METHOD_MEANINGS[c].encode())] for c in deid.method_codes(options)]
    return [*(Node(t, vr, to_bytes(vr, v)) for t, vr, v in flat), Node(0x00120064, "SQ", items=coded)]


def rewrite(content: bytes, edits: dict[int, tuple[str, str | None]], options: deid.DeidOptions, read: ReadOptions | None = None) -> bytes:
    """A file with its elements replaced by place."""
    f = parse(content, read or ReadOptions())
    kept: list[Element] = []
    gone: set[tuple] = set()
    marks = marker_nodes(options)
    for e in f.elements:
        if any((e.path[:i], e.path[i][0]) in gone for i in range(len(e.path))):
            continue
        if e.pos in edits:
            vr, value = edits[e.pos]
            if e.vr == "SQ":
                gone.add((e.path, e.tag))
                e.items = 0
            if e.tag == PIXELS and not e.path:
                f.fragments = None
            if value is None:
                continue
            charset = next((x.text for x in reversed(kept) if x.tag == 0x00080005 and e.path[: len(x.path)] == x.path), "ISO_IR 100")
            e.raw = b"" if e.vr == "SQ" else to_bytes(vr, value, charset, e.big)
        kept.append(e)
    nodes = [n for n in tree(kept, f.fragments) if n.tag not in {m.tag for m in marks}]
    # the meta group is made anew: the class, which names no one, as it was, and an instance that isn't the original where its element went
    meta = {e.tag: e.text for e in f.meta}
    sop_class = f.text(0x00080016) or meta.get(0x00020002)
    instance = next((n.raw.decode("ascii", "replace").strip(" \0") for n in nodes if n.tag == 0x00080018), "")
    if not instance:
        original = f.text(0x00080018) or meta.get(0x00020003, "")
        instance = f"2.25.{int.from_bytes(hashlib.sha256(f'{options.salt}{original}'.encode()).digest()[:16])}" if original else ""
    return encode([*nodes, *marks], f.syntax, preamble=f.preamble if len(f.preamble) == 128 else bytes(128), sop_class=sop_class, sop_instance=instance)


def deidentify_files(content: DataFrame, table: DataFrame, options: deid.DeidOptions, read: ReadOptions | None = None) -> DataFrame:
    """(file, content, error) for each of (file, content): new bytes, or why there are none. A file that fails has no content."""
    met = content.select("file", "content").join(changes(content, table, options, read), "file", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data, edits in zip(*(batch.column(i) for i in range(3)), strict=True):
                try:
                    rows.append((name.as_py(), rewrite(data.as_py() or b"", {e["pos"]: (e["vr"], e["new_value"]) for e in edits.as_py() or []}, options, read), None))
                except (DicomError, ValueError) as e:
                    rows.append((name.as_py(), None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.string(), pa.binary(), pa.string()), strict=True)], names=["file", "content", "error"])

    return met.mapInArrow(run, "file string, content binary, error string")
