"""Frames, codecs, colours, wavelets and whole files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..codecs import registry, wavelet
from ..functions import values
from ..operators import pixels
from ..sources import reader
from ..sources.encode import Node, encode
from . import bridge

W = bridge.with_views
SAMPLE = "cast(floor((cast(x as double) + 1) * 127) as int)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, s array<int>): 64 samples of 8 bits a vector, an 8 x 8 picture."""
    return bridge.read(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform(embedding, x -> {SAMPLE})").alias("s"))


def frame_table(spark: SparkSession, sf_dir: str, coarse: int = 1) -> DataFrame:
    """The pictures as frames in bytes; coarse divides samples, which makes runs."""
    text = F.concat_ws("", F.transform("s", lambda x: F.lpad(F.hex(F.floor(x / coarse).cast("int")), 2, "0")))
    return samples(spark, sf_dir).select("vec_id", F.unhex(text).alias("frame"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.lit(8).alias("bits"), F.lit(1).alias("samples"))


def frame_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four frames of 4 x 4 from each picture's bytes."""
    rows = frame_table(spark, sf_dir).select("vec_id", F.col("frame").alias("data"), F.lit(16).alias("frame_size"), F.lit(4).alias("n_frames"))
    return pixels.explode_frames(rows).select("vec_id", "frame_no", F.lower(F.hex("frame")).alias("frame_hex"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, k, a, b, c): the samples of each picture as 21 colours."""
    at = lambda i, j: F.get("s", i * 3 + j)
    rows = samples(spark, sf_dir).select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.alias("k"), at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c")))).alias("t"))
    return rows.select("vec_id", "t.*")


def color_ycbcr_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    abc = F.col("a"), F.col("b"), F.col("c")
    r, g, b = values.ycbcr_to_rgb(*abc)
    y, cb, cr = values.rgb_to_ycbcr(*abc)
    return _triples(spark, sf_dir).select("vec_id", "k", r.alias("r"), g.alias("g"), b.alias("b"), y.alias("y"), cb.alias("cb"), cr.alias("cr"))


def color_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of 12 bits."""
    r, g, b = values.wide_ycbcr_to_rgb(F.col("a") * 16, F.col("b") * 16, F.col("c") * 16, 4095)
    return _triples(spark, sf_dir).select("vec_id", "k", r.alias("r"), g.alias("g"), b.alias("b"))


def color_rct(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, u, v = values.rct(F.col("a"), F.col("b"), F.col("c"))
    rows = _triples(spark, sf_dir).withColumns({"y": y, "u": u, "v": v})
    r, g, b = values.inverse_rct(F.col("y"), F.col("u"), F.col("v"))
    return rows.select("vec_id", "k", "y", "u", "v", r.alias("r"), g.alias("g"), b.alias("b"))


def color_ict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance and differences in hundredths; colours that come back."""
    y, u, v = values.ict(F.col("a"), F.col("b"), F.col("c"))
    rows = _triples(spark, sf_dir).withColumns({"y": y, "u": u, "v": v})
    r, g, b = (F.round(x).cast("int") for x in values.inverse_ict(F.col("y"), F.col("u"), F.col("v")))
    return rows.select("vec_id", "k", *[F.floor(F.col(x) * 100 + 0.25).alias(x) for x in ("y", "u", "v")], r.alias("r"), g.alias("g"), b.alias("b"))


def dwt53_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level along 64 samples, in higher-order functions."""
    s = F.col("s")
    half = F.sequence(F.lit(0), F.lit(31))
    high = F.transform(half, lambda i: F.get(s, 2 * i + 1) - F.shiftright(F.get(s, 2 * i) + F.get(s, F.least(2 * i + 2, F.lit(62))), 1))
    rows = samples(spark, sf_dir).withColumn("high", high)
    low = F.transform(half, lambda i: F.get(s, 2 * i) + F.shiftright(F.get(F.col("high"), F.greatest(i - 1, F.lit(0))) + F.get(F.col("high"), i) + 2, 2))
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: x.cast("string")))
    return rows.withColumn("low", low).select("vec_id", text(F.col("low")).alias("low"), text(F.col("high")).alias("high"))


def dwt_2d_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, close = [], []
            for x in batch.column(1):
                p = np.frombuffer(x.as_py(), np.uint8).reshape(8, 8).astype(np.int64)
                exact.append(bool((wavelet.restore(wavelet.transform(p, 3), 3) == p).all()))
                close.append(bool(np.abs(wavelet.restore(wavelet.transform(p, 3, False), 3, False) - p).max() <= 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact), pa.array(close)], names=["vec_id", "exact", "close"])

    return frame_table(spark, sf_dir).select("vec_id", "frame").mapInArrow(run, "vec_id long, exact boolean, close boolean")


def _roundtrip(syntax: str, coarse: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = frame_table(spark, sf_dir, coarse)
        coded = registry.transcode(rows.withColumn("plain", F.col("frame")), None, syntax).withColumnRenamed("codec_error", "encode_error")
        back = registry.transcode(coded.withColumn("n_coded", F.octet_length("frame")), syntax, None)
        return back.select("vec_id", (F.col("frame") == F.col("plain")).alias("exact"), F.coalesce("encode_error", "codec_error").isNull().alias("ok"))

    return query


RLE_HEAD = "01000000" + "40000000" + "00000000" * 14  # a segment after 64 bytes


def rle_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of two runs, 40 samples of one value and 24 of another, in coded bytes."""
    one = lambda i, n: F.repeat(F.lpad(F.hex(F.col("s")[i]), 2, "0"), n)
    plain = F.unhex(F.concat(one(0, 40), one(63, 24)))
    coded = registry.transcode(frame_table(spark, sf_dir).drop("frame").join(samples(spark, sf_dir), "vec_id").withColumn("frame", plain).drop("s"), None, dims.RLE_SYNTAX)
    return coded.select("vec_id", F.lower(F.hex("frame")).alias("coded"), F.col("codec_error").isNull().alias("ok"))


def rle_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples out of coded bytes that columns made: 32 literal samples, then a run of 32."""
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    coded = F.concat(F.lit(RLE_HEAD + "1F"), F.concat_ws("", F.transform(F.slice("s", 1, 32), two)), F.lit("E1"), two(F.col("s")[63]))
    rows = frame_table(spark, sf_dir).drop("frame").join(samples(spark, sf_dir), "vec_id").withColumn("frame", F.unhex(coded)).drop("s")
    return registry.transcode(rows, dims.RLE_SYNTAX, None).select("vec_id", F.lower(F.hex("frame")).alias("plain"), F.col("codec_error").isNull().alias("ok"))


def codec_best_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry.Registry()
    r.register(registry.Codec("my-rle", dims.RLE_SYNTAX, registry.USER, None, None))
    r.register(registry.Codec("other-rle", dims.RLE_SYNTAX, registry.USER, None, None))
    return registry.best(r.table(spark))


def files(spark: SparkSession, sf_dir: str, syntax: str = dims.EXPLICIT_LE, only: Column | None = None) -> DataFrame:
    """(file, length, content): a file for each image, of those whose elements only is true of. Images that share a UID are one file."""
    sets = bridge.datasets(spark, sf_dir, lambda tag, vr: tag != 0x99999999)
    made = reader.encode_sets(sets if only is None else sets.where(only), syntax)
    return made.select("file", F.octet_length("content").cast("long").alias("length"), "content")


def parse_written_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances read back from files that were made of the images' elements."""
    found = reader.instances(files(spark, sf_dir, dims.IMPLICIT_LE), "failfast")
    return found.select("file", "patient_id", "patient_name", "study_uid", "modality", "study_date", "n_rows", "n_cols", "ts_uid")


def parse_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements read back, by tag."""
    return reader.elements(files(spark, sf_dir), "failfast", columns=["tag", "vr", "len", "values"]).groupBy("tag", "vr").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("values")).alias("n_values"), F.sum("len").alias("n_bytes"))


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): a file for each conversation, with a sequence of an item a turn; some items have a character set of their own."""
    c = bridge.read(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # those of one conversation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = []
                for r in rows:
                    own = (conv + r["turn"]) % 4 == 0
                    codec = "utf-8" if own else "latin-1"
                    mine = [Node(0x00080005, "CS", b"ISO_IR 192")] if own else []
                    items.append([*mine, Node(0x00081030, "LO", (r["role"] or "").encode(codec, "replace")), Node(0x00104000, "LT", ("\u00e9" + str(r["turn"])).encode(codec)), Node(0x00281052, "DS", str(len(r["text"] or "")).encode())])
                nodes = [Node(0x00080005, "CS", b"ISO_IR 100"), Node(0x00080016, "UI", b"1.2.840.10008.5.1.4.1.1.88.11"), Node(0x00080018, "UI", f"1.2.3.{conv}".encode()), Node(0x0040A730, "SQ", items=items)]
                out.append(encode(nodes, dims.EXPLICIT_LE, defined_lengths=conv % 2 == 0))
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], names=["file", "content"])

    return turns.mapInArrow(run, "file string, content binary")


def seq_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of nested files, by the parser: each with its depth and item."""
    e = reader.elements(nested_files(spark, sf_dir), "failfast").where("depth > 0")
    return e.select("file", "depth", F.col("item_path")[0]["tag"].alias("sequence"), F.col("item_path")[0]["item"].alias("item"), "tag", F.col("values")[0].alias("value"))


def seq_inherit_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each item by its own character set or its parent's, never a sibling's; and the bytes that it was read from."""
    e = reader.elements(nested_files(spark, sf_dir), "failfast").where("depth = 1 and tag = 1064960")
    return e.select("file", F.col("item_path")[0]["item"].alias("item"), F.col("values")[0].alias("value"), F.lower(F.hex(F.expr("substring(raw, 1, 1)"))).alias("first_byte"))


def redact_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = F.array(pixels.region(F.lit(-1), F.lit(0), F.lit(3), F.lit(2)), pixels.region(F.lit(20), F.lit(0), F.lit(3), F.lit(2)))
    rows = frame_table(spark, sf_dir).withColumn("encapsulated", F.col("vec_id") % 10 == 0).withColumn("regions", region)
    return pixels.redact(rows).select("vec_id", "n_regions", "status", F.lower(F.hex("frame")).alias("frame_hex"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that met pictures, and what became of the pictures."""
    inside, outside = pixels.region(F.lit(-1), F.lit(0), F.lit(3), F.lit(2)), pixels.region(F.lit(8), F.lit(8), F.lit(3), F.lit(2))
    wanted = F.when(F.col("vec_id") % 3 == 0, F.array(inside, outside)).when(F.col("vec_id") % 3 == 1, F.array(inside, inside)).otherwise(F.array(outside))
    rows = frame_table(spark, sf_dir).withColumn("encapsulated", F.col("vec_id") % 10 == 0).withColumn("regions", wanted)
    return pixels.redaction_summary(pixels.redact(rows))


def trim_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat("p_type", F.repeat(F.lit(" "), F.col("p_size") % 3), F.repeat(F.lit("\0"), F.col("p_size") % 4))
    return bridge.read(spark, sf_dir, "part").select("p_partkey", values.trim_padding(padded).alias("trimmed"), F.length(padded).alias("n_padded"))


QUERIES = {f.__name__: f for f in (rle_encode, rle_decode, color_wide, color_ict, redaction_counts, trim_padding, frame_slice, color_ycbcr_rgb, color_rct, dwt53_1d, dwt_2d_roundtrip, codec_best_priority, parse_written_files, parse_elements, seq_flatten, seq_inherit_charset, redact_pixels)}
QUERIES |= {"rle_roundtrip": _roundtrip(dims.RLE_SYNTAX, 16), "jpeg_lossless_roundtrip": _roundtrip(dims.JPEG_LOSSLESS, 1)}

_S = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127) AS INT)) AS s FROM embeddings) "
_T = _S + ", t AS (SELECT vec_id, CAST(k AS INT) AS k, s[CAST(3 * k + 1 AS INT)] AS a, s[CAST(3 * k + 2 AS INT)] AS b, s[CAST(3 * k + 3 AS INT)] AS c FROM s, range(21) r(k)) "
_C = lambda e, most=255: f"CAST(greatest(0, least({most}, trunc({e} + 0.5))) AS INT)"
_HEX = "lower(array_to_string(list_transform({}, lambda x: printf('%02x', x)), ''))"
_TURNS = "WITH turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS item FROM conversations)"
_OK = "SELECT vec_id, true AS exact, true AS ok FROM embeddings"
_MADE = W("images") + "SELECT sop_uid AS file, any_value(patient_id) AS patient_id, any_value(patient_name) AS patient_name, any_value(study_uid) AS study_uid, min(modality) AS modality, any_value(study_date) AS study_date, CAST(min(CAST(n_rows AS VARCHAR)) AS INT) AS n_rows, CAST(min(CAST(n_cols AS VARCHAR)) AS INT) AS n_cols, '1.2.840.10008.1.2' AS ts_uid FROM images GROUP BY sop_uid"
SQL = {
    "frame_slice": _S + f"SELECT vec_id, CAST(f AS INT) AS frame_no, {_HEX.format('s[CAST(f * 16 + 1 AS INT):CAST(f * 16 + 16 AS INT)]')} AS frame_hex FROM s, range(4) r(f)",
    "color_ycbcr_rgb": _T + f"SELECT vec_id, k, {_C('a + 1.402e0 * (c - 128)')} AS r, {_C('a - 0.344136e0 * (b - 128) - 0.714136e0 * (c - 128)')} AS g, {_C('a + 1.772e0 * (b - 128)')} AS b, y, {_C('(c - y) / 1.772e0 + 128')} AS cb, {_C('(a - y) / 1.402e0 + 128')} AS cr FROM (SELECT *, {_C('0.299e0 * a + 0.587e0 * b + 0.114e0 * c')} AS y FROM t)",
    "color_wide": _T + f"SELECT vec_id, k, {_C('a * 16 + 1.402e0 * (c * 16 - 2047)', 4095)} AS r, {_C('a * 16 - 0.344136e0 * (b * 16 - 2047) - 0.714136e0 * (c * 16 - 2047)', 4095)} AS g, {_C('a * 16 + 1.772e0 * (b * 16 - 2047)', 4095)} AS b FROM t",
    "color_rct": _T + "SELECT vec_id, k, CAST(floor((a + 2 * b + c) / 4.0) AS INT) AS y, c - b AS u, a - b AS v, a AS r, b AS g, c AS b FROM t",
    "color_ict": _T + "SELECT vec_id, k, CAST(floor((0.299e0 * a + 0.587e0 * b + 0.114e0 * c) * 100 + 0.25) AS BIGINT) AS y, CAST(floor((-0.16875e0 * a - 0.33126e0 * b + 0.5e0 * c) * 100 + 0.25) AS BIGINT) AS u, CAST(floor((0.5e0 * a - 0.41869e0 * b - 0.08131e0 * c) * 100 + 0.25) AS BIGINT) AS v, a AS r, b AS g, c AS b FROM t",
    "rle_encode": _S + f"SELECT vec_id, '{RLE_HEAD}' || CASE WHEN s[1] = s[64] THEN printf('c1%02x', s[1]) ELSE printf('d9%02xe9%02x', s[1], s[64]) END AS coded, true AS ok FROM s",
    "rle_decode": _S + f"SELECT vec_id, {_HEX.format('s[1:32]')} || repeat(printf('%02x', s[64]), 32) AS plain, true AS ok FROM s",
    "redaction_counts": "SELECT CAST(sum(CASE WHEN vec_id % 10 = 0 THEN 0 ELSE CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END END) AS BIGINT) AS regions, count(*) AS frames, count(*) FILTER (vec_id % 10 <> 0 AND vec_id % 3 < 2) AS modified, count(*) FILTER (vec_id % 10 <> 0) AS successes FROM embeddings",
    "trim_padding": "SELECT p_partkey, p_type AS trimmed, CAST(length(p_type) + p_size % 3 + p_size % 4 AS INT) AS n_padded FROM part",
    "dwt53_1d": _S + ", h AS (SELECT vec_id, s, list_transform(range(32), lambda i: CAST(s[2 * i + 2] - floor((s[2 * i + 1] + s[least(2 * i + 3, 63)]) / 2.0) AS INT)) AS h FROM s) SELECT vec_id, array_to_string(list_transform(range(32), lambda i: CAST(s[2 * i + 1] + floor((h[greatest(i, 1)] + h[i + 1] + 2) / 4.0) AS INT)), ',') AS low, array_to_string(h, ',') AS high FROM h",
    "dwt_2d_roundtrip": "SELECT vec_id, true AS exact, true AS close FROM embeddings",
    "rle_roundtrip": _OK,
    "jpeg_lossless_roundtrip": _OK,
    "codec_best_priority": "SELECT * FROM (VALUES ('1.2.840.10008.1.2.4.50', 'jpeg-baseline', 50), ('1.2.840.10008.1.2.4.70', 'jpeg-lossless', 50), ('1.2.840.10008.1.2.5', 'my-rle', 200)) v(ts_uid, name, priority)",
    "parse_written_files": _MADE,
    "seq_flatten": f"{_TURNS} SELECT CAST(conv_id AS VARCHAR) AS file, CAST(1 AS INT) AS depth, CAST(4237104 AS BIGINT) AS sequence, item, CAST(t AS BIGINT) AS tag, CASE t WHEN 524293 THEN 'ISO_IR 192' WHEN 528432 THEN role WHEN 1064960 THEN 'é' || turn ELSE CAST(length(coalesce(text, '')) AS VARCHAR) END AS value FROM turns, (VALUES (524293), (528432), (1064960), (2625618)) v(t) WHERE t <> 524293 OR (conv_id + turn) % 4 = 0",
    "seq_inherit_charset": f"{_TURNS} SELECT CAST(conv_id AS VARCHAR) AS file, item, 'é' || turn AS value, CASE WHEN (conv_id + turn) % 4 = 0 THEN 'c3' ELSE 'e9' END AS first_byte FROM turns",
    "parse_elements": W("elements") + "SELECT tag, vr, count(*) AS n, CAST(CASE vr WHEN 'US' THEN NULL ELSE sum(len(string_split(value, chr(92)))) END AS BIGINT) AS n_values, CAST(sum(CASE vr WHEN 'US' THEN 2 ELSE length(value) + length(value) % 2 END) AS BIGINT) AS n_bytes FROM (SELECT file, tag, vr, min(value) AS value FROM elements WHERE tag <> 2576980377 GROUP BY ALL) GROUP BY tag, vr",
    "redact_pixels": _S + f"SELECT vec_id, CAST(CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END AS INT) AS n_regions, CASE WHEN vec_id % 10 = 0 THEN 'skipped' ELSE 'redacted' END AS status, {_HEX.format('list_transform(s, lambda x, i: CASE WHEN vec_id % 10 <> 0 AND i IN (1, 2, 9, 10) THEN 0 ELSE x END)')} AS frame_hex FROM s",
}
