"""Files: round trips, nesting, damage, codecs, configs, dictionaries, mappings, streams."""

import datetime
import json
import random

import numpy as np
import pytest

from lumenframe import dims
from lumenframe.codecs import jpeg_baseline, jpeg_lossless, registry, rle, wavelet
from lumenframe.operators.deid import DeidOptions
from lumenframe.operators.query import ImageQuery
from lumenframe.sources import config, deid_files, dictionaries, lazy, mapping, reader, retrieve
from lumenframe.sources.encode import Node, encode, tree
from lumenframe.sources.parse import DicomError, Fragments, ReadOptions, iter_frames, parse
from lumenframe.streaming import association, dimse, ingest, pdu

BASE = [Node(0x00080005, "CS", b"ISO_IR 100"), Node(0x00080016, "UI", b"1.2.840.10008.5.1.4.1.1.2"), Node(0x00080018, "UI", b"1.2.3.4"), Node(0x00100010, "PN", "Müller^A".encode("latin-1")), Node(0x00100020, "LO", b"PAT1")]
NESTED = Node(0x00081115, "SQ", b"", [[Node(0x00100020, "LO", b"ONE"), Node(0x00081140, "SQ", b"", [[Node(0x00100010, "PN", "Ä".encode("latin-1"))]])], []])


@pytest.mark.parametrize("syntax", [dims.IMPLICIT_LE, dims.EXPLICIT_LE, dims.DEFLATED_LE])
@pytest.mark.parametrize("defined", [True, False])
def test_round_trip(syntax, defined):
    nodes = [*BASE, NESTED, Node(0x00081140, "SQ", b"", []), Node(0x00280010, "US", b"\2\0"), Node(0x7FE00010, "OW", bytes(7))]
    data = encode(nodes, syntax, defined)
    f = parse(data)
    assert f.syntax == syntax and f.text(0x00100010) == "Müller^A" and f.number(0x00280010) == 2
    inner = [e for e in f.elements if e.path]
    assert [len(e.path) for e in inner] == [1, 1, 2] or {e.text for e in inner} >= {"ONE", "Ä"}
    assert encode(tree(f.elements), syntax, defined) == data


def test_big_endian_numbers():
    data = encode([*BASE, Node(0x00280010, "US", b"\1\2")], dims.EXPLICIT_BE)
    assert parse(data).number(0x00280010) == 0x0102


def test_headers():
    body = encode(BASE)[132:]
    assert parse(b"DICM" + body).text(0x00100020) == "PAT1"
    with pytest.raises(DicomError):
        parse(b"nothing here at all")
    assert parse(b"nothing here at all", ReadOptions.lenient()).error
    with pytest.raises(DicomError):
        encode([Node(0x00100010, "PN", b"x")])


def test_damage_never_crashes():
    data = encode([*BASE, NESTED])
    rng = random.Random(5)
    for _ in range(300):
        cut = bytearray(data[: rng.randrange(len(data))])
        for _ in range(3):
            if cut:
                cut[rng.randrange(len(cut))] = rng.randrange(256)
        parse(bytes(cut), ReadOptions.lenient())


def test_depth_and_item_limits():
    deep = Node(0x00081115, "SQ", b"", [[]])
    for _ in range(5):
        deep = Node(0x00081115, "SQ", b"", [[deep]])
    data = encode([*BASE, deep])
    assert parse(data)
    with pytest.raises(DicomError):
        parse(data, ReadOptions(max_depth=3))
    with pytest.raises(DicomError):
        parse(data, ReadOptions(max_items=2))


def test_encapsulated_frames():
    parts = [b"ab", b"cdef"]
    f = parse(encode([*BASE, Node(0x00280008, "IS", b"2 "), Node(0x7FE00010, "OB", b"", fragments=Fragments(rle.offset_table(parts), parts))], dims.RLE_SYNTAX))
    assert list(iter_frames(f)) == [(0, b"ab"), (1, b"cdef")]
    assert encode(tree(f.elements, f.fragments), dims.RLE_SYNTAX) == encode([*BASE, Node(0x00280008, "IS", b"2 "), Node(0x7FE00010, "OB", b"", fragments=Fragments(rle.offset_table(parts), parts))], dims.RLE_SYNTAX)


def test_packbits():
    assert rle.unpack(bytes.fromhex("040102030405"), 5) == bytes([1, 2, 3, 4, 5])
    assert rle.unpack(bytes.fromhex("FCAB"), 5) == b"\xab" * 5
    assert rle.unpack(bytes.fromhex("02414243FD44014546"), 9) == b"ABCDDDDEF"
    assert rle.unpack(bytes.fromhex("8002414243"), 3) == b"ABC"
    assert rle.unpack(bytes.fromhex("81FF"), 128) == b"\xff" * 128
    with pytest.raises(rle.CodecError):
        rle.unpack(b"\x00", 5)


@pytest.mark.parametrize("bits,samples", [(8, 1), (8, 3), (16, 1), (16, 3)])
def test_lossless_codecs(bits, samples):
    rng = np.random.default_rng(42)
    for low in (0, 1):
        f = (rng.integers(0, 1 << bits, (11, 13, samples)) >> low * (bits - 2)).astype(np.uint8 if bits == 8 else np.uint16).tobytes()
        assert rle.decode(rle.encode(f, 11, 13, bits, samples), 11, 13, bits, samples) == f
        assert rle.validate(rle.encode(f, 11, 13, bits, samples), bits, samples) is None
        for p in range(1, 8):
            assert jpeg_lossless.decode(jpeg_lossless.encode(f, 11, 13, bits, samples, p))[0] == f


@pytest.mark.parametrize("quality,least", [(95, 25), (50, 20)])
def test_baseline_quality(quality, least):
    y, x = np.mgrid[0:30, 0:44]
    for samples in (1, 3):
        f = np.repeat((128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 7))[..., None], samples, -1).astype(np.uint8)
        got = np.frombuffer(jpeg_baseline.decode(jpeg_baseline.encode(f.tobytes(), 30, 44, samples, quality))[0], np.uint8).reshape(f.shape)
        assert 10 * np.log10(255**2 / max(((got.astype(float) - f) ** 2).mean(), 1e-9)) > least
    flat = np.full((16, 16), 77, np.uint8).tobytes()
    assert max(abs(v - 77) for v in jpeg_baseline.decode(jpeg_baseline.encode(flat, 16, 16, 1, 90))[0]) <= 2


@pytest.mark.parametrize("shape", [(8, 8), (7, 5), (1, 9), (16, 13)])
def test_wavelets(shape):
    x = np.random.default_rng(3).integers(-200, 200, shape)
    for levels in (1, 2, 3):
        assert (wavelet.restore(wavelet.transform(x, levels), levels) == x).all()
        assert np.abs(wavelet.restore(wavelet.transform(x, levels, False), levels, False) - x).max() <= 1


def test_registry():
    r = registry.Registry()
    assert r.can_decode(dims.RLE_SYNTAX) and r.get("1.2.3") is None
    r.register(registry.Codec("mine", dims.RLE_SYNTAX, registry.USER, None, None))
    assert r.get(dims.RLE_SYNTAX).name == "mine" and not r.can_decode(dims.RLE_SYNTAX)


def test_reading_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.dcm").write_bytes(encode([*BASE, NESTED]))
    (tmp_path / "sub" / "bad.dcm").write_bytes(b"junk")
    content = reader.files(spark, str(tmp_path))
    rows = {r["file"].rpartition("/")[2]: r for r in reader.instances(content).collect()}
    assert rows["a.dcm"]["patient_id"] == "PAT1" and rows["bad.dcm"]["parse_error"]
    assert reader.instances(content, "dropmalformed").count() == 1
    with pytest.raises(Exception, match="bad.dcm"):
        reader.instances(content, "failfast").collect()
    assert reader.elements(content).where("depth = 2").first()["values"] == ["Ä"]
    made = content.selectExpr("'x/' || element_at(split(file, '/'), -1) as name", "content")
    assert {(r["name"], r["error"]) for r in reader.write_files(made, f"file://{tmp_path}/out").collect()} == {("x/a.dcm", None), ("x/bad.dcm", None)}


def test_stream_of_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.dcm").write_bytes(encode(BASE))
    stream = ingest.store_status(ingest.instances(ingest.arriving(spark, str(folder))))
    ingest.into_table(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["sop_uid"], r["status"]) for r in rows] == [("1.2.3.4", 0)]


def test_retrying_sink(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.dcm").write_bytes(encode(BASE))
    tries = []

    def write(batch, number):
        tries.append(number)
        if len(tries) < 3:
            raise OSError("busy")

    ingest.into_table(ingest.arriving(spark, str(folder)), "", f"{tmp_path}/check", wait=0.01, write=write).awaitTermination()
    assert tries == [0, 0, 0]


def test_config():
    text = '{ // a note\n "$extends": "research", "options": ["ruid",], "overrides": {"PatientName": "keep", "(0008,0060)": "D"}, "note": "a // b, ]", }'
    o = config.options(text)
    assert isinstance(o, DeidOptions) and o.options == ("ruid", "rpat", "rmod", "cdesc") and o.overrides == {0x00100010: "K", 0x00080060: "D"} and o.shift.strategy == "per_patient"
    with pytest.raises(ValueError, match="extend each other"):
        config.resolve({"$extends": "a"}, {"a": {"$extends": "b"}, "b": {"$extends": "a"}})


def test_private_dictionary(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<?xml version="1.0"?><dict><entry owner="Acme " group="0019" element="xx10" vr="LO" vm="1" name="Menu code"/><entry owner="ACME" group="0019" element="xx10" vr="SH" vm="1" name="Again"/></dict>')
    rows = dictionaries.private_dictionary(spark, str(tmp_path / "d.xml")).collect()
    assert [(r["key"], r["group_no"], r["elem_offset"], r["vr"], r["keyword"]) for r in rows] == [("ACME", 0x19, 0x10, "LO", "MenuCode")]


def test_mapping_table(spark, tmp_path):
    path = str(tmp_path / "map")
    make = lambda *rows: spark.createDataFrame(rows, mapping.SCHEMA)
    mapping.append(make(("s", "1", "a")), path)
    mapping.append(make(("s", "1", "b"), ("s", "2", "c")), path)
    table = mapping.load(spark, path)
    assert {tuple(r) for r in table.collect()} == {("s", "1", "a"), ("s", "2", "c")}
    assert mapping.reverse(spark.createDataFrame([("c",)], "remapped_uid string"), table).first()["original_uid"] == "2"
    with pytest.raises(ValueError):  # c stands for 2 already
        mapping.append(make(("s", "3", "c")), path)
    make(("s", "1", "z")).selectExpr("*", "timestamp '2000-01-01' AS created_at").write.mode("append").parquet(path)  # of a run at the same time, and older
    assert {tuple(r) for r in mapping.load(spark, path).collect()} == {("s", "1", "z"), ("s", "2", "c")}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_mapping_export(spark, tmp_path, n):
    rows = [("s", f'u"{i}', f"m{i}", datetime.datetime(2024, 1, 9 - i)) for i in range(n)]
    mapping.export_json(spark.createDataFrame(rows, mapping.STORED), str(tmp_path / "out"), '2024 "now"')
    found = json.loads("".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))))
    assert (found["exportedAt"], found["mappingCount"]) == ('2024 "now"', n)
    assert [(m["originalUid"], m["remappedUid"]) for m in found["mappings"]] == [r[1:3] for r in reversed(rows)]


def test_retrieval_of_missing_files(spark, tmp_path):
    images = spark.createDataFrame([("p", "st", "se", "1.1", "CT"), ("p", "st", "se", "1.2", "CT"), ("p", "st", "se", "1.3", "MR")], "patient_id string, study_uid string, series_uid string, sop_uid string, modality string")
    images = images.selectExpr("*", "'n' AS patient_name", "'d' AS study_date", "'a' AS accession", "'x' AS description")
    files = spark.createDataFrame([("1.1", b"one"), ("1.3", b"three")], "file string, content binary")
    query = ImageQuery.for_images().with_modality("CT")
    for _ in range(2):  # a second time writes the same
        moved = {r["sop_uid"]: (r["status"], r["bytes"]) for r in retrieve.move(files, images, query, (tmp_path / "to").as_uri()).collect()}
        assert moved == {"1.1": (0, 3), "1.2": (retrieve.NOT_THERE, 0)}
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "to").iterdir()] == [("1.1.dcm", b"one")]
    got = retrieve.get(files, images, query, lambda uid, content: len(content) - 3)
    assert {tuple(r) for r in got.collect()} == {("1.1", 0), ("1.2", retrieve.NOT_THERE)}
    assert tuple(retrieve.final(got).first()) == (1, 0, 1, retrieve.SOME_FAILED)


def test_units():
    rq = pdu.Pdu(pdu.ASSOCIATE_RQ, "SCP", "SCU", [pdu.Context(1, "1.2.840.10008.1.1", [dims.IMPLICIT_LE, dims.EXPLICIT_LE])])
    assert pdu.decode(pdu.encode(rq))[0] == rq
    ac = pdu.negotiate(rq, {"1.2.840.10008.1.1": [dims.EXPLICIT_LE]})
    assert pdu.decode(pdu.encode(ac))[0].contexts[0].transfers == [dims.EXPLICIT_LE]
    parts = pdu.fragments(bytes(100), 3, False, 46)
    assert b"".join(p.values[0][3] for p in parts) == bytes(100) and [p.values[0][2] for p in parts] == [False, False, True]
    for kind in (pdu.ASSOCIATE_RJ, pdu.RELEASE_RQ, pdu.RELEASE_RP, pdu.ABORT):
        assert pdu.decode(pdu.encode(pdu.Pdu(kind)))[0].kind == kind
    with pytest.raises(pdu.PduError):
        pdu.decode(pdu.encode(rq)[:-3])


def test_commands():
    rows = {e.tag: e for e in dimse.read_command(dimse.store_request(7, "1.2", "1.2.3"))}
    assert rows[0x00000100].numbers == [1] and rows[0x00000110].numbers == [7] and rows[0].numbers == [sum(8 + len(e.raw) for t, e in rows.items() if t)]
    assert {e.tag: e for e in dimse.read_command(dimse.response(1, 7, 0xA700))}[0x00000900].numbers == [0xA700]


def test_state_machine():
    assert association.step(1, "transport_indication") == 2 and association.step(6, "release_rq_pdu") == 8
    assert association.step(1, "transport_close") is None and association.step(1, "p_data_pdu") is None and association.step(5, "abort_pdu") == 1


def test_lazy_pixels(spark, tmp_path):
    from lumenframe.sources import lazy

    (tmp_path / "p.dcm").write_bytes(encode([*BASE, Node(0x7FE00010, "OW", bytes(range(8)))]))
    rows = lazy.load(lazy.locate(reader.files(spark, str(tmp_path)))).collect()
    assert [bytes(r["data"]) for r in rows] == [bytes(range(8))]


def test_a_loaded_dictionary_names_representations_of_implicit_files():
    data = encode([*BASE, Node(0x00189073, "FD", np.float64(1.5).tobytes()), Node(0x00189999, "LO", b"text")], dims.IMPLICIT_LE)
    plain = {e.tag: e.vr for e in parse(data).elements}
    assert plain[0x00189073] == plain[0x00189999] == "UN"
    f = parse(data, ReadOptions(dictionary={0x00189073: "FD", 0x00189999: "LO"}))
    assert f.get(0x00189073).numbers == [1.5] and f.text(0x00189999) == "text"


def test_dictionary_files_reach_the_parser(spark, tmp_path):
    cells = [["(0018,9073)", "Acquisition Duration", "AcquisitionDuration", "FD", "1", ""], ["(60xx,3000)", "Overlay Data", "OverlayData", "OB or OW", "1", ""], ["(0018,9004)", "Content Qualification", "ContentQualification", "CS", "1", ""]]
    rows = "".join("<tr>" + "".join(f"<td><para>{c}</para></td>" for c in r) + "</tr>" for r in cells)
    (tmp_path / "part06.xml").write_text(f"<book><table>{rows}</table></book>")
    table = dictionaries.tag_dictionary(spark, str(tmp_path / "part06.xml"))
    known = dictionaries.representations(table)
    assert known == {0x00189073: "FD", 0x00189004: "CS"}
    content = spark.createDataFrame([("a", bytearray(encode([*BASE, Node(0x00189073, "FD", np.float64(2.0).tobytes())], dims.IMPLICIT_LE)))], "file string, content binary")
    row = reader.elements(content, options=ReadOptions(dictionary=known)).where("tag = 1609843").first()
    assert (row["vr"], row["nums"]) == ("FD", [2.0])
    assert config.options('{"overrides": {"AcquisitionDuration": "Z"}}', keywords=dictionaries.keywords(table)).overrides == {0x00189073: "Z"}


@pytest.mark.parametrize("syntax", [dims.IMPLICIT_LE, dims.EXPLICIT_LE, dims.DEFLATED_LE])
def test_places_of_pixels(spark, tmp_path, syntax):
    path = tmp_path / "a.dcm"
    path.write_bytes(encode([*BASE, Node(0x00280100, "US", b"\x10\0"), Node(0x7FE00010, "OW", b"ABCDEFGH")], syntax))
    places = lazy.locate(reader.files(spark, str(tmp_path)))
    got = [bytes(r["data"]) for r in lazy.load(places).collect()]
    assert got == ([] if syntax == dims.DEFLATED_LE else [b"ABCDEFGH"])


def test_pixel_filter_and_extended_offsets(spark):
    data = encode([*BASE, Node(0x7FE00010, "OW", bytes(8))])
    assert parse(data, ReadOptions(pixel_filter=lambda n, context: n < 8)).get(0x7FE00010).raw == b""
    assert len(parse(data, ReadOptions(pixel_filter=lambda n, context: n <= 8)).get(0x7FE00010).raw) == 8
    parts = [b"aa", b"bb", b"cccc"]
    table = np.array([0, 20], "<u8").tobytes()
    data = encode([*BASE, Node(0x00280008, "IS", b"2"), Node(0x7FE00001, "OV", table), Node(0x7FE00010, "OB", fragments=Fragments([], parts))], dims.RLE_SYNTAX)
    assert parse(data).fragments.offsets == [0, 20]
    content = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(encode(BASE)))], "file string, content binary")
    assert [tuple(r) for r in reader.fragments(content).collect()] == [("a", 3, 8, 2)]


def test_deidentified_files(spark):
    nodes = [*BASE, Node(0x00080020, "DA", b"20240101"), Node(0x00081115, "SQ", items=[[Node(0x00100010, "PN", b"Inner^Name"), Node(0x00080018, "UI", b"1.2.3.4")]]), Node(0x00280010, "US", b"\2\0"), Node(0x00091001, "LO", b"private"), Node(0x7FE00010, "OB", fragments=Fragments([0], [b"abcd"]))]
    data = encode(nodes, dims.RLE_SYNTAX)
    content = spark.createDataFrame([("a", bytearray(data)), ("broken", bytearray(b"nothing"))], "file string, content binary")
    options = DeidOptions(unknown="keep").with_override(0x00280010, "D")
    rows = {r["file"]: r for r in deid_files.deidentify_files(content, dims.dim_deid(spark), options).collect()}
    assert rows["broken"]["content"] is None and rows["broken"]["error"]
    f = parse(bytes(rows["a"]["content"]))
    assert b"ller^A" not in bytes(rows["a"]["content"]) and b"Inner^Name" not in bytes(rows["a"]["content"]) and f.fragments.fragments == [b"abcd"]
    uid = f.text(0x00080018)
    inner = [e.text for e in f.elements if e.path and e.tag == 0x00080018]
    assert uid.startswith("2.25.") and inner == [uid]  # the same UID, nested or not
    assert f.number(0x00280010) == 0 and f.get(0x00091001) is None and f.text(0x00120062) == "YES"
    codes = [e.text for e in f.elements if e.tag == 0x00080100 and e.path[0][0] == 0x00120064]
    assert codes == ["113100"]
    again = {r["file"]: r for r in deid_files.deidentify_files(content, dims.dim_deid(spark), options).collect()}
    assert again["a"]["content"] == rows["a"]["content"]


def test_a_sequence_that_goes_takes_its_items_along(spark):
    content = spark.createDataFrame([("a", bytearray(encode([*BASE, NESTED])))], "file string, content binary")
    for action, left in (("X", 0), ("Z", 1)):
        options = DeidOptions(unknown="keep").with_override(0x00081115, action)
        row = deid_files.deidentify_files(content, dims.dim_deid(spark), options).first()
        f = parse(bytes(row["content"]))
        assert sum(e.tag == 0x00081115 for e in f.elements) == left and not any(e.path and e.path[0][0] == 0x00081115 for e in f.elements)


def test_emptied_pixels(spark):
    for pixels in (Node(0x7FE00010, "OW", b"secret!!"), Node(0x7FE00010, "OB", fragments=Fragments([0], [b"secret!!"]))):
        content = spark.createDataFrame([("a", bytearray(encode([*BASE, pixels], dims.RLE_SYNTAX)))], "file string, content binary")
        row = deid_files.deidentify_files(content, dims.dim_deid(spark), DeidOptions(unknown="keep").with_override(0x7FE00010, "Z")).first()
        assert b"secret" not in bytes(row["content"]) and parse(bytes(row["content"])).get(0x7FE00010).raw == b""
