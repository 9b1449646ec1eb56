"""Media shards, WARC archives, top-k search and licence scans against plain computations."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from lumenframe.llm import licenses, media, queries, topk, warc

TEXTS = [None, "", "a", "x" * 63, "x" * 64, "x" * 65, "é\u0000語" * 100, "long " * 30_000, "a", "a"]


def test_media(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string")
    manifest = media.store(docs)
    for r in media.contents(media.metadata(manifest)).collect():
        raw = (TEXTS[r["doc_id"] or 0] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["width"], r["height"], r["bits"]) == (len(raw), len(payload), 64, len(payload) // 64, 8)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.encode(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and r["digest"] == r["media_sha256"]
    assert media.index(manifest).count() == len({t or "" for t in TEXTS})
    assert media.store(docs.where("false")).count() == 0


def test_a_digest_has_one_place_across_shards(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}", "mine") for i in range(2400)], "doc_id long, text string, shard string").repartition(6)
    manifest = media.store(docs)
    assert manifest.select("shard").distinct().count() > 1
    rows = media.addressed(manifest).collect()
    assert len(rows) == 2400 and len({(r["digest"], r["shard"], r["offset"], r["length"]) for r in rows}) == 3
    assert {r["payload_sha256"] for r in media.contents(media.addressed(manifest)).collect()} == {hashlib.sha256(media.pad(f"text {k}".encode())).hexdigest() for k in range(3)}


def test_archives_with_one_very_common_page(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "the same error page" if i % 3 else f"page {i % 7}") for i in range(4000)], "page_id long, url string, html string")
    rows = warc.whole(warc.read(warc.write(pages))).collect()
    assert len(rows) == 4000 and sum(r["type"] == "response" for r in rows) == 8
    common_page = [r for r in rows if r["refers_to"] == "urn:page:3998"]
    assert len(common_page) == sum(bool(i % 3) for i in range(3998))


def test_a_gap_in_archives_that_must_be_whole_is_an_error(spark):
    broken = spark.createDataFrame([("a", bytearray(b"no archive"))], "name string, content binary")
    with pytest.raises(Exception, match="a gap in a at 0"):
        warc.whole(warc.read(broken)).collect()


def test_shards_are_tar_files(spark, tmp_path):
    import tarfile

    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id long, text string").coalesce(1)
    rows = media.store(docs, folder=f"file://{tmp_path}").collect()
    with tarfile.open(tmp_path / rows[0]["shard"]) as t:
        assert len(t.getmembers()) == 2 and {m.name[3:-4] for m in t.getmembers()} == {r["digest"] for r in rows}


def test_damaged_media():
    data = bytearray(media.encode(media.pad(b"text")))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(data))


PAGES = [(1, "http://a", "same"), (4, "http://b", "same"), (3, None, "same"), (2, "http://c d", None), (6, "u", ""), (7, "u", "é" * 5000), (None, "u", "same"), (8, "u", "WARC/1.1\r\n\r\n"), (9, "u", "\x1f\x8b\x08")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("winner", F.lit(1))
    got = {r["record_id"]: r for r in warc.read(warc.write(pages)).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        r, raw = got[f"urn:page:{'' if i is None else i}"], (html or "").encode()
        equal = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["type"], r["refers_to"]) == (("response", None) if i == max(equal) else ("revisit", f"urn:page:{max(equal)}"))
    assert warc.write(pages.where("false")).count() == 0
    assert warc.read(warc.write(pages, min_bytes=5)).where("type = 'revisit'").count() == 0


def archive(n=30, zipped=True):
    parts = [warc.record("response", f"urn:page:{i}", "u", b"p%d" % i * 50, len(b"p%d" % i * 50), warc.base32_sha1(b"p%d" % i * 50), None) for i in range(n)]
    return [warc.compress(p) if zipped else p for p in parts]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(zipped=zipped)
    broken = list(parts)
    broken[4] = broken[4][:40] + bytes(20) + broken[4][60:]
    broken[9] = broken[9][:-30]
    broken.insert(15, b"junk \x1f\x8b\x08 junk WARC/ junk\n")
    found = list(warc.records(b"".join(broken)))
    ids = [r.headers["warc-record-id"] for r in found if r.error is None]
    assert len(ids) >= 27 and f"<urn:page:{29}>" in ids and ids == sorted(ids, key=lambda x: int(x[10:-1]))
    assert sum(r.length for r in found if r.error) + sum(r.length for r in found if not r.error) == len(b"".join(broken))
    assert all(r.error for r in found if not r.headers)


def test_salvage_never_crashes():
    rng = random.Random(1)
    data = b"".join(archive(6))
    for _ in range(200):
        cut = bytearray(data[: rng.randrange(len(data))])
        for _ in range(4):
            if cut:
                cut[rng.randrange(len(cut))] = rng.randrange(256)
        list(warc.records(bytes(cut)))


def test_exported_files_read_back(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    n = warc.export(warc.write(pages), f"file://{tmp_path}/out").count()
    files = spark.read.format("binaryFile").load(f"{tmp_path}/out").select(F.col("path").alias("name"), "content")
    assert files.count() == n and warc.read(files, payloads=True).where("error is null").count() == len(PAGES)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = (rng.integers(-4, 5, (400, 7)) / 37).astype(np.float32)  # many ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")]), (None, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), shard_rows=90).collect()}
    ints = np.floor(256 * x.astype(float)).astype(int)
    for q in range(0, 400, 50):
        order = sorted((-int(ints[q] @ ints[i]), i) for i in range(400) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in order]
    few = v.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id % 50 = 0")).count() == 2
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


def test_balls_that_cannot_hold_a_better_score_are_left_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 1, (500, 4)) for c in (-100, 0, 100)]).round()
    t = topk.BallTree.unpack(topk.BallTree(x, np.arange(len(x)), 32).pack(), 4)
    norms = np.sqrt((x[:3] ** 2).sum(1))
    every = t.bounds(x[:3], norms, slice(None))
    for node, (a, b) in enumerate(t.spans):
        assert (every[:, node, None] >= x[:3] @ t.vectors[a:b].T).all()
    floors = np.full(3, topk.NONE)
    best, who, searched = topk.search(t, x[:3], np.arange(3), floors, 5)
    leaves = int((t.first < 0).sum())
    assert 3 <= searched < 3 * leaves / 2  # nodes above most leaves were never replaced
    for q in range(3):
        order = sorted((-int(x[q] @ y), i) for i, y in enumerate(x) if i != q)[:5]
        assert [(-s, i) for s, i in zip(best[q].tolist(), who[q].tolist())] == order
    _, _, again = topk.search(t, x[:3], np.arange(3), best[:, -1], 5)  # a floor from elsewhere spares leaves
    assert again <= searched
    assert topk.search(t, x[:3], np.arange(3), best[:, 0] + 1, 5)[2] < searched


def test_topk_of_large_components_and_repeated_rows(spark):
    big = [(0, [3e6, 1.0]), (50, [-5000.0, 2.5]), (1, [4e15, 0.25]), (2, [4e15, 0.5]), (3, [4e15, 0.5]), (3, [4e15, 0.5]), (4, [-1e300, 0.0]), (5, [1e300, 0.0]), (6, [7e299])]
    v = spark.createDataFrame(big, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), k=9, shard_rows=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    ints = [(i, [math.floor(256 * x) if abs(x) < 1e15 else int(256 * x) for x in e]) for i, e in big]
    clip = lambda s: max(-(1 << 63) + 1, min(s, (1 << 63) - 1))
    for q in (0, 50):
        e = dict(ints)[q]
        want = sorted((-clip(sum(a * b for a, b in zip(e, c))), i) for i, c in ints if i != q)
        assert [got[q][k + 1] for k in range(len(want))] == [(-s, i) for s, i in want]


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "no notice here at all, just words"), (3, "a/b/y.py", "code\n# Licensed under the Apache License, Version 2.0.\n" + "more words " * 100),
        (4, "c/z.py", None), (5, None, "text"), (6, "ab/q.py", "words"), (7, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (8, "a/b/c/d.py", ""),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("?"))
    got = {r["doc_id"]: (r["license"], r["how"], r["from_dir"]) for r in licenses.license_scan(files).collect()}
    assert got[1] == ("MIT", "licence_file", None) and got[3] == ("Apache-2.0", "header", None) and got[7] == ("GPL-3.0", "licence_file", None)
    assert got[2] == got[8] == ("GPL-3.0", "inherited", "a/b") and got[4] == got[5] == got[6] == (None, "none", None)
    assert licenses.license_scan(files.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
