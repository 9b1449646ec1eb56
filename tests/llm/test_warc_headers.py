"""WARC records whose header is long or holds control characters."""

from lumenframe.llm import warc


def test_long_and_odd_urls_come_back(spark):
    urls = {1: "data:," + "x" * 70_000, 2: "http://a/\0b\x07c", 3: "http://a  b\r\nc", 4: "http://é", 5: "u" * 65_536}
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in urls.items()], "page_id long, url string, html string")
    rows = warc.read(warc.write(pages), payloads=True).collect()
    assert [r["error"] for r in rows] == [None] * len(urls)
    got = {r["record_id"]: r["uri"] for r in rows}
    assert got["urn:page:1"] == urls[1] and got["urn:page:5"] == urls[5] and got["urn:page:4"] == urls[4]
    assert got["urn:page:2"] == "http://a/%00b%07c" and got["urn:page:3"] == "http://a%20%20b%0D%0Ac"


def test_archives_of_others_with_such_headers():
    for uri in ("x" * 200_000, "http://a/\0"):
        rec = warc.record("response", "urn:page:1", uri, b"p", 1, warc.base32_sha1(b"p"), None)
        for data in (rec * 2, warc.compress(rec) * 2):
            assert [r.headers.get("warc-target-uri") for r in warc.records(data)] == [uri] * 2
