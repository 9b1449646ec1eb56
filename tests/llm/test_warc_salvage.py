"""What the reader keeps of damaged members, mixed archives and digests in other spellings."""

import base64
import hashlib

import pytest

from lumenframe.llm import warc


def rec(i, payload=None):
    p = b"payload %d " % i * 20 if payload is None else payload
    return warc.record("response", f"urn:page:{i}", "u", p, len(p), warc.base32_sha1(p), None)


def ids(data):
    return [int(r.headers["warc-record-id"][10:-1]) for r in warc.records(data) if r.error is None]


def test_a_bad_record_costs_itself_only():
    parts = [rec(i) for i in range(10)]
    parts[3] = parts[3].replace(b"payload 3 payload", b"payload X payload", 1)
    parts[6] = b"junk" + parts[6][10:]
    assert ids(warc.compress(b"".join(parts))) == [0, 1, 2, 4, 5, 7, 8, 9]
    found = list(warc.records(warc.compress(b"".join(parts)) + warc.compress(rec(10))))
    assert [r.error is None for r in found].count(False) == 2 and found[-1].headers["warc-record-id"] == "<urn:page:10>"


def noise(i):
    return b"".join(hashlib.sha256(b"%d %d" % (i, k)).digest() for k in range(40))


def test_a_cut_or_broken_member_keeps_what_came_before():
    whole = warc.compress(b"".join(rec(i, noise(i)) for i in range(40)))
    for data in (whole[: len(whole) // 2], whole[: len(whole) // 2] + bytes([whole[len(whole) // 2] ^ 255]) + whole[len(whole) // 2 + 1 :]):
        got = ids(data)
        assert len(got) >= 18 and got[:18] == list(range(18)) and len(set(got)) == len(got)
        assert any(r.error for r in warc.records(data))
    assert ids(whole[: len(whole) // 2] + warc.compress(rec(99)))[-1] == 99


def test_stored_member_gives_no_record_twice():
    data = bytearray(warc.compress(b"".join(rec(i) for i in range(5)), 0))
    data[-6] ^= 1  # the checksum
    assert ids(bytes(data) + rec(5)) == list(range(6))


def test_plain_archive_with_gzip_payloads_and_a_damaged_start():
    parts = [rec(i, warc.compress(b"text %d" % i)) for i in range(6)]
    assert ids(b"XXXX" + b"".join(parts)[4:]) == [1, 2, 3, 4, 5]
    assert ids(b"XXXX" + rec(0)[4:] + warc.compress(rec(1)) + rec(2)) == [1, 2]


@pytest.mark.parametrize("show", [lambda d: "sha1:" + d.hex(), lambda d: "SHA-1:" + d.hex().upper(), lambda d: "sha1:" + base64.b32encode(d).decode().lower(), lambda d: "sha1:" + base64.b64encode(d).decode()])
def test_spellings_of_digests(show):
    head, _, block = rec(1).partition(b"\r\n\r\n")
    block = block[:-4]
    old = b"sha1:" + warc.base32_sha1(block).encode()
    new = show(hashlib.sha1(block).digest()).encode()
    assert ids(rec(1).replace(old, new)) == [1]
    assert ids(rec(1).replace(old, new).replace(b"payload 1", b"payload 2", 1)) == []
