"""WARC archives: a writer with revisit records, and a reader that salvages what it can from damaged archives.

An archive is a binary value: a sequence of gzip members with a record each, as in a .warc.gz file. The writer makes a
table of archives (name, content) in the shared folder, so that the committed files of Spark's own writer are all that
a lost executor or a repeated task leaves; export() copies them out as files. The reader takes any table of (name,
content), such as spark.read.format("binaryFile") gives.

Salvage: a member that doesn't decompress, a record with a bad header or length, or a block whose digest doesn't match
is quarantined. The reader searches for the next gzip member that holds a record and for the next version line, in the
archive and in the contents of a member, goes on at the first that can be read and logs the byte range it left out, with
the reason. Of a member that is cut off or fails midway the records before the fault are kept, after a fault of the
stream those with a block digest only.

Null payloads are empty. Of records with equal payloads of at least min_bytes the one with the largest id is a response
and the others revisit it; where several rows share that id and payload, each of them is a response. A null id is
smaller than any other. Very long payloads and urls are written and read whole. Empty tables give no archives. Extra
columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 4 << 20
#: Rows of archives that go to a Python worker at a time are few, as each holds about ARCHIVE_BYTES.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
#: Characters that would end or break a header line.
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f-\x9f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """A record with an HTTP response; a revisit has its head alone, with the length of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str | None = None  # set for a quarantined gap

    @property
    def payload(self) -> bytes:
        if "application/http" in self.headers.get("content-type", ""):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    @property
    def http_length(self) -> int | None:
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(m[1]) if m else None


class Damaged(ValueError):
    pass


def digest_agrees(header: str, data: bytes) -> bool | None:
    """Whether a digest header fits the data, in base32, base 16 or base64 of any case and padding; None if it can't be told."""
    name, _, text = header.partition(":")
    name, text = name.strip().lower().replace("-", ""), text.strip().rstrip("=")
    if name not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512") or not text:
        return None
    raw = hashlib.new(name, data).digest()
    if text.lower() == raw.hex() or text.upper() == base64.b32encode(raw).decode().rstrip("="):
        return True
    return text.replace("-", "+").replace("_", "/") == base64.b64encode(raw).decode().rstrip("=")


def parse(data: bytes, at: int, sure: bool = True) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place of plain bytes, and where it ends. A header may have any length.

    Bytes that aren't sure to be right hold a record only where its block digest says so.
    """
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    pos = version.end()
    while True:
        end = data.find(b"\r\n", pos)
        if end < 0:
            raise Damaged("header without end")
        if end == pos:
            break
        name, colon, value = data[pos:end].partition(b":")
        if not colon:
            raise Damaged("bad header line")
        key = name.decode("utf-8", "replace").strip().lower()
        if b"\0" in name or (b"\0" in value and key != "warc-target-uri"):
            raise Damaged("header with NUL")
        headers[key] = value.decode("utf-8", "replace").strip()
        pos = end + 2
    if not {"warc-type", "warc-record-id"} <= headers.keys():
        raise Damaged("header without type or id")
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    start, stop = pos + 2, pos + 2 + int(length)
    if stop > len(data):
        raise Damaged("record is cut off")
    block = bytes(data[start:stop])
    agrees = digest_agrees(headers.get("warc-block-digest", ""), block)
    if agrees is False or not (agrees or sure):
        raise Damaged("no block digest to trust" if agrees is None else "block digest differs")
    if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
        raise Damaged("record without end")
    return headers, block, stop + 4


def member(data: memoryview, at: int) -> tuple[bytes, int, str | None, bool]:
    """The contents of the gzip member at a place as far as they can be had, where they end, what is wrong, and if they are sure.

    What comes before the end of the data is sure to be right; what comes before a fault of the stream is not.
    """
    z, out, pos, why, size = zlib.decompressobj(31), [], at, None, 16384
    while not z.eof:
        chunk = data[pos : pos + size]
        if not chunk:
            why = why or "member is cut off"
            break
        before = z.copy() if size > 1 else None
        try:
            out.append(z.decompress(chunk))
        except zlib.error as e:
            if before is None:
                return b"".join(out), pos, f"gzip: {e}", False
            z, size = before, 1  # once more, to the very byte of the fault
            continue
        pos += len(chunk)
        start = out[0] if len(out[0]) >= 5 else b"".join(out[:8])
        if start and not start.startswith(b"WARC/"[: len(start)]):
            raise Damaged("member holds no record")
    return b"".join(out), pos - len(z.unused_data), why, True


def walk(plain: bytes, sure: bool = True) -> Iterator[Record]:
    """The records in the contents of a member, and the gaps between them, at their places in the contents."""
    at, bad, why = 0, None, ""
    while at < len(plain):
        try:
            headers, block, stop = parse(plain, at, sure)
        except Damaged as e:
            bad, why = (at, str(e)) if bad is None else (bad, why)
            nxt = VERSION.search(plain, at + 1)
            at = nxt.start() if nxt else len(plain)
            continue
        if bad is not None:
            yield Record(bad, at - bad, error=why)
            bad = None
        yield Record(at, stop - at, headers, block)
        at = stop
    if bad is not None:
        yield Record(bad, len(plain) - bad, error=why)


def records(data: bytes) -> Iterator[Record]:
    """All records of an archive that can be read, and the gaps between them.

    Gzip members and plain records may follow each other. Records of a member, and gaps in its contents, have the place
    of the member. A member whose stream fails gives the records before the fault, and is a gap as well.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    zipped = line = read_to = 0  # the next places of either kind, as far as they are known; plain bytes up to read_to were read
    while at < len(data):
        found, fault = [], None
        try:
            if data.startswith(GZIP, at):
                plain, stop, fault, sure = member(view, at)
                found = list(walk(plain, sure))
                if not any(r.headers for r in found):
                    fault = fault or (found[0].error if found else "member holds no record")
                if fault is not None:
                    found = [r for r in found if r.headers]
                    read_to = stop if found else read_to
            elif data.startswith(b"WARC/", at):
                headers, block, stop = parse(data, at)
                found = [Record(at, stop - at, headers, block)]
            else:
                raise Damaged("no record")
        except Damaged as e:
            fault = str(e)
        if bad is not None and found:
            yield Record(bad, at - bad, error=why)
            bad = None
        for r in found:
            inner = "" if r.error is None else f"{r.error} (bytes {r.offset} to {r.offset + r.length} of the member's contents)"
            yield Record(at, stop - at, r.headers, r.block, inner or None)
        if fault is None:
            at = stop
            continue
        bad, why = (at, fault) if bad is None else (bad, why)
        if zipped <= at:
            zipped = data.find(GZIP, at + 1)
            zipped = len(data) if zipped < 0 else zipped
        if line <= at or line < read_to:
            nxt = VERSION.search(data, max(at + 1, read_to))
            line = nxt.start() if nxt else len(data)
        at = min(zipped, line)
    if bad is not None:
        yield Record(bad, len(data) - bad, error=why)


def with_winners(pages: DataFrame, id_col: str, url_col: str, text_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, sha1, winner): winner is the id of the response where payloads are equal, else null."""
    payload = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"))
    equal = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("c")).where("c > 1 and winner is not null")
    return common.hot_join(rows, common.write_shared(equal, "warc-equal"), "sha1", F.col("id"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """A table (name, content) of archives in the shared folder, with a record for each row of pages."""
    spark = pages.sparkSession
    common.bounded_batches(spark)
    rows = with_winners(pages, id_col, url_col, text_col, min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for i, url, payload, sha1, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = payload.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                again = winner is not None and i != winner
                uri = _UNSAFE.sub(lambda m: quote(m[0]), url or "")
                held.append(compress(record("revisit" if again else "response", f"{ID_PREFIX}{'' if i is None else i}", uri, None if again else raw, len(raw), digest, f"{ID_PREFIX}{winner}" if again else None)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{k:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])
                    held, size, k = [], 0, k + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{k:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["name", "content"])

    archives = rows.select("id", "url", "payload", "sha1", "winner").mapInArrow(common.tidy(run), "name string, content binary")
    path = common.new_path(spark, "warc")
    archives.write.option("compression", "none").parquet(path)
    return spark.read.schema(archives.schema).parquet(path)


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record and each quarantined gap of archives (name, content).

    Columns: name, offset, length, type, record_id, uri, refers_to, payload_bytes, payload_digest (of the payload as it
    was read, of the full one for revisits), error (of gaps); with payloads also payload.
    """
    fields = [("name", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def row(name: str, r: Record) -> tuple:
        if r.error:
            return (name, r.offset, r.length, None, None, None, None, None, None, r.error) + (None,) * payloads
        h = r.headers
        again = h.get("warc-type") == "revisit"
        bare = lambda k: h[k].strip("<>") if k in h else None
        body = r.payload
        digest = h.get("warc-payload-digest", "").rpartition(":")[2] if again else base32_sha1(body)
        return (name, r.offset, r.length, h.get("warc-type"), bare("warc-record-id"), h.get("warc-target-uri"), bare("warc-refers-to"), r.http_length if again else len(body), digest, None) + (body,) * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                found: list[tuple] = []
                for r in records(content.as_py() or b""):
                    found.append(row(name.as_py(), r))
                    if len(found) >= (64 if payloads else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    ddl = "name string, offset long, length long, type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, error string" + ", payload binary" * payloads
    return archives.select("name", "content").mapInArrow(common.tidy(run), ddl)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of a folder given as a URI that pyarrow.fs can open; (name, bytes) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.open_folder(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                with fs.open_output_stream(f"{base}/.{name}.part") as f:
                    f.write(data)
                fs.move(f"{base}/.{name}.part", f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], names=["name", "bytes"])

    return archives.select("name", "content").mapInArrow(common.tidy(run), "name string, bytes long")


def whole(found: DataFrame) -> DataFrame:
    """The records that read() found in archives that must have no gap: one is an error, not a row less."""
    gap = F.raise_error(F.concat(F.lit("a gap in "), "name", F.lit(" at "), F.col("offset").cast("string"), F.lit(": "), "error")).cast("boolean")
    return found.where(F.when(F.col("error").isNotNull(), gap).otherwise(F.lit(True)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whole(read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) as bigint)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
     w AS (SELECT h, max(page_id) AS winner FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(p.h || '00', CAST((5 * i) // 4 + 1 AS INT), 3) AS INT) >> CAST(7 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = w.winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = w.winner THEN NULL ELSE w.winner END AS refers_to
FROM p JOIN w USING (h)
"""
