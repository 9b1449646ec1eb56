"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

store() writes each task's payloads into tar files of the shared folder, one member for each distinct content of a
shard, named by its digest, and returns the manifest. metadata() fills columns from a range read of the header alone;
contents() reads whole members. Shard files are written under a name of the attempt and only the manifest, which Spark
commits, makes them count: a task that ran twice leaves a file that nothing refers to. Payloads are written where they are
read, so none is shuffled; addressed() then gives all rows of a digest one place, by a join of the narrow manifest in
which hot digests are spread. A content that several tasks met has a copy in a shard of each, to which nothing refers.

Texts become PNG pictures of 8-bit samples, 64 to a line, after padding with zero bytes to a positive multiple of 64.
Null texts are empty ones: 64 zero bytes. Equal texts give equal values; repeated rows stay. A very long text is one
payload like others. An empty table gives an empty one. Extra columns of docs besides the id are left out of the manifest.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LINE = 64
#: Bytes after which a task begins another shard.
SHARD_BYTES = 32 << 20
#: Signature, and the chunk IHDR with its length, name, contents and checksum.
HEADER_BYTES = 8 + 4 + 4 + 13 + 4
PNG = b"\x89PNG\r\n\x1a\n"
BANDS = 16


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of LINE."""
    return text + bytes(-len(text) % LINE if text else LINE)


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode(payload: bytes, level: int = 2) -> bytes:
    """A grey PNG of 8-bit samples, LINE wide."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), np.uint8)
    raw[:, 1:] = lines
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES."""
    if data[:8] != PNG or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode(data: bytes) -> bytes:
    """The samples of a picture that encode() made."""
    width, height, _ = header(data)
    at, parts = 8, []
    while at < len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if name == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """The mean sample of each of BANDS equal stretches, as two hex digits each."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.arange(BANDS) * len(x) // BANDS
    sums = np.add.reduceat(x, edges, dtype=np.int64)
    return bytes((sums // np.diff(np.append(edges, len(x)))).astype(np.uint8)).hex()


class Shards:
    """Tar files of one task."""

    def __init__(self, folder: str, part: int):
        self.fs, self.base = common.open_folder(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.part, self.attempt, self.k = part, uuid.uuid4().hex[:12], 0
        self.out: pa.NativeFile | None = None

    def add(self, digest: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of a content, written unless the shard has it."""
        if self.out is None:
            self.name = f"shard-{self.part:06d}-{self.attempt}-{self.k:04d}.tar"
            self.out, self.at, self.known = self.fs.open_output_stream(f"{self.base}/{self.name}"), 0, {}
        if digest not in self.known:
            info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.known[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % 512
        found = self.known[digest]
        if self.at >= SHARD_BYTES:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out, self.k = None, self.k + 1


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """The manifest (id, n_bytes, digest, folder, shard, offset, length) of docs, whose payloads are in shards."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    folder = folder or common.new_path(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shards = Shards(folder, TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for x in batch.column(1):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                data = encode(pad(raw))
                digest = hashlib.sha256(data).hexdigest()
                rows.append((len(raw), digest, folder, *shards.add(digest, data)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True))], names=["id", "n_bytes", "digest", "folder", "shard", "offset", "length"])
        shards.close()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(common.tidy(run), f"`{id_col}` long, n_bytes long, digest string, folder string, shard string, offset long, length long")
    return common.write_shared(rows, "media-manifest")


class Reader:
    """Range reads; the last shard stays open."""

    def __init__(self) -> None:
        self.key: tuple[str, str] | None = None

    def __call__(self, folder: str, shard: str, offset: int, length: int) -> bytes:
        if self.key != (folder, shard):
            fs, base = common.open_folder(folder)
            self.key, self.file = (folder, shard), fs.open_input_file(f"{base}/{shard}")
        return self.file.read_at(length, offset)


def _extended(manifest: DataFrame, make: object, fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    names = manifest.columns
    at = [names.index(c) for c in ("folder", "shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows = [make(reader, *place) for place in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            more = zip(*rows, strict=True) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f[1]) for c, f in zip(more, fields, strict=True))], names=[*names, *(f[0] for f in fields)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema.fields), *(f"{n} {k}" for n, _, k in fields)])
    return manifest.mapInArrow(common.tidy(run), schema)


def metadata(manifest: DataFrame) -> DataFrame:
    """manifest with width, height and bits, from range reads of the headers alone."""

    def make(read: Reader, folder: str, shard: str, offset: int, length: int) -> tuple:
        return header(read(folder, shard, offset, HEADER_BYTES))

    return _extended(manifest, make, [("width", pa.int64(), "long"), ("height", pa.int64(), "long"), ("bits", pa.int32(), "int")])


def contents(manifest: DataFrame) -> DataFrame:
    """manifest with what the stored bytes hold: sizes, digests and a feature of the payload and of the stored form."""

    def make(read: Reader, folder: str, shard: str, offset: int, length: int) -> tuple:
        data = read(folder, shard, offset, length)
        payload = decode(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)

    kinds = [("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"), ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string")]
    return _extended(manifest, make, kinds)


def index(manifest: DataFrame) -> DataFrame:
    """One place for each digest."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "folder")).alias("place"), F.count(F.lit(1)).alias("c")).select("digest", "place.*", "c")


def addressed(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """manifest with the one place of each row's digest, whichever task wrote the row's own; no row needs another place."""
    rows = manifest.drop("folder", "shard", "offset", "length")
    return common.hot_join(rows, common.write_shared(index(manifest), "media-index"), "digest", F.col(id_col))


def export_member(manifest_row: object) -> io.BytesIO:
    """The stored picture of one row of a manifest."""
    return io.BytesIO(Reader()(manifest_row["folder"], manifest_row["shard"], manifest_row["offset"], manifest_row["length"]))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contents(metadata(addressed(store(common.documents(spark, sf_dir)))))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
