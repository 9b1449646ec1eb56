"""What the operators of this subpackage share: the folder all executors see, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows handed to a Python worker at a time; texts may be long, so few rows are sent at once.
BATCH_ROWS = 1000
#: Rows of a number and a label up to which a table is broadcast (some 30 MB).
BROADCAST_ROWS = 1_000_000
#: Words as the contracts define them: runs without ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small unless the user has asked for smaller ones already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a session whose executors run in the driver; any other session gets
    an error, as its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenframe-shared-")
        sc.setCheckpointDir(path)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable_hash(*cols: Column | str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *[F.col(c) if isinstance(c, str) else c for c in cols])


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(stable_hash(*cols, seed=seed), 11).cast("double") / F.lit(float(1 << 53))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of all documents that no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def salted_join(big: DataFrame, small: DataFrame, key: str, by: Column, salts: int = 64, how: str = "left") -> DataFrame:
    """Join a big table, one key of which may hold a third of all rows, with a table of one row a key.

    The small side is repeated for every salt, so that no key meets in one task; Spark may still broadcast it
    where its size is under the session's threshold.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def sized_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """A join whose small side is counted first: up to most (narrow) rows are broadcast, more are shuffled with the big side."""
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return big.join(small, key, how)


def others(df: DataFrame, *new: str) -> tuple[list[int], list[StructField]]:
    """Places and fields of the columns that stay beside new ones: one of the same name gives way."""
    names = {n.lower() for n in new}
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name.lower() not in names]
    return [i for i, _ in kept], [f for _, f in kept]


def packed_row(df: DataFrame) -> Column:
    """All columns of df in one struct, so that none can clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def hot_join(rows: DataFrame, counted: DataFrame, key: str, by: Column, most: int = 100_000) -> DataFrame:
    """rows left-joined with counted (key, c, and other columns; c is the number of rows of the key), where any key may be hot.

    Keys that hold more than 1 in most of all counted rows are at most that many, so they are broadcast; their rows then
    go on under keys of their own, spread by another column, while all other keys meet in a shuffle.
    """
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    more = [c for c in counted.columns if c not in (key, "c")]
    hot = counted.where(F.col("c") > max(1000, total // most)).select(F.col(key).alias("_hot"), F.struct(*more).alias("_at_once"))
    rest = counted.where(F.col("c") <= max(1000, total // most)).select(F.col(key).cast("string").alias("_rest"), F.struct(*more).alias("_met"))
    spread = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")  # most rows at most
    spread = spread.withColumn("_key", F.when(F.col("_hot").isNotNull(), F.concat(F.lit("hot "), F.xxhash64(by).cast("string"))).otherwise(F.col(key).cast("string")))
    met = spread.join(rest, spread["_key"] == rest["_rest"], "left")
    return met.select(*[rows[c] for c in rows.columns], *[F.coalesce(F.col("_at_once")[c], F.col("_met")[c]).alias(c) for c in more])


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that Spark names, and its path there; names of Hadoop's connectors included."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("dbfs:/", "file:///dbfs/")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def release() -> None:
    """Give freed memory back to the system: Python workers live on and serve stages of other needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which releases memory when its task is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run) for columns of any name (those with dots are no names to mapInArrow): run reads them by place."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(tidy(run), schema)


def filter_rows(df: DataFrame, keep: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of df for which the function that keep() makes in a worker says so; columns stay as they are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for batch in batches:
            yield batch.filter(pa.array(decide(batch), pa.bool_())).rename_columns(names)

    return map_rows(df, run, df.schema)


def table(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
