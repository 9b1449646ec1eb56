"""Files that arrive in a folder: a stream of parsed instances, without duplicates, into a sink that retries."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import reader

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# Statuses of a store.
SUCCESS, DUPLICATE, NO_RESOURCES, NO_HANDLER, FAILED = 0x0000, 0x0111, 0xA700, 0xA900, 0x0110


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100, pattern: str = "*.dcm") -> DataFrame:
    """(file, length, modified, content) of new files; files_per_trigger bounds what is taken on at a time."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return stream.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), "content")


def instances(files: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Parsed instances of a stream of files, the first of each SOP instance within the watermark."""
    rows = reader.instances(files).withColumn("seen", F.current_timestamp())
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["sop_uid"])


def store_status(instances: DataFrame, most_bytes: int = 512 << 20, handled: bool = True) -> DataFrame:
    """instances with the status that a store of each gets before its handler runs."""
    status = F.when(F.lit(not handled), NO_HANDLER).when(F.col("length") > most_bytes, NO_RESOURCES).when(F.col("parse_error").isNotNull(), FAILED).otherwise(SUCCESS)
    return instances.withColumn("status", status)


def into_table(stream: DataFrame, path: str, checkpoint: str, retries: int = 3, wait: float = 0.5, write: Callable[[DataFrame, int], None] | None = None, **trigger: object) -> StreamingQuery:
    """Each batch as its own folder of a Parquet table, which makes a repeated batch replace itself; failures are tried again."""

    def store(batch: DataFrame, number: int) -> None:
        for k in range(retries + 1):
            try:
                if write:
                    write(batch, number)
                else:
                    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
                return
            except Exception:
                if k == retries:
                    raise
                time.sleep(wait * 2**k)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
