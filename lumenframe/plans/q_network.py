"""Associations, messages and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import values
from ..sources import shared
from ..streaming import association, dimse
from . import bridge

W = bridge.with_views


def assoc_state_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association.replay(bridge.events(spark, sf_dir))


def assoc_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = association.sessions(bridge.events(spark, sf_dir), "6 hours")
    return s.groupBy("assoc").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("most"), F.sum("n").alias("n_events"))


def dimse_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bridge.read(spark, sf_dir, "conversations")
    pdvs = c.select(F.col("conv_id").alias("assoc"), F.lit(1).alias("ctx"), F.lit(1).alias("message"), F.col("turn").alias("seq"), (F.col("turn") >= 1).alias("last"), F.coalesce("text", F.lit("")).alias("data"))
    return dimse.reassemble(pdvs).select("assoc", "n_fragments", "n_bytes", F.sha2("payload", 256).alias("payload_sha256"))


def suboperation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.events(spark, sf_dir).withColumn("category", values.status_category(F.expr("CASE event_id % 5 WHEN 0 THEN 45056 WHEN 1 THEN 272 ELSE 0 END")))
    return dimse.progress(rows).select("assoc", "event_id", "completed", "failed", "warning", "remaining", "final")


def transfer_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.events(spark, sf_dir).groupBy("assoc").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event") == "pdata").alias("done"))
    p = values.progress(F.col("done"), F.col("total"), F.lit(10))
    return rows.select("assoc", "total", "done", F.round(p["percent"], 6).alias("percent"), F.round(p["eta"], 6).alias("eta"))


def first_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the contexts accepted for each class the first one: classes are modalities here, contexts images."""
    i = bridge.images(spark, sf_dir)
    return i.groupBy("modality").agg(F.min_by(F.struct("series_uid", "l_linenumber"), F.struct("sop_uid", "l_linenumber")).alias("f"), F.min("sop_uid").alias("context")).select("modality", "context", F.col("f.series_uid").alias("series_uid"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = bridge.read(spark, sf_dir, "events").schema
    return bridge.view(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir), bridge.EVENTS)


def _finish(stream: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """All that a stream gives for the input that is there now: written to the shared folder, a part a batch.

    A complete result is that of its last batch; an update of a key replaces earlier ones.
    """
    spark = stream.sparkSession
    path = shared.new_path(spark, "stream")
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/rows/batch=-1")  # there is a table even without a batch

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")  # a batch that runs again replaces itself

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{path}/rows")
    names = [c for c in rows.columns if c != "batch"]
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0])
    elif key is not None:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*names), "batch").alias("last")).select("last.*")
    return rows.select(*names)


def stream_dedup_sop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each event number seen; rows of one batch are never late."""
    s = _stream(spark, sf_dir).withColumn("sop", F.col("event_id") % 100)
    return _finish(s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3650 days").dropDuplicatesWithinWatermark(["sop"]).select("sop"), "append")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w"), "event").agg(F.count(F.lit(1)).alias("n"))
    return _finish(s.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event", "n"), "complete")


def stream_assoc_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finish(association.stream_states(_stream(spark, sf_dir)), "update", "assoc")


QUERIES = {f.__name__: f for f in (assoc_state_replay, assoc_sessions, dimse_reassemble, suboperation_progress, transfer_progress, first_context, stream_dedup_sop, stream_window_counts, stream_assoc_states)}

_REPLAY = W("assoc_events", more="b AS (SELECT *, coalesce(last_value(CASE event WHEN 'connect' THEN 6 WHEN 'pdata' THEN NULL ELSE 1 END IGNORE NULLS) OVER (PARTITION BY assoc ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS st, coalesce(last_value(CASE event WHEN 'connect' THEN 6 WHEN 'pdata' THEN NULL ELSE 1 END IGNORE NULLS) OVER (PARTITION BY assoc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 1) AS after, row_number() OVER (PARTITION BY assoc ORDER BY ts DESC, event_id DESC) AS r FROM assoc_events)") + "SELECT assoc, count(*) AS n_events, CAST(max(after) FILTER (r = 1) AS INT) AS state, CAST(sum(CASE WHEN st = 6 AND event = 'connect' THEN 3 WHEN st = 1 AND event = 'pdata' THEN 1 WHEN st = 1 AND event = 'release' THEN 3 ELSE 0 END) AS INT) AS errors FROM b GROUP BY assoc"
SQL = {
    "assoc_state_replay": _REPLAY,
    "stream_assoc_states": _REPLAY,
    "assoc_sessions": W("assoc_events", more="g AS (SELECT assoc, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY assoc ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM assoc_events), s AS (SELECT assoc, sum(fresh) OVER (PARTITION BY assoc ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT assoc, s, count(*) AS n FROM s GROUP BY ALL)") + "SELECT assoc, count(*) AS n_sessions, max(n) AS most, CAST(sum(n) AS BIGINT) AS n_events FROM c GROUP BY assoc",
    "dimse_reassemble": "SELECT conv_id AS assoc, CAST(count(*) AS INT) AS n_fragments, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_bytes, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, text)) AS payload_sha256 FROM conversations GROUP BY conv_id HAVING bool_or(turn >= 1)",
    "suboperation_progress": W("assoc_events") + "SELECT assoc, event_id, count(*) FILTER (event_id % 5 > 1) OVER w AS completed, count(*) FILTER (event_id % 5 = 1) OVER w AS failed, count(*) FILTER (event_id % 5 = 0) OVER w AS warning, count(*) OVER (PARTITION BY assoc) - count(*) OVER w AS remaining, count(*) OVER (PARTITION BY assoc) = count(*) OVER w AS final FROM assoc_events WINDOW w AS (PARTITION BY assoc ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "transfer_progress": W("assoc_events") + "SELECT assoc, total, done, round(done * 100.0e0 / total, 6) AS percent, CASE WHEN done > 0 THEN round((total - done) * 10.0e0 / done, 6) END AS eta FROM (SELECT assoc, count(*) AS total, count(*) FILTER (event = 'pdata') AS done FROM assoc_events GROUP BY assoc)",
    "first_context": W("images") + "SELECT modality, sop_uid AS context, series_uid FROM (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY sop_uid, l_linenumber) AS r FROM images) WHERE r = 1",
    "stream_dedup_sop": W("assoc_events") + "SELECT DISTINCT event_id % 100 AS sop FROM assoc_events",
    "stream_window_counts": W("assoc_events") + "SELECT strftime(ts, '%Y-%m-%d') AS day, event, count(*) AS n FROM assoc_events GROUP BY ALL",
}
