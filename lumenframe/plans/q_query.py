"""Query/retrieve and hierarchy queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.query import ImageQuery, level_counts, retrieve, sop_class
from . import bridge

W = bridge.with_views


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CT or MR studies of 1997 of patients named Customer^00000001*, with what matches in each."""
    q = ImageQuery.for_studies().with_patient_name("Customer^00000001*").with_study_date_range("19970101", "19971231").with_modality("CT", "MR")
    return q.run(bridge.images(spark, sf_dir))


def _q(make: Callable[[], ImageQuery]) -> Callable[[SparkSession, str], DataFrame]:
    """A query from a builder, which needs a session for its columns."""
    return lambda spark, sf_dir: make().run(bridge.images(spark, sf_dir))


def join_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, i = bridge.patients(spark, sf_dir), bridge.studies(spark, sf_dir), bridge.images(spark, sf_dir)
    per_study = i.groupBy("study_uid").agg(F.count(F.lit(1)).alias("n_images"), F.count_distinct("series_uid").alias("n_series"))
    return p.select("patient_id", "patient_name", "segment").join(s.select("patient_id", "study_uid", "study_date"), "patient_id").join(per_study, "study_uid")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = bridge.read(spark, sf_dir, "nation"), bridge.read(spark, sf_dir, "region")
    sites = F.broadcast(nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("nation_key"), F.col("r_name").alias("site")))  # 25 rows
    s = bridge.studies(spark, sf_dir).groupBy("custkey").agg(F.count(F.lit(1)).alias("n"))
    return bridge.patients(spark, sf_dir).join(sites, "nation_key").join(s, "custkey", "left").groupBy("site", "segment").agg(F.count(F.lit(1)).alias("n_patients"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_studies"))


def no_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.patients(spark, sf_dir).join(bridge.studies(spark, sf_dir).where("study_date between '19970101' and '19970331'"), "custkey", "left_anti").select("patient_id", "patient_name")


def sop_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r, v, sop_class(r, v)) for r in ("patient", "study") for v in ("find", "move", "get")]
    levels = bridge.studies(spark, sf_dir).select(F.expr("CASE orderkey % 2 WHEN 0 THEN 'patient' ELSE 'study' END").alias("root"), F.expr("CASE orderkey % 3 WHEN 0 THEN 'find' WHEN 1 THEN 'move' ELSE 'get' END").alias("verb"))
    return levels.groupBy("root", "verb").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(spark.createDataFrame(rows, "root string, verb string, sop_class string")), ["root", "verb"])


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ImageQuery.for_series().with_modality("US").with_study_date_range("19960101", "19960630")
    return retrieve(bridge.images(spark, sf_dir), q, "ARCHIVE").select("sop_uid", "series_uid", "destination", "status")


QUERIES = {
    "qr_flagship": flagship,
    "qr_find_patient": _q(lambda: ImageQuery.for_patients().with_patient_id("PAT00000001*")),
    "qr_find_study": _q(lambda: ImageQuery.for_studies().with_study_date_range("19980101", None)),
    "qr_find_series": _q(lambda: ImageQuery.for_series().with_modality("XA").with_study_date_range(None, "19960301")),
    "qr_find_image": _q(lambda: ImageQuery.for_images().with_modality("ES").with_study_date("19960102").return_field("n_rows")),
    "qr_wildcard_name": _q(lambda: ImageQuery.for_patients().with_patient_name("Customer^0000000?5")),
    "qr_date_range": _q(lambda: ImageQuery.for_studies().with_study_date_range("19970301", "19970331")),
    "qr_modality_in": _q(lambda: ImageQuery.for_studies().with_modality("CT", "MR", "US")),
    "qr_universal_match": _q(lambda: ImageQuery.for_patients().with_patient_name("")),
    "qr_level_rollup": lambda spark, sf_dir: level_counts(bridge.images(spark, sf_dir)),
    "qr_sop_class": sop_classes,
    "qr_move": moved,
    "join_hierarchy": join_hierarchy,
    "join_sites": segments,
    "join_anti_no_studies": no_studies,
}

_STUDY = "patient_id, study_uid, any_value(patient_name) AS patient_name, any_value(study_date) AS study_date, any_value(accession) AS accession, any_value(description) AS description, count(*) AS n_images, count(DISTINCT series_uid) AS n_series, array_to_string(list_sort(list(DISTINCT modality)), chr(92)) AS modalities FROM images WHERE {} GROUP BY patient_id, study_uid"
_PATIENT = "patient_id, any_value(patient_name) AS patient_name, count(*) AS n_images, count(DISTINCT study_uid) AS n_studies, count(DISTINCT series_uid) AS n_series, array_to_string(list_sort(list(DISTINCT modality)), chr(92)) AS modalities FROM images WHERE {} GROUP BY patient_id"
_I = W("images") + "SELECT "
SQL = {
    "qr_flagship": _I + _STUDY.format("starts_with(patient_name, 'Customer^00000001') AND study_date BETWEEN '19970101' AND '19971231' AND modality IN ('CT', 'MR')"),
    "qr_find_patient": _I + _PATIENT.format("starts_with(patient_id, 'PAT00000001')"),
    "qr_find_study": _I + _STUDY.format("study_date >= '19980101'"),
    "qr_find_series": _I + "patient_id, study_uid, series_uid, any_value(patient_name) AS patient_name, any_value(study_date) AS study_date, any_value(accession) AS accession, any_value(description) AS description, count(*) AS n_images, array_to_string(list_sort(list(DISTINCT modality)), chr(92)) AS modalities FROM images WHERE modality = 'XA' AND study_date <= '19960301' GROUP BY ALL",
    "qr_find_image": _I + "patient_id, study_uid, series_uid, sop_uid, patient_name, study_date, accession, description, modality, n_rows FROM images WHERE modality = 'ES' AND study_date = '19960102'",
    "qr_wildcard_name": _I + _PATIENT.format("regexp_full_match(patient_name, 'Customer\\^0000000.5')"),
    "qr_date_range": _I + _STUDY.format("study_date BETWEEN '19970301' AND '19970331'"),
    "qr_modality_in": _I + _STUDY.format("modality IN ('CT', 'MR', 'US')"),
    "qr_universal_match": _I + _PATIENT.format("true"),
    "qr_level_rollup": _I + "patient_id, study_uid, series_uid, count(*) AS n_images, CAST(grouping(patient_id, study_uid, series_uid) AS BIGINT) AS level_bits FROM images GROUP BY ROLLUP (patient_id, study_uid, series_uid)",
    "qr_sop_class": W("studies") + "SELECT root, verb, count(*) AS n, '1.2.840.10008.5.1.4.1.2.' || CASE root WHEN 'patient' THEN '1' ELSE '2' END || '.' || CASE verb WHEN 'find' THEN '1' WHEN 'move' THEN '2' ELSE '3' END AS sop_class FROM (SELECT CASE orderkey % 2 WHEN 0 THEN 'patient' ELSE 'study' END AS root, CASE orderkey % 3 WHEN 0 THEN 'find' WHEN 1 THEN 'move' ELSE 'get' END AS verb FROM studies) GROUP BY root, verb",
    "qr_move": W("images") + "SELECT sop_uid, series_uid, 'ARCHIVE' AS destination, CAST(0 AS INT) AS status FROM images WHERE series_uid IN (SELECT series_uid FROM images WHERE modality = 'US' AND study_date BETWEEN '19960101' AND '19960630')",
    "join_hierarchy": W("patients", "studies", "images") + "SELECT s.study_uid, p.patient_id, p.patient_name, p.segment, s.study_date, count(*) AS n_images, count(DISTINCT i.series_uid) AS n_series FROM patients p JOIN studies s USING (patient_id) JOIN images i ON i.study_uid = s.study_uid GROUP BY ALL",
    "join_sites": W("patients", "studies") + "SELECT r_name AS site, segment, count(*) AS n_patients, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_studies FROM patients JOIN nation ON n_nationkey = nation_key JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT custkey, count(*) AS n FROM studies GROUP BY custkey) s USING (custkey) GROUP BY ALL",
    "join_anti_no_studies": W("patients", "studies") + "SELECT patient_id, patient_name FROM patients WHERE custkey NOT IN (SELECT custkey FROM studies WHERE study_date BETWEEN '19970101' AND '19970331')",
}
