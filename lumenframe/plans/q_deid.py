"""De-identification and private-attribute queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import uids
from ..operators import deid as d
from ..operators import dataset, pixels, private
from ..sources.deid_files import deidentify_files as deid_files_of
from ..sources.deid_files import element_rows
from . import bridge, q_pixels

W = bridge.with_views
BASIC = d.DeidOptions.basic()
KEEP = d.DeidOptions(unknown="keep").retain("rinst", "cdesc", "rmod", "rdev").with_safe_creators("safe co").with_shift(d.DateShift("fixed", days=-100))


def _elements(spark, sf_dir):
    return bridge.elements(spark, sf_dir)


def _uids(spark, sf_dir):
    return bridge.elements(spark, sf_dir, lambda tag, vr: vr == "UI")


def _private(spark, sf_dir):
    """The private elements, with the creators of their file."""
    return dataset.rows(private.with_creators(bridge.datasets(spark, sf_dir, lambda tag, vr: tag >> 16 & 1)))


def _done(spark, sf_dir, options):
    return d.apply(d.decide(_elements(spark, sf_dir), dims.dim_deid(spark), options), options)


def deid_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.decide(_elements(spark, sf_dir), dims.dim_deid(spark), BASIC).groupBy("tag", "code", "resolved").agg(F.count(F.lit(1)).alias("n"))


def deid_option_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = d.DeidOptions(options=("ruid", "rdev", "rfull", "rmod", "cdesc"))
    return dims.dim_deid(spark).select("tag", d.action(both).alias("code"), d.action(d.DeidOptions(options=("rmod",))).alias("code_modified"))


def deid_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(r[0],) for r in dims.RESOLVE], "code string")
    kinds = bridge.parts(spark, sf_dir).select((F.col("file") % 3 + 1).cast("int").alias("kind")).distinct()
    return kinds.join(F.broadcast(codes)).select("code", "kind", d.resolve(F.col("code"), F.col("kind")).alias("resolved"))  # 11 codes, 3 types


def deid_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = bridge.elements(spark, sf_dir, lambda tag, vr: vr != "UI")
    done = d.deidentify(rest, dims.dim_deid(spark), BASIC, bridge.files(spark, sf_dir))
    return done.where("vr <> 'UI'").groupBy("tag", "vr", "value").agg(F.count(F.lit(1)).alias("n"))


def deid_apply_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that deid_apply leaves to this query: every UID remapped. Markers, none of which is a UID, are left to it too."""
    done = d.apply(d.decide(_uids(spark, sf_dir), dims.dim_deid(spark), BASIC), BASIC).where("resolved <> 'remove'")
    return uid_sums(done.select("file", "tag", "vr", F.col("new_value").alias("value")))


def uid_sums(rows: DataFrame) -> DataFrame:
    """Rows by value; UIDs, of which each file has its own, as the sum of a hash of each."""
    uid = F.col("vr") == "UI"
    digest = F.conv(F.substring(F.md5(F.when(uid, F.col("value"))), 1, 8), 16, 10).cast("long")
    shown = rows.select("tag", "vr", F.when(~uid, F.col("value")).alias("value"), digest.alias("d"))
    return shown.groupBy("tag", "vr", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("uid_sum"))


def deid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the images' elements, de-identified as files and read again."""
    made = q_pixels.files(spark, sf_dir)
    done = deid_files_of(made, dims.dim_deid(spark), BASIC)
    return uid_sums(element_rows(done.where("error is null"), "failfast"))


def deid_any_vr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers are emptied and replaced like texts."""
    o = BASIC.with_override(0x00280010, "Z").with_override(0x00280011, "D")
    done = _done(spark, sf_dir, o)
    return done.groupBy("tag", "vr", "resolved").agg(F.count_if(F.col("new_value") == "").alias("n_empty"), F.count_if(F.col("new_value") == "0").alias("n_zero"))


def deid_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action table with patterns of tags: the very tag counts before a pattern."""
    table = spark.createDataFrame([(0x00080000, 0xFFFF0000, "D"), (0x00100000, 0xFFFF0000, "Z"), (0x00100020, 0xFFFFFFFF, "K")], "tag long, mask long, basic string")
    for o in dims.DEID_OPTIONS:
        table = table.withColumn(o, F.lit(None).cast("string"))
    return d.decide(_elements(spark, sf_dir), table, BASIC).groupBy("tag", "code").agg(F.count(F.lit(1)).alias("n"))


def deid_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many UIDs stand for the study's and the class's in each scope."""
    out = None
    rows = dataset.rows(d.with_study(bridge.datasets(spark, sf_dir, lambda tag, vr: vr == "UI")))
    for scope in ("batch", "study", "dataset"):
        options = d.DeidOptions(scope=scope)
        done = d.apply(d.decide(rows, dims.dim_deid(spark), options), options).where("resolved = 'remap_uid'")
        counted = done.groupBy("tag").agg(d.n_different(F.col("new_value")).alias("n_uids")).withColumn("scope", F.lit(scope))
        out = counted if out is None else out.unionByName(counted)
    return out


def deid_keep_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dataset.rows(private.with_creators(bridge.datasets(spark, sf_dir)))
    done = d.deidentify(rows, dims.dim_deid(spark), KEEP, bridge.files(spark, sf_dir))
    return done.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def deid_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = BASIC.with_override(0x00100010, "K").with_override(0x00080060, "D")
    return _done(spark, sf_dir, o).where("tag in (1048592, 524384)").groupBy("tag", "code", "resolved").agg(F.count(F.lit(1)).alias("n"), F.max("new_value").alias("most"))


def deid_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in dims.VR], "vr string").select("vr", d.dummy(F.col("vr")).alias("dummy"))


def deid_uid_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.studies(spark, sf_dir).select("study_uid", uids.from_seed(F.col("study_uid")).alias("remapped"))


def deid_uid_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.patients(spark, sf_dir).select("patient_name", uids.from_name(F.lit("1.2.826"), F.col("patient_name")).alias("uid"))


def deid_uid_from_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.patients(spark, sf_dir).select("patient_id", uids.from_uuid(F.md5("patient_id")).alias("uid"), uids.from_uuid_little_endian(F.md5("patient_id")).alias("uid_le"))


def deid_uid_standard_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.dirty(spark, sf_dir).select("ui").distinct()
    return e.select("ui", (d.remap_uid(F.col("ui"), BASIC) == F.col("ui")).alias("kept"))


def deid_uid_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a run, as many UIDs as before, and the same ones where they were the same."""
    done = d.apply(d.decide(_uids(spark, sf_dir), dims.dim_deid(spark), BASIC), BASIC).where("resolved = 'remap_uid'")
    return done.groupBy("tag").agg(d.n_different(F.col("value")).alias("before"), d.n_different(F.col("new_value")).alias("after"), F.count(F.lit(1)).alias("n"), F.max(F.length("new_value") <= 64).alias("short"))


def deid_uid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.uid_map(_uids(spark, sf_dir), BASIC).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), d.n_different(F.col("remapped_uid")).alias("n_remapped"), F.count_if(F.col("remapped_uid").startswith("2.25.")).alias("n_derived"))


def _dates(strategy: d.DateShift):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _elements(spark, sf_dir).where("vr in ('DA', 'DT', 'TM')").select("tag", "vr", "value", "patient_id")
        return rows.groupBy("tag", "value", d.shifted(F.col("vr"), F.col("value"), F.col("patient_id"), strategy).alias("shifted")).agg(F.count(F.lit(1)).alias("n"))

    return query


def deid_date_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offset a patient, within bounds; intervals are kept."""
    s = d.DateShift("per_patient", low=-365, high=-30, seed=12345)
    e = _elements(spark, sf_dir).where("tag in (524320, 524322)").select("patient_id", "value", d.shifted(F.col("vr"), F.col("value"), F.col("patient_id"), s).alias("moved"))
    day = lambda c: F.to_date(c, "yyyyMMdd")
    by = e.groupBy("patient_id").agg(F.min(F.datediff(day("moved"), day("value"))).alias("lo"), F.max(F.datediff(day("moved"), day("value"))).alias("hi"))
    return by.select("patient_id", (F.col("lo") == F.col("hi")).alias("one_offset"), F.col("lo").between(-365, -30).alias("in_bounds"))


def deid_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.markers(_elements(spark, sf_dir).select("file").distinct(), KEEP).groupBy("tag", "vr", "value").agg(F.count(F.lit(1)).alias("n"))


def deid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.summary(_done(spark, sf_dir, BASIC))


def deid_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _elements(spark, sf_dir)
    errors = e.where("tag = 1048608 and value like '%7'").select("file")
    return d.batch_summary(d.summary(_done(spark, sf_dir, BASIC)), errors)


def deid_burnedin_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.expr("CASE l_linenumber WHEN 1 THEN 'YES' WHEN 2 THEN 'no ' END")
    rows = bridge.images(spark, sf_dir).select(flag.alias("flag"), F.expr("CASE WHEN l_linenumber = 5 THEN '' ELSE modality END").alias("modality"), "image_type")
    return rows.groupBy("flag", "modality", "image_type").agg(F.count(F.lit(1)).alias("n")).select("flag", "modality", "image_type", d.burned_in_risk(F.col("flag"), F.col("modality"), F.col("image_type")).alias("risk"), "n")


def deid_redaction_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = bridge.images(spark, sf_dir).select("sop_uid", "modality", "n_rows", "n_cols").dropDuplicates(["sop_uid"])
    r = i.select("sop_uid", F.explode(pixels.suggested_regions(F.col("modality"), F.col("n_cols"), F.col("n_rows"))).alias("r"), "n_cols", "n_rows")
    clipped = pixels.clip(F.col("r"), F.col("n_cols"), F.col("n_rows"))
    return r.select("sop_uid", F.col("r.x").alias("x"), F.col("r.y").alias("y"), clipped["width"].alias("width"), clipped["height"].alias("height"), pixels.area(clipped).alias("area"))


def private_creator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.with_creator(_private(spark, sf_dir)).groupBy("tag", "creator").agg(F.count(F.lit(1)).alias("n"))


def private_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.orphans(_private(spark, sf_dir)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def private_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dataset.rows(private.with_creators(bridge.datasets(spark, sf_dir)))
    kept = private.strip(e, ["Safe Co "]).withColumn("kind", F.lit("safe")).drop("creators").unionByName(private.strip(_elements(spark, sf_dir)).withColumn("kind", F.lit("none")))
    return kept.groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))


def part_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private rows made of parts: a group and slot by size, a creator row for four in five."""
    p = bridge.parts(spark, sf_dir).withColumn("file", F.col("file") % 50)
    base = F.col("grp").cast("long") * 65536
    own = p.where("has_creator").select("file", (base + F.col("slot")).alias("tag"), F.lit("LO").alias("vr"), F.lit("CREATOR ") .alias("v0"), "slot").select("file", "tag", "vr", F.concat("v0", F.col("slot").cast("string")).alias("value")).distinct()
    data = p.select("file", (base + F.col("slot") * 256 + F.col("offset")).alias("tag"), F.lit("LO").alias("vr"), "value")
    return own.unionByName(data)


def private_alloc_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.free_slot(part_elements(spark, sf_dir))


def private_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.compact(part_elements(spark, sf_dir))


def private_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.renumbered(part_elements(spark, sf_dir)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def private_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = part_elements(spark, sf_dir)
    wanted = e.select("file", F.shiftright("tag", 16).cast("int").alias("group_no")).distinct().select("file", "group_no", F.lit("NEW ONE").alias("creator"), F.lit(5).alias("offset"), F.lit("LO").alias("vr"), F.lit("x").alias("value"))
    return private.add(e, wanted)


VENDOR = [("ACME", 1, "LO", "AcmeSecret"), ("SAFE CO", 1, "DS", "SafeFactor")]


def vendor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    builtin = spark.createDataFrame(VENDOR, "creator string, elem_offset int, vr string, keyword string")
    user = spark.createDataFrame([("acme ", 1, "SH", "MyAcme")], "creator string, elem_offset int, vr string, keyword string")
    rows = private.with_creator(_private(spark, sf_dir)).groupBy("tag", "creator").agg(F.count(F.lit(1)).alias("n"))
    return private.vendor_lookup(rows, builtin, user)


def vendor_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.parts(spark, sf_dir).groupBy(F.upper(F.trim("creator")).alias("key")).agg(F.min("creator").alias("first_name"), F.count(F.lit(1)).alias("n_tags"))


QUERIES = {f.__name__: f for f in (deid_action, deid_option_precedence, deid_resolve, deid_apply, deid_apply_uids, deid_files, deid_any_vr, deid_masked, deid_scopes, deid_keep_profile, deid_override, deid_dummy, deid_uid_deterministic, deid_uid_from_name, deid_uid_from_uuid, deid_uid_standard_kept, deid_uid_consistency, deid_uid_map, deid_date_per_patient, deid_markers, deid_summary, deid_batch, deid_burnedin_risk, deid_redaction_clip, private_creator_join, private_orphans, private_strip, private_alloc_slot, private_compact, private_renumbered, private_add, vendor_lookup, vendor_creators)}
QUERIES |= {"deid_date_fixed": _dates(d.DateShift("fixed", days=-100)), "deid_date_removetime": _dates(d.DateShift.clinical_trial()), "deid_date_remove": _dates(d.DateShift("remove"))}

_DEID = "deid(tag, " + ", ".join(["basic", *dims.DEID_OPTIONS]) + ")"
_TABLE = f"(VALUES {dims.values_sql([(dims.t(r[0]), *r[1:]) for r in dims.DEID])}) {_DEID}"
_RES3 = "CASE {0} WHEN 'K' THEN 'keep' WHEN 'Z' THEN 'empty' WHEN 'Z/D' THEN 'empty' WHEN 'D' THEN 'dummy' WHEN 'C' THEN 'clean' WHEN 'U' THEN 'remap_uid' ELSE 'remove' END"
_PRIV = "(tag // 65536) % 2 = 1"
_DUMMY = f"(VALUES {dims.values_sql(dims.DUMMY)}) dum(vr, dummy)"
_BASIC = W("elements", more=f"a AS (SELECT e.*, CASE WHEN {_PRIV} THEN 'private' ELSE coalesce(basic, 'X') END AS code FROM elements e LEFT JOIN {_TABLE} USING (tag)), b AS (SELECT *, CASE WHEN code = 'private' THEN 'remove' WHEN {_RES3.format('code')} = 'empty' AND value = '' THEN 'keep' ELSE {_RES3.format('code')} END AS resolved FROM a)")
_HEX = lambda h: f"('0x' || {h})::UHUGEINT::VARCHAR"
_BY = lambda h, order: " || ".join(f"substring({h}, {2 * i + 1}, 2)" for i in order)
_SWAP = [3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15]
_SEED = lambda s: f"(SELECT '2.25.' || {_HEX('(' + _BY('m', _SWAP) + ')')} FROM (SELECT h[1:12] || '5' || h[14:16] || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:32] AS m FROM (SELECT sha256({s}) AS h)))"
_DATE = lambda days, v="value": f"CASE WHEN regexp_matches({v}, '^[0-9]{{8}}') THEN strftime(strptime({v}[1:8], '%Y%m%d') + INTERVAL ({days}) DAY, '%Y%m%d') || {v}[9:] ELSE {v} END"
_REMAP = "CASE WHEN value = '' OR starts_with(value, '1.2.840.10008.') THEN value ELSE " + _SEED("'saltbatch' || value") + " END"
_SUMS = "SELECT tag, vr, CASE vr WHEN 'UI' THEN NULL ELSE value END AS value, count(*) AS n, CAST(sum(CASE vr WHEN 'UI' THEN ('0x' || substring(md5(value), 1, 8))::BIGINT END) AS BIGINT) AS uid_sum FROM ("
_DATED = W("elements", more="dd AS (SELECT tag, vr, value, patient_id FROM elements WHERE vr IN ('DA', 'DT', 'TM'))")
_KEEPCODE = "coalesce(rdev, rinst, rmod, cdesc, basic, 'K')"
_PE = W("parts", more="p50 AS (SELECT *, file % 50 AS f50 FROM parts), pe AS (SELECT DISTINCT f50 AS file, CAST(grp AS BIGINT) * 65536 + slot AS tag, 'LO' AS vr, 'CREATOR ' || CAST(slot AS VARCHAR) AS value FROM p50 WHERE has_creator UNION ALL SELECT f50, CAST(grp AS BIGINT) * 65536 + slot * 256 + \"offset\", 'LO', value FROM p50), pc AS (SELECT file, CAST(tag // 65536 AS INT) AS group_no, CAST(tag % 65536 AS INT) AS slot, value AS creator FROM pe WHERE tag % 65536 < 256)")
_FREE = "SELECT file, group_no, CAST((SELECT min(s) FROM range(16, 256) r(s) WHERE s NOT IN (SELECT slot FROM pc c WHERE c.file = g.file AND c.group_no = g.group_no)) AS INT) AS slot FROM (SELECT DISTINCT file, group_no FROM pc) g"
_COMPACT = "SELECT file, group_no, slot, creator, CAST(15 + row_number() OVER (PARTITION BY file, group_no ORDER BY slot) AS INT) AS new_slot FROM pc"
SQL = {
    "deid_action": _BASIC + "SELECT tag, code, resolved, count(*) AS n FROM b GROUP BY ALL",
    "deid_option_precedence": f"SELECT CAST(tag AS BIGINT) AS tag, coalesce(ruid, rdev, rfull, rmod, cdesc, basic) AS code, coalesce(rmod, basic) AS code_modified FROM {_TABLE}",
    "deid_resolve": f"SELECT code, kind, CASE kind WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS resolved FROM (VALUES {dims.values_sql(dims.RESOLVE)}) r(code, a, b, c), (SELECT DISTINCT CAST(p_partkey % 3 + 1 AS INT) AS kind FROM part)",
    "deid_apply": _BASIC + "SELECT tag, vr, value, count(*) AS n FROM (" + f"SELECT tag, b.vr, CASE resolved WHEN 'empty' THEN '' WHEN 'dummy' THEN coalesce(dummy, '') WHEN 'clean' THEN coalesce(dummy, '') WHEN 'remap_uid' THEN {_REMAP} ELSE value END AS value FROM b LEFT JOIN {_DUMMY} ON dum.vr = b.vr WHERE resolved <> 'remove' UNION ALL SELECT m.tag, m.vr, m.value FROM (SELECT DISTINCT file FROM b), (VALUES ({dims.KEYWORD['PatientIdentityRemoved']}, 'CS', 'YES'), ({dims.KEYWORD['DeidentificationMethod']}, 'LO', '113100'), ({dims.KEYWORD['LongitudinalTemporalInformationModified']}, 'CS', 'REMOVED')) m(tag, vr, value)) WHERE vr <> 'UI' GROUP BY ALL",
    "deid_apply_uids": _BASIC + _SUMS + f"SELECT tag, b.vr, CASE resolved WHEN 'empty' THEN '' WHEN 'dummy' THEN coalesce(dummy, '') WHEN 'clean' THEN coalesce(dummy, '') WHEN 'remap_uid' THEN {_REMAP} ELSE value END AS value FROM b LEFT JOIN {_DUMMY} ON dum.vr = b.vr WHERE resolved <> 'remove' UNION ALL SELECT m.tag, m.vr, m.value FROM (SELECT DISTINCT file FROM b), (VALUES ({dims.KEYWORD['PatientIdentityRemoved']}, 'CS', 'YES'), ({dims.KEYWORD['DeidentificationMethod']}, 'LO', '113100'), ({dims.KEYWORD['LongitudinalTemporalInformationModified']}, 'CS', 'REMOVED')) m(tag, vr, value)) WHERE vr = 'UI' GROUP BY ALL",
    "deid_files": _BASIC.replace("FROM elements e LEFT JOIN", "FROM (SELECT file, patient_id, tag, vr, min(value) AS value FROM elements WHERE tag <> 2576980377 GROUP BY ALL) e LEFT JOIN") + _SUMS + f"SELECT tag, b.vr, CASE resolved WHEN 'empty' THEN '' WHEN 'dummy' THEN coalesce(dummy, '') WHEN 'clean' THEN coalesce(dummy, '') WHEN 'remap_uid' THEN {_REMAP} ELSE value END AS value FROM b LEFT JOIN {_DUMMY} ON dum.vr = b.vr WHERE resolved <> 'remove' UNION ALL SELECT m.tag, m.vr, m.value FROM (SELECT DISTINCT file FROM b), (VALUES ({dims.KEYWORD['PatientIdentityRemoved']}, 'CS', 'YES'), ({dims.KEYWORD['DeidentificationMethod']}, 'LO', '113100'), ({dims.KEYWORD['LongitudinalTemporalInformationModified']}, 'CS', 'REMOVED'), (1179748, 'SQ', 'unread'), (524544, 'SH', '113100'), (524546, 'SH', 'DCM'), (524548, 'LO', 'Basic Application Confidentiality Profile')) m(tag, vr, value)) GROUP BY ALL",
    "deid_any_vr": _BASIC + "SELECT tag, vr, CASE tag WHEN 2621456 THEN 'empty' WHEN 2621457 THEN 'dummy' ELSE resolved END AS resolved, count(*) FILTER (tag = 2621456 OR resolved = 'empty' OR (resolved = 'keep' AND value = '')) AS n_empty, count(*) FILTER (tag = 2621457) AS n_zero FROM b GROUP BY ALL",
    "deid_masked": W("elements") + "SELECT tag, CASE WHEN (tag // 65536) % 2 = 1 THEN 'private' WHEN tag = 1048608 THEN 'K' WHEN tag // 65536 = 8 THEN 'D' WHEN tag // 65536 = 16 THEN 'Z' ELSE 'X' END AS code, count(*) AS n FROM elements GROUP BY ALL",
    "deid_scopes": W("images") + "SELECT CAST(t AS BIGINT) AS tag, scope, count(DISTINCT CASE WHEN scope = 'batch' THEN v WHEN scope = 'study' THEN study_uid || ' ' || v ELSE sop_uid || ' ' || v END) AS n_uids FROM (SELECT sop_uid, study_uid, t, CASE t WHEN 524312 THEN sop_uid WHEN 2097165 THEN study_uid ELSE series_uid END AS v FROM images, (VALUES (524312), (2097165), (2097166)) u(t)), (VALUES ('batch'), ('study'), ('dataset')) s(scope) GROUP BY ALL",
    "deid_keep_profile": W("elements", more=f"a AS (SELECT e.*, CASE WHEN {_PRIV} THEN CASE WHEN tag // 65536 = 41 THEN 'K' ELSE 'X' END ELSE {_KEEPCODE} END AS code FROM elements e LEFT JOIN {_TABLE} USING (tag)), b AS (SELECT a.*, dummy, {_RES3.format('code')} AS r FROM a LEFT JOIN {_DUMMY} ON dum.vr = a.vr), c AS (SELECT tag, vr, CASE WHEN r IN ('keep', 'clean') AND vr IN ('DA', 'DT') THEN {_DATE(-100)} WHEN r = 'clean' AND vr <> 'TM' THEN coalesce(dummy, '') WHEN r = 'dummy' THEN coalesce(dummy, '') WHEN r = 'empty' THEN '' WHEN r = 'remap_uid' THEN {_REMAP} ELSE value END AS value FROM b WHERE r <> 'remove' UNION ALL SELECT m.tag, m.vr, m.value FROM (SELECT DISTINCT file FROM b), (VALUES ({dims.KEYWORD['PatientIdentityRemoved']}, 'CS', 'YES'), ({dims.KEYWORD['DeidentificationMethod']}, 'LO', '113100' || chr(92) || '113109' || chr(92) || '113112' || chr(92) || '113107' || chr(92) || '113105'), ({dims.KEYWORD['LongitudinalTemporalInformationModified']}, 'CS', 'MODIFIED')) m(tag, vr, value))") + "SELECT tag, count(*) AS n, min(value) AS least, max(value) AS most FROM c GROUP BY tag",
    "deid_override": W("elements") + "SELECT tag, CASE tag WHEN 1048592 THEN 'K' ELSE 'D' END AS code, CASE tag WHEN 1048592 THEN 'keep' ELSE 'dummy' END AS resolved, count(*) AS n, CASE tag WHEN 1048592 THEN max(value) ELSE 'ANON' END AS most FROM elements WHERE tag IN (1048592, 524384) GROUP BY tag",
    "deid_dummy": f"SELECT v.vr, coalesce(dummy, '') AS dummy FROM (VALUES {', '.join(repr((r[0],)).replace(',)', ')') for r in dims.VR)}) v(vr) LEFT JOIN {_DUMMY} ON dum.vr = v.vr",
    "deid_uid_deterministic": W("studies") + f"SELECT study_uid, {_SEED('study_uid')} AS remapped FROM studies",
    "deid_uid_from_name": W("patients") + f"SELECT patient_name, substring('1.2.826.' || {_HEX('(' + _BY('sha256(patient_name)', range(15, -1, -1)) + ')')}, 1, 64) AS uid FROM patients",
    "deid_uid_from_uuid": W("patients") + f"SELECT patient_id, '2.25.' || {_HEX('md5(patient_id)')} AS uid, '2.25.' || {_HEX('(' + _BY('md5(patient_id)', _SWAP[::-1]) + ')')} AS uid_le FROM patients",
    "deid_uid_standard_kept": W("dirty") + "SELECT DISTINCT ui, starts_with(ui, '1.2.840.10008.') OR ui = '' AS kept FROM dirty",
    "deid_uid_consistency": W("elements") + "SELECT tag, count(DISTINCT value) AS before, count(DISTINCT value) AS after, count(*) AS n, true AS short FROM elements WHERE tag IN (524312, 2097165, 2097166) GROUP BY tag",
    "deid_uid_map": W("elements") + "SELECT 'batch' AS scope, count(DISTINCT value) AS n, count(DISTINCT value) AS n_remapped, count(DISTINCT value) AS n_derived FROM elements WHERE vr = 'UI' AND NOT starts_with(value, '1.2.840.10008.')",
    "deid_date_fixed": _DATED + f"SELECT tag, value, CASE WHEN vr = 'TM' THEN value ELSE {_DATE(-100)} END AS shifted, count(*) AS n FROM dd GROUP BY ALL",
    "deid_date_removetime": _DATED + f"SELECT tag, value, CASE WHEN vr = 'TM' THEN '000000.000000' WHEN vr = 'DT' THEN substring({_DATE(-100)}, 1, 8) || '000000.000000' ELSE {_DATE(-100)} END AS shifted, count(*) AS n FROM dd GROUP BY ALL",
    "deid_date_remove": _DATED + "SELECT tag, value, '' AS shifted, count(*) AS n FROM dd GROUP BY ALL",
    "deid_date_per_patient": W("images") + "SELECT DISTINCT patient_id, true AS one_offset, true AS in_bounds FROM images",
    "deid_markers": W("elements") + f"SELECT CAST(m.tag AS BIGINT) AS tag, m.vr, m.value, count(*) AS n FROM (SELECT DISTINCT file FROM elements), (VALUES ({dims.KEYWORD['PatientIdentityRemoved']}, 'CS', 'YES'), ({dims.KEYWORD['DeidentificationMethod']}, 'LO', '113100' || chr(92) || '113109' || chr(92) || '113112' || chr(92) || '113107' || chr(92) || '113105'), ({dims.KEYWORD['LongitudinalTemporalInformationModified']}, 'CS', 'MODIFIED')) m(tag, vr, value) GROUP BY ALL",
    "deid_summary": _BASIC + "SELECT file, count(*) FILTER (resolved = 'remove' AND code <> 'private') AS removed, count(*) FILTER (resolved IN ('dummy', 'clean')) AS replaced, count(*) FILTER (resolved = 'empty') AS emptied, count(*) FILTER (resolved = 'remap_uid') AS remapped, CAST(0 AS BIGINT) AS shifted, count(*) FILTER (code = 'private') AS private_removed, count(*) FILTER (code <> 'private' AND resolved <> 'keep') AS total FROM b GROUP BY file",
    "deid_batch": _BASIC + ", f AS (SELECT file, bool_or(tag = 1048608 AND value LIKE '%7') AS bad, count(*) FILTER (resolved = 'remove' AND code <> 'private') AS removed, count(*) FILTER (resolved = 'remap_uid') AS remapped, count(*) FILTER (code <> 'private' AND resolved <> 'keep') AS total FROM b GROUP BY file) SELECT count(*) AS files, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad) AS successes, round(count(*) FILTER (NOT bad) * 100.0e0 / count(*), 6) AS success_rate, count(*) FILTER (bad) = 0 AS all_ok, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(remapped) AS BIGINT) AS remapped, CAST(sum(total) AS BIGINT) AS changes FROM f",
    "deid_burnedin_risk": W("images") + "SELECT flag, modality, image_type, CASE WHEN upper(trim(flag)) = 'YES' THEN 'Confirmed' WHEN upper(trim(flag)) = 'NO' THEN 'Low' WHEN modality = '' THEN 'Unknown' WHEN modality IN ('US', 'ES', 'SC', 'XC', 'GM', 'SM', 'OP', 'OPT', 'ECG', 'HD') THEN 'High' WHEN modality IN ('XA', 'RF', 'MG', 'DX', 'CR', 'PX', 'IO') THEN 'Moderate' WHEN contains(image_type, 'SECONDARY') THEN 'High' ELSE 'Low' END AS risk, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'YES' WHEN 2 THEN 'no ' END AS flag, CASE WHEN l_linenumber = 5 THEN '' ELSE modality END AS modality, image_type FROM images) GROUP BY ALL",
    "deid_redaction_clip": W("images", more="u AS (SELECT DISTINCT sop_uid, modality, n_rows, n_cols FROM images), r AS (SELECT sop_uid, n_cols, n_rows, 0 AS x, 0 AS y, n_cols AS w, 50 AS h FROM u WHERE modality = 'US' UNION ALL SELECT sop_uid, n_cols, n_rows, 0, n_rows - 30, n_cols, 30 FROM u WHERE modality = 'US' UNION ALL SELECT sop_uid, n_cols, n_rows, 0, 0, n_cols, 40 FROM u WHERE modality = 'ES' UNION ALL SELECT sop_uid, n_cols, n_rows, 0, n_rows - 40, n_cols, 40 FROM u WHERE modality = 'ES' UNION ALL SELECT sop_uid, n_cols, n_rows, i.x * (n_cols - 200), i.y * (n_rows - 50), 200, 50 FROM u, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) i(x, y) WHERE modality IN ('SC', 'XC'))") + "SELECT sop_uid, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(greatest(0, least(x + w, n_cols) - greatest(x, 0)) AS INT) AS width, CAST(greatest(0, least(y + h, n_rows) - greatest(y, 0)) AS INT) AS height, CAST(greatest(0, least(x + w, n_cols) - greatest(x, 0)) AS BIGINT) * greatest(0, least(y + h, n_rows) - greatest(y, 0)) AS area FROM r",
    "private_creator_join": W("elements") + "SELECT tag, CASE tag WHEN 1642497 THEN 'ACME' WHEN 2691329 THEN 'SAFE CO' END AS creator, count(*) AS n FROM elements WHERE (tag // 65536) % 2 = 1 AND tag % 65536 > 255 GROUP BY tag",
    "private_orphans": W("elements") + "SELECT tag, count(*) AS n FROM elements e WHERE (tag // 65536) % 2 = 1 AND tag % 65536 > 255 AND NOT EXISTS (SELECT 1 FROM elements c WHERE c.file = e.file AND c.tag // 65536 = e.tag // 65536 AND c.tag % 65536 = (e.tag % 65536) // 256) GROUP BY tag",
    "private_strip": W("elements") + "SELECT kind, tag, count(*) AS n FROM elements, (VALUES ('safe'), ('none')) k(kind) WHERE (tag // 65536) % 2 = 0 OR (kind = 'safe' AND tag // 65536 = 41) GROUP BY ALL",
    "private_alloc_slot": _PE + _FREE,
    "private_compact": _PE + _COMPACT,
    "private_renumbered": _PE + f", q AS ({_COMPACT}) SELECT tag, count(*) AS n FROM (SELECT CASE WHEN e.tag % 65536 < 256 THEN CAST(q.group_no AS BIGINT) * 65536 + q.new_slot ELSE CAST(q.group_no AS BIGINT) * 65536 + q.new_slot * 256 + e.tag % 256 END AS tag FROM pe e JOIN q ON q.file = e.file AND q.group_no = e.tag // 65536 AND q.slot = CASE WHEN e.tag % 65536 < 256 THEN e.tag % 65536 ELSE (e.tag % 65536) // 256 END) GROUP BY tag",
    "private_add": _PE + f", fr AS ({_FREE}), s AS (SELECT g.file, g.group_no, coalesce(fr.slot, 16) AS slot FROM (SELECT DISTINCT file, tag // 65536 AS group_no FROM pe) g LEFT JOIN fr ON fr.file = g.file AND fr.group_no = g.group_no) SELECT file, CAST(group_no * 65536 + slot AS BIGINT) AS tag, 'LO' AS vr, 'NEW ONE' AS value FROM s UNION ALL SELECT file, CAST(group_no * 65536 + slot * 256 + 5 AS BIGINT), 'LO', 'x' FROM s",
    "vendor_lookup": W("elements") + "SELECT tag, CASE tag WHEN 1642497 THEN 'ACME' WHEN 2691329 THEN 'SAFE CO' END AS creator, count(*) AS n, CASE tag WHEN 1642497 THEN 'SH' WHEN 2691329 THEN 'DS' ELSE 'UN' END AS dict_vr, CASE tag WHEN 1642497 THEN 'MyAcme' WHEN 2691329 THEN 'SafeFactor' END AS keyword FROM elements WHERE (tag // 65536) % 2 = 1 AND tag % 65536 > 255 GROUP BY tag",
    "vendor_creators": W("parts") + "SELECT upper(trim(creator)) AS key, min(creator) AS first_name, count(*) AS n_tags FROM parts GROUP BY 1",
}
