"""Validation queries over values that are partly wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import validate as v
from . import bridge

W = bridge.with_views


def _rule(column: str, rule: Callable[[Column], Column]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = bridge.dirty(spark, sf_dir).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        found = v.issues(rows.select(F.col(column).alias("value"), "n", F.lit("").alias("vr")), [], {column: lambda value, vr: rule(value)})
        return found.select("value", "n", "code", "severity")

    return query


COLUMNS = [("DA", "da"), ("TM", "tm"), ("DT", "dt"), ("AS", "age"), ("UI", "ui"), ("PN", "pn"), ("CS", "cs"), ("DS", "ds"), ("IS", "is_"), ("AE", "ae"), ("LO", "lo")]


def dirty_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, tag, vr, value): the values of each line as elements of a file."""
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.col(c).alias("value")) for i, (vr, c) in enumerate(COLUMNS)])
    return bridge.dirty(spark, sf_dir).select(F.col("k").alias("file"), F.explode(rows).alias("e")).select("file", "e.tag", "e.vr", "e.value")


def val_profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = dirty_elements(spark, sf_dir).groupBy("tag", "vr", "value").agg(F.count(F.lit(1)).alias("n"))  # each rule once a value
    return v.issues(values).groupBy("rule_id", "code", "severity").agg(F.sum("n").alias("n"))


def val_profile_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame([(1, "skip"), (7, "validate")], "tag long, behavior string")
    values = dirty_elements(spark, sf_dir).groupBy("tag", "vr", "value").agg(F.count(F.lit(1)).alias("n"))
    return v.behave(v.issues(values), "lenient", overrides).groupBy("tag", "behavior").agg(F.sum("n").alias("n"))


def val_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.summary(v.issues(dirty_elements(spark, sf_dir), "structural"))


def val_is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.valid_files(dirty_elements(spark, sf_dir)).groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def val_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings pass where errors would stop the reading."""
    values = dirty_elements(spark, sf_dir).groupBy("tag", "vr", "value").agg(F.count(F.lit(1)).alias("n"))
    found = v.enforce(v.behave(v.issues(values, ["PN", "CS", "length", "repertoire"]), "strict"))
    return found.groupBy("tag", "rule_id", "code", "severity").agg(F.sum("n").alias("n"))


def val_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by named set of rules; each rule runs once, and a set has those of its own."""
    member = spark.createDataFrame([(k, r) for k, rules in v.SETS.items() for r in rules], "rule_set string, rule_id string")
    return val_profile_counts(spark, sf_dir).join(F.broadcast(member), "rule_id").groupBy("rule_set", "code", "severity").agg(F.sum("n").alias("n"))  # some twenty rows


def val_custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = {"no_shout": lambda value, vr: v.issue([((vr == "LO") & value.startswith("L"), 24, v.WARNING)])}
    return v.issues(dirty_elements(spark, sf_dir), [], mine).groupBy("rule_id", "code").agg(F.count(F.lit(1)).alias("n"))


def val_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of values are counted by tag first, so that the rule looks at few rows."""
    known = bridge.elements(spark, sf_dir).where("value <> ''").groupBy("tag", values.count_values(F.col("value")).alias("n_values")).agg(F.count(F.lit(1)).alias("n"))
    # by the count, or the filter on what the rule says would be moved below, to each element
    rows = known.withColumn("i", F.when(F.col("n") > 0, v.multiplicity_of(F.col("n_values"), F.when(F.col("tag") == 524296, "3").otherwise("1"))))
    return rows.where("i is not null").groupBy("tag", "i.code").agg(F.sum("n").alias("n"))


QUERIES = {
    "val_da": _rule("da", v.date), "val_tm": _rule("tm", v.time), "val_dt": _rule("dt", v.date_time), "val_as": _rule("age", v.age), "val_ui": _rule("ui", v.uid), "val_pn": _rule("pn", v.person_name), "val_cs": _rule("cs", v.code_string),
    "val_length": _rule("lo", lambda c: v.length(c, F.lit("LO"))), "val_chars_ds": _rule("ds", lambda c: v.repertoire(c, F.lit("DS"))), "val_chars_is": _rule("is_", lambda c: v.repertoire(c, F.lit("IS"))), "val_chars_ae": _rule("ae", lambda c: v.repertoire(c, F.lit("AE"))),
    "val_profile_counts": val_profile_counts, "val_profile_override": val_profile_override, "val_structural": val_structural, "val_is_valid": val_is_valid, "val_custom_rule": val_custom_rule, "val_enforce": val_enforce, "val_sets": val_sets, "val_multiplicity": val_multiplicity,
}

_DIGITS = "regexp_full_match({}, '[0-9]+')"
_N = "CAST({} AS INT)"
# codes as numbers, negative for warnings; null where there is no issue
_DA = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) NOT IN (4, 6, 8) THEN 7 WHEN NOT regexp_full_match({0}, '[0-9]+') THEN 13 WHEN {0}[1:4] = '0000' THEN 26 WHEN length({0}) >= 6 AND {0}[5:6] NOT BETWEEN '01' AND '12' THEN 26 WHEN length({0}) = 8 AND try_strptime({0}, '%Y%m%d') IS NULL THEN 26 END"
_TM = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) > 14 THEN 4 WHEN length({0}) < 2 THEN 8 WHEN NOT regexp_matches({0}, '^[0-9][0-9]') THEN 13 WHEN {0}[1:2] > '23' THEN 27 WHEN length({0}) = 3 THEN 8 WHEN length({0}) > 2 AND NOT regexp_matches({0}, '^..[0-9][0-9]') THEN 13 WHEN length({0}) > 2 AND {0}[3:4] > '59' THEN 27 WHEN length({0}) > 4 AND ({0}[5] = '.' OR length({0}) = 5) THEN 8 WHEN length({0}) > 4 AND NOT regexp_matches({0}, '^....[0-9][0-9]') THEN 13 WHEN length({0}) > 4 AND {0}[5:6] > '59' THEN 27 WHEN length({0}) > 6 AND ({0}[7] <> '.' OR length({0}) = 7) THEN 8 WHEN length({0}) > 13 THEN -8 WHEN length({0}) > 7 AND NOT regexp_full_match({0}[8:], '[0-9]+') THEN 13 END"
_DT = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) < 4 THEN 7 WHEN NOT regexp_full_match({0}[1:4], '[0-9]+') THEN 13 WHEN {0}[1:4] = '0000' THEN 26 WHEN length({1}) >= 6 AND {1}[5:6] NOT BETWEEN '01' AND '12' THEN 26 WHEN length({1}) >= 8 AND try_strptime({1}[1:8], '%Y%m%d') IS NULL THEN 26 WHEN length({1}) >= 10 AND {1}[9:10] > '23' THEN 27 WHEN length({1}) >= 12 AND {1}[11:12] > '59' THEN 27 WHEN length({1}) >= 14 AND {1}[13:14] > '59' THEN 27 END"
_AS = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) <> 4 THEN 21 WHEN NOT regexp_matches({0}, '^[0-9]{{3}}') THEN 13 WHEN {0}[4] NOT IN ('D', 'W', 'M', 'Y') THEN 21 END"
_UI = "CASE WHEN {0} = '' THEN NULL WHEN length({0}) > 64 THEN 4 WHEN starts_with({0}, '.') OR ends_with({0}, '.') THEN 9 WHEN regexp_matches({0}, '[^0-9.]') THEN 13 WHEN contains({0}, '..') OR regexp_matches({0}, '(^|\\.)0[0-9]') THEN 9 END"
_PN = "CASE WHEN {0} = '' THEN NULL WHEN len(list_filter(string_split({0}, '=')[1:3], lambda g: length(g) > 64)) > 0 THEN -4 WHEN len(list_filter(string_split({0}, '=')[1:3], lambda g: len(string_split(g, '^')) > 5)) > 0 THEN -10 WHEN len(string_split({0}, '=')) > 3 THEN -10 END"
_CS = "CASE WHEN len(list_filter(string_split({0}, chr(92)), lambda x: length(trim(x)) > 16)) > 0 THEN -4 WHEN len(list_filter(string_split({0}, chr(92)), lambda x: regexp_matches(x, '[^A-Z0-9 _]'))) > 0 THEN -22 END"
_LEN = "CASE WHEN len(list_filter(string_split({0}, chr(92)), lambda x: octet_length(encode(trim(x))) > {1})) > 0 THEN -4 END"
_DS = "CASE WHEN regexp_matches(replace({0}, chr(92), ''), '[^0-9+Ee. -]') THEN -19 END"
_IS = "CASE WHEN regexp_matches(replace({0}, chr(92), ''), '[^0-9+ -]') THEN -20 END"
_AE = "CASE WHEN {0} <> '' AND trim({0}) = '' THEN -13 WHEN contains({0}, chr(92)) THEN -13 END"
_SHOW = "printf('DICOM-%03d', abs(c)) AS code, CASE WHEN c < 0 THEN 'Warning' ELSE 'Error' END AS severity"


def _one(column: str, rule: str) -> str:
    return W("dirty") + f"SELECT value, n, {_SHOW} FROM (SELECT value, n, CAST({rule} AS BIGINT) AS c FROM (SELECT {column} AS value, regexp_replace({column}, '[+-][0-9]+$', '') AS loc, count(*) AS n FROM dirty GROUP BY ALL)) WHERE c IS NOT NULL"


_BY = {"DA": _DA.format("da"), "TM": _TM.format("tm"), "DT": _DT.format("dt", "regexp_replace(dt, '[+-][0-9]+$', '')"), "AS": _AS.format("age"), "UI": _UI.format("ui"), "PN": _PN.format("pn"), "CS": _CS.format("cs")}
_LIMIT = {"DA": 8, "TM": 14, "DT": 26, "PN": 64, "CS": 16, "DS": 16, "IS": 12, "AE": 16, "LO": 64, "AS": 4}
_ALL = " UNION ALL ".join(
    [f"SELECT k AS file, {1 + [x for x, _ in COLUMNS].index(name)} AS tag, '{name}' AS rule_id, CAST({rule} AS BIGINT) AS c FROM dirty" for name, rule in _BY.items()]
    + [f"SELECT k, {i + 1}, 'length', CAST({_LEN.format(c, _LIMIT[vr])} AS BIGINT) FROM dirty" for i, (vr, c) in enumerate(COLUMNS) if vr in _LIMIT]
    + [f"SELECT k, {1 + [x for x, _ in COLUMNS].index(vr)}, 'repertoire', CAST({r} AS BIGINT) FROM dirty" for vr, r in (("DS", _DS.format("ds")), ("IS", _IS.format("is_")), ("AE", _AE.format("ae")))]
)
_ISSUES = W("dirty", more=f"i AS (SELECT * FROM ({_ALL}) WHERE c IS NOT NULL)")
SQL = {
    "val_da": _one("da", _DA.format("value")), "val_tm": _one("tm", _TM.format("value")), "val_dt": _one("dt", _DT.format("value", "loc")), "val_as": _one("age", _AS.format("value")), "val_ui": _one("ui", _UI.format("value")), "val_pn": _one("pn", _PN.format("value")), "val_cs": _one("cs", _CS.format("value")),
    "val_length": _one("lo", _LEN.format("value", 64)), "val_chars_ds": _one("ds", _DS.format("value")), "val_chars_is": _one("is_", _IS.format("value")), "val_chars_ae": _one("ae", _AE.format("value")),
    "val_profile_counts": _ISSUES + f"SELECT rule_id, {_SHOW}, count(*) AS n FROM i GROUP BY rule_id, c",
    "val_profile_override": _ISSUES + "SELECT CAST(tag AS BIGINT) AS tag, CASE tag WHEN 7 THEN 'validate' ELSE 'warn' END AS behavior, count(*) AS n FROM i WHERE tag <> 1 GROUP BY tag",
    "val_structural": _ISSUES + f"SELECT {_SHOW}, count(*) AS n FROM i WHERE rule_id = 'length' GROUP BY c",
    "val_is_valid": _ISSUES + "SELECT valid, count(*) AS n FROM (SELECT k, k NOT IN (SELECT file FROM i WHERE c > 0) AS valid FROM (SELECT DISTINCT k FROM dirty)) GROUP BY valid",
    "val_enforce": _ISSUES + f"SELECT CAST(tag AS BIGINT) AS tag, rule_id, {_SHOW}, count(*) AS n FROM i WHERE rule_id IN ('PN', 'CS', 'length', 'repertoire') GROUP BY tag, rule_id, c",
    "val_sets": _ISSUES + f"SELECT rule_set, {_SHOW}, count(*) AS n FROM i JOIN (VALUES ('all', ['DA', 'TM', 'DT', 'AS', 'UI', 'PN', 'CS', 'length', 'repertoire']), ('structural', ['length']), ('datetime', ['DA', 'TM', 'DT', 'AS']), ('identifier', ['UI', 'PN']), ('character', ['CS', 'repertoire', 'length'])) s(rule_set, rules) ON list_contains(rules, rule_id) GROUP BY rule_set, c",
    "val_custom_rule": W("dirty") + "SELECT 'no_shout' AS rule_id, 'DICOM-024' AS code, count(*) AS n FROM dirty WHERE starts_with(lo, 'L')",
    "val_multiplicity": W("elements") + "SELECT tag, 'DICOM-005' AS code, count(*) AS n FROM elements WHERE tag = 524296 AND value <> '' AND len(string_split(value, chr(92))) <> 3 GROUP BY tag",
}
