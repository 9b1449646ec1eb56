"""Tags, representations, multiplicities, scalar parsing, dictionaries and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import tags, uids, values
from . import bridge

W = bridge.with_views


def tag_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.col("tag")
    return bridge.elements(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select("tag", tags.group(tag).alias("group_no"), tags.element(tag).alias("elem_no"), tags.is_private(tag).alias("private"), tags.is_private_creator(tag).alias("creator"), tags.slot(tag).alias("slot"), "n")


def tag_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("CASE k % 4 WHEN 0 THEN '(' || lpad(hex(k % 65536), 4, '0') || ',0010)' WHEN 1 THEN lpad(hex(k % 65536), 4, '0') || '00FF' WHEN 2 THEN 'x' || cast(k as string) ELSE '(0010,00)' END")
    rows = bridge.dirty(spark, sf_dir).select("k", made.alias("text")).distinct()
    parsed = tags.parse(F.col("text"))
    return rows.select("text", parsed.alias("tag"), tags.show(parsed).alias("shown"), tags.to_hex(parsed).alias("hex"))


PATTERNS = [("overlay", "(60xx,3000)"), ("curve", "(50xx,xxxx)"), ("patient", "(0010,xxxx)"), ("study uid", "(0020,000D)"), ("private 19", "(0019,xxxx)")]


def tag_masked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask, card = tags.parse_pattern(F.col("pattern"))
    patterns = spark.createDataFrame(PATTERNS, "name string, pattern string").select("name", mask.alias("mask"), card.alias("card"))
    counts = bridge.elements(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(patterns), tags.matches(F.col("tag"), F.col("mask"), F.col("card"))).select("name", "tag", "n")  # a constant table of patterns


def vr_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    vr = F.col("vr")
    return bridge.elements(spark, sf_dir).groupBy("vr").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("n_bytes")).select("vr", "n", "n_bytes", tags.is_string(vr).alias("is_string"), tags.is_numeric(vr).alias("is_numeric"), tags.has_long_length(vr).alias("long_length"))


def vr_resolve_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = bridge.images(spark, sf_dir)
    of = lambda t, d: tags.resolve_vr(F.lit(t).cast("long"), F.lit(d), F.col("bits"), F.col("pixel_representation"))
    return i.select("bits", "pixel_representation", of(0x7FE00010, "OW").alias("pixel_vr"), of(0x00280106, "US").alias("smallest_vr"), of(0x00100010, "PN").alias("name_vr")).groupBy("bits", "pixel_representation", "pixel_vr", "smallest_vr", "name_vr").agg(F.count(F.lit(1)).alias("n"))


def vm_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of values are counted by tag first, so that the dictionary meets few rows."""
    counts = bridge.elements(spark, sf_dir).groupBy("tag", F.size(values.split_values(F.col("value"))).alias("n_values")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(F.broadcast(dims.dim_tag(spark).select("tag", "keyword", "vm")), "tag")
    return known.groupBy("keyword", "vm", "n_values", tags.vm_ok(F.col("n_values"), F.col("vm")).alias("ok")).agg(F.sum("n").alias("n"))


def uid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.dirty(spark, sf_dir).select("ui").distinct().select("ui", uids.is_valid(F.col("ui")).alias("ok"))


def ts_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.expr("CASE k % 5 WHEN 0 THEN '1.2.840.10008.1.2' WHEN 1 THEN '1.2.840.10008.1.2.4.50' WHEN 2 THEN '1.2.840.10008.1.2.5' WHEN 3 THEN '1.2.840.10008.1.2.2' ELSE '1.2.3.4' END")
    counts = bridge.dirty(spark, sf_dir).groupBy(uid.alias("ts_uid")).agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(F.broadcast(dims.dim_transfer_syntax(spark)), "ts_uid", "left")
    return known.select("ts_uid", "n", F.coalesce("explicit_vr", F.lit(True)).alias("explicit_vr"), F.coalesce("little_endian", F.lit(True)).alias("little_endian"), F.coalesce("encapsulated", F.lit(False)).alias("encapsulated"), F.coalesce("lossy", F.lit(False)).alias("lossy"), F.col("compression").isNotNull().alias("known"))


def parse_da(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.dirty(spark, sf_dir).select("da").distinct().select("da", values.parse_da(F.col("da")).cast("string").alias("day"))


def parse_tm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.dirty(spark, sf_dir).select("tm").distinct().select("tm", values.parse_tm(F.col("tm")).alias("micros"))


def parse_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.dirty(spark, sf_dir).select("dt").distinct().select("dt", values.parse_dt(F.col("dt")).alias("p")).select("dt", "p.micros", "p.offset")


def parse_is_ds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("ds"), F.col("is_")
    return bridge.dirty(spark, sf_dir).select("ds", "is_").distinct().select("ds", "is_", values.parse_int(i).alias("first_int"), values.parse_double(d).alias("first_double"), F.size(values.parse_ints(i)).alias("n_ints"), F.aggregate(values.parse_doubles(d), F.lit(0.0), lambda a, x: a + x).alias("sum_doubles"))


def split_multivalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.elements(spark, sf_dir).where("tag = 524296")
    return e.select("file", F.posexplode(values.split_values(F.col("value"))).alias("place", "one")).groupBy("place", "one").agg(F.count(F.lit(1)).alias("n"))


def even_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.elements(spark, sf_dir)
    padded = values.even_pad(F.col("value"), F.lit(" "))
    return e.groupBy("tag").agg(F.sum(F.octet_length("value")).alias("n_bytes"), F.sum(F.octet_length(padded)).alias("n_padded"), F.count_if(F.octet_length(padded) % 2 != 0).alias("n_odd"))


def encoded_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda explicit: F.sum(values.encoded_length(F.col("vr"), F.octet_length("value"), F.lit(explicit)))
    return bridge.elements(spark, sf_dir).groupBy("file").agg(of(True).alias("explicit_bytes"), of(False).alias("implicit_bytes"))


def status_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 65024 WHEN 2 THEN 65280 WHEN 3 THEN 45056 + code % 4096 WHEN 4 THEN 42752 ELSE code END")
    return bridge.events(spark, sf_dir).select(code.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select("status", values.status_category(F.col("status")).alias("category"), "n")


def command_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.expr("CASE event WHEN 'connect' THEN 48 WHEN 'pdata' THEN 1 WHEN 'release' THEN 32 ELSE 4095 END + CASE event_id % 2 WHEN 0 THEN 32768 ELSE 0 END")
    rows = bridge.events(spark, sf_dir).groupBy(field.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw", "n", values.is_response(F.col("raw")).alias("response"), F.col("raw").bitwiseAND(F.lit(0x7FFF)).alias("field")).join(F.broadcast(dims.dim_command(spark)), "field", "left").select("raw", "n", "response", "command")


def dict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.elements(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(dims.dim_tag(spark).select("tag", "keyword", F.element_at("vrs", 1).alias("dict_vr"))), "tag", "left").select("tag", "n", "keyword", F.coalesce("dict_vr", F.lit("UN")).alias("dict_vr"))


def keyword_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("patientname",), ("STUDYINSTANCEUID",), ("Rows",), ("nothing",)], "asked string")
    known = dims.dim_tag(spark).withColumn("key", F.lower("keyword"))
    found = asked.join(F.broadcast(known), F.lower("asked") == F.col("key"), "left").select("asked", "tag")
    counts = bridge.elements(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return found.join(counts, "tag", "left").select("asked", "tag", F.coalesce("n", F.lit(0)).alias("n"))


def dict_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry a key: those in use before retired ones, then the first. Keys are part brands here, entries parts."""
    rows = bridge.parts(spark, sf_dir).select("creator", (F.col("file") % 2 == 0).alias("retired"), F.col("file").alias("entry"), "value")
    return rows.groupBy("creator").agg(F.min(F.struct("retired", "entry", "value")).alias("best"), F.count(F.lit(1)).alias("n")).select("creator", "best.retired", "best.entry", "best.value", "n")


def keyword_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.parts(spark, sf_dir).select("value").distinct().select("value", values.keyword(F.lower("value")).alias("keyword"))


def charset_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.expr("CASE k % 5 WHEN 0 THEN ' iso ir 100' WHEN 1 THEN 'ISO-IR 192' WHEN 2 THEN 'ISO_IR 144 ' WHEN 3 THEN 'gb18030' ELSE 'latin' END")
    rows = bridge.dirty(spark, sf_dir).groupBy(term.alias("raw")).agg(F.count(F.lit(1)).alias("n")).withColumn("term", values.charset_term(F.col("raw")))
    return rows.join(F.broadcast(dims.dim_charset(spark)), "term", "left").select("raw", "term", "codec", "n")


def query_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bridge.studies(spark, sf_dir).groupBy("patient_id").agg(F.min("study_date").alias("a"), F.max("study_date").alias("b"))
    day = lambda c: F.to_date(c, "yyyyMMdd")
    return s.select("patient_id", values.query_range(day("a"), day("b")).alias("key"), values.query_range(day("a"), F.lit(None).cast("date")).alias("open_key"))


def ae_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.dirty(spark, sf_dir).select("ae").distinct().select("ae", values.ae_title_ok(F.col("ae")).alias("ok"))


def frame_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = values.frame_bytes(F.col("n_rows"), F.col("n_cols"), F.col("samples"), F.col("bits"))
    return bridge.images(spark, sf_dir).groupBy("modality").agg(F.sum(size).cast("long").alias("frame_bytes"), F.sum(size * F.col("n_frames")).cast("long").alias("total_bytes"))


QUERIES = {f.__name__: f for f in (tag_parts, tag_parse_format, tag_masked_match, vr_classify, vr_resolve_pixel, vm_check, uid_valid, ts_lookup, parse_da, parse_tm, parse_dt, parse_is_ds, split_multivalue, even_pad, encoded_length, status_category, command_field, dict_join, keyword_lookup, dict_dedup, keyword_generation, charset_terms, query_dates, ae_titles, frame_size)}

_TAGS = dims.values_sql([(dims.t(x), k, vr.split(" or ")[0], vm) for x, k, vr, vm in dims.TAGS])
_BOOL = lambda vrs: "vr IN (" + ", ".join(f"'{v}'" for v in vrs) + ")"
_B = "chr(92)"
_TM_OK = "regexp_full_match({0}, '([01][0-9]|2[0-3])([0-5][0-9]([0-5][0-9](\\.[0-9]{{1,6}})?)?)?')"
_TM = "CASE WHEN " + _TM_OK + " THEN coalesce(try_cast(substring({0}, 1, 2) AS BIGINT), 0) * 3600000000 + coalesce(try_cast(substring({0}, 3, 2) AS BIGINT), 0) * 60000000 + coalesce(try_cast(substring({0}, 5, 2) AS BIGINT), 0) * 1000000 + coalesce(try_cast(rpad(nullif(regexp_extract({0}, '\\.([0-9]+)$', 1), ''), 6, '0') AS BIGINT), 0) END"
_DS_VALUE = "try_cast(trim(x) AS DOUBLE)"
SQL = {
    "tag_parts": W("elements") + "SELECT tag, CAST(tag // 65536 AS INT) AS group_no, CAST(tag % 65536 AS INT) AS elem_no, (tag // 65536) % 2 = 1 AS private, (tag // 65536) % 2 = 1 AND tag % 65536 BETWEEN 1 AND 255 AS creator, CAST(CASE WHEN (tag // 65536) % 2 = 1 THEN CASE WHEN tag % 65536 BETWEEN 1 AND 255 THEN tag % 65536 ELSE (tag % 65536) // 256 END END AS INT) AS slot, count(*) AS n FROM elements GROUP BY tag",
    "tag_parse_format": W("dirty", more="r AS (SELECT DISTINCT k, CASE k % 4 WHEN 0 THEN '(' || lpad(printf('%X', k % 65536), 4, '0') || ',0010)' WHEN 1 THEN lpad(printf('%X', k % 65536), 4, '0') || '00FF' WHEN 2 THEN 'x' || CAST(k AS VARCHAR) ELSE '(0010,00)' END AS text FROM dirty), p AS (SELECT text, CASE k % 4 WHEN 0 THEN (k % 65536) * 65536 + 16 WHEN 1 THEN (k % 65536) * 65536 + 255 END AS tag FROM r)")
    + "SELECT text, CAST(tag AS BIGINT) AS tag, printf('(%04X,%04X)', tag // 65536, tag % 65536) AS shown, printf('%08X', tag) AS hex FROM p",
    "tag_masked_match": W("elements") + "SELECT p.name, tag, count(*) AS n FROM elements, (VALUES ('overlay', '60..3000'), ('curve', '50......'), ('patient', '0010....'), ('study uid', '0020000D'), ('private 19', '0019....')) p(name, re) WHERE regexp_full_match(printf('%08X', tag), p.re) GROUP BY ALL",
    "vr_classify": W("elements") + f"SELECT vr, count(*) AS n, CAST(sum(octet_length(encode(value))) AS BIGINT) AS n_bytes, {_BOOL(dims.STRING_VRS)} AS is_string, {_BOOL(dims.NUMERIC_VRS)} AS is_numeric, {_BOOL(dims.LONG_LENGTH_VRS)} AS long_length FROM elements GROUP BY vr",
    "vr_resolve_pixel": W("images") + "SELECT bits, pixel_representation, CASE WHEN bits > 8 THEN 'OW' ELSE 'OB' END AS pixel_vr, CASE pixel_representation WHEN 1 THEN 'SS' ELSE 'US' END AS smallest_vr, 'PN' AS name_vr, count(*) AS n FROM images GROUP BY ALL",
    "vm_check": W("elements") + f"SELECT keyword, vm, CAST(len(string_split(value, {_B})) AS INT) AS n_values, len(string_split(value, {_B})) BETWEEN CAST(substring(vm, 1, 1) AS INT) AND (CASE WHEN contains(vm, 'n') THEN 65535 ELSE CAST(substring(vm, 1, 1) AS INT) END) AS ok, count(*) AS n FROM elements JOIN (VALUES {_TAGS}) d(tag, keyword, vr, vm) USING (tag) GROUP BY ALL",
    "uid_valid": W("dirty") + "SELECT DISTINCT ui, length(ui) <= 64 AND len(list_filter(string_split(ui, '.'), lambda x: NOT (x = '0' OR (length(x) > 0 AND x[1] <> '0' AND len(regexp_extract_all(x, '[0-9]')) = length(x))))) = 0 AS ok FROM dirty",
    "ts_lookup": W("dirty") + f"SELECT ts_uid, count(*) AS n, coalesce(any_value(e), true) AS explicit_vr, coalesce(any_value(l), true) AS little_endian, coalesce(any_value(c), false) AS encapsulated, coalesce(any_value(y), false) AS lossy, any_value(z) IS NOT NULL AS known FROM (SELECT CASE k % 5 WHEN 0 THEN '1.2.840.10008.1.2' WHEN 1 THEN '1.2.840.10008.1.2.4.50' WHEN 2 THEN '1.2.840.10008.1.2.5' WHEN 3 THEN '1.2.840.10008.1.2.2' ELSE '1.2.3.4' END AS ts_uid FROM dirty) LEFT JOIN (VALUES {dims.values_sql(dims.TRANSFER_SYNTAXES)}) t(ts_uid, e, l, c, y, z) USING (ts_uid) GROUP BY ts_uid",
    "parse_da": W("dirty") + "SELECT da, strftime(day, '%Y-%m-%d') AS day FROM (SELECT DISTINCT da, CASE WHEN regexp_full_match(da, '[0-9]{8}') AND da >= '0001' THEN CAST(try_strptime(da, '%Y%m%d') AS DATE) WHEN regexp_full_match(da, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(try_strptime(da, '%Y-%m-%d') AS DATE) END AS day FROM dirty)",
    "parse_tm": W("dirty") + f"SELECT DISTINCT tm, {_TM.format('tm')} AS micros FROM dirty",
    "parse_dt": W("dirty", more="v AS (SELECT DISTINCT dt, regexp_replace(dt, '[+-][0-9]{4}$', '') AS l, regexp_extract(dt, '[+-][0-9]{4}$') AS o FROM dirty), w AS (SELECT *, substring(l, 9) AS t, CAST(try_strptime(substring(l, 1, 8), '%Y%m%d') AS DATE) AS d FROM v)")
    + f"SELECT dt, CASE WHEN length(l) >= 8 AND (t = '' OR {_TM_OK.format('t')}) THEN date_diff('day', DATE '1970-01-01', d) * 86400000000 + CASE WHEN t = '' THEN 0 ELSE {_TM.format('t')} END END AS micros, CAST(CASE WHEN o <> '' THEN (CAST(substring(o, 2, 2) AS INT) * 60 + CAST(substring(o, 4, 2) AS INT)) * CASE WHEN o[1] = '-' THEN -1 ELSE 1 END END AS INT) AS \"offset\" FROM w",
    "parse_is_ds": W("dirty") + f"SELECT DISTINCT ds, is_, CASE WHEN regexp_full_match(trim(string_split(is_, {_B})[1]), '[+-]?[0-9]+') THEN try_cast(trim(string_split(is_, {_B})[1]) AS INT) END AS first_int, try_cast(trim(string_split(ds, {_B})[1]) AS DOUBLE) AS first_double, CAST(len(list_filter(string_split(is_, {_B}), lambda x: regexp_full_match(trim(x), '[+-]?[0-9]+'))) AS INT) AS n_ints, coalesce(list_sum(list_filter(list_transform(string_split(ds, {_B}), lambda x: {_DS_VALUE}), lambda x: x IS NOT NULL)), 0.0e0) AS sum_doubles FROM dirty",
    "split_multivalue": W("elements", more=f"s AS (SELECT string_split(value, {_B}) AS v FROM elements WHERE tag = 524296), u AS (SELECT unnest(v) AS one, unnest(range(len(v))) AS place FROM s)") + "SELECT CAST(place AS INT) AS place, one, count(*) AS n FROM u GROUP BY ALL",
    "even_pad": W("elements") + "SELECT tag, CAST(sum(octet_length(encode(value))) AS BIGINT) AS n_bytes, CAST(sum(octet_length(encode(value)) + octet_length(encode(value)) % 2) AS BIGINT) AS n_padded, CAST(0 AS BIGINT) AS n_odd FROM elements GROUP BY tag",
    "encoded_length": W("elements") + f"SELECT file, CAST(sum(CASE WHEN {_BOOL(dims.LONG_LENGTH_VRS)} THEN 12 ELSE 8 END + 2 * ((octet_length(encode(value)) + 1) // 2)) AS BIGINT) AS explicit_bytes, CAST(sum(8 + 2 * ((octet_length(encode(value)) + 1) // 2)) AS BIGINT) AS implicit_bytes FROM elements GROUP BY file",
    "status_category": W("assoc_events") + "SELECT status, CASE WHEN status = 0 THEN 'Success' WHEN status = 65024 THEN 'Cancel' WHEN status IN (65280, 65281) THEN 'Pending' WHEN status BETWEEN 45056 AND 49151 THEN 'Warning' ELSE 'Failure' END AS category, count(*) AS n FROM (SELECT CAST(CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 65024 WHEN 2 THEN 65280 WHEN 3 THEN 45056 + code % 4096 WHEN 4 THEN 42752 ELSE code END AS INT) AS status FROM assoc_events) GROUP BY status",
    "command_field": W("assoc_events") + f"SELECT raw, count(*) AS n, raw >= 32768 AS response, any_value(command) AS command FROM (SELECT CAST(CASE event WHEN 'connect' THEN 48 WHEN 'pdata' THEN 1 WHEN 'release' THEN 32 ELSE 4095 END + CASE event_id % 2 WHEN 0 THEN 32768 ELSE 0 END AS INT) AS raw FROM assoc_events) LEFT JOIN (VALUES {dims.values_sql(dims.COMMANDS)}) c(field, command) ON field = raw % 32768 GROUP BY raw",
    "dict_join": W("elements") + f"SELECT tag, count(*) AS n, any_value(keyword) AS keyword, coalesce(any_value(d.vr), 'UN') AS dict_vr FROM elements LEFT JOIN (VALUES {_TAGS}) d(tag, keyword, vr, vm) USING (tag) GROUP BY tag",
    "keyword_lookup": W("elements") + f"SELECT a.asked, d.tag, (SELECT count(*) FROM elements e WHERE e.tag = d.tag) AS n FROM (VALUES ('patientname'), ('STUDYINSTANCEUID'), ('Rows'), ('nothing')) a(asked) LEFT JOIN (VALUES {_TAGS}) d(tag, keyword, vr, vm) ON lower(keyword) = lower(asked)",
    "dict_dedup": W("parts") + "SELECT creator, retired, entry, value, n FROM (SELECT creator, file % 2 = 0 AS retired, file AS entry, value, count(*) OVER (PARTITION BY creator) AS n, row_number() OVER (PARTITION BY creator ORDER BY file % 2 = 0, file) AS r FROM parts) WHERE r = 1",
    "keyword_generation": W("parts") + "SELECT DISTINCT value, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), '') AS keyword FROM parts",
    "charset_terms": W("dirty") + f"SELECT raw, term, codec, count(*) AS n FROM (SELECT raw, replace(replace(upper(trim(raw)), 'ISO IR ', 'ISO_IR '), 'ISO-IR ', 'ISO_IR ') AS term FROM (SELECT CASE k % 5 WHEN 0 THEN ' iso ir 100' WHEN 1 THEN 'ISO-IR 192' WHEN 2 THEN 'ISO_IR 144 ' WHEN 3 THEN 'gb18030' ELSE 'latin' END AS raw FROM dirty)) LEFT JOIN (VALUES {dims.values_sql(dims.CHARSETS)}) c(term, codec) USING (term) GROUP BY ALL",
    "query_dates": W("studies") + "SELECT patient_id, min(study_date) || '-' || max(study_date) AS key, min(study_date) || '-' AS open_key FROM studies GROUP BY patient_id",
    "ae_titles": W("dirty") + "SELECT DISTINCT ae, length(ae) BETWEEN 1 AND 16 AND trim(ae) = ae AND ae <> '' AS ok FROM dirty",
    "frame_size": W("images") + "SELECT modality, CAST(sum(CAST(n_rows AS BIGINT) * n_cols * samples * ((bits + 7) // 8)) AS BIGINT) AS frame_bytes, CAST(sum(CAST(n_rows AS BIGINT) * n_cols * samples * ((bits + 7) // 8) * n_frames) AS BIGINT) AS total_bytes FROM images GROUP BY modality",
}
