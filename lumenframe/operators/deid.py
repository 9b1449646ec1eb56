"""De-identification of element tables: an action for each row, UIDs remapped by a deterministic map, dates shifted.

Items of sequences are rows of the table like any other, so nothing recurses. The action table is a small dimension; the
options decide, in their fixed order, whose cell of a row counts. Derived UIDs follow from (salt, scope, original), so
no store has to be locked or shared, and a repeated task gives the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import tags, uids, values

ACTIONS = [r[0] for r in dims.RESOLVE]
MOST_ACTIONS = 10_000


@dataclass(frozen=True)
class DateShift:
    """strategy: none, fixed, per_patient, remove_time or remove."""

    strategy: str = "fixed"
    days: int = -365
    low: int = -365
    high: int = 365
    seed: int = 1

    @staticmethod
    def research() -> DateShift:
        return DateShift("per_patient", low=-365, high=365)

    @staticmethod
    def clinical_trial() -> DateShift:
        return DateShift("remove_time", days=-100)

    def offset(self, patient: Column) -> Column:
        """Days to add: the same for all dates of a patient, whatever order they come in."""
        if self.strategy != "per_patient":
            return F.lit(self.days)
        key = F.coalesce(patient, F.lit("UNKNOWN"))
        return F.lit(self.low) + F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.high - self.low + 1)).cast("int")


@dataclass(frozen=True)
class DeidOptions:
    """options: names of dims.DEID_OPTIONS. unknown: what happens to tags that the table doesn't list (remove or keep)."""

    options: tuple[str, ...] = ()
    unknown: str = "remove"
    private: str = "remove"
    safe_creators: tuple[str, ...] = ()
    overrides: dict[int, str] = field(default_factory=dict)
    attribute_type: int = 3
    scope: str = "batch"
    salt: str = "salt"
    shift: DateShift | None = None
    shift_first: bool = True

    @staticmethod
    def basic() -> DeidOptions:
        return DeidOptions()

    @staticmethod
    def research() -> DeidOptions:
        return DeidOptions(("rpat", "rmod", "cdesc"), shift=DateShift.research())

    @staticmethod
    def clinical_trial() -> DeidOptions:
        return DeidOptions(("rpat", "rdev", "rmod"), shift=DateShift.clinical_trial())

    @staticmethod
    def teaching() -> DeidOptions:
        return DeidOptions(("cdesc", "cgraph"))

    def retain(self, *names: str) -> DeidOptions:
        unknown = set(names) - set(dims.DEID_OPTIONS)
        if unknown:
            raise ValueError(f"no such option: {sorted(unknown)}")
        return replace(self, options=tuple(o for o in dims.DEID_OPTIONS if o in {*self.options, *names}))

    def with_override(self, tag: int, action: str) -> DeidOptions:
        if action not in ACTIONS:
            raise ValueError(f"no such action: {action}")
        return replace(self, overrides={**self.overrides, tag: action})

    def with_safe_creators(self, *names: str) -> DeidOptions:
        return replace(self, private="keep_safe", safe_creators=(*self.safe_creators, *names))

    def with_shift(self, shift: DateShift) -> DeidOptions:
        return replace(self, shift=shift)


def action(options: DeidOptions) -> Column:
    """The action of a row joined with the action table: the first set option with a cell, else the basic profile."""
    return F.coalesce(*[F.col(o) for o in dims.DEID_OPTIONS if o in options.options], F.col("basic"))


def resolve(code: Column, attribute_type: int | Column = 3) -> Column:
    """What an action code means for an attribute type (1, 2 or 3)."""
    kind = attribute_type if isinstance(attribute_type, Column) else F.lit(attribute_type)
    out = F.lit("remove")
    for name, one, two, three in dims.RESOLVE:
        out = F.when(code == name, F.when(kind == 1, one).when(kind == 2, two).otherwise(three)).otherwise(out)
    return out


def resolve_for(resolved: Column, vr: Column, value: Column) -> Column:
    """Remapping is for UIDs alone; an empty value stays as it is."""
    return F.when((resolved == "remap_uid") & (vr != "UI"), "dummy").when((resolved == "empty") & (F.coalesce(value, F.lit("")) == ""), "keep").otherwise(resolved)


def dummy(vr: Column) -> Column:
    """A constant of the representation; empty for those of bytes and for sequences."""
    out = F.when(F.lit(False), "")
    for name, text in dims.DUMMY:
        out = out.when(vr == name, text)
    return out.otherwise("")


def _kept(bare: Column) -> Column:
    return (bare == "") | bare.startswith(uids.REGISTERED)


def remap_uid(value: Column, options: DeidOptions, scope_key: Column | None = None) -> Column:
    """Each UID of a value, remapped unless it is registered or empty."""
    scope = F.lit(options.scope) if scope_key is None else scope_key

    def one(u: Column) -> Column:
        bare = F.trim(u)
        return F.when(_kept(bare), u).otherwise(uids.from_seed(F.concat(F.lit(options.salt), scope, bare)))

    return F.array_join(F.transform(values.split_values(value), one), "\\")


def with_remapped(rows: DataFrame, name: str, value: Column, options: DeidOptions, scope: Column) -> DataFrame:
    """rows with remap_uid(value) as a column; values of one UID, as nearly all are, take the shorter way of uids.with_derived."""
    several = value.contains(values.BACKSLASH)
    seed = F.when(~several & ~_kept(F.trim(value)), F.concat(F.lit(options.salt), scope, F.trim(value)))
    made = uids.with_derived(rows, "_uid", seed)
    return made.withColumn(name, F.coalesce("_uid", F.when(several, remap_uid(value, options, scope)).otherwise(value))).drop("_uid")


def shift_date(value: Column, days: Column) -> Column:
    """Each date of a value moved by days; a value that is no date of eight digits stays."""

    def one(s: Column) -> Column:
        day = F.try_to_timestamp(F.substring(s, 1, 8), F.lit("yyyyMMdd")).cast("date")
        good = s.rlike("^[0-9]{8}") & day.isNotNull()
        return F.when(good, F.concat(F.date_format(F.date_add(day, days), "yyyyMMdd"), F.substring(s, 9, 100))).otherwise(s)

    return F.array_join(F.transform(values.split_values(value), one), "\\")


def shifted(vr: Column, value: Column, patient: Column, shift: DateShift) -> Column:
    """The value of a date or time under a strategy; any other as it is."""
    dated = vr.isin("DA", "DT")
    if shift.strategy == "none":
        return value
    if shift.strategy == "remove":
        return F.when(vr.isin("DA", "DT", "TM"), F.lit("")).otherwise(value)
    moved = F.when(dated, shift_date(value, shift.offset(patient))).otherwise(value)
    if shift.strategy == "remove_time":
        moved = F.when(vr == "TM", F.when(value == "", value).otherwise("000000.000000")).when(vr == "DT", F.when(moved.rlike("^[0-9]{9}"), F.concat(F.substring(moved, 1, 8), F.lit("000000.000000"))).otherwise(moved)).otherwise(moved)
    return moved


def creators(elements: DataFrame) -> DataFrame:
    """(file, group_no, slot, creator): the private creators of each file."""
    tag = F.col("tag")
    rows = elements.where(tags.is_private_creator(tag))
    return rows.select("file", tags.group(tag).alias("group_no"), tags.slot(tag).alias("slot"), values.creator_key(F.col("value")).alias("creator"))


def item_key(elements: DataFrame) -> list[str]:
    """What tells a data set apart: its file, and its item where rows have the path of one."""
    return ["file", "item_path"] if "item_path" in elements.columns else ["file"]


def with_actions(elements: DataFrame, table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """elements with the columns of their row of the action table: that of the very tag, else of a pattern (tag, mask) that fits.

    A table of the standard has some hundred rows; one above MOST_ACTIONS is no such table.
    """
    if table.limit(MOST_ACTIONS + 1).count() > MOST_ACTIONS:
        raise ValueError(f"an action table of more than {MOST_ACTIONS} rows")
    cells = ["basic", *dims.DEID_OPTIONS]
    if "mask" not in table.columns:
        return elements.join(F.broadcast(table.select("tag", *(columns or cells))), "tag", "left")
    whole = F.coalesce(F.col("mask"), F.lit(0xFFFFFFFF)) == 0xFFFFFFFF
    rows = elements.join(F.broadcast(table.where(whole).select("tag", *cells)), "tag", "left")
    patterns = table.where(~whole).select("tag", "mask", *cells).orderBy(F.desc(F.bit_count("mask")), "tag").collect()  # at most MOST_ACTIONS
    listed = F.coalesce(*[F.col(c) for c in cells]).isNotNull()
    for c in cells:
        found = F.when(listed, F.col(c))
        for p in patterns:
            found = found.when(F.col("tag").bitwiseAND(F.lit(p["mask"])) == p["tag"] & p["mask"], F.lit(p[c]).cast("string"))
        rows = rows.withColumn(f"_{c}", found)
    return rows.drop(*cells).withColumnsRenamed({f"_{c}": c for c in cells})


def decide(elements: DataFrame, table: DataFrame, options: DeidOptions) -> DataFrame:
    """elements (file, patient_id, tag, vr, value) with code (the action) and resolved (what is done).

    Where elements have creators (private.with_creators), those of their file, safe ones are found there; by a window else.
    """
    tag = F.col("tag")
    unlisted = "X" if options.unknown == "remove" else "K"
    if "mask" in table.columns:
        rows = with_actions(elements, table)
        code = F.coalesce(action(options), F.lit(unlisted))
        meant = resolve(code, options.attribute_type)
    else:  # what a row of the table means is found once, not for each element
        listed = table.select("tag", action(options).alias("_code"), resolve(action(options), options.attribute_type).alias("_meant"))
        rows = with_actions(elements, listed, ["_code", "_meant"])
        code = F.coalesce("_code", F.lit(unlisted))
        meant = F.when(F.col("_code").isNull(), resolve(F.lit(unlisted), options.attribute_type)).otherwise(F.col("_meant"))
    for t, a in options.overrides.items():
        code, meant = F.when(tag == t, a).otherwise(code), F.when(tag == t, resolve(F.lit(a), options.attribute_type)).otherwise(meant)
    resolved = resolve_for(meant, F.col("vr"), F.col("value"))
    private = F.lit("remove")
    if options.private == "keep_safe":
        names = [c.strip().upper() for c in options.safe_creators]
        if "creators" in elements.columns:
            safe = F.exists("creators", lambda c: (c["block"] == tags.block(tag)) & values.creator_key(c["creator"]).isin(*names))
            private = F.when(F.when(tags.is_private(tag), safe).otherwise(F.lit(False)), "keep").otherwise("remove")
        else:
            # one window over a data set's rows of a group and slot: its creator is among them, and no file is large
            block = Window.partitionBy(*item_key(elements), tags.group(tag), tags.slot(tag))
            own = F.max(F.when(tags.is_private_creator(tag), values.creator_key(F.col("value")))).over(block)
            rows = rows.withColumn("_safe", tags.is_private(tag) & F.coalesce(own.isin(*names), F.lit(False)))
            private = F.when(F.col("_safe"), "keep").otherwise("remove")
    elif options.private == "keep":
        private = F.lit("keep")
    overridden = tag.isin(*options.overrides) if options.overrides else F.lit(False)
    rows = rows.withColumn("code", F.when(tags.is_private(tag) & ~overridden, "private").otherwise(code)).withColumn("resolved", F.when(tags.is_private(tag) & ~overridden, private).otherwise(resolved))
    return rows.select(*elements.columns, "code", "resolved")


def apply(decided: DataFrame, options: DeidOptions) -> DataFrame:
    """decided with new_value (null where the row goes) and outcome, by the row's resolved action and the date shift.

    Values of any representation are emptied and replaced: numbers by zeros, bytes by none.
    """
    vr, value = F.col("vr"), F.col("value")
    cleaned = dummy(vr)
    if options.shift is not None and options.shift_first:  # a shift takes the place of cleaning dates, or intervals are lost
        cleaned = F.when(vr.isin("DA", "DT", "TM"), value).otherwise(cleaned)
    done = (
        F.when(F.col("resolved").isin("remove", "remap_uid"), None)
        .when(F.col("resolved") == "empty", F.lit(""))
        .when(F.col("resolved") == "dummy", dummy(vr))
        .when(F.col("resolved") == "clean", cleaned)
        .otherwise(value)
    )
    mapped = with_remapped(with_scope(decided, options), "_mapped", F.when(F.col("resolved") == "remap_uid", value), options, F.col("_scope"))
    rows = mapped.withColumn("new_value", F.coalesce("_mapped", done)).drop("_scope", "_mapped")
    if options.shift is not None:
        moved = shifted(vr, F.col("new_value"), F.col("patient_id"), options.shift)
        movable = F.col("resolved").isin("keep", "clean") & vr.isin("DA", "DT", "TM")
        rows = rows.withColumn("shifted", movable & ~F.col("new_value").eqNullSafe(moved)).withColumn("new_value", F.when(movable, moved).otherwise(F.col("new_value")))
    else:
        rows = rows.withColumn("shifted", F.lit(False))
    return rows


def with_study(files: DataFrame) -> DataFrame:
    """Sets (file, elements) with study, the study's UID in each, for scopes of studies."""
    uid = F.array_max(F.transform(F.filter("elements", lambda e: e["tag"] == dims.KEYWORD["StudyInstanceUID"]), lambda e: F.trim(e["value"])))
    return files.withColumn("study", uid)


def with_scope(elements: DataFrame, options: DeidOptions) -> DataFrame:
    """elements with _scope: what UIDs are remapped in. batch is one scope; study and dataset have one for each of them.

    Where elements have study (with_study), it is their file's; it is found by a window else.
    """
    if options.scope == "dataset":
        return elements.withColumn("_scope", F.concat(F.lit("dataset "), "file"))
    if options.scope == "study":
        study = F.col("study") if "study" in elements.columns else F.max(F.when(F.col("tag") == dims.KEYWORD["StudyInstanceUID"], F.trim("value"))).over(Window.partitionBy("file"))
        return elements.withColumn("_scope", F.concat(F.lit("study "), F.coalesce(study, F.col("file"))))
    return elements.withColumn("_scope", F.lit(options.scope))


def method_codes(options: DeidOptions) -> list[str]:
    codes = dict(dims.METHOD_CODES)
    return [codes["basic"], *[codes[o] for o in options.options]]


def marker_values(options: DeidOptions) -> list[tuple[int, str, str]]:
    """(tag, representation, value) of what says how a data set was de-identified."""
    mark = "UNMODIFIED" if "rfull" in options.options else "MODIFIED" if "rmod" in options.options or options.shift else "REMOVED"
    return [(dims.KEYWORD["PatientIdentityRemoved"], "CS", "YES"), (dims.KEYWORD["DeidentificationMethod"], "LO", "\\".join(method_codes(options))), (dims.KEYWORD["LongitudinalTemporalInformationModified"], "CS", mark)]


def markers(files: DataFrame, options: DeidOptions) -> DataFrame:
    """The rows that say how each file (file) was de-identified."""
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("tag"), F.lit(vr).alias("vr"), F.lit(v).alias("value")) for t, vr, v in marker_values(options)])
    return files.select("file", F.explode(rows).alias("m")).select("file", "m.tag", "m.vr", "m.value")


def summary(applied: DataFrame) -> DataFrame:
    """Counts of what was done to each file; total leaves private elements out."""
    r = F.col("resolved")
    private = F.col("code") == "private"
    n = lambda c: F.count_if(c)
    counts = applied.groupBy("file").agg(
        n((r == "remove") & ~private).alias("removed"), n(r.isin("dummy", "clean")).alias("replaced"), n(r == "empty").alias("emptied"),
        n(r == "remap_uid").alias("remapped"), n(F.col("shifted")).alias("shifted"), n((r == "remove") & private).alias("private_removed"),
    )
    return counts.withColumn("total", F.col("removed") + F.col("replaced") + F.col("emptied") + F.col("remapped") + F.col("shifted"))


def batch_summary(summaries: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row for a batch: files, errors, rate of success, sums."""
    failed = errors.select("file").distinct().withColumn("failed", F.lit(True)) if errors is not None else None
    rows = summaries if failed is None else summaries.join(failed, "file", "full")
    bad = F.lit(False) if failed is None else F.coalesce("failed", F.lit(False))
    total = F.count(F.lit(1))
    return rows.agg(total.alias("files"), F.count_if(bad).alias("errors"), F.count_if(~bad).alias("successes"), F.round((total - F.count_if(bad)) * 100.0 / total, 6).alias("success_rate"), (F.count_if(bad) == 0).alias("all_ok"), F.sum("removed").alias("removed"), F.sum("remapped").alias("remapped"), F.sum("total").alias("changes"))


def deidentify(elements: DataFrame, table: DataFrame, options: DeidOptions, files: DataFrame | None = None) -> DataFrame:
    """The rows of elements after de-identification, with the markers of each file; files (file) are those of elements, where they are known."""
    done = apply(decide(elements, table, options), options)
    kept = done.where("resolved <> 'remove'").select("file", "tag", "vr", F.col("new_value").alias("value"))
    return kept.unionByName(markers(elements.select("file").distinct() if files is None else files, options))


def uid_map(elements: DataFrame, options: DeidOptions) -> DataFrame:
    """(scope, original_uid, remapped_uid): the mapping that a run uses, one row a UID."""
    one = with_scope(elements, options).where("vr = 'UI'").select(F.col("_scope").alias("scope"), F.explode(values.split_values(F.col("value"))).alias("original_uid")).where("original_uid <> ''").distinct()
    one = one.where(~F.col("original_uid").startswith(uids.REGISTERED))
    return uids.with_derived(one, "remapped_uid", F.concat(F.lit(options.salt), "scope", F.trim("original_uid"))).select("scope", "original_uid", "remapped_uid")


def n_different(value: Column) -> Column:
    """The number of different texts, counted by their digests of 128 bits, which are shorter than most UIDs are."""
    return F.count_distinct(F.unhex(F.md5(value)))


def burned_in_risk(flag: Column, modality: Column, image_type: Column) -> Column:
    """How likely text is part of the pixels."""
    kind = F.upper(F.trim(F.coalesce(modality, F.lit(""))))
    declared = F.upper(F.trim(flag))
    captured = F.upper(image_type).rlike("SECONDARY|SCREEN|CAPTURE")
    by_modality = F.when(kind == "", "Unknown").when(kind.isin(dims.HIGH_RISK), "High").when(kind.isin(dims.MODERATE_RISK), "Moderate").when(captured, "High").otherwise("Low")
    return F.when(declared == "YES", "Confirmed").when(declared == "NO", "Low").otherwise(by_modality)


def risk_message(risk: Column) -> Column:
    return F.concat(F.lit("Burned-in text: "), F.lower(risk), F.lit(" risk"))
