"""Validation: each rule is a Column that is null or an issue; a profile decides which rules run and what an issue does.

A rule looks at a value as it is stored, after its padding. Rules are built from predicates in the order in which they
are tried, and the first that fails names the issue.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import VR
from ..functions import tags, values

ERROR, WARNING = "Error", "Warning"
Check = tuple[Column, int, str]


def issue(checks: list[Check]) -> Column:
    """struct(code, severity) of the first check whose condition holds, else null."""
    out = None
    for bad, code, severity in checks:
        made = F.struct(F.lit(f"DICOM-{code:03d}").alias("code"), F.lit(severity).alias("severity"))
        out = F.when(bad, made) if out is None else out.when(bad, made)
    return out


def _unpad(v: Column, pad: str = " ") -> Column:
    return F.rtrim(v, F.lit(pad))


def _part(v: Column, at: int, n: int = 2) -> Column:
    return F.substring(v, at, n)


def _digits(v: Column) -> Column:
    return v.rlike(r"\A[0-9]+\z")


def _outside(v: Column, low: int, high: int) -> Column:
    return ~F.coalesce(v.try_cast("int").between(low, high), F.lit(False))


def _no_such_day(v: Column) -> Column:
    """Of yyyyMMdd with a good year and month: no such day. In whole numbers: rules run on every value."""
    year, month, day = (_part(v, at, n).try_cast("int") for at, n in ((1, 4), (5, 2), (7, 2)))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return ~F.coalesce(day.between(1, days), F.lit(False))


def date(value: Column) -> Column:
    v = _unpad(value)
    n = F.length(v)
    return issue([
        (n == 0, 0, ""),
        (~n.isin(4, 6, 8), 7, ERROR),
        (~_digits(v), 13, ERROR),
        (_outside(_part(v, 1, 4), 1, 9999), 26, ERROR),
        ((n >= 6) & _outside(_part(v, 5), 1, 12), 26, ERROR),
        ((n == 8) & _no_such_day(v), 26, ERROR),
    ])


def time(value: Column) -> Column:
    v = _unpad(value)
    n = F.length(v)
    return issue([
        (n == 0, 0, ""),
        (n > 14, 4, ERROR),
        (n < 2, 8, ERROR),
        (~_digits(_part(v, 1)), 13, ERROR),
        (_outside(_part(v, 1), 0, 23), 27, ERROR),
        (n == 3, 8, ERROR),
        ((n > 2) & ~_digits(_part(v, 3)), 13, ERROR),
        ((n > 2) & _outside(_part(v, 3), 0, 59), 27, ERROR),
        ((n > 4) & (_part(v, 5, 1) == "."), 8, ERROR),
        (n == 5, 8, ERROR),
        ((n > 4) & ~_digits(_part(v, 5)), 13, ERROR),
        ((n > 4) & _outside(_part(v, 5), 0, 59), 27, ERROR),
        ((n > 6) & (_part(v, 7, 1) != "."), 8, ERROR),
        (n == 7, 8, ERROR),
        (n > 13, 8, WARNING),
        ((n > 7) & ~_digits(F.substring(v, 8, 6)), 13, ERROR),
    ])


def date_time(value: Column) -> Column:
    """A length between two parts, such as yyyyMMddH, passes; only whole parts are looked at."""
    v = _unpad(value)
    n = F.length(v)
    local = F.when(v.contains("+") | v.contains("-"), F.regexp_replace(v, "[+-][^+-]*$", "")).otherwise(v)
    zone = F.substring(v, F.length(local) + 1, F.lit(30))
    m = F.length(local)
    has = lambda k: m >= k
    frac = F.substring(local, 16, 20)
    return issue([
        (n == 0, 0, ""),
        (n > 26, 4, ERROR),
        (n < 4, 7, ERROR),
        (has(4) & ~_digits(_part(local, 1, 4)), 13, ERROR),
        (has(4) & _outside(_part(local, 1, 4), 1, 9999), 26, ERROR),
        (has(6) & ~_digits(_part(local, 5)), 13, ERROR),
        (has(6) & _outside(_part(local, 5), 1, 12), 26, ERROR),
        (has(8) & ~_digits(_part(local, 7)), 13, ERROR),
        (has(8) & _no_such_day(local), 26, ERROR),
        (has(10) & ~_digits(_part(local, 9)), 13, ERROR),
        (has(10) & _outside(_part(local, 9), 0, 23), 27, ERROR),
        (has(12) & ~_digits(_part(local, 11)), 13, ERROR),
        (has(12) & _outside(_part(local, 11), 0, 59), 27, ERROR),
        (has(14) & ~_digits(_part(local, 13)), 13, ERROR),
        (has(14) & _outside(_part(local, 13), 0, 59), 27, ERROR),
        (has(15) & (_part(local, 15, 1) != "."), 8, ERROR),
        (m == 15, 8, ERROR),
        (has(16) & (F.length(frac) > 6), 8, WARNING),
        (has(16) & ~_digits(frac), 13, ERROR),
        ((zone != "") & (F.length(zone) != 5), 8, ERROR),
        ((zone != "") & ~_digits(F.substring(zone, 2, 4)), 13, ERROR),
        ((zone != "") & _outside(F.substring(zone, 2, 2), 0, 14), 27, WARNING),
        ((zone != "") & _outside(F.substring(zone, 4, 2), 0, 59), 27, ERROR),
    ])


def age(value: Column) -> Column:
    v = _unpad(value)
    return issue([(F.length(v) == 0, 0, ""), (F.length(v) != 4, 21, ERROR), (~_digits(_part(v, 1, 3)), 13, ERROR), (~_part(v, 4, 1).isin("D", "W", "M", "Y"), 21, ERROR)])


def uid(value: Column) -> Column:
    v = _unpad(value, "\0")
    # whichever comes first in the text, a letter or a bad component, names the issue
    bad_letter = F.length(F.regexp_extract(v, r"^[0-9.]*", 0))
    bad_part = F.length(F.regexp_extract(v, r"^((0|[1-9][0-9]*)(\.|$))*", 0))
    part_end = F.length(F.regexp_extract(F.substring(v, bad_part + 1, F.lit(100)), r"^[0-9]*", 0)) + bad_part
    letter = bad_letter < F.length(v)
    part = bad_part < F.length(v)
    return issue([
        (F.length(v) == 0, 0, ""),
        (F.length(v) > 64, 4, ERROR),
        (v.startswith(".") | v.endswith("."), 9, ERROR),
        (letter & (bad_letter <= part_end), 13, ERROR),
        (part, 9, ERROR),
    ])


def person_name(value: Column) -> Column:
    v = _unpad(value)
    groups = F.split(v, "=")
    first = F.slice(groups, 1, 3)
    bad = lambda g: (F.length(g) > 64) | (F.size(F.split(g, r"\^")) > 5)
    found = F.get(F.filter(first, bad), 0)
    # a fourth group is seen when the third has ended
    return issue([
        (F.length(v) == 0, 0, ""),
        (F.exists(first, bad) & (F.length(found) > 64), 4, WARNING),
        (F.exists(first, bad), 10, WARNING),
        (F.size(groups) > 3, 10, WARNING),
    ])


def code_string(value: Column) -> Column:
    one = F.transform(F.split(_unpad(value), r"\\"), lambda x: F.regexp_replace(x, "^ +| +$", ""))
    bad = F.get(F.filter(one, lambda x: (F.length(x) > 16) | x.rlike("[^A-Z0-9 _]")), 0)
    return issue([(bad.isNull(), 0, ""), (F.length(bad) > 16, 4, WARNING), (bad.isNotNull(), 22, WARNING)])


#: Longest values of the representations whose length is looked at.
LIMITS = {r[0]: (r[3], r[7] is not None, r[2]) for r in VR if r[4] and r[3] is not None and r[0] not in ("LT", "UI")}


def length(value: Column, vr: Column) -> Column:
    """Values are only split where all of them together are longer than one may be."""
    v = _unpad(value)
    parts = F.transform(F.split(v, r"\\"), lambda x: F.octet_length(F.regexp_replace(x, "^ +| +$", "")))
    bad = F.lit(False)
    for name, (most, many, _) in LIMITS.items():
        bad = F.when(vr == name, (F.octet_length(value) > most) & (F.array_max(parts) > most if many else F.octet_length(v) > most)).otherwise(bad)
    return issue([(bad, 4, WARNING)])


def repertoire(value: Column, vr: Column) -> Column:
    v = _unpad(value)
    outside = lambda letters: F.exists(F.split(v, r"\\"), lambda x: x.rlike(f"[^{letters}]"))
    return issue([
        ((vr == "AE") & (F.length(value) > 0) & (F.length(v) == 0), 13, WARNING),
        ((vr == "AE") & v.rlike(r"[\\\x00-\x1A\x1C-\x1F]"), 13, WARNING),
        ((vr == "DS") & outside(r"0-9+\-Ee. "), 19, WARNING),
        ((vr == "IS") & outside(r"0-9+\- "), 20, WARNING),
    ])


def multiplicity(value: Column, vm: Column) -> Column:
    """A rule of our own: the number of values is outside the attribute's multiplicity."""
    return F.when(value != "", multiplicity_of(values.count_values(value), vm))


def multiplicity_of(count: Column, vm: Column) -> Column:
    """multiplicity() of a number of values."""
    return issue([(~tags.vm_ok(count, vm), 5, ERROR)])


def _only(vr_name: str, rule: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda value, vr: F.when(vr == vr_name, rule(value))


RULES: dict[str, Callable[[Column, Column], Column]] = {
    "DA": _only("DA", date), "TM": _only("TM", time), "DT": _only("DT", date_time), "AS": _only("AS", age), "UI": _only("UI", uid), "PN": _only("PN", person_name),
    "CS": _only("CS", code_string), "length": length, "repertoire": repertoire,
}
SETS = {"all": list(RULES), "structural": ["length"], "datetime": ["DA", "TM", "DT", "AS"], "identifier": ["UI", "PN"], "character": ["CS", "repertoire", "length"]}
#: What a profile runs, and what it does with an error: stop, report or nothing.
PROFILES = {"strict": ("all", "validate"), "lenient": ("all", "warn"), "permissive": ("structural", "warn"), "none": (None, "skip")}


def issues(elements: DataFrame, rules: list[str] | str = "all", custom: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """A row for each rule that an element (.., vr, value) fails: its columns, rule_id, code and severity. custom adds rules."""
    named = {k: RULES[k] for k in (SETS[rules] if isinstance(rules, str) else rules)} | (custom or {})
    found = F.array(*[F.struct(F.lit(k).alias("rule_id"), rule(F.col("value"), F.col("vr")).alias("i")) for k, rule in named.items()])
    failed = F.filter(found, lambda x: x["i"].isNotNull() & (x["i"]["severity"] != ""))  # before rows are made of them
    rows = elements.withColumn("_i", F.explode(failed))
    return rows.select(*elements.columns, "_i.rule_id", "_i.i.code", "_i.i.severity")


def behave(found: DataFrame, profile: str, overrides: DataFrame | None = None) -> DataFrame:
    """found with behavior, by profile and by tag where overrides (tag, behavior) has it; skipped ones go."""
    default = PROFILES[profile][1]
    rows = found.join(F.broadcast(overrides), "tag", "left") if overrides is not None else found.withColumn("behavior", F.lit(None).cast("string"))  # overrides are a user's short list
    return rows.withColumn("behavior", F.coalesce("behavior", F.lit(default))).where("behavior <> 'skip'")


def enforce(found: DataFrame) -> DataFrame:
    """found, unless an error of a tag that is to be validated is among it: then reading it raises."""
    stop = (F.col("behavior") == "validate") & (F.col("severity") == ERROR)
    return found.where(F.when(stop, F.raise_error(F.concat(F.lit("validation: "), F.col("code")))).otherwise(F.lit(True)).cast("boolean"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def validity(elements: DataFrame, found: DataFrame, key: str = "file") -> DataFrame:
    """(key, valid): no error among a file's issues."""
    bad = found.groupBy(key).agg(F.bool_or(F.col("severity") == ERROR).alias("bad"))
    return elements.select(key).distinct().join(bad, key, "left").select(key, (~F.coalesce("bad", F.lit(False))).alias("valid"))


def valid_files(elements: DataFrame, rules: list[str] | str = "all", key: str = "file") -> DataFrame:
    """validity() of elements and all their issues, in one aggregation: no row is made for an issue."""
    named = [RULES[k] for k in (SETS[rules] if isinstance(rules, str) else rules)]
    bad = [F.coalesce(rule(F.col("value"), F.col("vr"))["severity"] == ERROR, F.lit(False)) for rule in named]
    return elements.select(key, reduce(lambda a, b: a | b, bad, F.lit(False)).alias("bad")).groupBy(key).agg((~F.bool_or("bad")).alias("valid"))
