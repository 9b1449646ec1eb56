"""Scalar cases of parsing, validation, UIDs, shifts and redaction, one column at a time."""

import pytest
from pyspark.sql import functions as F

from lumenframe import dims
from lumenframe.functions import tags, uids, values
from lumenframe.operators import deid, pixels, private, validate
from lumenframe.operators.query import ImageQuery, sop_class


def column(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def codes(spark, texts, rule):
    e = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "i int, value string, vr string")
    found = {r["i"]: r["code"][-3:] for r in validate.issues(e, [], {"x": lambda v, vr: rule(v)}).collect()}
    return [found.get(i) for i in range(len(texts))]


def test_dates(spark):
    good = ["20240115", "20240229", "19000101", "99991231", "202401", "2024", ""]
    bad = ["20241301", "20240001", "20240100", "20240230", "20240431", "20230229", "2024-01-15", "01/15/24", "2024O115", "20240", "202401151"]
    assert codes(spark, good, validate.date) == [None] * len(good)
    assert codes(spark, bad, validate.date) == ["026"] * 6 + ["007", "013", "013", "007", "007"]


def test_times(spark):
    assert codes(spark, ["12", "1234", "123456", "123456.1", "123456.123456"], validate.time) == [None] * 5
    assert codes(spark, ["250000", "126000", "125960", "1", "1234.5"], validate.time) == ["027", "027", "027", "008", "008"]


def test_date_times(spark):
    assert codes(spark, ["2024", "20240115", "20240115120000.5+0100", "20240"], validate.date_time) == [None] * 4
    assert codes(spark, ["19", "20241301", "20240115250000", "20240115120000+01", "20240115120000+1500"], validate.date_time) == ["007", "026", "027", "008", "027"]


@pytest.mark.parametrize("text", ["1.2.840.10008.1.2", "2.25.123456789", "1.0", "0.0", "1", "1.0.3", "1." + "2" * 62])
def test_good_uids(spark, text):
    assert codes(spark, [text], validate.uid) == [None]
    assert column(spark, [text], uids.is_valid) == [True]


def test_bad_uids(spark):
    assert codes(spark, ["1.02.3", "1..3", ".1.2.3", "1.2.3.", "1.2.a", "1." + "2" * 63], validate.uid) == ["009", "009", "009", "009", "013", "004"]


def test_other_rules(spark):
    assert codes(spark, ["045Y", "012M", "045y", "045X", "45Y", "04AY"], validate.age) == [None, None, "021", "021", "021", "013"]
    assert codes(spark, ["MR", "VALUE_1", "A B C", "abc", "TEST@VALUE", "12345678901234567", "CT\\mr"], validate.code_string) == [None, None, None, "022", "022", "004", "022"]
    assert codes(spark, ["A^B^C", "A=B=C=D", "A^B^C^D^E^F", "N" * 65], validate.person_name) == [None, "010", "010", "004"]
    assert codes(spark, ["123.456", " 1E10 ", "12.3A"], lambda v: validate.repertoire(v, F.lit("DS"))) == [None, None, "019"]
    assert codes(spark, ["AE\\TITLE", "   ", "MY_AE"], lambda v: validate.repertoire(v, F.lit("AE"))) == ["013", "013", None]


def test_profiles(spark):
    e = spark.createDataFrame([(1, "DA", "20241301")], "tag long, vr string, value string")
    with pytest.raises(Exception, match="validation"):
        validate.enforce(validate.behave(validate.issues(e), "strict")).collect()
    assert validate.enforce(validate.behave(validate.issues(e), "lenient")).count() == 1
    assert validate.behave(validate.issues(e), "none").count() == 0


def test_parsing(spark):
    assert [str(d) for d in column(spark, ["20240229", "20230229", "2024.01.15"], values.parse_da)] == ["2024-02-29", "None", "2024-01-15"]
    assert column(spark, ["12", "123456.5", "126000"], values.parse_tm) == [43_200_000_000, 45_296_500_000, None]
    assert column(spark, ["1\\x\\3"], values.parse_ints) == [[1, 3]]
    assert column(spark, ["a_b", "aXb", "a%c"], lambda c: values.wildcard(c, "a_?")) == [True, False, False]


def test_tags(spark):
    assert column(spark, ["(0010,0010)", "7FE00010", "x"], tags.parse) == [0x00100010, 0x7FE00010, None]
    low, high = zip(*[(r[0], r[1]) for r in spark.createDataFrame([("1",), ("1-3",), ("2-2n",), ("n",)], "v string").select(*tags.vm_range(F.col("v"))).collect()])
    assert (low, high) == ((1, 1, 2, 1), (1, 3, 65535, 65535))


def test_derived_uid(spark):
    assert column(spark, ["a"], uids.from_seed) == ["2.25.24598988875419711687751754798510365773"]


GOLDEN = {
    "0008,0050": "Z", "0010,0010": "Z", "0008,0018": "U", "0020,000D": "U", "0020,000E": "U", "0008,1030": "X", "0008,0020": "Z", "0008,002A": "X/Z/D", "0008,0021": "X/D", "0008,0023": "Z/D",
    "0008,0090": "Z", "0010,0020": "Z/D", "0010,0030": "Z", "9999,9999": "X",
}


def test_golden_actions(spark):
    rows = spark.createDataFrame([("f", "p", dims.t(k), "LO", "v") for k in GOLDEN], "file string, patient_id string, tag long, vr string, value string")
    got = {r["tag"]: r["code"] for r in deid.decide(rows, dims.dim_deid(spark), deid.DeidOptions()).collect()}
    assert {k: got.get(dims.t(k)) for k in GOLDEN if k != "9999,9999"} == {k: v for k, v in GOLDEN.items() if k != "9999,9999"}
    for tag, option, want in (("0008,0018", "ruid", "K"), ("0008,0080", "rinst", "K"), ("0008,1030", "cdesc", "C"), ("0008,0020", "rfull", "K"), ("0008,0020", "rmod", "C")):
        table = dims.dim_deid(spark).where(F.col("tag") == dims.t(tag))
        assert table.select(deid.action(deid.DeidOptions().retain(option))).first()[0] == want


def test_shift(spark):
    fixed = lambda c: deid.shift_date(c, F.lit(-100))
    assert column(spark, ["20240115", "", "invalid", "2024"], fixed) == ["20231007", "", "invalid", "2024"]
    p = deid.DateShift("per_patient", low=-365, high=-30, seed=12345)
    days = column(spark, [f"PATIENT{i:03d}" for i in range(10)] + ["PATIENT000"], p.offset)
    assert all(-365 <= d <= -30 for d in days) and days[0] == days[10] and len(set(days)) > 1


def test_uid_remap(spark):
    o = deid.DeidOptions()
    a, b, c, std, two = column(spark, ["1.2.3", " 1.2.3 ", "1.2.4", "1.2.840.10008.1.2", "1.2.3\\1.2.4"], lambda v: deid.remap_uid(v, o))
    assert a == b != c and std == "1.2.840.10008.1.2" and two == f"{a}\\{c}" and a.startswith("2.25.") and len(a) <= 64


def test_safe_creators_keep_their_own_row(spark):
    rows = [("f", "p", 0x00190010, "LO", "Safe "), ("f", "p", 0x00191005, "LO", "x"), ("f", "p", 0x00210010, "LO", "OTHER"), ("f", "p", 0x00211005, "LO", "y")]
    e = spark.createDataFrame(rows, "file string, patient_id string, tag long, vr string, value string")
    done = deid.deidentify(e, dims.dim_deid(spark), deid.DeidOptions().with_safe_creators("SAFE")).where("tag % 2 >= 0").collect()
    assert {r["tag"] for r in done} >= {0x00190010, 0x00191005} and not {r["tag"] for r in done} & {0x00210010, 0x00211005}


def test_private_slots(spark):
    e = spark.createDataFrame([("f", 0x00190010, "LO", "A"), ("f", 0x00190012, "LO", "B"), ("f", 0x00191201, "LO", "x"), ("f", 0x00191501, "LO", "lost")], "file string, tag long, vr string, value string")
    assert private.free_slot(e).first()["slot"] == 0x11
    assert [r["tag"] for r in private.orphans(e).collect()] == [0x00191501]
    assert 0x00191101 in {r["tag"] for r in private.renumbered(e).collect()}


def test_redaction(spark):
    rows = [(bytes([9] * 12), 2, 2, 3, 8, False), (bytes([9] * 8), 2, 2, 1, 16, False), (b"zip", 2, 2, 1, 8, True)]
    f = spark.createDataFrame(rows, "frame binary, rows int, cols int, samples int, bits int, encapsulated boolean").withColumn("regions", F.array(pixels.region(F.lit(0), F.lit(0), F.lit(1), F.lit(5))))
    a, b, c = pixels.redact(f, 0x010203).collect()
    assert bytes(a["frame"]) == bytes([1, 2, 3, 9, 9, 9] * 2) and bytes(b["frame"])[:4] == bytes([3, 2, 9, 9]) and c["status"] == "skipped"


def test_query_builder():
    assert sop_class("study", "find").endswith("2.2.1")
    assert ImageQuery.for_studies().with_patient_id("").keys == ()
