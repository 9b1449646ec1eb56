"""Files as one row each: nothing but the tables is shuffled, images that share a file are one, and results stay the same."""

import hashlib
import re
import uuid

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from lumenframe import dims
from lumenframe.functions import uids, values
from lumenframe.operators import dataset, deid, private, validate
from lumenframe.plans import bridge, registry
from lumenframe.sources import reader
from lumenframe.sources.encode import Node, encode, encode_flat


@pytest.fixture(scope="module")
def shared_files(spark, tmp_path_factory):
    """Tables in which some lines come twice, with other quantities."""
    folder = tmp_path_factory.mktemp("twice")
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(300)
    lines.unionByName(lines.limit(40).withColumn("l_quantity", F.col("l_quantity") + 1).withColumn("l_returnflag", F.lit("A"))).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/orders.parquet").write.parquet(f"{folder}/orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["ds_ordered", "ds_remove", "ds_typed_getters", "ds_upsert", "private_orphans", "private_strip", "parse_elements", "deid_scopes"])
def test_images_that_share_a_file(spark, shared_files, name):
    import duckdb

    c = duckdb.connect()
    for t in ("lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{shared_files}/{t}.parquet/*.parquet'")
    assert rows_of(registry.queries()[name](spark, shared_files).toPandas()) == rows_of(c.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["ds_ordered", "ds_variant", "ds_typed_getters"])
def test_elements_are_not_shuffled(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall("Exchange hashpartitioning", plan)) == 2 and all("orderkey" in x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan))


def test_derived_uids(spark):
    rows = spark.createDataFrame([(f"salt{i}",) for i in range(200)] + [(None,)], "s string")
    for r in uids.with_derived(rows, "fast", F.col("s")).select("s", "fast", uids.from_seed(F.col("s")).alias("slow")).collect():
        if r["s"] is None:
            assert r["fast"] is None
            continue
        b = bytearray(hashlib.sha256(r["s"].encode()).digest()[:16])
        b[6], b[8] = b[6] & 0x0F | 0x50, b[8] & 0x3F | 0x80
        assert r["fast"] == r["slow"] == f"2.25.{uuid.UUID(bytes_le=bytes(b)).int}"
    edges = ["0" * 32, "f" * 32, "0" * 31 + "7", "8" + "0" * 31, "0" * 16 + "f" * 16, "0" * 15 + "1" + "0" * 16]
    got = spark.createDataFrame([(h,) for h in edges], "h string").select("h", uids.decimal_of_hex(F.col("h")).alias("d")).collect()
    assert [r["d"] for r in got] == [str(int(r["h"], 16)) for r in got]


def test_creators_of_sets_are_those_of_rows(spark):
    tags = [(0x00190010, "ACME"), (0x00190011, "safe "), (0x00191001, "a"), (0x00191101, "b"), (0x00191501, "c"), (0x00100010, "d")]
    e = spark.createDataFrame([("f", "p", t, "LO", v) for t, v in tags], "file string, patient_id string, tag long, vr string, value string")
    rows = dataset.rows(private.with_creators(dataset.sets(e).withColumn("patient_id", F.lit("p"))))
    options = deid.DeidOptions().with_safe_creators("SAFE")
    table = dims.dim_deid(spark)
    show = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert show(deid.decide(rows, table, options), "tag", "code", "resolved") == show(deid.decide(e, table, options), "tag", "code", "resolved")
    assert show(private.with_creator(rows), "tag", "creator") == show(private.with_creator(e), "tag", "creator")
    assert show(private.strip(rows, ["Safe"]), "tag") == show(private.strip(e, ["Safe"]), "tag")


def test_rules_look_at_counts_not_at_elements(spark):
    plan = registry.queries()["val_multiplicity"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan[plan.index("Generate") :]
    assert spark.createDataFrame([("a\\b",), ("",), ("a",)], "v string").select(values.count_values(F.col("v")).alias("n")).collect() == [(2,), (1,), (1,)]


def test_valid_files(spark):
    e = spark.createDataFrame([(1, "DA", "20240101"), (1, "CS", "abc"), (2, "DA", "20241301"), (3, "LO", None)], "file int, vr string, value string")
    assert {tuple(r) for r in validate.valid_files(e).collect()} == {tuple(r) for r in validate.validity(e, validate.issues(e)).collect()} == {(1, True), (2, False), (3, True)}


def test_flat_files_and_asked_columns(spark):
    rows = [(0x00080016, "UI", b"1.2.3"), (0x00080018, "UI", b"1.2.4"), (0x00100020, "LO", b"P"), (0x00280010, "US", b"\x01\x02")]
    for syntax in (dims.EXPLICIT_LE, dims.IMPLICIT_LE, "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"):
        assert encode_flat(rows, syntax) == encode([Node(*r) for r in rows], syntax)
    content = spark.createDataFrame([("f", encode_flat(rows))], "file string, content binary")
    assert reader.elements(content, columns=["patient_id", "tag"]).collect() == [("P", r[0]) for r in rows]
