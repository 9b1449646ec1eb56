"""Dictionaries from the standards' XML: private attributes by Spark's XML reader, tables of the standard's books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import creator_key, keyword

ENTRY = "_owner string, _group string, _element string, _vr string, _vm string, _name string"
CELLS = "td array<struct<para: string>>"


def private_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(creator, key, group_no, elem_offset, vr, vm, keyword, name) of an XML file of entry elements; first of each key."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    low = F.conv(F.regexp_extract("_element", "([0-9A-Fa-f]{2})$", 1), 16, 10).cast("int")
    shaped = rows.select(F.col("_owner").alias("creator"), creator_key(F.col("_owner")).alias("key"), F.conv("_group", 16, 10).cast("int").alias("group_no"), low.alias("elem_offset"), F.col("_vr").alias("vr"), F.col("_vm").alias("vm"), keyword(F.col("_name")).alias("keyword"), F.col("_name").alias("name"))
    return first_per_key(shaped, ["key", "group_no", "elem_offset"], ["vr", "name"])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def docbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(cells array<string>) of all table rows of a DocBook file."""
    rows = spark.read.format("xml").option("rowTag", "tr").schema(CELLS).load(path)
    return rows.select(F.transform("td", lambda c: F.trim(F.regexp_replace(c["para"], "[\\u200b\\s]+", " "))).alias("cells"))


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, mask, keyword, name, vrs, vm, retired) of the tables of attributes: x in a tag stands for any digit."""
    from ..functions.tags import parse_pattern

    c = F.col("cells")
    rows = docbook_rows(spark, path).where(F.size(c) >= 5).where(c[0].rlike(r"^\([0-9A-Fa-fx]{4},[0-9A-Fa-fx]{4}\)$"))
    mask, card = parse_pattern(c[0])
    shaped = rows.select(card.alias("tag"), mask.alias("mask"), F.replace(c[2], F.lit(" "), F.lit("")).alias("keyword"), c[1].alias("name"), F.split(c[3], " or ").alias("vrs"), c[4].alias("vm"), F.coalesce(F.get(c, 5).startswith("RET"), F.lit(False)).alias("retired"))
    return first_per_key(shaped, ["tag", "mask"], ["retired", "keyword"])


def deid_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, mask, basic and the options' actions) of the table of confidentiality profiles; an empty cell is null."""
    from ..dims import DEID_OPTIONS
    from ..functions.tags import parse_pattern

    c = F.col("cells")
    rows = docbook_rows(spark, path).where(F.size(c) >= 15).where(c[1].rlike(r"^\([0-9A-Fa-fx]{4},[0-9A-Fa-fx]{4}\)$"))
    mask, card = parse_pattern(c[1])
    cell = lambda i: F.when(c[i] != "", c[i])
    shaped = rows.select(card.alias("tag"), mask.alias("mask"), cell(4).alias("basic"), *[cell(5 + i).alias(o) for i, o in enumerate(DEID_OPTIONS)])
    return first_per_key(shaped, ["tag", "mask"], ["basic"])


#: Rows of a dictionary of tags up to which it is handed to parsers as a whole.
MOST_TAGS = 100_000


def representations(dictionary: DataFrame) -> dict[int, str]:
    """tag to representation of a tag_dictionary() without its patterns, for ReadOptions.dictionary; the first where there are several."""
    rows = dictionary.where("mask is null or mask = 4294967295").select("tag", F.col("vrs")[0].alias("vr")).where("length(vr) = 2").limit(MOST_TAGS + 1).collect()
    if len(rows) > MOST_TAGS:
        raise ValueError(f"a dictionary of more than {MOST_TAGS} tags")
    return {r["tag"]: r["vr"] for r in rows}


def keywords(dictionary: DataFrame) -> dict[str, int]:
    """keyword to tag, for config.options()."""
    rows = dictionary.where("keyword <> ''").select("keyword", "tag").limit(MOST_TAGS + 1).collect()
    if len(rows) > MOST_TAGS:
        raise ValueError(f"a dictionary of more than {MOST_TAGS} tags")
    return {r["keyword"]: r["tag"] for r in rows}
