"""Private attributes: creators, orphans, stripping, slots. Keys are (file, group, slot); no list of elements is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags, values

FIRST_SLOT, LAST_SLOT = 0x10, 0xFF


def blocks(elements: DataFrame) -> DataFrame:
    """The private rows of elements with group_no, slot and is_creator."""
    tag = F.col("tag")
    return elements.where(tags.is_private(tag)).select(*elements.columns, tags.group(tag).alias("group_no"), tags.slot(tag).alias("slot"), tags.is_private_creator(tag).alias("is_creator"))


def creators(elements: DataFrame) -> DataFrame:
    """(file, group_no, slot, creator), one row a slot: a file that came twice has its creators once."""
    return blocks(elements).where("is_creator").groupBy("file", "group_no", "slot").agg(F.min("value").alias("creator"))


def with_creators(files: DataFrame) -> DataFrame:
    """Sets (file, elements) with creators: block and name of the private creators of each file."""
    own = F.filter("elements", lambda e: tags.is_private_creator(e["tag"]))
    return files.withColumn("creators", F.transform(own, lambda e: F.struct(tags.block(e["tag"]).alias("block"), e["value"].alias("creator"))))


def owner() -> Column:
    """The creator of a private row's block among the creators of its file, null for orphans; of several of a slot the least, as creators() has it."""
    mine = F.filter("creators", lambda c: c["block"] == tags.block(F.col("tag")))
    return F.array_min(F.transform(mine, lambda c: c["creator"]))


def with_creator(elements: DataFrame) -> DataFrame:
    """Private data rows with their creator, null for orphans."""
    if "creators" in elements.columns:
        return blocks(elements).where("not is_creator").withColumn("creator", owner()).drop("creators")
    return blocks(elements).where("not is_creator").join(creators(elements), ["file", "group_no", "slot"], "left")


def orphans(elements: DataFrame) -> DataFrame:
    if "creators" in elements.columns:
        known = F.exists("creators", lambda c: c["block"] == tags.block(F.col("tag")))
        return blocks(elements).where("not is_creator").where(~known).drop("creators")
    return blocks(elements).where("not is_creator").join(creators(elements), ["file", "group_no", "slot"], "left_anti")


def strip(elements: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """elements without private rows, but for those of creators in keep and the creators' own rows."""
    public = elements.where(~tags.is_private(F.col("tag")))
    if not keep:
        return public
    if "creators" in elements.columns:
        mine = F.coalesce(values.creator_key(owner()).isin(*[k.strip().upper() for k in keep]), F.lit(False))
        return elements.where(F.when(tags.is_private(F.col("tag")), mine).otherwise(F.lit(True)))
    safe = creators(elements).where(values.creator_key(F.col("creator")).isin(*[k.strip().upper() for k in keep])).select("file", "group_no", "slot")
    return public.unionByName(blocks(elements).join(safe, ["file", "group_no", "slot"], "left_semi").select(*elements.columns))


def free_slot(elements: DataFrame) -> DataFrame:
    """(file, group_no, slot): the least slot of each group with creators that none has; null if all are taken."""
    used = creators(elements).groupBy("file", "group_no").agg(F.collect_set("slot").alias("used"))  # at most 240 slots
    left = F.array_except(F.sequence(F.lit(FIRST_SLOT), F.lit(LAST_SLOT)), F.col("used"))
    return used.select("file", "group_no", F.array_min(left).alias("slot"))


def compact(elements: DataFrame) -> DataFrame:
    """(file, group_no, slot, new_slot): slots renumbered from the first in their order."""
    order = Window.partitionBy("file", "group_no").orderBy("slot")
    return creators(elements).select("file", "group_no", "slot", "creator", (F.row_number().over(order) + (FIRST_SLOT - 1)).alias("new_slot"))


def renumbered(elements: DataFrame) -> DataFrame:
    """elements with the tags of private rows moved to their new slots."""
    rows = blocks(elements).join(compact(elements).drop("creator"), ["file", "group_no", "slot"])
    base = F.col("group_no").cast("long") * 65536
    moved = F.when(F.col("is_creator"), base + F.col("new_slot")).otherwise(base + F.col("new_slot") * 256 + F.col("tag").bitwiseAND(F.lit(0xFF)))
    public = elements.where(~tags.is_private(F.col("tag")))
    return public.unionByName(rows.withColumn("tag", moved).select(*elements.columns))


def add(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows to add for wanted (file, group_no, creator, offset, vr, value): the creator's row if it is new, and the data's."""
    known = creators(elements).withColumn("key", values.creator_key(F.col("creator"))).groupBy("file", "group_no", "key").agg(F.min("slot").alias("slot"))
    free = free_slot(elements).withColumnRenamed("slot", "free")
    rows = wanted.withColumn("key", values.creator_key(F.col("creator"))).join(known, ["file", "group_no", "key"], "left").join(free, ["file", "group_no"], "left")
    rows = rows.withColumn("new", F.col("slot").isNull()).withColumn("slot", F.coalesce("slot", "free", F.lit(FIRST_SLOT)))
    base = F.col("group_no").cast("long") * 65536
    own = rows.where("new").select("file", (base + F.col("slot")).alias("tag"), F.lit("LO").alias("vr"), F.col("creator").alias("value")).distinct()
    return own.unionByName(rows.select("file", (base + F.col("slot") * 256 + F.col("offset")).alias("tag"), "vr", "value"))


def vendor_lookup(rows: DataFrame, builtin: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """Private data rows (creator, tag) with the dictionary's representation and keyword; a user's entries go first."""
    key = rows.withColumn("key", values.creator_key(F.col("creator"))).withColumn("elem_offset", F.col("tag").bitwiseAND(F.lit(0xFF)).cast("int"))
    shape = lambda d, p: d.select(values.creator_key(F.col("creator")).alias("key"), "elem_offset", F.col("vr").alias(f"{p}_vr"), F.col("keyword").alias(f"{p}_keyword"))
    out = key.join(shape(builtin, "b"), ["key", "elem_offset"], "left")
    if user is not None:
        out = out.join(shape(user, "u"), ["key", "elem_offset"], "left")
    else:
        out = out.withColumn("u_vr", F.lit(None).cast("string")).withColumn("u_keyword", F.lit(None).cast("string"))
    return out.select(*rows.columns, F.coalesce("u_vr", "b_vr", F.lit("UN")).alias("dict_vr"), F.coalesce("u_keyword", "b_keyword").alias("keyword"))
