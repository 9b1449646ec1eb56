"""Data sets as rows: reading, changing and ordering elements (file, tag, vr, value), and data sets as one variant each.

Where each file has one row with all its elements (file, elements: array of tag, vr, value), the functions of sets do the
same in that row, without a shuffle; sets() makes such rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags, values


def pick(elements: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(file, one column a tag): values by tag, null where a file has none; one aggregation for all of them."""
    few = elements.where(F.col("tag").isin(*wanted.values()))
    return few.groupBy("file").agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(n) for n, t in wanted.items()])


def get_or_raise(value: Column, name: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{name} is missing")))


def upsert(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """elements with the rows of changes in place of those of the same file and tag."""
    kept = elements.join(changes.select("file", "tag"), ["file", "tag"], "left_anti")
    return kept.unionByName(changes.select(*elements.columns))


def remove(elements: DataFrame, gone: DataFrame) -> DataFrame:
    """elements without those of gone (file, tag)."""
    return elements.join(gone, ["file", "tag"], "left_anti")


def ordered(elements: DataFrame) -> DataFrame:
    """(file, elements): each file's elements in order of their tags. Tags are unsigned, which longs keep."""
    return elements.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("tag", "vr", "value"))).alias("elements"))  # one file's elements


def sets(elements: DataFrame) -> DataFrame:
    """(file, elements): a row a file."""
    return elements.groupBy("file").agg(F.collect_list(F.struct("tag", "vr", "value")).alias("elements"))  # one file's elements


def pick_sets(files: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """pick() of sets: a column a tag, the largest value of the tag in each file."""
    value = lambda t: F.array_max(F.filter("elements", lambda e: e["tag"] == t)["value"])
    return files.select("file", *[value(t).alias(n) for n, t in wanted.items()])


def upsert_sets(files: DataFrame, changes: Column) -> DataFrame:
    """sets with the elements of changes, an array a file, in place of those of the same tag; null changes nothing."""
    kept = F.filter("elements", lambda e: ~F.array_contains(changes["tag"], e["tag"]))
    return files.withColumn("elements", F.when(F.size(changes) > 0, F.concat(kept, changes)).otherwise(F.col("elements")))


def remove_sets(files: DataFrame, gone: Column) -> DataFrame:
    """sets without the tags of gone, an array a file."""
    return files.withColumn("elements", F.when(F.size(gone) > 0, F.filter("elements", lambda e: ~F.array_contains(gone, e["tag"]))).otherwise(F.col("elements")))


def rows(files: DataFrame) -> DataFrame:
    """A row an element of sets."""
    others = [c for c in files.columns if c != "elements"]
    # the filter that is inferred from an inner explode would make the arrays once more, below
    made = files.select(*others, F.posexplode_outer("elements").alias("_at", "e")).where("_at is not null")
    return made.select(*others, "e.tag", "e.vr", "e.value")


def tags_in_order(files: DataFrame) -> DataFrame:
    """(file, tags): the tags of each file of sets in their order, each once."""
    return files.select("file", F.sort_array(F.array_distinct(F.col("elements")["tag"])).alias("tags"))


def variants(elements: DataFrame) -> DataFrame:
    """(file, ds): each file as a variant in the shape of DICOM JSON: {"GGGGEEEE": {"vr": .., "Value": [..]}}."""
    return variants_of_sets(sets(elements.dropDuplicates(["file", "tag"])))


def variants_of_sets(files: DataFrame) -> DataFrame:
    """variants() of sets; of several elements of a tag the first counts."""
    tag = F.col("elements")["tag"]
    first = F.filter("elements", lambda e, i: F.array_position(tag, e["tag"]) == i + 1)
    entry = lambda e: F.struct(e["vr"].alias("vr"), values.split_values(e["value"]).alias("Value"))
    maps = F.map_from_entries(F.transform(first, lambda e: F.struct(tags.to_hex(e["tag"]).alias("k"), entry(e).alias("v"))))
    return files.select("file", F.parse_json(F.to_json(maps)).alias("ds"))


def variant_value(ds: Column, tag: int, index: int = 0, kind: str = "string") -> Column:
    return F.try_variant_get(ds, f"$['{tag:08X}'].Value[{index}]", kind)


def with_callback(elements: DataFrame, decide: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """elements after a user's function, called with batches: per row "keep", "remove" or "=<new value>"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = pa.array(decide(b.to_pandas()), pa.string(), from_pandas=True)
            change = pc.fill_null(pc.starts_with(said, "="), False)
            at = b.schema.get_field_index("value")
            new = pc.if_else(change, pc.utf8_slice_codeunits(said, 1), b.column(at))
            yield b.set_column(at, b.schema.field(at), new).filter(pc.fill_null(pc.not_equal(said, "remove"), True))

    return elements.mapInArrow(run, elements.schema)
