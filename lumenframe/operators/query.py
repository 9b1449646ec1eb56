"""Query/retrieve: a fluent builder whose keys become Column predicates over an image table.

A query at a level returns one row per entity of that level. Keys on images below the level (a series UID in a study
query) keep the entities that have such an image. Wildcards, lists, ranges and universal matching follow the standard's
attribute matching.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import QR_CLASSES
from ..functions import values

LEVELS = ["PATIENT", "STUDY", "SERIES", "IMAGE"]
KEYS = {"PATIENT": ["patient_id"], "STUDY": ["patient_id", "study_uid"], "SERIES": ["patient_id", "study_uid", "series_uid"], "IMAGE": ["patient_id", "study_uid", "series_uid", "sop_uid"]}
#: Attributes that are the same for all images of an entity.
CARRIED = {"PATIENT": ["patient_name"], "STUDY": ["patient_name", "study_date", "accession", "description"], "SERIES": ["patient_name", "study_date", "accession", "description"], "IMAGE": ["patient_name", "study_date", "accession", "description", "modality"]}


def sop_class(root: str, verb: str) -> str:
    return next(uid for r, v, uid in QR_CLASSES if (r, v) == (root.lower(), verb.lower()))


@dataclass(frozen=True)
class ImageQuery:
    level: str
    keys: tuple[Column, ...] = ()
    modalities: tuple[str, ...] = ()
    returned: tuple[str, ...] = field(default=())

    @staticmethod
    def for_patients() -> ImageQuery:
        return ImageQuery("PATIENT")

    @staticmethod
    def for_studies() -> ImageQuery:
        return ImageQuery("STUDY")

    @staticmethod
    def for_series() -> ImageQuery:
        return ImageQuery("SERIES")

    @staticmethod
    def for_images() -> ImageQuery:
        return ImageQuery("IMAGE")

    def _and(self, key: Column) -> ImageQuery:
        return replace(self, keys=(*self.keys, key))

    def _text(self, name: str, value: str) -> ImageQuery:
        """Universal match for an empty value; wildcards where there are any; equality else."""
        if value == "":
            return self
        return self._and(values.wildcard(F.col(name), value) if set(value) & {"*", "?"} else F.col(name) == value)

    def with_patient_name(self, value: str) -> ImageQuery:
        return self._text("patient_name", value)

    def with_patient_id(self, value: str) -> ImageQuery:
        return self._text("patient_id", value)

    def with_accession(self, value: str) -> ImageQuery:
        return self._text("accession", value)

    def with_study_date(self, day: str) -> ImageQuery:
        return self.with_study_date_range(day, day)

    def with_study_date_range(self, start: str | None, end: str | None) -> ImageQuery:
        """Both ends belong to the range; None leaves it open. Days are yyyyMMdd, which order as text."""
        q = self if start is None else self._and(F.col("study_date") >= start)
        return q if end is None else q._and(F.col("study_date") <= end)

    def with_study_uid(self, *uids: str) -> ImageQuery:
        return self._and(F.col("study_uid").isin(*uids))

    def with_series_uid(self, *uids: str) -> ImageQuery:
        return self._and(F.col("series_uid").isin(*uids))

    def with_sop_uid(self, *uids: str) -> ImageQuery:
        return self._and(F.col("sop_uid").isin(*uids))

    def with_modality(self, *modalities: str) -> ImageQuery:
        return replace(self, modalities=(*self.modalities, *modalities))

    def return_field(self, *names: str) -> ImageQuery:
        return replace(self, returned=(*self.returned, *names))

    def predicate(self) -> Column:
        """Everything that holds of single images."""
        own = [F.col("modality").isin(*self.modalities)] if self.modalities else []
        return reduce(lambda a, b: a & b, [*self.keys, *own], F.lit(True))

    def run(self, images: DataFrame) -> DataFrame:
        """The matching entities with the counts of what matches below them, and their modalities."""
        found = images.where(self.predicate())
        if self.level == "IMAGE":
            return found.select(*KEYS["IMAGE"], *CARRIED["IMAGE"], *self.returned)
        below = LEVELS[LEVELS.index(self.level) + 1 :]
        # an entity's rows meet once, with the columns that are used, and its UIDs are counted there as sets: nothing is expanded
        keys = KEYS[self.level]
        carried = [*CARRIED[self.level], *self.returned]
        counted = {{"STUDY": "n_studies", "SERIES": "n_series"}[x]: KEYS[x][-1] for x in below if x != "IMAGE"}
        met = found.select(*dict.fromkeys([*keys, *carried, *counted.values(), "modality"])).repartition(*keys)
        counts = [F.count(F.lit(1)).alias("n_images")] + [F.size(F.collect_set(c)).cast("long").alias(n) for n, c in counted.items()]
        return met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in carried], *counts, F.array_join(F.array_sort(F.collect_set("modality")), "\\").alias("modalities"))


def retrieve(images: DataFrame, query: ImageQuery, destination: str | None) -> DataFrame:
    """C-MOVE as a plan: the images of a query with where they go; a missing destination is status A801."""
    found = query.run(images) if query.level == "IMAGE" else images.join(query.run(images).select(*KEYS[query.level]), KEYS[query.level], "left_semi")
    status = F.lit(0xA801 if not destination else 0)
    return found.withColumn("destination", F.lit(destination)).withColumn("status", status)


def level_counts(images: DataFrame) -> DataFrame:
    """Numbers of images by patient, study and series with subtotals: a rollup of the hierarchy."""
    return images.rollup("patient_id", "study_uid", "series_uid").agg(F.count(F.lit(1)).alias("n_images"), F.grouping_id().alias("level_bits"))
