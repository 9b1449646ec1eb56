"""N-gram Jaccard join: a grouped prefix join of documents by their sets of word shingles, and its components.

1. Every document becomes its set of distinct shingles, as sorted 64-bit hashes. Equal sets are one class.
2. Document frequencies: each Arrow batch sends its shingles, packed by ranges of the hash, to the task of the range,
   which returns those that at least two classes hold, with their numbers of classes.
3. A class's prefix is its first n - ceil(0.75 n) + 1 shingles in the order of (frequency, hash): two similar sets share
   one. A shingle of a single class can't be shared, so it only fills a place; most classes have nothing else in their
   prefix and drop out. The shingles returned by step 2 are also all that an intersection can hold, so nothing is read
   again in order to verify a pair.
4. Classes with the same prefix and size are one group. Groups meet in the prefix index under size and position filters.
   First each group meets three pivots of each index entry, which connects groups of near copies with few pairs, and
   what is still apart meets twelve more; then every pair of an entry that is not connected yet is verified. Pairs of one component need
   no further test: the result is the component.
5. Components of the verified links, and of the classes, by alternating stars.

Sets are compared by hashes of at least 52 bits; two different shingles of two documents meet by chance with a
probability below 1e-10 for any pair that is compared.

Nulls and texts without words have an empty set, link with nothing and are their own component. Fewer words than a
shingle has are one shingle. Repeated rows link with each other. A null id never names a component. Very long texts are
sets like others. An empty table gives an empty one. Ids are integers. Other columns are left out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected

SHINGLE_WORDS = 5
#: Two sets link when 7 * intersection >= 3 * (sum of sizes), that is, intersection / union >= 3/4.
THREE_QUARTERS = (7, 3)
#: Shingles for one range of hashes, and those that a batch gathers before it sends them.
RANGE_SHINGLES = 2_000_000
SEND_SHINGLES = 400_000
LEAST_BITS = 4
REST_BITS = 48
#: Classes of an index entry that all others of it are held against, first and again for what is still apart.
PIVOTS, MORE_PIVOTS = 3, 12
#: Classes of an index entry that a block holds where all links are asked for.
BLOCK_ROWS = 512
CACHE_WORDS = 150_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class Shingler:
    """Sets of shingles as sorted arrays of 64-bit hashes."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)] if words else [], np.uint64)
        a = self.hashes(words)
        n = len(a) - self.words + 1
        h = np.zeros(n, np.uint64)
        for k in range(self.words):
            h ^= h >> np.uint64(29)
            h += a[k : k + n]
            h *= _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(32)
        h *= _MIX[0]
        h ^= h >> np.uint64(29)
        return np.unique(h)


def class_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=2) - (1 << 63)


def profile(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, cls, mark): size and class of each document's set, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sizes, classes = [], []
            for x in batch.column(1):
                s = shingler(x.as_py())
                sizes.append(len(s))
                classes.append(class_id(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), batch.column(2)], names=["doc_id", "n_shingles", "cls", "mark"])

    return docs.select(F.col("doc_id").cast("long"), "text", text_mark(docs["text"])).mapInArrow(common.tidy(run), "doc_id long, n_shingles long, cls long, mark long")


def text_mark(text: Column) -> Column:
    """A hash that tells apart the texts of rows that share an id."""
    return F.xxhash64(text)


def packed(docs: DataFrame, bits: int, words: int) -> DataFrame:
    """Blobs of shingles by ranges of their hashes: low 32 and next 16 bits of each, its owner, and the owners' class and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        sets: list[np.ndarray] = []
        total = 0

        def send() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            classes = np.array([class_id(s) for s in sets], np.int64)
            lengths = np.array([len(s) for s in sets], np.int32)
            order = np.argsort(flat)
            flat, owner = flat[order], owner[order]
            part = (flat >> np.uint64(64 - bits)).astype(np.int64)
            rest = flat >> np.uint64(16 - bits) if bits < 16 else flat
            edges = np.searchsorted(part, np.arange((1 << bits) + 1)) if bits <= 16 else None
            spans = zip(range(1 << bits), edges[:-1], edges[1:], strict=True) if edges is not None else ((part[i], i, j) for i, j in _runs(part))
            for p, i, j in spans:
                if i == j:
                    continue
                own, local = np.unique(owner[i:j], return_inverse=True)
                x = rest[i:j]
                blob = [(x & np.uint64(0xFFFFFFFF)).astype("<u4"), ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2"), local.astype("<u2"), classes[own], lengths[own]]
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int64()), *(pa.array([b.tobytes()], pa.binary()) for b in blob)], names=["part", "low", "high", "owner", "cls", "n"])

        for batch in batches:
            for x in batch.column(0):
                s = shingler(x.as_py())
                if len(s):
                    sets.append(s)
                    total += len(s)
                if total >= SEND_SHINGLES or len(sets) >= 60_000:
                    yield from send()
                    sets, total = [], 0
        if sets:
            yield from send()

    return docs.select("text").mapInArrow(common.tidy(run), "part long, low binary, high binary, owner binary, cls binary, n binary")


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def shared_shingles(docs: DataFrame, bits: int, words: int) -> DataFrame:
    """(cls, n, tok, df): the shingles that at least two classes hold, for each class that holds them."""

    def count(blobs: pa.Table) -> pa.Table:
        part = blobs.column("part")[0].as_py()
        toks, owners, classes, sizes, first = [], [], [], [], 0
        for r in blobs.select(["low", "high", "owner", "cls", "n"]).to_batches(max_chunksize=1):
            low, high, own, cls, n = (np.frombuffer(c[0].as_buffer(), k) for c, k in zip(r.columns, ("<u4", "<u2", "<u2", np.int64, np.int32), strict=True))
            toks.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
            owners.append(own.astype(np.int32) + first)
            classes.append(cls)
            sizes.append(n)
            first += len(cls)
        tok, owner, classes, sizes = map(np.concatenate, (toks, owners, classes, sizes))
        del toks, owners
        order = np.argsort(tok)
        tok = tok[order]
        same = tok[1:] == tok[:-1]
        often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        owner, tok = owner[order[often]], tok[often]
        cls, n = classes[owner], sizes[owner]
        order = np.lexsort((n, cls, tok))
        tok, cls, n = tok[order], cls[order], n[order]
        fresh = np.concatenate([[True], (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1]) | (n[1:] != n[:-1])])[: len(tok)]
        tok, cls, n = tok[fresh], cls[fresh], n[fresh]
        _, back, df = np.unique(tok, return_inverse=True, return_counts=True)
        df = df[back] if len(tok) else np.zeros(0, np.int64)
        kept = df > 1
        whole = (tok[kept] | np.uint64((part << REST_BITS) & 0xFFFFFFFFFFFFFFFF)) if bits <= 16 else tok[kept] | np.uint64((part << (64 - bits)) & 0xFFFFFFFFFFFFFFFF)
        return pa.table({"cls": cls[kept], "n": n[kept].astype(np.int64), "tok": whole.view(np.int64), "df": df[kept].astype(np.int64)})

    def tidy_count(blobs: pa.Table) -> pa.Table:
        out = count(blobs)
        common.release()
        return out

    return packed(docs, bits, words).groupBy("part").applyInArrow(tidy_count, "cls long, n long, tok long, df long")


def similar_sizes(n: Column, m: Column) -> Column:
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (n > 0)


def may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Size and position filters, for the first shingle that two sets share: places from 0."""
    top, low = THREE_QUARTERS
    return similar_sizes(n, m) & (top * (1 + F.least(n - pos - 1, m - at - 1)) >= low * (n + m))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    top, low = THREE_QUARTERS
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("toks").alias("toks_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("toks").alias("toks_b"))
    met = pairs.join(one, "a").join(two, "b")
    return met.where(top * F.size(F.array_intersect("toks_a", "toks_b")) >= low * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def class_links(sets: DataFrame) -> DataFrame:
    """(node, label): components of the classes in sets (cls, n, used, prefix, toks), as far as they link with another."""
    members = sets.select("cls", "n", "gid", "used", "prefix")
    groups = sets.groupBy("gid").agg(F.min(F.struct("cls", "n", "used", "prefix")).alias("g"))
    index = groups.select("gid", F.col("g.cls").alias("rep"), F.col("g.n").alias("n"), F.posexplode("g.prefix").alias("i", "tok"), F.col("g.used").alias("used"))
    index = common.write_shared(index.select("tok", "gid", "rep", "n", (F.col("used") + F.col("i")).alias("pos")), "prefix-index")
    # pivots of each entry, and of each group
    pivots = [F.min_by(F.struct("gid", "rep", "n", "pos"), F.xxhash64("gid", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    entries = index.groupBy("tok").agg(F.count(F.lit(1)).alias("c"), F.array_distinct(F.array(*pivots)).alias("pivots")).where("c > 1").drop("c")
    met = index.join(entries, "tok").select("gid", "rep", "n", "pos", F.explode("pivots").alias("p")).where("gid <> p.gid")
    met = met.where(may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"))).select(*ordered_pair("rep", "p.rep"))
    within = members.select("cls", "gid").join(groups.select("gid", F.col("g.cls").alias("rep")), "gid").where("cls <> rep").select(*ordered_pair("cls", "rep"))
    first = common.write_shared(verified(met.unionByName(within).distinct(), sets), "links")
    labels = common.write_shared(connected(first), "labels")
    # more pivots for what shares an entry and is not connected yet
    rows, named = open_rows(index, members, labels)
    tops = [F.min_by(F.struct("cls", "n", "pos", "label"), F.xxhash64("cls", F.lit(PIVOTS + k))).alias(f"p{k}") for k in range(MORE_PIVOTS)]
    entries = rows.groupBy("tok").agg(F.array_distinct(F.array(*tops)).alias("pivots"))
    met = rows.join(entries, "tok").select("cls", "n", "pos", "label", F.explode("pivots").alias("p")).where("label <> p.label")
    met = met.where(may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"))).select(*ordered_pair("cls", "p.cls")).distinct()
    labels = common.write_shared(merged(named, verified(met, sets)), "labels")
    # and then every pair, at the first shingle that both prefixes have
    rows, named = open_rows(index, members, labels)
    other = rows.select("tok", *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "pos", "label", "before")])
    met = rows.join(other, "tok").where("label < label2").where(may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
    pairs = met.where(~F.arrays_overlap("before", "before2")).select(*ordered_pair("cls", "cls2")).distinct()
    return merged(named, verified(pairs, sets))


def open_rows(index: DataFrame, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members' rows of entries that hold more than one label, and (cls, label) of all members."""
    named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = common.write_shared(named, "named")
    spans = named.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    entries = index.join(spans, "gid").groupBy("tok").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("tok")
    before = F.slice("prefix", F.lit(1), (F.col("pos") - F.col("used")).cast("int"))
    rows = index.select("tok", "gid", "pos").join(entries, "tok").join(named, "gid").select("tok", "cls", "n", "pos", "label", before.alias("before"))
    return common.write_shared(rows, "open-entries"), named.select("cls", "label")


def merged(named: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of named (cls, label) after the components of further links."""
    joined = links.join(named.select(F.col("cls").alias("a"), F.col("label").alias("la")), "a").join(named.select(F.col("cls").alias("b"), F.col("label").alias("lb")), "b")
    over = connected(joined.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return named.join(over, "label", "left").select(F.col("cls").alias("node"), F.coalesce("top", "label").alias("label"))


def shingle_sets(docs: DataFrame, profiles: DataFrame, words: int) -> DataFrame:
    """(cls, n, used, prefix, toks, gid) of the classes that hold a shingle of another class in their prefix."""
    total = profiles.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    bits = max(LEAST_BITS, math.ceil(math.log2(max(1, total / RANGE_SHINGLES))))
    shared = shared_shingles(docs, bits, words).groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("s"))
    shared = shared.withColumn("used", F.col("n") - F.size("s"))
    shared = shared.withColumn("places", F.col("n") - F.expr("(3 * n + 3) div 4") + 1 - F.col("used")).where("places > 0")
    toks = F.transform("s", lambda x: x["tok"])
    sets = shared.select("cls", "n", "used", F.slice(toks, 1, F.col("places").cast("int")).alias("prefix"), toks.alias("toks"))
    gid = F.when(F.col("used") == 0, F.xxhash64("prefix", "n")).otherwise(F.col("cls"))
    return common.write_shared(sets.withColumn("gid", gid), "shingle-sets")


def all_class_links(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of classes in sets that links, whether or not it connects anything new.

    An entry of the prefix index that many classes share is split: each class stands in one of its blocks on the left
    and in all of them on the right, so that no task holds all pairs of an entry.
    """
    rows = sets.select("cls", "n", "used", "prefix", F.posexplode("prefix").alias("i", "tok"))
    rows = rows.select("tok", "cls", "n", (F.col("used") + F.col("i")).alias("pos"), F.slice("prefix", F.lit(1), F.col("i")).alias("before"))
    rows = common.write_shared(rows, "class-entries")
    entries = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = rows.join(entries, "tok")
    left = rows.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    right = rows.select("tok", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *[F.col(c).alias(f"{c}2") for c in ("cls", "n", "pos", "before")])
    met = left.join(right, ["tok", "block"]).where("cls < cls2").where(may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
    pairs = met.where(~F.arrays_overlap("before", "before2")).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))
    return verified(pairs.distinct(), sets)


def jaccard_links(docs: DataFrame, words: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """All links between different texts: (links, members) of docs (doc_id, text).

    links (a, b, n_a, n_b) has each pair of linked classes once; members (doc_id, n_shingles, cls, class_id, n_links) has
    for each row of docs its class, the smallest id in it and the exact number of other classes that it links with. Rows
    of an equal class link with each other as well, and are not counted. The links are as many as there are similar
    pairs of different texts; jaccard_components needs fewer of them.
    """
    common.bounded_batches(docs.sparkSession)
    profiles = common.write_shared(profile(docs, words), "profiles")
    sets = shingle_sets(docs, profiles, words)
    size = lambda c, n: sets.select(F.col("cls").alias(c), F.col("n").alias(n))
    links = common.write_shared(all_class_links(sets).join(size("a", "n_a"), "a").join(size("b", "n_b"), "b"), "all-links")
    ends = links.select(F.col("a").alias("cls"), F.col("n_a").alias("n_shingles")).unionByName(links.select(F.col("b").alias("cls"), F.col("n_b").alias("n_shingles")))
    counts = ends.groupBy("cls", "n_shingles").agg(F.count(F.lit(1)).alias("n_links"))
    classes = profiles.where("cls is not null").groupBy("cls", "n_shingles").agg(F.min("doc_id").alias("class_id")).join(counts, ["cls", "n_shingles"], "left")
    members = profiles.join(classes, ["cls", "n_shingles"], "left")
    return links, members.select("doc_id", "n_shingles", "cls", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def labelled(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, mark, n_shingles, label, component_id) for each row of docs; label names a component, whatever its ids are."""
    common.bounded_batches(docs.sparkSession)
    profiles = common.write_shared(profile(docs, words), "profiles")
    sets = shingle_sets(docs, profiles, words)
    labels = class_links(sets)
    classes = profiles.where("cls is not null").groupBy("cls", F.col("n_shingles")).agg(F.min("doc_id").alias("rep"))
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = common.write_shared(named, "classes")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    homes = named.join(least, "label").select("cls", "n_shingles", "label", "component_id")
    out = profiles.join(homes, ["cls", "n_shingles"], "left")
    return out.select("doc_id", "mark", "n_shingles", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    return labelled(docs, words).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last), then of the smallest hash of its text.

    Different texts of one id are documents of their own. Empty texts link with nothing and stay; rows that share id and
    text are one document, of which the row with the smallest hash of all columns stays.
    """
    found = common.write_shared(labelled(docs, words).select("doc_id", "mark", "label"), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = found.where("label is not null").groupBy("label").agg(F.min(rank).alias("k"), F.count(F.lit(1)).alias("c")).where("c > 1").select("label", "k")
    rest = found.join(firsts, "label").where(rank != F.col("k")).select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).distinct()
    plain = docs.select(common.packed_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_id"), text_mark(docs["text"]).alias("_mark"))
    kept = plain.join(rest, plain["_id"].eqNullSafe(rest["_d"]) & (plain["_mark"] == rest["_m"]), "left_anti")
    repeated = found.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"))
    repeated = common.write_shared(repeated, "repeated")
    if repeated.take(1):
        same = kept["_id"].eqNullSafe(repeated["_d"]) & (kept["_mark"] == repeated["_m"])
        whole = F.xxhash64(F.to_json("_row"))
        once = kept.join(repeated, same, "left_semi").groupBy("_id", "_mark").agg(F.min_by("_row", whole).alias("_row"))
        kept = kept.join(repeated, same, "left_anti").select("_row").unionByName(once.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir))
