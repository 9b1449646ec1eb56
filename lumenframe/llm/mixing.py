"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree; DataFrame operations only.

1. Every document gets a hash in [0, 1) from its id and text. A source's documents, in the order of their hashes, are a
   permutation, cut into blocks: ranges of equal width of the hash, a power of two of them, which grows with the words.
2. The words to take from each source (its target) become a quota of blocks: whole rounds through all its blocks, then
   as many more as hold the rest of the target, the last of them in part.
3. The quotas are split among the output shards by a binary tree. A node's left half gets a multivariate
   hypergeometric draw from what the node holds, itself a tree of draws over its sources (inversion of a uniform number
   from the mode outwards, to twelve standard deviations; probabilities are doubles), so that all quotas add up exactly.
4. Each shard draws its number of blocks of each source from where the shards before it stopped, and orders its rows by
   a hash of its own: rows are shuffled within shards, and no order over the whole mix is ever needed. What a document
   gives to the mix is the sum over the draws of its block.

Everything follows from hashes of the values, so reruns agree. A number a source is gathered in one row; documents move
once, by (source, block), which spreads a source that holds most rows over many tasks.

Null texts have size 0, null sources are one source, last in order. Sources without words get nothing. Repeated rows
share a hash and are mixed as any others. A very long text is a document like others: its block is larger. Empty tables
give empty results. Extra columns of any name stay where rows are returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Blocks of a source with enough documents for them, and words of a block beyond which a source has more blocks.
LEAST_BLOCKS = 4096
BLOCK_WORDS = 1 << 22
#: Words for one output shard; above MOST_SHARDS of them, shards hold more words instead.
SHARD_WORDS = 1 << 22
MOST_SHARDS = 1 << 16
SEED = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that no two sources share, null included."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def ln_factorial(n: str) -> str:
    stirling = f"({n}) * ln(greatest({n}, 1)) - ({n}) + 0.5D * ln({2 * math.pi}D * greatest({n}, 1)) + 1D / (12D * greatest({n}, 1)) - 1D / (360D * pow(greatest({n}, 1), 3)) + 1D / (1260D * pow(greatest({n}, 1), 5))"
    return f"if(({n}) <= 20, ln(factorial(cast(least({n}, 20) as int))), {stirling})"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked ones among drawn of total: inversion of the uniform u, from the mode outwards."""
    n_, k_, d_ = "h.total", "h.marked", "h.drawn"
    lo = f"greatest(0L, {d_} - ({n_} - {k_}))"
    hi = f"least({k_}, {d_})"
    mode = f"least({hi}, greatest({lo}, cast(floor(({d_} + 1D) * ({k_} + 1D) / ({n_} + 2D)) as bigint)))"
    sd = f"sqrt({d_} * ({k_} / cast({n_} as double)) * (1D - {k_} / cast({n_} as double)) * ({n_} - {d_}) / greatest({n_} - 1D, 1D))"
    choose = lambda a, b: [f"{a}", f"-1 - ({b})", f"-1 - ({a} - ({b}))"]  # noqa: E731  x for ln x!, -1 - x for -ln x!
    negative = lambda terms: [f"-1 - ({t})" for t in terms]
    terms = choose("m.k", "m.mode") + choose("m.n - m.k", "m.d - m.mode") + negative(choose("m.n", "m.d"))
    p_mode = f"exp(aggregate(array({', '.join(terms)}), 0D, (a, t) -> a + if(t >= 0, 1, -1) * transform(array(if(t >= 0, t, -1 - t)), x -> {ln_factorial('x')})[0]))"
    up = "s.up * ((m.k - m.mode - j + 1D) * (m.d - m.mode - j + 1D) / ((m.mode + j) * greatest(m.n - m.k - m.d + m.mode + j, 1D)))"
    down = "s.down * ((m.mode - j + 1D) * (m.n - m.k - m.d + m.mode - j + 1D) / ((m.k - m.mode + j) * (m.d - m.mode + j)))"
    step = f"""transform(array(named_struct('up', if(m.mode + j <= m.hi, {up}, 0D), 'down', if(m.mode - j >= m.lo, {down}, 0D))), t ->
        named_struct('u', s.u - t.up - t.down, 'up', t.up, 'down', t.down,
                     'x', case when s.x is not null then s.x when s.u < t.up then m.mode + j when s.u < t.up + t.down then m.mode - j end))[0]"""
    search = f"""transform(array({p_mode}), p -> aggregate(sequence(1L, m.reach), named_struct('u', m.u - p, 'up', p, 'down', p, 'x', if(m.u < p, m.mode, cast(null as bigint))),
        (s, j) -> if(s.x is not null, s, {step}), s -> coalesce(s.x, m.mode)))[0]"""
    middle = f"named_struct('n', {n_}, 'k', {k_}, 'd', {d_}, 'u', h.u, 'lo', {lo}, 'hi', {hi}, 'mode', {mode}, 'reach', greatest(1L, least({hi} - {lo}, cast(ceil(12D * {sd}) as bigint) + 12L)))"
    drawn_ = f"transform(array({middle}), m -> {search})[0]"
    return f"transform(array(named_struct('total', {total}, 'marked', {marked}, 'drawn', {drawn}, 'u', {u})), h -> if(h.drawn <= 0 or h.marked <= 0, 0L, if(h.drawn >= h.total, h.marked, {drawn_})))[0]"


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, quotas) from one row of quotas array<struct<source, n>>: the tree, one level at a time.

    A node holds the sources that it has blocks of, so nodes get smaller as they get more. Its left half takes half of its
    blocks; how many of them come from either half of its sources is a hypergeometric draw, then from either quarter, and
    so on to single sources, which together is the multivariate draw.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.col("quotas"))
    depth = max(0, math.ceil(math.log2(max(1, quotas.select(F.size("quotas")).first()[0]))))
    for level in range(int(math.log2(shards))):
        # sums of runs of 1, 2, 4 ... sources
        nodes = nodes.withColumn("s0", F.transform("quotas", lambda q: q["n"]))
        for k in range(depth):
            nodes = nodes.withColumn(f"s{k + 1}", F.expr(f"transform(sequence(0, greatest(1, size(s{k}) + size(s{k}) % 2) - 1, 2), i -> s{k}[i] + coalesce(get(s{k}, i + 1), 0L))"))
        nodes = nodes.withColumn("left", F.expr(f"array(s{depth}[0] div 2)"))
        for k in reversed(range(depth)):
            u = f"shiftrightunsigned(xxhash64({seed}L, {level}, node, {k}, i), 11) / 9007199254740992D"
            draw = hypergeometric(f"s{k + 1}[i]", f"s{k}[2 * i]", "left[i]", u)
            halves = f"flatten(transform(sequence(0, size(s{k + 1}) - 1), i -> transform(array({draw}), x -> array(x, left[i] - x))[0]))"
            nodes = nodes.withColumn("left", F.expr(f"slice({halves}, 1, size(s{k}))"))
        rest = F.expr("filter(zip_with(quotas, left, (q, x) -> named_struct('source', q.source, 'n', q.n - x)), q -> q.n > 0)")
        left = F.expr("filter(zip_with(quotas, left, (q, x) -> named_struct('source', q.source, 'n', x)), q -> q.n > 0)")
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("quotas")))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.node", "h.quotas").where(F.size("quotas") > 0)
    return nodes.withColumnRenamed("node", "shard")


@dataclass
class MixPlan:
    """blocks: a row for each (source, block) that holds documents, with the draws that take it: (copy, shard)."""

    blocks: DataFrame
    shards: int
    fine_bits: int
    seed: int


def with_targets(sources: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """sources (source, docs, words) with target: shares of all words by weight, none above max_repeat times its words.

    Those that reach their cap do so in the order of cap / weight, so sums over that order give each one's level.
    There is a row a source; no window here sees documents.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    listed = sources.withColumn("rank", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("words").cast("double") * max_repeat
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = listed.withColumn("weight", weight).withColumn("cap", cap).withColumn("all_words", F.sum("words").over(everything).cast("double"))
    rest = rest.withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rest = rest.withColumn("left_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    rest = rest.withColumn("level", F.col("left_words") / F.col("left_weight"))
    # the first source below its cap gives the level of all that follow it
    free = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    return rest.withColumn("free", free["level"]).withColumn("target", F.coalesce(F.least("cap", F.col("free") * F.col("weight")), F.col("cap"))).drop("level", "free", "left_words", "left_weight", "all_words")


def plan(narrow: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> MixPlan:
    """The plan of a mix; narrow has _key, _u, source and size (words) of each document."""
    counted = common.write_shared(narrow.groupBy("_key").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words")), "mix-sources")
    # blocks of a source: LEAST_BLOCKS or fewer where it has few documents, more where they would hold too many words
    blocks_of = F.greatest(F.least(F.col("docs") / 4, F.lit(float(LEAST_BLOCKS))), F.col("words") / block_words, F.lit(1.0))
    sources = with_targets(counted, weights, max_repeat).withColumn("bits", F.floor(F.log2(blocks_of)).cast("int"))
    goal = F.floor("target").cast("long")
    sources = sources.withColumn("rounds", F.when(F.col("words") > 0, F.expr("cast(floor(target) as bigint) div words")).otherwise(0).cast("long"))
    sources = common.write_shared(sources.withColumn("rest", F.when(F.col("words") > 0, goal - F.col("rounds") * F.col("words")).otherwise(0).cast("long")), "mix-targets")
    bits = sources.agg(F.max("bits")).first()[0] or 0
    # blocks, and the one in which the target falls
    fine = narrow.groupBy("_key", fine_column(bits).alias("_fine")).agg(F.sum("size").alias("w")).join(sources.select("_key", "bits"), "_key")
    blocks = fine.groupBy("_key", block_column(F.col("_fine"), F.col("bits"), bits).alias("_block")).agg(F.sum("w").alias("block_words"))
    running = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_words").over(running), F.lit(0)).cast("long")).join(sources, "_key")
    blocks = blocks.withColumn("room", F.greatest(F.lit(0), F.least(F.col("block_words"), F.col("rest") - F.col("before"))).cast("long"))
    blocks = common.write_shared(blocks.withColumn("draws", F.when(F.col("block_words") > 0, F.col("rounds") + (F.col("room") > 0).cast("long")).otherwise(0)), "mix-blocks")
    # whole numbers of blocks for the tree: empty blocks are no rows and are never drawn
    totals = blocks.groupBy("_key").agg(F.sum("draws").alias("quota")).where("quota > 0")
    sized = blocks.agg(F.coalesce(F.sum(F.col("rounds") * F.col("block_words") + F.col("room")), F.lit(0)).alias("words"), F.coalesce(F.sum("draws"), F.lit(0)).alias("draws")).first()
    shards = 1
    while shards < min(MOST_SHARDS, sized["words"] / shard_words, max(1, sized["draws"])):
        shards *= 2
    # one row of a number a source: no document is in it
    listed = totals.agg(F.array_sort(F.collect_list(F.struct(F.col("_key").alias("source"), F.col("quota").alias("n")))).alias("quotas"))
    leaves = split_quotas(listed, shards, seed).select("shard", F.explode("quotas").alias("q")).select("shard", F.col("q.source").alias("_key"), F.col("q.n").alias("n"))
    ends = Window.partitionBy("_key").orderBy("shard")
    ranges = leaves.withColumn("end", F.sum("n").over(ends))
    # positions of a source: its blocks in order, again and again; each shard draws the next n of them
    drawn = ranges.select("_key", "shard", F.explode(F.expr("sequence(end - n, end - 1)")).alias("position"))
    order = Window.partitionBy("_key").orderBy("copy", "_block")
    positions = blocks.where("draws > 0").select("_key", "_block", F.explode(F.expr("sequence(1L, draws)")).alias("copy"))
    positions = positions.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    placed = positions.join(drawn, ["_key", "position"]).groupBy("_key", "_block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("drawn"))
    kept = blocks.select("_key", "_block", "words", "target", "rounds", "room", "block_words", "bits")
    full = common.write_shared(kept.join(placed, ["_key", "_block"], "left"), "mix-plan")
    return MixPlan(full, shards, bits, seed)


def fine_column(bits: int) -> Column:
    return F.floor(F.col("_u") * (1 << bits)).cast("long")


def block_column(fine: Column, bits: Column, fine_bits: int) -> Column:
    return F.call_function("shiftright", fine, F.lit(fine_bits) - bits)


def attach(rows: DataFrame, mix: MixPlan) -> DataFrame:
    """rows (with _key, _u) with their block's columns. Sources are few numbers; rows meet them by (source, block)."""
    widths = mix.blocks.groupBy("_key").agg(F.max("bits").alias("_bits"))
    tagged = common.salted_join(rows, widths, "_key", F.col("_u")).withColumn("_block", block_column(fine_column(mix.fine_bits), F.col("_bits"), mix.fine_bits)).drop("_bits")
    return tagged.join(mix.blocks, ["_key", "_block"], "left")


def taken_words(narrow: DataFrame, mix: MixPlan, id_col: str = "doc_id") -> DataFrame:
    """narrow with target, taken and drawn: what a document gives to each draw of its block, added up.

    A draw of one of the whole rounds takes all of its words; that of the round which the target cuts short takes what
    lies before the cut, so that the document in which the target ends is taken in part.
    """
    inside = Window.partitionBy("_key", "_block").orderBy("_u", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = attach(narrow, mix).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - F.col("_before"))))
    taken = F.expr("aggregate(drawn, 0L, (a, d) -> a + if(d.copy <= rounds, size, _part))")
    return rows.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))


def mixed_rows(docs: DataFrame, mix: MixPlan, narrow: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix has them: whole rows, one for each draw of their block, dealt to its shard and shuffled within it.

    In the block in which a target ends, a row is taken once more if at least half of it lies within the target.
    """
    ends = taken_words(narrow, mix, id_col).where("room > 0 and room < block_words and 2 * _part >= size and size > 0")
    cuts = ends.groupBy("_key").agg(F.max("_u").alias("_cut"))
    blocks = mix.blocks.join(cuts, "_key", "left").select("_key", "_block", "bits", "rounds", "room", "block_words", "drawn", "_cut")
    rows = docs.select(common.packed_row(docs).alias("_row"), source_key(docs[source_col]).alias("_key"), common.unit_hash(docs[id_col], docs[text_col], seed=mix.seed).alias("_u"))
    rows = attach(rows, MixPlan(blocks, mix.shards, mix.fine_bits, mix.seed)).withColumn("_draw", F.explode("drawn"))
    rows = rows.where((F.col("_draw.copy") <= F.col("rounds")) | (F.col("room") == F.col("block_words")) | (F.col("_u") <= F.col("_cut")))
    rows = rows.select("_row", "_u", F.col("_draw.copy").alias("_copy"), F.col("_draw.shard").alias("_shard"))
    shuffled = rows.repartition(mix.shards, "_shard").sortWithinPartitions("_shard", F.xxhash64("_u", "_copy", F.lit(mix.seed)))
    return shuffled.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def narrow_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """What the plan needs of each document: id, source, size, _key, _u."""
    u = common.unit_hash(docs[id_col], docs[text_col], seed=SEED)
    rows = docs.select(docs[id_col], docs[source_col].alias("source"), n_words(docs[text_col]).alias("size"), source_key(docs[source_col]).alias("_key"), u.alias("_u"))
    return common.write_shared(rows, "mix-narrow")


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, **options: object) -> DataFrame:
    narrow = narrow_documents(docs)
    return mixed_rows(docs, plan(narrow, weights, **options), narrow)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = narrow_documents(common.documents(spark, sf_dir))
    mixed = taken_words(narrow, plan(narrow))
    return mixed.select("doc_id", "size", F.col("words").alias("source_size"), "target", "taken", "source", F.expr("get(drawn, 0).shard").alias("first_shard"))
