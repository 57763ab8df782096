"""Mixing sources to target weights, with DataFrame operations only.

Each source's documents are dealt into blocks by a hash of their id. A source's target
says how often each block is drawn: all blocks as often as the whole target needs, and
the first blocks of a permuted order once more, the last of them in part. The block
draws of all sources are then split among output shards by a binary tree: at each node
the left half's draws of each source are a multivariate hypergeometric sample, so every
shard gets an exact number of draws and every draw goes to one shard. A shard takes
disjoint slices of each source's permuted draws and shuffles its documents by a hash.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_enough, words, written

WEIGHTS, CAP = (5, 2, 1), 3
#: Blocks of a source, levels of the tree (2 ** LEVELS shards), both at least, and what makes the permutations.
BLOCKS, LEVELS, SEED = 512, 5, 17
#: Rows of a block if one source had them all, and of a shard, on average; beyond them blocks and levels grow with the rows.
BLOCK_ROWS, SHARD_ROWS = 8192, 1 << 16
#: Rows of the plan (one for each source and block) up to which it is broadcast, the bits of a shard's slices, and levels after which the tree is written.
BROADCAST, SLICE_BITS, WRITTEN_LEVELS = 100_000, 3, 6


def sizes(rows: int) -> tuple[int, int]:
    """Blocks of a source and levels of the tree, both from the number of rows."""
    return max(BLOCKS, 1 << ceil(log2(max(rows / BLOCK_ROWS, 1)))), max(LEVELS, ceil(log2(max(rows / SHARD_ROWS, 1))))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with target: shares of the total by weight, none above cap times its size.

    Sources get the weights in code-point order, null last, repeating. With the water level x,
    a source gets min(weight * x, cap * size); x is where the sum is the total. Sources are few
    rows (one for each source), whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select("*", F.sum(F.col("source_size").cast("double")).over(all_rows).alias("total"), F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
                 (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest"))
    # If the sources before this one in order are at their cap, the rest share what is left by weight.
    s = s.select("*", ((F.col("total") - F.col("full")) / F.col("rest")).alias("level"), F.row_number().over(order).alias("at"))
    level = F.min_by("level", F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("at"))).over(all_rows)
    return s.select("source", "source_size", F.least(F.coalesce(level, F.lit(0.0)) * F.col("w"), "most").alias("target"))


def _uniform(*keys: Column) -> Column:
    """A number from 0 up to 1, fixed by keys and SEED."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(SEED)), 11).cast("double") / float(1 << 53)


def _from_source(level: int):
    """How a node's left half draws from one source's units, one by one: each is left's if it falls among its free places."""

    def step(acc: Column, x: Column) -> Column:
        uniform = lambda i: _uniform(F.col("shard"), F.lit(level), x["key"], i)
        one = lambda a, i: F.struct((a["left"] - (uniform(i) * a["N"] < a["left"]).cast("long")).alias("left"), (a["N"] - 1).alias("N"))
        now = F.struct(acc["left"].alias("left"), acc["N"].alias("N"))
        end = F.when(x["n"] > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), x["n"]), now, one)).otherwise(now)
        return F.struct(end["left"].alias("left"), end["N"].alias("N"), F.concat(acc["taken"], F.array(acc["left"] - end["left"])).alias("taken"))

    return step


def split_tree(draws: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(source, n) to (source, shard, first, n): shards' exact numbers of draws, and where each slice begins.

    Rows are sources and, at each level, nodes; a node draws one by one from its sources' urn.
    """
    node = draws.where("n > 0").groupBy().agg(F.sort_array(F.collect_list(F.struct(F.struct(F.col("source").isNull().alias("null"), "source").alias("key"), F.col("n").cast("long").alias("n")))).alias("urn")).select(F.lit(0).alias("shard"), "urn")
    for level in range(levels):
        total = F.aggregate("urn", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        node = node.select("shard", "urn", total.alias("N"), F.floor((total + F.pmod("shard", F.lit(2))) / 2).cast("long").alias("half"))

        start = F.struct(F.col("half").alias("left"), F.col("N").alias("N"), F.array().cast("array<bigint>").alias("taken"))
        node = node.select("shard", "urn", F.aggregate("urn", start, _from_source(level))["taken"].alias("taken"))
        side = lambda n: F.zip_with("urn", "taken", lambda x, t: F.struct(x["key"].alias("key"), n(x, t).alias("n")))
        halves = F.array(F.struct((F.col("shard") * 2).alias("shard"), side(lambda x, t: t).alias("urn")), F.struct((F.col("shard") * 2 + 1).alias("shard"), side(lambda x, t: x["n"] - t).alias("urn")))
        node = node.select(F.explode(halves).alias("h")).select("h.shard", "h.urn")
        if level % WRITTEN_LEVELS == WRITTEN_LEVELS - 1:
            node = written(node, "tree")
    leaves = node.select("shard", F.explode("urn").alias("x")).select(F.col("x.key.source").alias("source"), "shard", F.col("x.n").alias("n")).where("n > 0")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("source", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs nested in ``row``, with size, source_size, target and ``draws``: one (shard, place) for each time the row is drawn.

    No row is drawn more than cap times. A source's drawn words come within one document of its
    target. Ids decide everything, so reruns agree. Rows without an id are told apart by their
    texts; rows that share id and size (without an id: the text) are drawn alike. Texts without
    words have size 0 and draws that add none.

    Texts are never shuffled: block totals are written, and a source has one block at most that is
    drawn in part, whose rows' hashes and sizes alone are put in order. Blocks and shards keep
    their size and become more as rows do.
    """
    blocks, levels = sizes(docs.count())
    hashed = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text)), F.lit(SEED)).alias("h"))
    hashed = hashed.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    size = F.size(words(F.col(f"row.{text}"))).cast("long").alias("size")
    by_block = written(hashed.select("source", "block", size).groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = by_block.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(sources, weights, cap).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("int").alias("whole"))
    plan = plan.select("*", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("part"))
    b = by_block.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select("b.source", "block", "words", "source_size", "target", "whole", "part")
    permuted = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(SEED)), "block")
    b = b.select("*", (F.row_number().over(permuted) - 1).alias("at"), (F.sum("words").over(permuted) - F.col("words")).alias("before"), F.count("*").over(Window.partitionBy("source")).alias("n_blocks"))
    # Words of this block's extra draw: all, some or none.
    b = b.select("*", F.greatest(F.least(F.col("part") - F.col("before"), "words"), F.lit(0)).alias("extra"))
    b = b.select("*", (F.col("whole") + (F.col("extra") > 0).cast("int")).alias("times"))
    tree = split_tree(b.groupBy("source").agg(F.sum("times").alias("n")), levels)
    b = written(b.select("source", "block", "words", "source_size", "target", "whole", "extra", "times", "at", "n_blocks"), "drawn-blocks")
    # Draw k of a block stands at k * n_blocks + at in its source's permuted draws; the last slice that begins there or before takes it.
    place = b.where("times > 0").select("source", "block", F.posexplode(F.sequence(F.lit(1), "times")).alias("k", "one"), "n_blocks", "at").select("source", "block", "k", (F.col("k") * F.col("n_blocks") + F.col("at")).alias("place"))
    null = lambda kind: F.lit(None).cast(kind)
    both = tree.select("source", null("int").alias("block"), null("int").alias("k"), F.col("first").alias("place"), "shard").unionByName(place.withColumn("shard", null("int")))
    in_order = Window.partitionBy("source").orderBy("place", F.col("block").asc_nulls_first())
    dealt = both.select("source", "block", "k", F.last("shard", True).over(in_order).alias("shard")).where("block is not null")
    dealt = dealt.groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "shard"))), lambda x: x["shard"]).alias("shards"))
    b = b.join(dealt, b["source"].eqNullSafe(dealt["d_source"]) & (b["block"] == dealt["d_block"]), "left")
    b = written(b.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "source_size", "target", "whole", "extra", F.col("words").alias("block_words"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards")), "plan")
    # One row for each source and block: broadcast while that is few.
    few = small_enough(b, BROADCAST)

    def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(plan) if few else plan, rows["source"].eqNullSafe(plan["b_source"]) & (rows["block"] == plan["b_block"]))

    # In a block drawn in part, documents whose middle lies within the part's words are drawn: those up to a cut.
    key = F.struct(F.xxhash64("h", F.lit(SEED + 1)).alias("order"), "h", "size")
    in_part = with_plan(hashed, b.where("extra > 0 AND extra < block_words").select("b_source", "b_block", "extra")).select("b_source", "b_block", "extra", "h", size)
    inside = Window.partitionBy("b_source", "b_block").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = in_part.select("b_source", "b_block", "extra", "size", key.alias("key")).withColumn("end", F.sum("size").over(inside))
    cuts = summed.where(F.col("end") * 2 - F.col("size") <= F.col("extra") * 2).groupBy("b_source", "b_block").agg(F.max("key").alias("cut")).toDF("c_source", "c_block", "cut")
    b = b.join(cuts, b["b_source"].eqNullSafe(cuts["c_source"]) & (b["b_block"] == cuts["c_block"]), "left").drop("c_source", "c_block")
    d = with_plan(hashed.select("*", size), b)
    drawn = F.when(F.col("extra") >= F.col("block_words"), F.size("shards")).otherwise(F.col("whole") + F.coalesce(key <= F.col("cut"), F.lit(False)).cast("int"))
    draws = F.transform(F.slice("shards", 1, F.least(drawn, F.size("shards"))), lambda x, k: F.struct(x.alias("shard"), F.xxhash64("h", k, F.lit(SEED + 2)).alias("place")))
    return d.select("row", "size", "source_size", "target", draws.alias("draws"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is drawn, dealt by shard and in the shard's random order.

    A shard is dealt in 2 ** SLICE_BITS slices of that order, so that no task holds all of it.
    """
    m = mix(docs, **options).select("row", F.explode("draws").alias("d"))
    return m.repartition("d.shard", F.shiftright("d.place", 64 - SLICE_BITS)).sortWithinPartitions("d.shard", "d.place").select("row.*")
