"""Mixing sources to target weights: exact block quotas dealt to output shards by a splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import staged

#: fixed weights, repeating in the order of the sources
WEIGHTS = (3.0, 1.0, 2.0)
#: hexadecimal digits of a document's key that name its block: 16 ** 3 blocks of each source
BLOCK_DIGITS = 3
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """sources(source, source_size) -> + target. Weights by rank (code point order, null last) share `share` of
    all sizes; a target stops at `most` times its source's size and the excess goes to the others by weight.

    With sources ordered by limit / weight, the sources before some point are at their limits and the others
    get one common level times their weight: the first level that does not pass the next source's ratio holds.
    One row per source goes through one window; documents never do.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    limited = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    held = F.when(level <= F.col("ratio"), level)
    solved = limited.withColumn("held", held)
    solved = solved.withColumn("rank", F.row_number().over(order)).withColumn("first_rank", F.min(F.when(F.col("held").isNotNull(), F.col("rank"))).over(everything))
    solved = solved.withColumn("level", F.max(F.when(F.col("rank") == F.col("first_rank"), F.col("held"))).over(everything))
    return solved.select("source", "source_size", F.when(F.col("rank") < F.col("first_rank"), F.col("limit")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def planned(docs: DataFrame, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: row, doc_id, source, size, source_size, target, block, at (words of the source before the
    document in permuted order), rounds (times it is taken whole), last (words taken once more).

    A document's key is the md5 of its id and a seed: its order is the permutation of its source and its first
    digits are its block. Block sums are added up per source (4,096 blocks at most), documents inside their block,
    so a source with a third of all rows is spread over thousands of windows. The mix takes every document of a
    source as often as whole rounds fit the target, and one more time those in front of the rest's last word; the
    document at that edge gives its first words only. So sources meet their targets to the word.

    Null or empty texts have size 0 and are taken with 0 words; null ids share one key and rows with equal
    key, size and source are interchangeable; a null source is a source. An empty table gives no rows.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(SEED)))
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row")))
    sized = sized.withColumn("block", F.substring("key", 1, BLOCK_DIGITS))
    blocks = staged(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    order = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    goals = staged(targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), share, most))
    placed = blocks.withColumn("block_at", F.coalesce(F.sum("block_size").over(order), F.lit(0))).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    named = goals.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    placed = staged(placed.join(named, "s").drop("s"))
    within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    side = placed.select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "block_at", "source_size", "target")
    inside = sized.withColumn("in_block", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = inside.join(side, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block"))).drop("p_source", "p_block")
    at = F.col("block_at") + F.col("in_block")
    # a source of size 0 has target 0
    rounds = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    rest = F.floor(F.col("target")) - rounds * F.col("source_size")
    rows = rows.withColumn("at", at).withColumn("rounds", rounds).withColumn("rest", rest)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return rows.withColumn("last", last.cast("long")).drop("in_block", "block_at")


def dealt(plan: DataFrame, shards: int = 16) -> DataFrame:
    """Draws of the mix: row, doc_id, source, words, round, shard, shuffle_key. `laid_out` writes them as shards.

    A unit is one block of a source in one round. The tree starts with every source's exact number of
    units; each node gives its left child a uniformly random half of its units (ranks of seeded hashes), so the
    sources' counts in the halves are multivariate hypergeometric. After log2(shards) levels each shard has a
    quota for each source, and takes that many units from the source's permuted blocks, disjoint from all others.
    """
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    draws = plan.select("row", "doc_id", "source", "block", "size", "last", "rounds", F.explode(F.sequence(F.lit(0), F.col("rounds").cast("int"))).alias("round"))
    draws = draws.withColumn("words", F.when(F.col("round") < F.col("rounds"), F.col("size")).otherwise(F.col("last"))).where("words > 0 OR round < rounds")
    draws = staged(draws.select("row", "doc_id", "source", "block", "round", "words").withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    units = staged(draws.select("s", "block", "round").distinct())
    quotas = units.groupBy("s").agg(F.count(F.lit(1)).cast("int").alias("units")).withColumn("node", F.lit(0))
    for level in range(levels):
        slots = quotas.select("node", "s", F.explode(F.sequence(F.lit(1), F.col("units"))).alias("slot"))
        slots = slots.withColumn("h", F.xxhash64(F.lit(SEED), F.lit(level), "node", "s", "slot"))
        quotas = staged(ranked(slots).groupBy("s", (F.col("node") * 2 + (F.col("rank") * 2 > F.col("of")).cast("int")).alias("node")).agg(F.count(F.lit(1)).cast("int").alias("units")))
    upto = Window.partitionBy("s").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    quotas = quotas.withColumn("low", F.coalesce(F.sum("units").over(upto), F.lit(0)))
    seats = quotas.select("s", F.col("node").alias("shard"), F.explode(F.expr("sequence(low + 1, low + units)")).alias("seat"))
    permuted = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(SEED), "block", "round"), "block", "round")
    seated = staged(units.withColumn("seat", F.row_number().over(permuted).cast("long")).join(seats, ["s", "seat"]).drop("seat"))
    return draws.join(seated, ["s", "block", "round"]).select("row", "doc_id", "source", "words", "round", "shard", F.xxhash64(F.lit(SEED), "doc_id", "round").alias("shuffle_key"))


def ranked(slots: DataFrame) -> DataFrame:
    """Adds each slot's rank by h within its node and the node's number of slots, through 256 slices of h, so that no window holds a whole node."""
    slots = staged(slots.withColumn("slice", F.shiftright("h", 56)))
    counts = slots.groupBy("node", "slice").agg(F.count(F.lit(1)).alias("many"))
    before = Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))).withColumn("of", F.sum("many").over(Window.partitionBy("node")))
    inside = F.row_number().over(Window.partitionBy("node", "slice").orderBy("h", "s", "slot"))
    return slots.join(staged(counts.drop("many")), ["node", "slice"]).withColumn("rank", F.col("before") + inside)


def totals(plan: DataFrame, draws: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken, the words of its draws."""
    taken = draws.groupBy("row").agg(F.sum("words").alias("taken"))
    return plan.select("row", "doc_id", "source", "size", "source_size", "target").join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("row")


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, shards: int = 16) -> DataFrame:
    """`totals` of the draws as they are dealt."""
    plan = staged(planned(docs, share, most))
    return totals(plan, dealt(plan, shards))


def laid_out(draws: DataFrame) -> DataFrame:
    """The draws as shards in the shared folder, read back: each shard's draws in the order of their seeded keys, so that sources and documents are
    shuffled within it. A shard is a run of files and no task holds it whole; draws with equal keys, as those of null ids, are split by row.
    Shards hold draws (row, doc_id, source, words, round), not texts."""
    order = ("shard", "shuffle_key", "row")
    return staged(draws.repartitionByRange(*order).sortWithinPartitions(*order))


def sharded(docs: DataFrame, share: float = 1.5, most: float = 2.0, shards: int = 16) -> DataFrame:
    """`totals` of the draws that the written shards hold. Nulls, empty texts and empty tables as in `planned`; extra columns are ignored."""
    plan = staged(planned(docs, share, most))
    return totals(plan, laid_out(dealt(plan, shards)))
