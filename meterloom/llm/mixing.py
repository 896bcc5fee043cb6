"""Mixing sources to target weights, in DataFrame operations only.

Each source is a stream of words: its documents end to end in a pseudorandom order, cut into blocks
of fixed length.  A source's target is its share of all words by weight, but at most ``cap`` times
its own words; what a capped source cannot take is shared out again by weight.  Output shards have
equal numbers of slots.  In every shard a source gets the whole part of its expected slots, and the
fractional rest is drawn from the multinomial of the fractions, so each shard is a fresh draw while
the totals stay near their targets.  The ``i``-th slot of a source takes block ``perm(i mod M)`` of
its ``M`` blocks, where ``perm`` is a swap-or-not permutation of the indices, another one for every pass:
no block is taken again before all have been taken.  Slots and documents meet by block index.

Hot sources: words before a document are summed per bucket of the source (about the square root of
all rows), then within the bucket, and blocks have unique keys, so no task holds a source.  The list
of sources itself (one row each) is a catalogue and is ordered in one task.

A null text has size 0 and is taken 0 words; a null source is a source of its own, ordered last;
repeated rows and null identifiers are documents of their own; if no document has words all targets
are 0; an empty table gives an empty result.  Reruns agree: every draw is a hash of its place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterloom.llm.common import WORD, stored

WEIGHTS, CAP, BLOCK = (5.0, 2.0, 1.0), 3, 64
#: Slots of an output shard (more if there would be more than SHARDS shards); rounds of the permutation.
SLOTS, SHARDS, ROUNDS, SEED = 4_096, 65_536, 12, 7


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, source, size`` with the words of each text."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def key(source: F.Column) -> F.Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, weight, target`` of each source.

    A source is capped while its cap per weight is at most the level ``(rest of the words) / (rest
    of the weights)``; the level rises with every capped source, so the highest one decides.
    """
    ranked = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    everything, by_cap = W.partitionBy(), W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(by_cap), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    return weighted.withColumn("level", level).select(
        "source", "source_size", "weight", F.least(F.col("weight") * F.max("level").over(everything), F.col("source_size") * float(cap)).alias("target"))


def permuted(index: str, size: str, keys: str) -> F.Column:
    """A pseudorandom permutation of ``0 .. size - 1`` (swap or not); ``keys`` has a number below ``size`` per round."""
    mirror = f"pmod(k - x, {size})"
    return F.expr(f"aggregate({keys}, {index}, (x, k) -> if(xxhash64(k, greatest(x, {mirror})) % 2 = 0, x, {mirror}))")


def drawn_slots(targets: DataFrame, block: int = BLOCK, slots: int = SLOTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``skey, shard, block`` for each slot of the mix."""
    plan = targets.where("source_size > 0").select(
        key(F.col("source")).alias("skey"), F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
        (F.col("target") / F.col("source_size")).alias("times"))
    # A permutation of its own for every pass over a source.
    passes = [F.array(*[F.pmod(F.xxhash64(F.lit(seed), "skey", F.lit(p), F.lit(r)), F.col("blocks")) for r in range(ROUNDS)]) for p in range(math.ceil(cap))]
    plan = plan.withColumns({"expected": F.col("times") * F.col("blocks"), "keys": F.array(*passes)})
    total = plan.agg(F.sum("expected")).first()[0] or 0.0
    shards = min(SHARDS, max(1, round(total / slots)))
    plan = plan.withColumns({"whole": F.floor(F.col("expected") / shards).cast("long"), "rest": F.col("expected") / shards - F.floor(F.col("expected") / shards)})
    shard = plan.sparkSession.range(shards).withColumnRenamed("id", "shard")
    # The fractions end to end on a line, one row; a draw falls on one of them.
    line = plan.groupBy().agg(F.array_sort(F.collect_list(F.struct("skey", "rest"))).alias("parts"), F.sum("rest").alias("length"))
    line = line.select("length", F.col("parts.skey").alias("keys"), F.expr(
        "aggregate(parts, array(0D), (a, p) -> concat(a, array(element_at(a, -1) + p.rest)))").alias("ends"))
    row = line.first()
    keys, ends, length = F.array(*map(F.lit, row["keys"] or ["n"])), F.array(*map(F.lit, row["ends"])), F.lit(row["length"] or 0.0)
    draws = F.floor((F.col("shard") + 1) * length + 0.5) - F.floor(F.col("shard") * length + 0.5)
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "draw"), F.lit(1 << 52)) / float(1 << 52)) * length
    rest = shard.withColumn("draws", draws.cast("int")).where("draws > 0").select("shard", F.explode(F.sequence(F.lit(1), "draws")).alias("draw"))
    rest = rest.withColumn("at", unit).select(
        "shard", F.element_at(keys, F.greatest(F.lit(1), F.least(F.size(F.filter(ends, lambda e: e <= F.col("at"))), F.size(keys)))).alias("skey"))
    counted = (
        plan.select("skey", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.col("whole").alias("n"))
        .union(rest.select("skey", "shard", F.lit(1).cast("long")))
        .groupBy("skey", "shard").agg(F.sum("n").alias("n")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A row stands for thousands of slots, so rows are dealt out before they are unrolled.
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = counted.withColumn("before", before).where("n > 0").join(plan.select("skey", "blocks", "keys"), "skey").repartition(parts, "skey", "shard")
    taken = ranges.select("skey", "shard", "blocks", "keys", F.explode(F.expr("sequence(before, before + n - 1)")).alias("slot")).where(F.col("slot") < cap * F.col("blocks"))
    placed = taken.select("skey", "shard", "blocks", F.expr("slot % blocks").alias("place"), F.expr("element_at(keys, cast(slot div blocks as int) + 1)").alias("keys"))
    return placed.select("skey", "shard", permuted("place", "blocks", "keys").alias("block"))


def document_blocks(sizes: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``id, skey, start, size, block, words``: the part of each document in each block of its source."""
    rows = sizes.count()
    buckets = max(1, math.isqrt(rows))
    placed = sizes.where("size > 0").select("id", "size", key(F.col("source")).alias("skey"), F.xxhash64(F.lit(seed), "id", "size").alias("order"))
    placed = placed.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    base = placed.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    base = base.select("skey", "bucket", F.coalesce(F.sum("words").over(
        W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("size").over(W.partitionBy("skey", "bucket").orderBy("order", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inner", inner).join(base, ["skey", "bucket"]).withColumn("start", F.col("base") + F.col("inner"))
    parts = placed.select("id", "skey", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    return parts.withColumn("words", F.expr(f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block})"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK,
          slots: int = SLOTS, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``id, source, size, source_size, target, taken`` of every row."""
    sizes = stored(sized(docs, id_col, text_col, source_col))
    targets = stored(source_targets(sizes, weights, cap))
    times = drawn_slots(targets, block, slots, cap, seed).groupBy("skey", "block").agg(F.count("*").alias("times"))
    met = document_blocks(sizes, block, seed).join(times, ["skey", "block"], "left")
    taken = met.groupBy("skey", "start", "id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")).drop("start")
    empty = sizes.where("size = 0").select(key(F.col("source")).alias("skey"), "id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.union(empty).join(targets.withColumn("skey", key(F.col("source"))), "skey").select(
        "id", "source", "size", "source_size", "target", "taken")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
