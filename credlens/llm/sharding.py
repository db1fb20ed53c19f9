"""Proportional stratified interleaving of rows into shards, in DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked. Row r of a source with n rows gets the
fraction (2r - 1) / 2n; rows sorted by fraction follow the mixture of sources at every scale, so equal
cuts give shards with that mixture. Both rankings use hash or fraction buckets of bounded number with
prefix sums of their counts, so that no task holds a whole source or the whole table.

Defined results: a null source is a source of its own; null keys are ranked like one more key value;
repeated rows are ranked one after another; input columns called shard or slot are replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import without

#: Rows that a bucket should hold at most, and bits of a bucket's number; the most buckets are what one window over their counts can hold.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 50_000, 12, 20


def interleave(df: DataFrame, n_shards: int = 8, source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """df with shard (0 .. n_shards - 1, counts at most one apart) and slot (gapless from 0 in a shard)."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, df.count()) / BUCKET_ROWS))))
    size = 1 << bits
    kept = without(df, "shard", "slot")
    src = F.col(f"`{source}`").cast("string")
    rows = kept.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("r"),
        F.when(src.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), src)).alias("s"),
        F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("h"),
        F.col(f"`{key}`").alias("k"),
    ).withColumn("b", F.shiftrightunsigned("h", 64 - bits))

    # Rank within a source: rows before the hash bucket, then the place in it.
    by_source = Window.partitionBy("s")
    starts = (
        rows.groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"))
        .select("s", "b", (F.sum("c").over(by_source.orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(by_source).alias("n"))
    )
    ranked = rows.join(starts, ["s", "b"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "k")))
    placed = ranked.select(
        "r", "s", "h", "k",
        ((2 * F.col("rank") - 1) / (2 * F.col("n"))).alias("frac"),
        F.expr(f"((2 * rank - 1) * {size}L) div (2 * n)").alias("b2"),
    )

    # How many rows of all sources fall below each fraction bucket follows from the sources' counts alone.
    totals = starts.groupBy("s").agg(F.max("n").alias("n"))
    first = lambda b: f"((2 * n * ({b}) + {size}L + {2 * size - 1}L) div {2 * size}L)"  # noqa: E731  least rank in bucket b
    small = totals.where(F.col("n") < size).select(F.explode(F.expr(f"transform(sequence(1L, n), x -> ((2 * x - 1) * {size}L) div (2 * n))")).alias("b2"), F.lit(1).cast("long").alias("c"))
    large = (
        totals.where(F.col("n") >= size).select("n", F.explode(F.expr(f"sequence(0L, {size - 1}L)")).alias("b2"))
        .select("b2", F.expr(f"{first('b2 + 1')} - {first('b2')}").alias("c"))
    )
    in_bucket = small.unionByName(large).groupBy("b2").agg(F.sum("c").alias("c"))
    # At most 2 ** MOST_BITS rows, whatever the input.
    everything = Window.partitionBy(F.lit(0))
    before = in_bucket.select("b2", (F.sum("c").over(everything.orderBy("b2")) - F.col("c")).alias("before"), F.sum("c").over(everything).alias("n"))
    at = placed.join(before, "b2").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("b2").orderBy("frac", "s", "h", "k")) - 1)
    shard = F.expr(f"(pos * {n_shards}L) div n")
    return at.select("r", "pos", "n", shard.alias("g")).select(
        "r.*", F.col("g").cast("int").alias("shard"), (F.col("pos") - F.expr(f"(g * n + {n_shards - 1}L) div {n_shards}L")).alias("slot"),
    )
