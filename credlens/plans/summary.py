"""Statistics derived from histograms: top items, percentiles and a one-row summary.

Histograms are small (their keys are lengths, masks and buckets), so windows over all of one are fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import BUCKET


def _all() -> Window:
    """A window over a whole histogram."""
    return Window.partitionBy(F.lit(0))


def top_tokens(token_frequencies: DataFrame, n: int = 100) -> DataFrame:
    """rank, item_type, item_repr, count of the n most frequent substrings; ties by token."""
    best = token_frequencies.where("token_type = 'substring'").orderBy(F.desc("count"), "token").limit(n)
    return best.select(F.row_number().over(_all().orderBy(F.desc("count"), "token")).alias("rank"), F.lit("token").alias("item_type"), F.col("token").alias("item_repr"), "count")


def top_patterns(pattern_stats: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent patterns as type:repr; ties by repr, then type."""
    order = (F.desc("count"), "pattern_repr", "pattern_type")
    best = pattern_stats.orderBy(*order).limit(n)
    return best.select(F.row_number().over(_all().orderBy(*order)).alias("rank"), F.lit("pattern").alias("item_type"), F.concat_ws(":", "pattern_type", "pattern_repr").alias("item_repr"), "count")


def length_summary(h: DataFrame) -> DataFrame:
    cum = h.withColumn("upto", F.sum("count").over(_all().orderBy("length"))).withColumn("n", F.sum("count").over(_all()))
    return cum.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("sample_size"), (F.sum(F.col("length") * F.col("count")) / F.sum("count")).alias("avg_length"),
        F.min(F.when(F.col("upto") >= F.col("n") / 2, F.col("length"))).alias("median_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
    )


def charset_summary(h: DataFrame) -> DataFrame:
    """Percentages of values of digits only, letters only, letters and digits at most, and with symbols; null without values."""
    m = F.col("charset_mask")
    share = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)) * 100.0 / F.sum("count")
    has = lambda bits: m.bitwiseAND(bits) > 0
    return h.agg(
        share(m == 4).alias("pct_digits_only"), share(has(3) & ~has(28)).alias("pct_letters_only"), share(~has(24)).alias("pct_alphanumeric"), share(has(8)).alias("pct_with_symbols"),
    )


def _percentile(target: float) -> Column:
    """Of (bucket_min, count, upto, n): the value at a share, linear within its bucket."""
    goal = F.col("n") * target
    inside = F.col("bucket_min") + (goal - (F.col("upto") - F.col("count"))) / F.col("count") * BUCKET
    return F.coalesce(F.min_by(inside, F.when(F.col("upto") >= goal, F.col("bucket_min"))), F.max("bucket_min") + BUCKET, F.lit(0.0))


def entropy_summary(h: DataFrame) -> DataFrame:
    """Mean and percentiles of Shannon entropy and mean charset entropy, from bucket middles."""
    mean = lambda kind: F.sum(F.when(F.col("entropy_type") == kind, (F.col("bucket_min") + BUCKET / 2) * F.col("count"))) / F.sum(F.when(F.col("entropy_type") == kind, F.col("count")))
    means = h.agg(mean("shannon").alias("mean_shannon_entropy"), mean("charset").alias("mean_charset_entropy"))
    s = h.where("entropy_type = 'shannon'").withColumn("upto", F.sum("count").over(_all().orderBy("bucket_min"))).withColumn("n", F.sum("count").over(_all()))
    found = s.agg(*[_percentile(p / 100).alias(f"p{p}_shannon_entropy") for p in (50, 75, 90)])
    return means.crossJoin(F.broadcast(found))


def global_summary(length: DataFrame, charset: DataFrame, entropy: DataFrame) -> DataFrame:
    """One row; none if there are no values. Each side of the products has one row."""
    return length_summary(length).where("sample_size > 0").crossJoin(F.broadcast(entropy_summary(entropy))).crossJoin(F.broadcast(charset_summary(charset)))
