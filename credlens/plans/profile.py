"""Corpus profiles: additive histograms of distinct values with weights, in three modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as f
from ..operators.decompose import scored
from ..operators.detectors import detect_all, pattern_repr
from ..operators.lexical import deleetified, found
from ..sources.lexicon import cultural_terms
from ..sources.store import REPR_LEN, TOKEN_LEN

MODES = ("light", "heavy", "full")


def featured(weighted: DataFrame) -> DataFrame:
    """weighted (value, weight) with length, charset_mask, shannon_total and charset_bits; columns that a plan doesn't use are pruned."""
    v = F.col("value")
    sized = weighted.withColumn("length", F.length(v)).withColumn("charset_mask", f.charset_mask(v))
    return sized.withColumn("charset_bits", f.charset_bits(F.col("length"), f.charset_size(F.col("charset_mask")))).withColumn("shannon_total", f.shannon_per_char(v) * F.col("length"))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("weight").alias("count"))


def length_histogram(weighted: DataFrame) -> DataFrame:
    return _counted(featured(weighted), "length")


def charset_histogram(weighted: DataFrame) -> DataFrame:
    return _counted(featured(weighted), "charset_mask")


def entropy_histogram(weighted: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.lit("shannon").alias("entropy_type"), f.entropy_bucket(F.col("shannon_total")).alias("bucket_min")), F.struct(F.lit("charset").alias("entropy_type"), f.entropy_bucket(F.col("charset_bits")).alias("bucket_min")))
    return _counted(featured(weighted).select("weight", F.inline(both)), "entropy_type", "bucket_min")


def totals(weighted: DataFrame) -> DataFrame:
    w = F.col("weight")
    return featured(weighted).agg(F.coalesce(F.sum(w), F.lit(0)).alias("total_lines"), F.coalesce(F.sum(w * F.col("length")), F.lit(0)).alias("sum_length"), F.coalesce(F.sum(w * F.col("shannon_total")), F.lit(0.0)).alias("sum_shannon"), F.coalesce(F.sum(w * F.col("charset_bits")), F.lit(0.0)).alias("sum_charset_bits"))


def lexical_hits(weighted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """weight, gram, pattern_type, pattern_repr: one row for each count that a substring gives, its weights summed before the lookup. Regional terms and word lists are joined at once; lists named *_es count twice."""
    rank = F.col("rank").cast("string")
    terms = cultural_terms(weighted.sparkSession).select(F.col("word").alias("gram"), F.lit("spanish").alias("pattern_type"), F.concat(F.lit("src=cultural;rank="), rank).alias("pattern_repr"))
    lists = lexicon.select(F.col("word").alias("gram"), F.lit("dictionary").alias("pattern_type"), F.concat(F.lit("dict="), "dict_name", F.lit(";rank="), rank).alias("pattern_repr"))
    again = lexicon.where(F.col("dict_name").endswith("_es")).select(F.col("word").alias("gram"), F.lit("spanish").alias("pattern_type"), F.concat(F.lit("src="), "dict_name", F.lit(";rank="), rank).alias("pattern_repr"))
    every = terms.unionByName(lists).unionByName(again)
    # The weights of a word's places are summed before it meets its lists.
    listed = every.select("gram").distinct()
    return found(weighted, listed).groupBy("gram").agg(F.sum("weight").alias("weight")).join(every, "gram")


def lexical_patterns(weighted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pattern counts of word lists and regional terms alone."""
    return _counted(lexical_hits(weighted, lexicon).withColumn("pattern_repr", F.left("pattern_repr", F.lit(REPR_LEN))), "pattern_type", "pattern_repr")


def pattern_stats(weighted: DataFrame, lexicon: DataFrame) -> DataFrame:
    own = weighted.select("weight", F.explode(detect_all(F.col("value"))).alias("m")).select("weight", F.col("m.type").alias("pattern_type"), pattern_repr(F.col("m")).alias("pattern_repr"))
    words = lexical_hits(weighted, lexicon).select("weight", "pattern_type", "pattern_repr")
    return _counted(own.unionByName(words).withColumn("pattern_repr", F.left("pattern_repr", F.lit(REPR_LEN))), "pattern_type", "pattern_repr")


def token_frequencies(weighted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Counts of lexicon words and of plain forms. Both can equal whole inputs: as sensitive as the source."""
    grams = lexical_hits(weighted, lexicon).where(F.length("gram") <= TOKEN_LEN).select("weight", F.lit("substring").alias("token_type"), F.col("gram").alias("token"))
    plain = deleetified(weighted).select("weight", F.lit("deleetified").alias("token_type"), "token")
    return _counted(grams.unionByName(plain), "token_type", "token")


def score_histogram(weighted: DataFrame, lexicon: DataFrame) -> DataFrame:
    return _counted(scored(weighted, lexicon), "score")


def guess_totals(weighted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sums of guesses (as double, so it can't overflow) and of their bits."""
    s = scored(weighted, lexicon)
    return s.agg(F.sum(F.col("weight") * F.col("guesses").cast("double")).alias("sum_guesses"), F.sum(F.col("weight") * F.col("guess_bits")).alias("sum_guess_bits"))


def profile(weighted: DataFrame, mode: str, lexicon: DataFrame | None = None, dataset_id: int = 1) -> dict[str, DataFrame]:
    """The tables of a mode, with their dataset; totals carry the mode, so that modes aren't mixed in means."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = {"length_histogram": length_histogram(weighted), "charset_histogram": charset_histogram(weighted)}
    sums = totals(weighted)
    if mode == "light":
        sums = sums.select("total_lines", "sum_length")
    else:
        if lexicon is None:
            raise ValueError(f"mode {mode} needs a lexicon")
        out |= {"entropy_histogram": entropy_histogram(weighted), "pattern_stats": pattern_stats(weighted, lexicon), "token_frequencies": token_frequencies(weighted, lexicon)}
    if mode == "full":
        out["score_histogram"] = score_histogram(weighted, lexicon)
        sums = sums.crossJoin(guess_totals(weighted, lexicon))
    out["dataset_totals"] = sums.withColumn("mode", F.lit(mode))
    return {k: v.withColumn("dataset_id", F.lit(dataset_id).cast("long")) for k, v in out.items()}
