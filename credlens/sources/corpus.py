"""Line-delimited corpora: enumeration, tolerant decoding, normalization."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLACEMENT = "�"


def read_lines(spark: SparkSession, path: str, normalize: bool = True) -> DataFrame:
    """value, had_invalid and file of every line under path, split at \\n only; empty lines are kept and have value ''."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"))
    return decoded(raw, normalize)


def decoded(raw: DataFrame, normalize: bool = True) -> DataFrame:
    value, invalid = decode(F.col("value"))
    return raw.withColumn("had_invalid", invalid).withColumn("value", nfc(value) if normalize else value)


def decode(value: Column) -> tuple[Column, Column]:
    """Valid UTF-8 without one line end, and whether the replacement character stands in it."""
    text = F.regexp_replace(F.make_valid_utf8(value), r"(?:\r\n|\n|\r)\z", "")
    return text, F.contains(F.make_valid_utf8(value), F.lit(REPLACEMENT))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(value: Column) -> Column:
    """Canonical composition; ASCII text doesn't leave the JVM's values."""
    plain = ~value.rlike(r"[^\x00-\x7F]")
    return F.when(plain, value).otherwise(_nfc(F.when(plain, F.lit(None)).otherwise(value)))


def valid_lines(lines: DataFrame, limit: int | None = None) -> DataFrame:
    kept = lines.where("value <> ''")
    return kept.limit(limit) if limit is not None else kept


def line_counts(lines: DataFrame, weight: str | None = None, invalid: str | None = None) -> DataFrame:
    """Lines read, valid and with invalid bytes, for each file; of lines, or of (file, value) with counts of lines and of invalid ones."""
    n = F.col(weight) if weight else F.lit(1)
    bad = F.col(invalid) if invalid else F.col("had_invalid").cast("int")
    return lines.groupBy("file").agg(F.sum(n).cast("long").alias("lines_read"), F.sum(F.when(F.col("value") != "", n).otherwise(0)).cast("long").alias("lines_valid"), F.sum(bad).cast("long").alias("lines_invalid"))


def tokens(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row for each word of the texts."""
    return documents.select(F.explode(F.split(text, r"\s+")).alias("value")).where("value <> ''")


def weighted(values: DataFrame) -> DataFrame:
    """Distinct values with their counts, so that features are computed once for each."""
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("weight"))
