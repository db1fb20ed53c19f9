"""Lookup of digests in a breach table by prefix, so that a range provider sees only five hex characters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = 5


def digest(value: Column) -> Column:
    return F.upper(F.sha1(value.cast("binary")))


def parse_ranges(bodies: DataFrame) -> DataFrame:
    """prefix, suffix, count from (prefix, body): SUFFIX:COUNT lines; lines without a colon or a whole count are left out."""
    lines = bodies.select("prefix", F.explode(F.split("body", r"\r?\n")).alias("line")).where(F.contains("line", F.lit(":")))
    parts = lines.select("prefix", F.upper(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("suffix"), F.expr("trim(substring(line, instr(line, ':') + 1))").alias("n"))
    return parts.select(F.upper("prefix").alias("prefix"), "suffix", F.col("n").try_cast("long").alias("count")).where("count is not null")


def hashed(values: DataFrame) -> DataFrame:
    """values with prefix and suffix of their digests."""
    d = digest(F.col("value"))
    return values.withColumn("prefix", F.substring(d, 1, PREFIX)).withColumn("suffix", F.substring(d, PREFIX + 1, 40))


def lookup(values: DataFrame, breach: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """values with prefix, suffix, breach_count and status found, not_found, or error where the value's range is among those that failed (prefix); padding rows with count 0 aren't hits."""
    known = breach.groupBy("prefix", "suffix").agg(F.max("count").alias("breach_count"))
    joined = hashed(values).join(known, ["prefix", "suffix"], "left").withColumn("breach_count", F.coalesce("breach_count", F.lit(0)))
    status = F.when(F.col("breach_count") > 0, "found").otherwise("not_found")
    if failed is None:
        return joined.withColumn("status", status)
    marked = joined.join(failed.select("prefix", F.lit(True).alias("broken")).distinct(), "prefix", "left")
    return marked.withColumn("status", F.when(F.col("broken") & (F.col("breach_count") == 0), "error").otherwise(status)).drop("broken")


def failures(bodies: DataFrame) -> DataFrame:
    """Prefixes (prefix, body) whose range couldn't be had."""
    return bodies.where("body is null").select(F.upper("prefix").alias("prefix"))


def fetch_ranges(values: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """prefix and body of each distinct prefix, fetched once with the given provider on the executors; failures give a null body."""
    return _fetched(hashed(values).select("prefix").distinct(), provider)


def _fetched(prefixes: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bodies = []
            for p in f["prefix"]:
                try:
                    bodies.append(provider(p))
                except OSError:
                    bodies.append(None)
            yield f.assign(body=bodies)

    return prefixes.mapInPandas(run, "prefix string, body string")


class RangeCache:
    """Ranges kept in a folder, partitioned by the first SHARD characters of their prefix, with the time and the outcome of each fetch.

    Each fetch appends; the newest good range of a prefix counts while it is younger than max_age seconds, an older one and a
    failed one are fetched again. Files are only added, so sessions may share a folder: at worst both fetch a prefix."""

    SCHEMA = "prefix string, body string, ok boolean, fetched_at double, shard string"
    SHARD = 2

    def __init__(self, spark: SparkSession, folder: str, max_age: float = 86_400.0) -> None:
        self.spark, self.folder, self.max_age = spark, folder.rstrip("/"), max_age

    def _there(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder) if self._there() else self.spark.createDataFrame([], self.SCHEMA)

    def fresh(self, now: float) -> DataFrame:
        """prefix and body of ranges that needn't be fetched."""
        good = self.rows().where(F.col("ok") & (F.col("fetched_at") > now - self.max_age))
        return good.groupBy("prefix").agg(F.max_by("body", "fetched_at").alias("body"))

    def fill(self, prefixes: DataFrame, provider: Callable[[str], str], now: float) -> int:
        """Fetches what isn't fresh of prefixes, once each, and stores outcomes; how many were fetched."""
        missing = prefixes.join(self.fresh(now).select("prefix"), "prefix", "left_anti")
        before = self.rows().count()
        got = _fetched(missing, provider).select("prefix", "body", F.col("body").isNotNull().alias("ok"), F.lit(now).alias("fetched_at"), F.substring("prefix", 1, self.SHARD).alias("shard"))
        got.repartition("shard").write.mode("append").partitionBy("shard").parquet(self.folder)
        return self.rows().count() - before


class BreachSession:
    """Lookups of one session: nothing is fetched or looked up without consent, and every range at most once while it is fresh."""

    def __init__(self, cache: RangeCache, provider: Callable[[str], str], consent: bool = False) -> None:
        self.cache, self.provider, self.consent, self.fetched = cache, provider, consent, 0

    def lookup(self, values: DataFrame) -> DataFrame:
        """values with breach_count and status: skipped without consent, error where the range can't be had, else found or not_found."""
        if not self.consent:
            return values.withColumn("breach_count", F.lit(0).cast("long")).withColumn("status", F.lit("skipped"))
        now = time.time()
        wanted = hashed(values).select("prefix").distinct()
        self.fetched += self.cache.fill(wanted, self.provider, now)
        ready = self.cache.fresh(now).join(wanted, "prefix", "left_semi")
        broken = wanted.join(ready.select("prefix"), "prefix", "left_anti")
        return lookup(values, parse_ranges(ready), broken).drop("prefix", "suffix")
