"""Statistics of an unbounded stream of single values with state: sums are kept by dataset and flushed to the store by timers.

A micro-batch of few events costs no commit: counts are added up in the state of a dataset's shard, and a timer puts out what
came together since the last flush, which one commit for all shards merges into the store. The state and the commits' log make every
event count once, also over restarts. Values themselves are never kept. Datasets are spread over SHARDS keys, so that one
dataset with most of the events isn't the work of one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import features as f
from ..plans.profile import featured
from ..sources.store import HistogramStore

SHARDS = 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a shard puts out: kind of number, its key, events and a sum.
OUT = "dataset_id long, kind string, k double, n long, x double"


class Sums(StatefulProcessor):
    """Counts of lengths, masks and entropy buckets, and totals, since the last flush."""

    def __init__(self, flush_ms: int) -> None:
        self.flush_ms = flush_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "kind string, k double", "n long, x double")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            n = len(frame)
            new = [("lines", 0.0, n, 0.0), ("length_sum", 0.0, n, float(frame["length"].sum())), ("shannon_sum", 0.0, n, float(frame["shannon_total"].sum())), ("charset_sum", 0.0, n, float(frame["charset_bits"].sum()))]
            for kind, column in (("length", "length"), ("mask", "charset_mask"), ("shannon", "shannon_bucket"), ("charset", "charset_bucket")):
                new += [(kind, float(k), int(c), 0.0) for k, c in frame[column].value_counts().items()]
            for kind, k, c, x in new:
                held = self.sums.getValue((kind, k)) if self.sums.containsKey((kind, k)) else (0, 0.0)
                self.sums.updateValue((kind, k), (held[0] + c, held[1] + x))
        if not self.due.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.flush_ms
            self.due.update((at,))
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = [(int(key[0]), kind, k, int(n), float(x)) for (kind, k), (n, x) in self.sums.iterator()]
        self.sums.clear()
        self.due.clear()
        yield pd.DataFrame(rows, columns=["dataset_id", "kind", "k", "n", "x"])

    def close(self) -> None:
        pass


def _deltas(flushed: DataFrame) -> dict[str, DataFrame]:
    """What was flushed, as rows of the store's tables."""
    count = lambda kind, name, cast: flushed.where(F.col("kind") == kind).groupBy("dataset_id", F.col("k").cast(cast).alias(name)).agg(F.sum("n").alias("count"))
    of = lambda kind: count(kind, "bucket_min", "double").select("dataset_id", F.lit(kind).alias("entropy_type"), "bucket_min", "count")
    one = lambda kind, column: F.sum(F.when(F.col("kind") == kind, F.col(column)))
    totals = flushed.groupBy("dataset_id").agg(one("lines", "n").alias("total_lines"), one("length_sum", "x").cast("long").alias("sum_length"), one("shannon_sum", "x").alias("sum_shannon"), one("charset_sum", "x").alias("sum_charset_bits"))
    return {"length_histogram": count("length", "length", "int"), "charset_histogram": count("mask", "charset_mask", "int"), "entropy_histogram": of("shannon").unionByName(of("charset")), "dataset_totals": totals.withColumn("mode", F.lit("events"))}


def stream_events(events: DataFrame, store: HistogramStore, checkpoint: str, name: Callable[[str], str], flush_seconds: float = 60.0, every: str = "1 second") -> StreamingQuery:
    """Starts the query over a stream (dataset_id, value); empty values don't count. name gives the query's own id for its checkpoint, which the store's log of batches goes by. The caller stops the query; what isn't flushed then is in the checkpoint's state."""
    spark = events.sparkSession
    values = featured(events.where("value <> ''").withColumn("weight", F.lit(1).cast("long")))
    rows = values.select(F.col("dataset_id").cast("long").alias("dataset_id"), F.pmod(F.xxhash64("value"), F.lit(SHARDS)).cast("int").alias("shard"), "length", "charset_mask", "shannon_total", "charset_bits", f.entropy_bucket(F.col("shannon_total")).alias("shannon_bucket"), f.entropy_bucket(F.col("charset_bits")).alias("charset_bucket"))
    flushed = rows.groupBy("dataset_id", "shard").transformWithStateInPandas(statefulProcessor=Sums(int(flush_seconds * 1000)), outputStructType=OUT, outputMode="Update", timeMode="ProcessingTime")

    def merge(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        if held.limit(1).count():
            store.commit(name(checkpoint), _deltas(held), number)
        held.unpersist()

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, PROVIDER)  # the query keeps it; state with timers needs it
    try:
        return flushed.writeStream.foreachBatch(merge).outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
