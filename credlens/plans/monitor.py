"""Progress of ingestion: runs, files, speed and expected time, as DataFrames."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attack import format_duration
from ..sources.store import HistogramStore


def recent_runs(runs: DataFrame, datasets: DataFrame, n: int = 5) -> DataFrame:
    """The newest runs with their dataset's name; runs without a start come last."""
    named = runs.join(datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name")), "dataset_id")
    return named.select("id", "dataset_name", "status", "started_at", "finished_at", F.coalesce("lines_valid", F.lit(0)).alias("lines_valid")).orderBy(F.desc_nulls_last("started_at"), "id").limit(n)


def files(progress: DataFrame, n: int = 60) -> DataFrame:
    return progress.orderBy(F.desc("status"), "filename").limit(n)


def recently_completed(progress: DataFrame, n: int = 5) -> DataFrame:
    return progress.where("status = 'completed'").orderBy(F.desc_nulls_last("finished_at"), "filename").limit(n)


def mean_lengths(datasets: DataFrame, totals: DataFrame) -> DataFrame:
    joined = datasets.where("dataset_type = 'leaked'").join(totals.withColumnRenamed("dataset_id", "id"), "id")
    mean = F.when(F.col("total_lines") > 0, F.round(F.col("sum_length") / F.col("total_lines"), 2)).otherwise(0.0)
    return joined.select("name", F.coalesce("total_lines", F.lit(0)).alias("total_lines"), mean.alias("mean_length"))


def by_status(progress: DataFrame) -> DataFrame:
    known = F.when(F.col("status").isin("running", "completed", "failed"), F.col("status")).otherwise("other")
    return progress.groupBy(known.alias("status")).agg(F.count(F.lit(1)).alias("files"))


def speed_eta(progress: DataFrame, now, expected_lines: int | None) -> DataFrame:
    """filename, speed in lines per second since the start, and expected time left, of running files."""
    running = progress.where("status = 'running'")
    elapsed = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    speed = F.when(F.col("started_at").isNotNull() & (F.col("lines_processed") > 0) & (elapsed > 0), F.col("lines_processed") / elapsed).otherwise(0.0)
    sped = running.select("filename", "lines_processed", speed.alias("speed"))
    left = F.greatest(F.lit(expected_lines or 0) - F.col("lines_processed"), F.lit(0)) / F.col("speed")
    eta = F.when(F.col("speed") > 0, format_duration(left)).otherwise("—") if expected_lines else F.lit("—")
    return sped.select("filename", "speed", eta.alias("eta"))


def total_speed(speeds: DataFrame) -> DataFrame:
    return speeds.agg(F.coalesce(F.sum("speed"), F.lit(0.0)).alias("total_speed"))


def pending(listed: DataFrame, progress: DataFrame) -> DataFrame:
    """Files that aren't completed yet, in order."""
    return listed.join(progress.where("status = 'completed'").select("filename"), "filename", "left_anti").orderBy("filename")


def _lines(df: DataFrame, section: int, line: Column, *order: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("place"), line.alias("line"))


def _duration(start: str, end: str) -> Column:
    seconds = F.unix_micros(F.col(end).cast("timestamp")) / 1e6 - F.unix_micros(F.col(start).cast("timestamp")) / 1e6
    return F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), F.concat(F.lit("  "), format_duration(seconds))).otherwise("")


def snapshot_text(totals: DataFrame, runs: DataFrame, progress: DataFrame, now, expected_lines: int | None = None) -> DataFrame:
    """section, place and line of a monitor's screen: totals per dataset (of mean_lengths), the three newest runs (of recent_runs), running files with speed and expected time, failed files, counts by status, files completed last. Every section has few rows. The words and widths are fixed values."""
    c, num = F.col, lambda x: F.format_number(x, 0)
    name = F.element_at(F.split("filename", "/"), -1)
    clock = lambda x, other: F.coalesce(F.date_format(c(x).cast("timestamp"), "HH:mm:ss"), F.lit(other))
    sped = progress.where("status = 'running'").join(speed_eta(progress, now, expected_lines), "filename")
    failed = progress.where("status = 'failed'")
    done = recently_completed(progress)
    counts = progress.agg(*[F.count_if(c("status") == s).alias(s) for s in ("completed", "running", "failed")], F.count(F.lit(1)).alias("all"))
    other = c("all") - c("completed") - c("running") - c("failed")
    shown = [
        _lines(totals, 1, F.format_string("  %-25s  %15s líneas válidas  media longitud: %.2f", c("name"), num(c("total_lines")), c("mean_length").cast("double")), c("name")),
        _lines(runs.orderBy(F.desc_nulls_last("started_at"), "id").limit(3), 2, F.format_string("  #%-4s %-20s [%-11s]  %s → %s  %s líneas", c("id").cast("string"), c("dataset_name"), c("status"), clock("started_at", "—"), clock("finished_at", "running"), num(c("lines_valid"))), F.desc_nulls_last("started_at"), c("id")),
        _lines(sped, 3, F.format_string("  %-45s %12s  %8s  %8s", name, num(c("lines_valid")), F.format_string("%.0f", c("speed")), c("eta")), c("filename")),
        _lines(failed, 4, F.format_string("  %-45s %12s  (checkpoint: %s líneas)", name, num(c("lines_valid")), num(c("lines_processed"))), c("filename")),
        _lines(counts, 5, F.when(c("all") == 0, "Sin ficheros en file_progress (¿ingesta aún no iniciada?)").otherwise(F.format_string("Ficheros: %d completados  %d en curso  %d fallidos  %d pendientes  (total %d)", c("completed"), c("running"), c("failed"), other, c("all"))), c("all")),
        _lines(done, 6, F.concat(F.format_string("  %-45s %12s", name, num(c("lines_valid"))), _duration("started_at", "finished_at")), F.desc_nulls_last("finished_at"), c("filename")),
    ]
    every = shown[0]
    for s in shown[1:]:
        every = every.unionByName(s)
    return every.orderBy("section", "place")


def snapshot(store: HistogramStore, now=None, expected_lines: int | None = None) -> str:
    """The monitor's screen of a store as it is now."""
    spark = store.spark
    held = lambda name, schema: spark.createDataFrame([], schema) if (rows := store.read(name)) is None else rows
    datasets = held("datasets", "id long, name string, dataset_type string")
    totals = mean_lengths(datasets, held("dataset_totals", "dataset_id long, mode string, total_lines long, sum_length long"))
    runs = recent_runs(held("ingestion_runs", "id string, dataset_id long, status string, started_at timestamp, finished_at timestamp, lines_valid long"), datasets)
    progress = held("file_progress", "filename string, status string, lines_processed long, lines_valid long, started_at timestamp, finished_at timestamp")
    return "\n".join(r.line for r in snapshot_text(totals, runs, progress, now or datetime.now(UTC), expected_lines).collect())


def watch(store: HistogramStore, show: Callable[[str], object] = print, seconds: float = 5.0, stop: threading.Event | None = None, expected_lines: int | None = None) -> None:
    """Shows the screen again and again until it is asked to stop or interrupted; what goes wrong in one round is shown and the next one tried."""
    stop = stop or threading.Event()
    try:
        while not stop.is_set():
            try:
                show(snapshot(store, expected_lines=expected_lines))
            except Exception as wrong:  # noqa: BLE001
                show(f"{type(wrong).__name__}: {wrong}")
            stop.wait(seconds)
    except KeyboardInterrupt:
        pass
