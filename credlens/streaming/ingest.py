"""Incremental ingestion: micro-batches of lines merged into a store, with records of runs and files; statistics of single events."""

from __future__ import annotations

import json
import signal
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import features as f
from ..plans.profile import MODES, profile
from ..plans.summary import global_summary, top_patterns, top_tokens
from ..sources.corpus import decoded, line_counts
from ..sources.line_stream import BATCH_BYTES, SPLIT_BYTES, PlanLog, listed, place, read_ranges, read_stream
from ..sources.store import HistogramStore

def list_files(spark: SparkSession, path: str) -> DataFrame:
    """filename and length of all files under path, in order; their content isn't read."""
    return spark.createDataFrame(listed(path), "filename string, length long").orderBy("filename")


def _query_name(spark: SparkSession, checkpoint: str) -> str:
    """The streaming query's own id, which its checkpoint keeps: two checkpoints never share it, and a restart has it again."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _checked(mode: str, lexicon: DataFrame | None, files_per_batch: int | None, limit: int | None, batch_bytes: int, split_bytes: int) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode != "light" and lexicon is None:
        raise ValueError(f"mode {mode} needs a lexicon")
    if any(x is not None and x < 1 for x in (files_per_batch, limit, batch_bytes, split_bytes)):
        raise ValueError("files_per_batch, limit, batch_bytes and split_bytes must be at least 1")


def _batch_log(checkpoint: str) -> tuple[int, int]:
    """Plans of the last batch that was begun and of the last one that was done."""
    from pyarrow import fs

    system, folder = place(checkpoint)

    def names(part: str) -> list[int]:
        there = system.get_file_info(fs.FileSelector(f"{folder}/{part}", allow_not_found=True))
        return sorted(int(f.base_name) for f in there if f.base_name.isdigit())

    def plan(n: int) -> int:
        with system.open_input_stream(f"{folder}/offsets/{n}") as f:
            return json.loads(f.read().decode().strip().rsplit("\n", 1)[-1])["plan"]

    begun, done = names("offsets"), [n for n in names("commits")]
    return (plan(begun[-1]) if begun else 0), (plan(done[-1]) if done and done[-1] in begun else 0)


def _valid(spark: SparkSession, ranges: list, split: int) -> DataFrame:
    return decoded(read_ranges(spark, ranges, split).withColumn("value", F.col("value").cast("string"))).where("value <> ''")


def place_after(spark: SparkSession, ranges: list, n: int, split: int) -> tuple[str, int] | None:
    """The place (file, byte) behind the n-th valid line of ranges; None if they hold fewer than n + 1. Reads twice as many pieces each time until it is reached."""
    pieces = [(f, max(a, c), min(b, c + split)) for f, a, b in ranges for c in range(a // split * split, b, split)]
    seen, at, step = 0, 0, 8
    while at < len(pieces):
        some = pieces[at : at + step]
        # A piece is a cell of its file; no more rows than pieces.
        counts = {(r.file, r.cell): r.n for r in _valid(spark, some, split).groupBy("file", F.expr(f"start div {split}").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for piece in some:
            here = counts.get((piece[0], piece[1] // split), 0)
            if seen + here >= n:
                last = _valid(spark, [piece], split).orderBy("start").limit(n - seen).agg(F.max("end")).first()[0]
                return piece[0], last
            seen += here
        at, step = at + step, 2 * step
    return None


def ingest(spark: SparkSession, path: str, store_path: str, checkpoint: str, mode: str = "light", lexicon: DataFrame | None = None, dataset_id: int = 1, files_per_batch: int | None = None, limit: int | None = None, dataset: str | None = None, batch_bytes: int = BATCH_BYTES, split_bytes: int = SPLIT_BYTES, dry_run: bool = False, stop: threading.Event | None = None):
    """Ingests the lines under path that weren't ingested before, then stops; returns the store.

    Files are read in the order of their names, a batch of at most batch_bytes (and files_per_batch files) after the other, and large
    ones are split over tasks. A batch counts once, with its histograms, totals and files' progress, even if it is run again.
    limit: valid lines of this run; the next one goes on with the line behind the last. A batch that a broken run had begun is
    repeated whole first, also beyond the limit. SIGTERM in the main thread or `stop` ends the run: what is committed stays, the batch under
    way is repeated by the next run. Runs are recorded as running, then completed, interrupted or failed; files as running, completed, pending
    (a limit stands inside) or failed, with the reason. dry_run: writes nothing and returns filename, length and done, the bytes that are planned or ingested."""
    _checked(mode, lexicon, files_per_batch, limit, batch_bytes, split_bytes)
    checkpoint, log = checkpoint.rstrip("/"), PlanLog(f"{checkpoint.rstrip('/')}/plans")
    if dry_run:
        return spark.createDataFrame([(f, n, log.done.get(f, 0)) for f, n in listed(path)], "filename string, length long, done long").orderBy("filename")
    store = HistogramStore(spark, store_path)
    if dataset is not None:
        dataset_id = store.dataset(dataset)
    run, began, done = uuid.uuid4().hex, time.time(), {"lines": 0, "files": 0}
    reason: list[str] = []
    stamp = lambda t: F.lit(t).cast("double").cast("timestamp")
    begun, finished = _batch_log(checkpoint)
    log.forget_after(begun)
    until = None
    if limit is not None:
        pending = log.ranges(finished, begun)
        more = limit - (_valid(spark, pending, split_bytes).count() if pending else 0)
        until = place_after(spark, log.left(path), more, split_bytes) if more > 0 else ("", 0)

    def record(status: str, end: float | None) -> None:
        row = spark.createDataFrame([(run, dataset_id, status, done["lines"], done["files"])], "id string, dataset_id long, status string, lines_valid long, files long")
        store.record("ingestion_runs", row.withColumn("started_at", stamp(began)).withColumn("finished_at", stamp(end) if end else F.lit(None).cast("timestamp")).select("id", "dataset_id", "status", "started_at", "finished_at", "lines_valid", "files"))

    def merge(batch: DataFrame, number: int) -> None:
        start = time.time()
        lines = decoded(batch.withColumn("value", F.col("value").cast("string")))
        # One reading and decoding for all tables.
        seen = lines.groupBy("file", "value").agg(F.count(F.lit(1)).alias("weight"), F.count_if("had_invalid").alias("invalid"), F.max("end").alias("upto")).persist()
        try:
            values = seen.where("value <> ''").groupBy("value").agg(F.sum("weight").alias("weight")).persist()
            files = line_counts(seen, "weight", "invalid").join(seen.groupBy("file").agg(F.max("upto").alias("upto")), "file").persist()
            n_valid = files.agg(F.coalesce(F.sum("lines_valid"), F.lit(0))).first()[0]
            sizes = spark.createDataFrame(listed(path), "file string, size long")
            state = _progress(store, files.join(sizes, "file", "left"), dataset_id).withColumn("started_at", F.coalesce("started_at", stamp(start))).withColumn("finished_at", F.when(F.col("status") == "completed", stamp(time.time()))).withColumn("run", F.lit(run))
            if store.commit(f"{_query_name(spark, checkpoint)}:{dataset_id}:{mode}", {**profile(values, mode, lexicon, dataset_id), "file_progress": state}, number):
                done["lines"] += n_valid
            values.unpersist()
            files.unpersist()
        except Exception as wrong:
            reason.append(f"{type(wrong).__name__}: {wrong}"[:500])
            raise
        finally:
            seen.unpersist()

    def close(message: str | None, extra: dict[str, int]) -> None:
        """What this run left unfinished: pending behind a limit, else failed with the reason. Files without a byte are completed."""
        rows = store.read("file_progress")
        if not message and until is None and (blank := [(f,) for f, size in listed(path) if not size]):
            empty = spark.createDataFrame(blank, "filename string").select(F.lit(dataset_id).cast("long").alias("dataset_id"), "filename", *[{"status": F.lit("completed"), "run": F.lit(run), "started_at": stamp(began), "finished_at": stamp(time.time())}.get(c, F.lit(0 if t == "long" else None)).cast(t).alias(c) for c, t in PROGRESS.items()])
            if (new := empty if rows is None else empty.join(rows, ["dataset_id", "filename"], "left_anti")).limit(1).count():
                store.record("file_progress", new)
                rows = store.read("file_progress")
        known = spark.createDataFrame(list(extra.items()), "filename string, wanted long")
        if rows is None:
            rows = known.limit(0).drop("wanted").select(F.lit(dataset_id).cast("long").alias("dataset_id"), "filename", *[F.lit(None).cast(t).alias(c) for c, t in PROGRESS.items()])
        mine = rows.where(F.col("dataset_id") == dataset_id)
        done["files"] = mine.where((F.col("run") == run) & (F.col("status") == "completed")).count()
        open_ = mine.where((F.col("run") == run) & (F.col("status") == "running"))
        if extra:  # files of the batch that wasn't done; the store may have it already
            fresh = known.drop("wanted").join(mine, "filename", "left_anti")
            open_ = mine.join(known, "filename").where(F.coalesce("bytes_done", F.lit(0)) < F.col("wanted")).drop("wanted").unionByName(open_).dropDuplicates(["filename"]).unionByName(fresh.withColumn("dataset_id", F.lit(dataset_id).cast("long")), allowMissingColumns=True)
        now = open_.withColumn("status", F.lit("failed" if message else "pending")).withColumn("error_message", F.lit(message).cast("string")).withColumn("run", F.lit(run))
        now = now.withColumn("finished_at", stamp(time.time()) if message else F.lit(None).cast("timestamp"))
        if now.limit(1).count():
            store.record("file_progress", now.select("dataset_id", "filename", *PROGRESS))

    record("running", None)
    lines = read_stream(spark, path, f"{checkpoint}/plans", batch_bytes, split_bytes, until, files_per_batch)
    status, message = "failed", "failed"
    with _stopping(stop) as asked:
        query = lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
        try:
            status = "interrupted" if _wait(query, asked) else "completed"
            message = "interrupted" if status == "interrupted" else None
        except KeyboardInterrupt:
            status = message = "interrupted"
            raise
        except Exception as wrong:
            message = reason[-1] if reason else str(wrong)[:500]
            raise
        finally:
            query.stop()
            begun, finished = _batch_log(checkpoint)
            close(message, {f: end for f, _, end in PlanLog(f"{checkpoint}/plans").ranges(finished, begun)} if message else {})
            record(status, time.time())
    return store


#: Columns of a file's progress beside its key.
PROGRESS = {"status": "string", "lines_processed": "long", "lines_valid": "long", "lines_invalid": "long", "bytes_done": "long", "started_at": "timestamp", "finished_at": "timestamp", "error_message": "string", "run": "string"}


def _progress(store: HistogramStore, files: DataFrame, dataset_id: int) -> DataFrame:
    """Progress of the files of a batch (file, counts, upto, size) with what was counted before."""
    old = store.read("file_progress")
    new = files.select(F.lit(dataset_id).cast("long").alias("dataset_id"), F.col("file").alias("filename"), "lines_read", F.col("lines_valid").alias("v"), F.col("lines_invalid").alias("i"), "upto", "size")
    if old is None:
        met = new.select("*", *[F.lit(None).cast("long").alias(c) for c in ("lines_processed", "lines_valid", "lines_invalid", "bytes_done")], F.lit(None).cast("timestamp").alias("started_at"))
    else:
        met = new.join(old.select("dataset_id", "filename", "lines_processed", "lines_valid", "lines_invalid", "bytes_done", "started_at"), ["dataset_id", "filename"], "left")
    sum_ = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) + F.col(b)).alias(a)
    upto = F.greatest(F.coalesce("bytes_done", F.lit(0)), F.col("upto"))
    return met.select("dataset_id", "filename", F.when(upto >= F.coalesce("size", upto), "completed").otherwise("running").alias("status"), sum_("lines_processed", "lines_read"), sum_("lines_valid", "v"), sum_("lines_invalid", "i"), upto.alias("bytes_done"), "started_at", F.lit(None).cast("string").alias("error_message"))


@contextmanager
def _stopping(stop: threading.Event | None) -> Iterator[threading.Event]:
    """An event that SIGTERM sets, where this is the main thread."""
    asked = stop or threading.Event()
    if threading.current_thread() is not threading.main_thread():
        yield asked
        return
    before = signal.signal(signal.SIGTERM, lambda *_: asked.set())
    try:
        yield asked
    finally:
        signal.signal(signal.SIGTERM, before)


def _wait(query: StreamingQuery, asked: threading.Event) -> bool:
    """Waits until all that is there now is done, or until it is asked to stop; whether it was."""
    wrong: list[BaseException] = []

    def work() -> None:
        try:
            query.processAllAvailable()
        except BaseException as e:  # noqa: BLE001  raised again below
            wrong.append(e)

    waiter = threading.Thread(target=work, daemon=True)
    waiter.start()
    while waiter.is_alive():
        waiter.join(0.1)
        if asked.is_set():
            query.stop()
            return True
    if wrong:
        raise wrong[0]
    return False


def derive(store: HistogramStore, dataset_id: int = 1, n: int = 100) -> None:
    """Top items and the one-row summary of a dataset from its histograms, deleted and stored anew."""
    of = {t: store.read(t).where(F.col("dataset_id") == dataset_id).drop("dataset_id") for t in ("length_histogram", "charset_histogram", "entropy_histogram", "token_frequencies", "pattern_stats") if store.read(t) is not None}
    marked = lambda df: df.withColumn("dataset_id", F.lit(dataset_id).cast("long"))
    tops = [top(of[t], n) for top, t in ((top_tokens, "token_frequencies"), (top_patterns, "pattern_stats")) if t in of]
    if tops:
        store.replace("top_items", marked(tops[0] if len(tops) == 1 else tops[0].unionByName(tops[1])), dataset_id)
    if {"length_histogram", "charset_histogram", "entropy_histogram"} <= set(of):
        store.replace("global_summary", marked(global_summary(of["length_histogram"], of["charset_histogram"], of["entropy_histogram"])), dataset_id)


def event_stats(events: DataFrame) -> DataFrame:
    """Counts of a stream of values by length and charset mask, with sums of entropy; for a query in complete or update mode."""
    v = F.col("value")
    one = events.where("value <> ''").select(F.length(v).alias("length"), f.charset_mask(v).alias("charset_mask"), (f.shannon_per_char(v) * F.length(v)).alias("shannon_total"))
    return one.groupBy("length", "charset_mask").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("shannon_total"), 4).alias("sum_shannon"))


def ingest_events(events: DataFrame, store: HistogramStore, checkpoint: str, dataset_id: int = 0) -> None:
    """Statistics of a stream of single values (value) merged into the store as they come, without the values: lengths, masks, both entropies and totals."""
    from ..plans import profile as p

    def merge(batch: DataFrame, number: int) -> None:
        values = batch.where("value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("weight")).persist()
        tables = {"length_histogram": p.length_histogram(values), "charset_histogram": p.charset_histogram(values), "entropy_histogram": p.entropy_histogram(values), "dataset_totals": p.totals(values).withColumn("mode", F.lit("events"))}
        store.commit(f"{_query_name(batch.sparkSession, checkpoint)}:{dataset_id}:events", {k: v.withColumn("dataset_id", F.lit(dataset_id).cast("long")) for k, v in tables.items()}, number)
        values.unpersist()

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """The final state of an aggregated stream over what is there now."""
    spark = stream.sparkSession
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
