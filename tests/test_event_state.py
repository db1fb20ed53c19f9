"""An unbounded stream of events, stopped and started again, gives the sums of one batch."""

import time

from pyspark.sql import functions as F

from credlens.plans import profile
from credlens.sources.corpus import weighted
from credlens.sources.store import HistogramStore
from credlens.streaming.event_state import stream_events
from credlens.streaming.ingest import _query_name

ROUNDS = [["hola", "Hola1985", "abc123", ""], ["p3dr0", "hola", "ñandú"], ["x", "qwerty", "hola", "aaaa"]]


def _until(done, seconds=120):
    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.5)


def test_restarts_in_the_middle_lose_and_repeat_nothing(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    store = HistogramStore(spark, str(tmp_path / "store"))
    name = lambda checkpoint: f"{_query_name(spark, checkpoint)}:events"

    def start():
        stream = spark.readStream.format("text").load(str(src)).select(F.lit(0).cast("long").alias("dataset_id"), "value")
        return stream_events(stream, store, ck, name, flush_seconds=2.0, every="500 milliseconds")

    def total():
        rows = store.read("dataset_totals")
        return 0 if rows is None else rows.agg(F.sum("total_lines")).first()[0]

    seen = 0
    for i, words in enumerate(ROUNDS):
        (src / f"{i}.txt").write_text("\n".join(words) + "\n")
        query = start()
        if i == 1:  # stopped with sums in the state alone
            _until(lambda: any(p["numInputRows"] for p in query.recentProgress))
            query.stop()
            continue
        seen = sum(sum(map(bool, r)) for r in ROUNDS[: i + 1])
        _until(lambda: total() == seen)
        query.stop()
    every = spark.createDataFrame([(w,) for r in ROUNDS for w in r if w], "value string")
    plain = profile.profile(weighted(every), "heavy", spark.createDataFrame([("d", "hola", 0)], "dict_name string, word string, rank int"), 0)
    rows = lambda df: {tuple(r) for r in df.select(sorted(df.columns)).collect()}
    for table in ("length_histogram", "charset_histogram", "entropy_histogram"):
        assert rows(store.read(table)) == rows(plain[table]), table
    got, want = store.read("dataset_totals").first(), plain["dataset_totals"].first()
    assert (got.total_lines, got.sum_length, got["mode"]) == (want.total_lines, want.sum_length, "events")
    assert abs(got.sum_shannon - want.sum_shannon) < 1e-9 and abs(got.sum_charset_bits - want.sum_charset_bits) < 1e-9
