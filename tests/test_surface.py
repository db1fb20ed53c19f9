"""Detectors added by name, the live monitor, and word lists that are let go."""

import threading

import pytest
from pyspark.sql import functions as F

from credlens.operators import detectors as det
from credlens.operators.decompose import scored
from credlens.plans import monitor, profile
from credlens.sources import bindings
from credlens.sources.store import HistogramStore
from credlens.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"


def test_a_detector_added_by_name_is_used_by_profile_scorer_and_sql(spark):
    values = spark.createDataFrame([("zx1234BCDqw", 2), ("nothing", 1)], "value string, weight long")
    lexicon = spark.createDataFrame([("d", "hola", 0)], "dict_name string, word string, rank int")
    before = {r.value: r.guess_bits for r in scored(values.select("value"), lexicon).collect()}
    det.register("plate", det.found_by("plate", "[0-9]{4}[B-Z]{3}", lambda t: F.lit(7)), gate=lambda s: s.rlike("[0-9]{4}[B-Z]"))
    try:
        with pytest.raises(ValueError):
            det.register("plate", det.dates)
        assert {(r.pattern_type, r.pattern_repr, r["count"]) for r in profile.pattern_stats(values, lexicon).collect()} >= {("plate", "len=7", 2)}
        after = {r.value: r for r in scored(values.select("value"), lexicon).collect()}
        assert after["zx1234BCDqw"].guess_bits < before["zx1234BCDqw"] and after["nothing"].guess_bits == before["nothing"]
        assert "plate" in [x.type for x in after["zx1234BCDqw"].segments]
        det.matches_view(values, "matches")
        assert [tuple(r) for r in spark.sql("SELECT value, start, end, token, guesses FROM matches WHERE type = 'plate'").collect()] == [("zx1234BCDqw", 2, 9, "1234BCD", 7)]
    finally:
        det.unregister("plate")
    assert "plate" not in {r.pattern_type for r in profile.pattern_stats(values, lexicon).collect()}


def test_the_screen_follows_the_store_until_it_is_stopped(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one\ntwo\nthree\n")
    store, shown, stop = HistogramStore(spark, str(tmp_path / "store")), [], threading.Event()
    watcher = threading.Thread(target=monitor.watch, args=(store, shown.append, 0.2, stop))
    watcher.start()
    try:
        store.reset(seed=True)
        leak = store.ensure_dataset("leak")
        ingest(spark, str(src), str(tmp_path / "store"), str(tmp_path / "ck"), dataset_id=leak)
    finally:
        stop.set()
        watcher.join()
    assert "Sin ficheros" in shown[0]
    last = monitor.snapshot(store)
    assert "1 completados" in last and "3 líneas válidas" in last and "leak" in last and "a.txt" in last


def test_word_lists_are_let_go(spark):
    bindings.release()
    spark.catalog.clearCache()
    bindings.lexicon(spark, SF).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() > 0
    bindings.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
