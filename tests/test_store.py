"""The store under several writers: claims, levels, deletes, unique names."""

import math
import threading

import pytest
from pyspark.sql import functions as F

from credlens.sources import store as module
from credlens.sources.store import HistogramStore


def _delta(spark, dataset, length, n):
    return spark.createDataFrame([(dataset, length, n)], "dataset_id long, length int, count long")


def _at_once(*work):
    wrong = []

    def run(f):
        try:
            f()
        except BaseException as e:  # noqa: BLE001
            wrong.append(e)

    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not wrong, wrong


def test_writers_at_once_keep_all_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "FAN", 3)
    path = str(tmp_path / "store")

    def writer(name):
        def run():
            store = HistogramStore(spark, path)
            for i in range(5):
                assert store.commit(name, {"length_histogram": _delta(spark, 1, i, 1), "dataset_totals": spark.createDataFrame([(1, "light", 1, i)], "dataset_id long, mode string, total_lines long, sum_length long")}, i)
                assert not store.commit(name, {"length_histogram": _delta(spark, 1, i, 1)}, i)

        return run

    _at_once(*[writer(n) for n in "abc"])
    store = HistogramStore(spark, path)
    assert {(r.length, r["count"]) for r in store.read("length_histogram").collect()} == {(i, 3) for i in range(5)}
    totals = store.read("dataset_totals").first()
    assert (totals.total_lines, totals.sum_length) == (15, 30)
    m = store._manifest()
    assert m["batches"] == {n: 4 for n in "abc"} and all(len(f) <= 9 for f in m["tables"].values())


def test_one_batch_by_two_writers_counts_once(spark, tmp_path):
    path, done = str(tmp_path / "store"), []
    _at_once(*[lambda: done.append(HistogramStore(spark, path).commit("q", {"length_histogram": _delta(spark, 1, 4, 2)}, 0)) for _ in range(3)])
    assert sorted(done) == [False, False, True] and HistogramStore(spark, path).read("length_histogram").first()["count"] == 2


def test_bytes_written_grow_with_the_logarithm_of_commits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "FAN", 4)
    store = HistogramStore(spark, str(tmp_path / "store"))
    rows = 64
    plain, most = [], 0
    write = HistogramStore._write

    def counted(self, table, df):
        plain.append(df.count())
        return write(self, table, df)

    monkeypatch.setattr(HistogramStore, "_write", counted)
    for i in range(rows):  # a key of its own each, so that nothing shrinks
        store.commit("q", {"length_histogram": _delta(spark, 1, i, 1)}, i)
        most = max(most, len(store._manifest()["tables"]["length_histogram"]))
    assert sum(plain) <= rows * (1 + math.log(rows, 4)) and most <= 3 * 3 + 4
    assert store.read("length_histogram").count() == rows
    m = store._manifest()
    assert len(m["batches"]) == 1 and len(m["gone"]) <= 5 * module.GRACE and len(store._numbers()) <= module.KEPT + 2


def test_deleting_a_dataset_leaves_no_row_of_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "FAN", 3)
    store = HistogramStore(spark, str(tmp_path / "store"))
    store.reset(seed=True)
    a, b = store.ensure_dataset("a"), store.ensure_dataset("b")
    file = lambda d: spark.createDataFrame([(d, "f", "completed")], "dataset_id long, filename string, status string")
    for d in (a, b):
        store.commit(f"q{d}", {"length_histogram": _delta(spark, d, 3, 5), "file_progress": file(d)}, 0)
        store.replace("top_items", spark.createDataFrame([(d, "x")], "dataset_id long, item_repr string"), d)
    store.delete_dataset(a)
    owned = lambda t: {r[0] for r in store.read(t).select("id" if t == "datasets" else "dataset_id").collect()}
    tables = ("length_histogram", "file_progress", "top_items")
    assert all(owned(t) == {b} for t in tables) and owned("datasets") == {0, b}
    for i in range(1, 6):  # folders are put together; the rows stay away, new ones of the same id count
        store.commit(f"q{b}", {"length_histogram": _delta(spark, b, 3, 1), "file_progress": file(b)}, i)
    assert all(owned(t) == {b} for t in tables) and store.read("length_histogram").first()["count"] == 10
    store.commit("again", {"length_histogram": _delta(spark, a, 9, 1)}, 0)
    assert {(r.dataset_id, r.length, r["count"]) for r in store.read("length_histogram").collect()} == {(a, 9, 1), (b, 3, 10)}


def test_names_of_datasets_are_unique_also_for_writers_at_once(spark, tmp_path):
    path, ids = str(tmp_path / "store"), []
    HistogramStore(spark, path).reset(seed=True)
    _at_once(*[lambda n=n: ids.append((n, HistogramStore(spark, path).ensure_dataset(n))) for n in ("x", "x", "y", "z")])
    store = HistogramStore(spark, path)
    assert len({i for _, i in ids}) == 3 and {r.name for r in store.read("datasets").collect()} == {"user_queries", "x", "y", "z"}
    with pytest.raises(ValueError):
        store.record("datasets", spark.createDataFrame([(77, "x", "leaked")], "id long, name string, dataset_type string"))
    store.record("datasets", spark.createDataFrame([(store.dataset("x"), "x", "user_submitted")], "id long, name string, dataset_type string"))
    assert store.read("datasets").where(F.col("name") == "x").first().dataset_type == "user_submitted"
