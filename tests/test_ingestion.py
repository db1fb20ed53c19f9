"""Ingestion by (file, byte): splits, batches, limits, stops and failures lose no line and count none twice."""

import io
import os
import random
import signal
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from credlens.plans import monitor
from credlens.sources import line_stream
from credlens.sources.store import HistogramStore
from credlens.streaming import ingest as module
from credlens.streaming.ingest import ingest


class _File(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_any_cut_of_a_file_gives_every_line_once(monkeypatch):
    rng = random.Random(1)
    for block in (3, 7, 64):
        monkeypatch.setattr(line_stream, "BLOCK", block)
        for _ in range(80):
            data = b"".join(bytes(rng.choices(b"ab\xff", k=rng.randrange(9))) + b"\n" for _ in range(rng.randrange(6))) + rng.choice([b"", b"tail", b"\n"])
            cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(4))})
            got = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                for block_, starts, ends in line_stream.lines_in(_File(data), len(data), a, b):
                    r = line_stream._record(block_, starts, ends, "f")
                    got += list(zip(r["value"].to_pylist(), r["start"].to_pylist(), r["end"].to_pylist(), strict=True))
            want, at = [], 0
            for line in data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]:
                end = min(at + len(line) + 1, len(data))
                want.append((line, at, end))
                at = end
            assert got == want, (data, cuts)


@pytest.fixture
def where(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    return src, (str(src), str(tmp_path / "store"), str(tmp_path / "ck"))


def _files(src, n=4, lines=10):
    for i in range(n):
        (src / f"f{i}.txt").write_text("".join(f"line{i}x{j}\n" + ("\n" if j % 3 == 0 else "") for j in range(lines)))


def _total(store):
    return store.read("length_histogram").agg(F.sum("count")).first()[0]


def _states(store):
    return {os.path.basename(r.filename): (r.status, r.lines_valid) for r in store.read("file_progress").collect()}


def test_a_limited_run_and_a_free_one_count_every_line_once(spark, where):
    src, at = where
    _files(src)
    store = ingest(spark, *at, limit=15, split_bytes=40)
    assert _total(store) == 15 and _states(store) == {"f0.txt": ("completed", 10), "f1.txt": ("pending", 5)}
    assert _total(ingest(spark, *at, limit=3, split_bytes=40)) == 18
    (src / "a-new.txt").write_text("one\ntwo")
    (src / "empty.txt").write_text("")
    store = ingest(spark, *at, batch_bytes=64, split_bytes=16)
    assert _total(store) == 42
    assert _states(store) == {**{f"f{i}.txt": ("completed", 10) for i in range(4)}, "a-new.txt": ("completed", 2), "empty.txt": ("completed", 0)}
    assert {r.lines_processed for r in store.read("file_progress").where("filename like '%f_.txt'").collect()} == {14}
    assert _total(ingest(spark, *at)) == 42 and _total(ingest(spark, *at, limit=5)) == 42


def test_a_large_file_is_split_over_tasks_and_batches(spark, where):
    src, at = where
    rng = random.Random(2)
    data = b"".join(bytes(rng.choices(b"abc\xff\xc3\xb1", k=rng.randrange(12))) + rng.choice([b"\n", b"\r\n"]) for _ in range(3000)) + b"no end"
    (src / "big.txt").write_bytes(data)
    store = ingest(spark, *at, batch_bytes=7000, split_bytes=500)
    want = [x.decode("utf-8", "replace").removesuffix("\r") for x in data.split(b"\n")]
    import unicodedata

    lengths = np.unique([len(unicodedata.normalize("NFC", x)) for x in want if x], return_counts=True)
    assert sorted((r.length, r["count"]) for r in store.read("length_histogram").collect()) == list(zip(*[x.tolist() for x in lengths], strict=True))
    row = store.read("file_progress").first()
    assert (row.status, row.lines_processed, row.lines_valid, row.lines_invalid, row.bytes_done) == ("completed", 3001, sum(map(bool, want)), sum("�" in x for x in want), len(data))
    from credlens.sources.line_stream import PlanLog

    log = PlanLog(f"{at[2]}/plans")
    assert log.last == -(-len(data) // 7000) and log.left(at[0]) == []


def _after(commits, do):
    """A commit that does something once so many batches of lines are committed."""
    plain, seen = HistogramStore.commit, []

    def commit(self, batch, deltas, number=0):
        out = plain(self, batch, deltas, number)
        if "length_histogram" in deltas:
            seen.append(batch)
            if len(seen) == commits:
                do()
        return out

    return commit


def test_a_stop_inside_a_file_is_resumed_at_the_next_line(spark, where, monkeypatch):
    src, at = where
    _files(src, 2, 60)
    stop = threading.Event()
    monkeypatch.setattr(HistogramStore, "commit", _after(2, stop.set))
    store = ingest(spark, *at, batch_bytes=150, stop=stop)
    assert 0 < _total(store) < 120
    row = store.read("file_progress").where("status = 'failed'").first()
    assert row.error_message == "interrupted" and row.lines_valid < 60
    assert [r.status for r in store.read("ingestion_runs").collect()] == ["interrupted"]
    monkeypatch.undo()
    monkeypatch.setattr(HistogramStore, "commit", _after(1, lambda: os.kill(os.getpid(), signal.SIGTERM)))
    store = ingest(spark, *at, batch_bytes=300)
    assert _total(store) < 120 and signal.getsignal(signal.SIGTERM) == signal.SIG_DFL
    monkeypatch.undo()
    store = ingest(spark, *at)
    assert _total(store) == 120 and set(_states(store).values()) == {("completed", 60)}
    # The monitor reads what ingestion wrote.
    runs, progress = store.read("ingestion_runs"), store.read("file_progress")
    datasets = spark.createDataFrame([(1, "leak", "leaked")], "id long, name string, dataset_type string")
    assert {r.status for r in monitor.recent_runs(runs, datasets).collect()} == {"interrupted", "completed"}
    assert {r.status: r.files for r in monitor.by_status(progress).collect()} == {"completed": 2}
    assert monitor.recently_completed(progress).count() == 2 and monitor.pending(module.list_files(spark, at[0]), progress).count() == 0
    totals = monitor.mean_lengths(datasets, store.read("dataset_totals"))
    screen = [r.line for r in monitor.snapshot_text(totals, monitor.recent_runs(runs, datasets), progress, "2030-01-01 00:00:00").collect()]
    assert any("2 completados" in x for x in screen) and any("120 líneas válidas" in x for x in screen)


def test_a_failed_batch_marks_its_files_and_is_repeated(spark, where, monkeypatch):
    src, at = where
    _files(src, 3, 20)

    plain, seen = HistogramStore.commit, []

    def commit(self, batch, deltas, number=0):
        seen.extend([batch] if "length_histogram" in deltas else [])
        if "length_histogram" in deltas and len(seen) == 2:
            raise OSError("disk is full")
        return plain(self, batch, deltas, number)

    monkeypatch.setattr(HistogramStore, "commit", commit)
    with pytest.raises(Exception, match="disk is full"):
        ingest(spark, *at, files_per_batch=1)
    store = HistogramStore(spark, at[1])
    assert [r.status for r in store.read("ingestion_runs").collect()] == ["failed"]
    bad = store.read("file_progress").where("status = 'failed'").collect()
    assert [os.path.basename(r.filename) for r in bad] == ["f1.txt"] and "disk is full" in bad[0].error_message
    monkeypatch.undo()
    store = ingest(spark, *at, limit=1)  # the broken batch is repeated first, though it is longer
    assert _total(store) == 40
    assert _total(ingest(spark, *at)) == 60 and set(_states(store).values()) == {("completed", 20)}


def test_a_dry_run_writes_nothing(spark, where, tmp_path):
    src, at = where
    _files(src, 2)
    rows = ingest(spark, *at, dry_run=True).collect()
    assert [os.path.basename(r.filename) for r in rows] == ["f0.txt", "f1.txt"] and {r.done for r in rows} == {0}
    assert sorted(os.listdir(tmp_path)) == ["in"]
    ingest(spark, *at, limit=11)
    assert [r.done == r.length for r in ingest(spark, *at, dry_run=True).collect()] == [True, False]
