"""Laws that hold for any input: merging, modes, resumption, streams."""

from pyspark.sql import functions as F

from credlens.plans import profile
from credlens.sources.corpus import weighted
from credlens.sources.store import HistogramStore, check, merge_counts
from credlens.streaming.ingest import ingest

WORDS = ["hola", "Hola1985", "abc123", "p3dr0", "qwerty", "aaaa", "ñandú", "x", "hola"]


def _lexicon(spark):
    return spark.createDataFrame([("palabras_es", "hola", 0), ("otros", "pedro", 1)], "dict_name string, word string, rank int")


def _values(spark, words):
    return spark.createDataFrame([(w,) for w in words], "value string")


def _set(df):
    return {tuple(r) for r in df.select(sorted(df.columns)).collect()}


def test_merging_parts_equals_profiling_all(spark):
    whole, a, b = (profile.profile(weighted(_values(spark, w)), "heavy", _lexicon(spark)) for w in (WORDS, WORDS[:4], WORDS[4:]))
    for name in ("length_histogram", "charset_histogram", "entropy_histogram", "pattern_stats", "token_frequencies"):
        keys = tuple(c for c in whole[name].columns if c != "count")
        assert _set(merge_counts(a[name], b[name], keys)) == _set(whole[name]), name


def test_light_agrees_with_heavy_and_full(spark):
    w = weighted(_values(spark, WORDS))
    light, full = profile.profile(w, "light"), profile.profile(w, "full", _lexicon(spark))
    for name in ("length_histogram", "charset_histogram"):
        assert _set(light[name]) == _set(full[name])
    assert full["score_histogram"].agg(F.sum("count")).first()[0] == len(WORDS)


def test_weights_equal_repetition(spark):
    once = profile.pattern_stats(_values(spark, WORDS).withColumn("weight", F.lit(1).cast("long")), _lexicon(spark))
    assert _set(once) == _set(profile.pattern_stats(weighted(_values(spark, WORDS)), _lexicon(spark)))


def test_hola_counts_three_times(spark):
    got = profile.token_frequencies(weighted(_values(spark, ["hola"])), _lexicon(spark)).where("token = 'hola'").first()
    assert got["count"] == 3


def test_store_commits_once_and_resets(spark, tmp_path):
    store = HistogramStore(spark, str(tmp_path / "store"))
    p = profile.profile(weighted(_values(spark, WORDS)), "light")
    assert store.commit("b1", p) and not store.commit("b1", p) and store.commit("b2", p)
    assert store.read("length_histogram").agg(F.sum("count")).first()[0] == 2 * len(WORDS)
    store.replace("top_items", spark.createDataFrame([(1, "x")], "dataset_id long, item_repr string"), 1)
    store.replace("top_items", spark.createDataFrame([(1, "y"), (2, "z")], "dataset_id long, item_repr string"), 1)
    assert {r.item_repr for r in store.read("top_items").collect()} == {"y", "z"}
    store.reset()
    assert store.read("length_histogram") is None


def test_ingestion_resumes_with_new_files_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    where = (str(src), str(tmp_path / "store"), str(tmp_path / "ck"))
    (src / "a.txt").write_text("hola\nabc123\n\n")
    ingest(spark, *where)
    (src / "b.txt").write_text("xyz\n")
    store = ingest(spark, *where)
    assert {(r.length, r["count"]) for r in store.read("length_histogram").collect()} == {(4, 1), (6, 1), (3, 1)}
    assert ingest(spark, *where).read("length_histogram").agg(F.sum("count")).first()[0] == 3


def test_constraints(spark):
    assert check("score_histogram", spark.createDataFrame([(5,), (4,)], "score int")).count() == 1


def test_two_checkpoints_into_one_store_keep_all_lines(spark, tmp_path):
    a, b, store = tmp_path / "a", tmp_path / "b", str(tmp_path / "store")
    for folder, text in ((a, "hola\nabc\n\n"), (b, "xyz12\n")):
        folder.mkdir()
        (folder / "f.txt").write_text(text)
    ingest(spark, str(a), store, str(tmp_path / "ca"))
    done = ingest(spark, str(b), store, str(tmp_path / "cb"))
    assert done.read("length_histogram").agg(F.sum("count")).first()[0] == 3
    assert ingest(spark, str(a), store, str(tmp_path / "ca")).read("dataset_totals").first().total_lines == 3
    files = {r.filename.rsplit("/", 2)[1]: r for r in done.read("file_progress").collect()}
    assert {k: (r.status, r.lines_processed, r.lines_valid, r.lines_invalid) for k, r in files.items()} == {"a": ("completed", 3, 2, 0), "b": ("completed", 1, 1, 0)}
    runs = done.read("ingestion_runs").collect()
    assert sorted((r.status, r.lines_valid, r.files) for r in runs) == [("completed", 0, 0), ("completed", 1, 1), ("completed", 2, 1)]
    datasets = spark.createDataFrame([(1, "leak", "leaked")], "id long, name string, dataset_type string")
    from credlens.plans import monitor

    assert {r.dataset_name for r in monitor.recent_runs(done.read("ingestion_runs"), datasets).collect()} == {"leak"}
    assert {r.status: r.files for r in monitor.by_status(done.read("file_progress")).collect()} == {"completed": 2}


def test_a_replayed_batch_and_a_failed_commit_change_nothing(spark, tmp_path):
    store = HistogramStore(spark, str(tmp_path / "store"))
    h = spark.createDataFrame([(1, 4, 2)], "dataset_id long, length int, count long")
    assert store.commit("q", {"length_histogram": h}, 0) and store.commit("q", {"length_histogram": h}, 1)
    assert not store.commit("q", {"length_histogram": h}, 1) and not store.commit("q", {"length_histogram": h}, 0)
    bad = spark.createDataFrame([(1, 7, 2)], "dataset_id long, score int, count long")
    try:
        store.commit("q", {"length_histogram": h, "score_histogram": bad}, 2)
        raise AssertionError("a broken constraint passes")
    except ValueError:
        pass
    assert store.read("length_histogram").first()["count"] == 4 and store.read("score_histogram") is None


def test_compaction_keeps_sums_and_newest_records(spark, tmp_path, monkeypatch):
    from credlens.sources import store as module

    monkeypatch.setattr(module, "FAN", 3)
    store = HistogramStore(spark, str(tmp_path / "store"))
    store.reset(seed=True)
    for i in range(5):
        h = spark.createDataFrame([(1, 4, 1)], "dataset_id long, length int, count long")
        run = spark.createDataFrame([("r", 1, "running" if i < 4 else "completed")], "id string, dataset_id long, status string")
        store.commit("q", {"length_histogram": h, "ingestion_runs": run}, i)
    assert store.read("length_histogram").first()["count"] == 5 and [r.status for r in store.read("ingestion_runs").collect()] == ["completed"]
    assert len(store._manifest()["tables"]["length_histogram"]) < 4 and store.dataset("user_queries") == 0


def test_arguments_limits_and_listing(spark, tmp_path):
    import pytest

    from credlens.streaming.ingest import list_files

    src = tmp_path / "in"
    src.mkdir()
    for name in "ba":
        (src / f"{name}.txt").write_text("one\ntwo\nthree\n")
    where = (str(src), str(tmp_path / "store"), str(tmp_path / "ck"))
    for wrong in ({"mode": "huge"}, {"mode": "heavy"}, {"files_per_batch": 0}, {"limit": 0}, {"dataset": "absent"}):
        with pytest.raises(ValueError):
            ingest(spark, *where, **wrong)
    assert [r.filename[-5:] for r in list_files(spark, str(src)).collect()] == ["a.txt", "b.txt"]
    store = ingest(spark, *where, limit=4)
    assert store.read("dataset_totals").first().total_lines == 4
    assert "pending" in {r.status for r in store.read("file_progress").collect()}


def test_events_and_derived_tables(spark, tmp_path):
    from credlens.streaming.ingest import derive, ingest_events

    src = tmp_path / "in"
    src.mkdir()
    (src / "e.txt").write_text("\n".join(WORDS))
    stream = spark.readStream.format("text").load(str(src))
    store = HistogramStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_events(stream, store, str(tmp_path / "ck"))
    plain = profile.profile(weighted(_values(spark, WORDS)), "heavy", _lexicon(spark), 0)
    for name in ("length_histogram", "charset_histogram", "entropy_histogram"):
        assert _set(store.read(name)) == _set(plain[name]), name
    derive(store, 0)
    derive(store, 0)
    assert store.read("global_summary").count() == 1 and store.read("global_summary").first().sample_size == len(WORDS)
    store.commit("h", {"token_frequencies": plain["token_frequencies"], "pattern_stats": plain["pattern_stats"]})
    derive(store, 0)
    assert {r.item_type for r in store.read("top_items").collect()} == {"token", "pattern"}


def test_monitor_screen(spark):
    from credlens.plans import monitor

    totals = spark.createDataFrame([("leak", 1234567, 8.5)], "name string, total_lines long, mean_length double")
    runs = spark.createDataFrame([(i, "leak", "completed", f"2025-01-0{i} 10:00:00", None, 1000 * i) for i in range(1, 6)], "id long, dataset_name string, status string, started_at string, finished_at string, lines_valid long")
    files = [("in/a.txt", "running", 5000, 4000, "2025-01-01 00:00:00", None), ("b.txt", "failed", 7, 6, None, None), ("c.txt", "completed", 9, 9, "2025-01-01 00:00:00", "2025-01-01 00:01:30"), ("d.txt", "pending", 0, 0, None, None)]
    progress = spark.createDataFrame(files, "filename string, status string, lines_processed long, lines_valid long, started_at string, finished_at string")
    lines = [r.line for r in monitor.snapshot_text(totals, runs, progress, "2025-01-01 00:00:50", 15_000).collect()]
    assert lines[0] == f"  {'leak':<25}  {'1,234,567':>15} líneas válidas  media longitud: 8.50"
    assert [x.split()[0] for x in lines[1:4]] == ["#5", "#4", "#3"] and "10:00:00 → running" in lines[1]
    assert lines[4] == f"  {'a.txt':<45} {'4,000':>12}  {'100':>8}  {'1m40s':>8}"
    assert "checkpoint: 7 líneas" in lines[5] and lines[6] == "Ficheros: 1 completados  1 en curso  1 fallidos  1 pendientes  (total 4)"
    assert lines[7].endswith("1m30s")
