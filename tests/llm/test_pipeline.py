"""The stages of the pipeline, each against what it must do to its own input."""

import re

import corpus_pipeline
from credlens.llm import crf
from credlens.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    from test_operators import _components, _kept_lines, _sets, _spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, whole = docs.columns, docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "personal_data", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, after = docs.collect(), spark.read.parquet(str(tmp_path / name)).collect()
        if name == "quality":
            field = crf.fit(docs, table(spark, SF, "labels"))
            want = {r.doc_id for r in crf.classify(docs, field).where("predicted = 1").collect()}
            assert {r.doc_id for r in after} == want and 0 < len(after) < len(before)
        elif name == "lines":
            want = _kept_lines([(r.doc_id, r.text) for r in before])
            assert {r.doc_id: r.text for r in after} == {i: w[2] for i, w in want.items()}
        elif name == "near_duplicates":
            ids = {r.doc_id for r in before}
            now, was = (_components(_sets([(r.doc_id, r.text) for r in rows if r.doc_id in ids], 5)) for rows in (before, whole))
            root = {i: i for i in ids}
            for _ in ids:
                root = {i: min(root[i], root[now[i]], root[was[i]], *[root[j] for j in ids if now[j] == i or was[j] == i]) for i in ids}
            assert sorted(r.doc_id for r in after) == sorted(i for i in ids if root[i] == i) and len(after) < len(before)
        elif name == "personal_data":
            assert len(after) == len(before) and not any(k == 0 for r in after for k, _, _ in _spans(r.text))
            changed = {r.doc_id: r.text for r in before}
            assert all(r.text == changed[r.doc_id] or re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r.text) for r in after)
            # Every address, number of a host, card and phone that stood in a text, by its digits.
            assert not any(_spans(r.text) for r in after)
            kinds = {k for r in before for k, _, _ in _spans(r.text)}
            assert all(any(f"[{name}]" in r.text for r in after) for k, name in enumerate(("EMAIL", "IP", "CARD", "PHONE")) if k in kinds) and kinds
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        if name != "packing":
            assert out.columns == columns and all(r.n_chars == len(r.text) for r in after)
        docs = spark.read.parquet(str(tmp_path / name))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_odd_rows_pass_every_stage(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    odd = odd.withColumn("score", F.lit("mine")).withColumn("component_id", F.lit("mine")).withColumn("uid", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        rows = out.collect()
        assert out.columns == odd.columns and all((r.score, r.component_id, r.uid) == ("mine",) * 3 for r in rows), name
        assert name == "quality" or sum(r.doc_id is None for r in rows) == 2, name
        assert name in ("quality", "near_duplicates") or len(rows) == 10, name


def test_a_small_table_gets_few_files(spark):
    from credlens.llm.common import Stored

    store, before = Stored(spark), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(500).repartition(60, "id")
        few = store.write(rows, 500)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert few.count() == 500 and len(few.inputFiles()) <= spark.sparkContext.defaultParallelism < 60


def test_stages_write_few_files_however_many_partitions(spark, tmp_path, monkeypatch):
    from credlens.llm.common import Stored

    docs, plain, files = spark.read.parquet(f"{SF}/documents.parquet"), Stored.write, []

    def write(self, df, *size):
        files.append(len((out := plain(self, df, *size)).inputFiles()))
        return out

    monkeypatch.setattr(Stored, "write", write)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before, most = [spark.conf.get(n) for n in names], spark.sparkContext.defaultParallelism
    want = {}
    for many in (False, True):
        if many:
            for n, v in zip(names, ("false", "16"), strict=True):
                spark.conf.set(n, v)
        try:
            for stage in (corpus_pipeline.lines, corpus_pipeline.near_duplicates):
                files.clear()
                stage(spark, docs, SF).write.parquet(out := str(tmp_path / f"{stage.__name__}-{many}"))
                got = spark.read.parquet(out)
                rows = sorted(map(tuple, got.collect()), key=str)
                assert rows == want.setdefault(stage, rows) and rows
                assert not many or max([*files, len(got.inputFiles())]) <= most < 16, (stage.__name__, files)
        finally:
            for n, v in zip(names, before, strict=True):
                spark.conf.set(n, v)


def test_a_worker_lets_go_what_another_kernel_kept():
    from credlens.llm.common import kept_by, let_go
    from credlens.llm.queries import tokenizer
    from credlens.llm.tokens import word_bpe

    bpe = word_bpe(tokenizer())
    let_go("words")
    assert word_bpe(tokenizer()) is bpe
    let_go("")
    assert not kept_by("words") and word_bpe(tokenizer()) is not bpe
