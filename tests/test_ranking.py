"""Gapless ranks by ranges instead of one partition."""

import random

from pyspark.sql import functions as F

from credlens.sources.lexicon import build_lexicon, ranked


def test_ranks_are_those_of_a_sort_whatever_is_tied(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("abcdef", k=6)) + str(i), rng.choice([0, 0, 0, 0, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "word string, freq long").repartition(5)
    got = {r.word: r["rank"] for r in ranked(df, (-F.col("freq"), F.col("word")), parts=16).collect()}
    assert got == {w: i for i, (w, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    for few in (rows[:3], []):
        small = ranked(spark.createDataFrame(few, "word string, freq long"), (-F.col("freq"), F.col("word")))
        assert sorted(r["rank"] for r in small.collect()) == list(range(len(few)))


def test_no_window_without_a_partition_in_the_plan(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}",) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"], "word string")
    made = build_lexicon(words, words.select("word", F.length("word").cast("long").alias("freq")))
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert sorted(r["rank"] for r in made.collect()) == list(range(1000))
