"""Large word lists: a sieve against plain substrings, and what of them comes to the driver or is shuffled."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from credlens.operators import automaton, lexical
from credlens.operators.decompose import scored
from credlens.queries import QUERIES
from credlens.sources.bindings import strings
from credlens.sources.lexicon import CULTURAL

SMALL = "/root/testdata/sf0.001"
#: Queries that look words up in a list made from the documents.
LOOKUPS = ["evaluation_json", "evaluation_reports", "lexical_pattern_stats", "pattern_stats", "token_frequencies", "top_items_patterns", "top_items_tokens"]


def test_a_sieve_lets_every_word_through_and_little_else(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abcñ👍e", k=rng.randrange(1, 40))) for _ in range(300)})
    sieve = automaton.sieve_of(spark.createDataFrame([(w,) for w in words] + [(None,)], "gram string").repartition(3), len(words), max(map(len, words)))
    texts = ["".join(rng.choices("abcñ👍e1", k=rng.randrange(9))) + rng.choice(words) + rng.choice(["", "1", "ab"]) for _ in range(200)]
    values = spark.createDataFrame(list(enumerate(texts)), "i int, value string").withColumn("f", F.col("value"))
    got = {(r.i, r.start, r.gram) for r in automaton.word_places(values, sieve, {"f": "f"}, 2).collect()}
    every = {(i, s, t[s:e]) for i, t in enumerate(texts) for s in range(len(t)) for e in range(s + 2, len(t) + 1)}
    want = {x for x in every if x[2] in set(words)}
    assert want <= got <= every and len(got - want) < 0.05 * len(every)
    assert sorted(r.gram for r in automaton.sieved(values, sieve, {"f": "f"}, 2).collect()) == sorted({x[2] for x in got})
    assert automaton.Sieve(16, 3).walk(automaton.code_points(["abc"]), np.arange(3), np.full(3, 3), 1)[0].size == 0


@pytest.fixture
def sent(monkeypatch):
    """Numbers of words of which tries are made on the driver."""
    sizes, made = [], automaton.Trie.__init__

    def init(self, words):
        sizes.append(len(words))
        made(self, words)

    monkeypatch.setattr(automaton.Trie, "__init__", init)
    return sizes


def _lists(spark, n=30_000):
    """A list of n words of six letters, of which "aaaaaa" to "aaabmv" are the first thousand."""
    digits = [F.element_at(F.array(*[F.lit(c) for c in string.ascii_lowercase]), (F.floor(F.col("id") / 26**k) % 26 + 1).cast("int")) for k in range(5, -1, -1)]
    return spark.range(n).select(F.lit("otros").alias("dict_name"), F.concat(*digits).alias("word"), F.col("id").cast("int").alias("rank"))


def test_words_that_do_not_occur_stay_on_the_executors(spark, sent):
    values = spark.createDataFrame([("xaaaabz9",), ("4aaabc!",), ("Hola7",), ("zzzzzz",)], "value string")
    found = lexical.dictionary_matches(values, _lists(spark)).select("token", "rank").collect()
    assert {tuple(r) for r in found} == {("aaaabz", 51)} and scored(values, _lists(spark)).count() == 4
    assert sent and max(sent) <= 5 + len(CULTURAL)


@pytest.mark.parametrize("name", LOOKUPS)
def test_queries_keep_their_lists_on_the_executors(spark, sent, monkeypatch, name):
    monkeypatch.setattr(lexical, "FEW", 100, raising=False)
    rows = QUERIES[name](spark, SMALL).count()
    words = QUERIES["lexicon_build"](spark, SMALL).select("word").distinct().count()
    assert rows and sent and max(sent) < 0.5 * words


def test_scores_shuffle_neither_substrings_nor_matches(spark, monkeypatch):
    values = spark.createDataFrame([("xaaaabz9", 1), ("4aaabc!", 2), ("Hola7", 3), (None, 4), ("", 5)], "value string, weight long")
    lists = _lists(spark)
    done = scored(values, lists)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(str, done.collect()))
    assert len(rows) == 5 and any("aaaabz" in r for r in rows)
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 2)
    assert sorted(map(str, scored(values, lists).collect())) == rows


def test_the_join_meets_few_substrings_that_are_no_words(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 0)
    values = spark.range(2000).select(F.format_string("Customer#%09d", "id").alias("value"))
    lists = _lists(spark).unionByName(spark.createDataFrame([("otros", "tom", 7)], "dict_name string, word string, rank int"))
    found = lexical.dictionary_matches(values, lists)
    assert found.count() == 2000
    known = lexical.met(values.withColumn("f", F.lower("value")), lists.select(F.col("word").alias("gram")), {"f": "f"})
    assert known.words is None
    assert automaton.word_places(values.withColumn("f", F.lower("value")), known.sieve, {"f": "f"}, 3).count() < 3 * 2000


#: Queries that score strings.
SCORES = ["score_histogram", "strength_bits", "strength_scores"]


@pytest.mark.parametrize("name", SCORES)
def test_queries_of_scores_shuffle_values_only_to_make_them(spark, monkeypatch, name):
    monkeypatch.setattr(lexical, "FEW", 100, raising=False)
    by_value = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(value")
    assert by_value(QUERIES[name](spark, SMALL)) == by_value(strings(spark, SMALL)) > 0
