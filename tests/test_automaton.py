"""Word lookups: the trie against plain substrings, and against the join that larger lexicons take."""

import random

import numpy as np
from pyspark.sql import functions as F

from credlens.operators import lexical
from credlens.operators.automaton import Trie, code_points, word_places


def _plain(texts, words, least):
    return sorted((i, s, s + n, t[s : s + n]) for i, t in enumerate(texts) for s in range(len(t)) for n in range(least, len(t) - s + 1) if t[s : s + n] in words)


def test_walks_find_every_word_at_every_place():
    rng = random.Random(1)
    for alphabet in ("ab", "abcñ👍\x00"):
        words = {"".join(rng.choices(alphabet, k=rng.randrange(1, 7))) for _ in range(60)}
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(200)]
        trie, chars = Trie(list(words)), code_points(texts)
        size = np.array(list(map(len, texts)))
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(texts)), size)
        starts = np.arange(len(chars))
        who, length, word = trie.walk(chars, starts, (first + size)[row], 2)
        got = sorted((int(row[w]), int(w - first[row[w]]), int(w - first[row[w]] + n), trie.words[k]) for w, n, k in zip(who, length.tolist(), word.tolist(), strict=True))
        assert got == _plain(texts, words, 2)
    empty = Trie([])
    assert len(empty.walk(code_points(["abc"]), np.arange(3), np.full(3, 3), 1)[0]) == 0


def test_places_in_two_forms(spark):
    values = spark.createDataFrame([(i, v) for i, v in enumerate(["Hola", "xholax", "ho", "", None, "H0LA", "İhola"])], "i int, value string")
    made = values.withColumn("a", F.lower("value")).withColumn("b", F.translate(F.lower("value"), "0", "o"))
    got = word_places(made, ["hola", "ola"], {"low": "a", "plain": "b"}, 3).collect()
    assert {(r.i, r.form, r.start, r.gram) for r in got} >= {(0, "low", 0, "hola"), (0, "low", 1, "ola"), (1, "plain", 1, "hola"), (5, "plain", 0, "hola")}
    assert not any(r.i in (2, 3, 4) or (r.i == 5 and r.form == "low") for r in got) and got[0].__fields__ == ["i", "value", "start", "end", "form", "gram"]


def test_large_lexicons_take_the_join_and_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("aeiosl", k=rng.randrange(3, 6))) for _ in range(120)})
    lexicon = spark.createDataFrame([(("palabras_es", "otros")[i % 2], w, i) for i, w in enumerate(words)] + [("otros", words[0], 999)], "dict_name string, word string, rank int")
    values = spark.createDataFrame([("".join(rng.choices("aeiosl4310$ñA", k=rng.randrange(10))),) for _ in range(300)], "value string").distinct()
    made = [lambda: lexical.dictionary_matches(values, lexicon), lambda: lexical.spanish_matches(values, lexicon), lambda: lexical.leet_matches(values, lexicon), lambda: lexical.lexical_matches(values, lexicon)]
    rows = lambda f: sorted(map(str, f().select(sorted(f().columns)).collect()))
    by_trie = [rows(f) for f in made]
    monkeypatch.setattr(lexical, "BROADCAST_WORDS", 10)
    assert [rows(f) for f in made] == by_trie and all(by_trie)
