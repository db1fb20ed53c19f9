"""A text of 5 MB and one with a line of 3 MB through each operator."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from credlens.llm import crf
from credlens.llm.chunked_bpe import encode_decode
from credlens.llm.line_dedup import dedup_lines
from credlens.llm.minhash import near_texts
from credlens.llm.packing import pack
from credlens.llm.pii import find_personal_data
from credlens.llm.quality_rules import robust_outliers
from credlens.llm.sharding import interleave
from credlens.llm.suffix_dedup import remove_repeats

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(77)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, end = say(60), "a closing line that both of them have"
    long = "\n".join([say(400) for _ in range(2300)]) + "\nmail a.b@c.example\n" + passage + "\n" + end
    line = say(560_000) + "\n" + passage + " " + say(30) + "\n" + end
    assert len(long) > 5_000_000 and len(line.split("\n")[0]) > 3_000_000
    return {1: long, 2: line, 3: say(60), 4: long, 5: long[: 4_900_000]}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).persist()


def _by_id(df, *cols):
    return {r.doc_id: r for r in df.select("doc_id", *cols).collect()}


def test_quality_and_lines(docs, texts):
    df = docs
    scores = _by_id(crf.classify(df, crf.LineField.blank()), "score")
    assert {r.score for r in scores.values()} == {0.5} and set(scores) == set(texts)
    kept = _by_id(dedup_lines(df), "n_lines", "n_dropped", "text")
    assert kept[1].n_lines == texts[1].count("\n") + 1 and kept[1].n_dropped == 0 and kept[2].n_dropped == 1
    assert kept[4].text == "" and kept[4].n_dropped == kept[1].n_lines


def test_repeats_and_near_copies(docs, texts):
    df = docs
    cut = _by_id(remove_repeats(df), "n_bytes", "n_removed")
    assert all(cut[i].n_bytes == len(t) for i, t in texts.items())
    assert cut[1].n_removed == 0 and cut[4].n_removed == len(texts[4]) and cut[5].n_removed == len(texts[5])
    assert 0 < cut[2].n_removed < 2000
    near = _by_id(near_texts(df), "component_id")
    assert {i: r.component_id for i, r in near.items()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}


def test_tokens(docs, texts):
    df = docs
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    got = _by_id(encode_decode(df, PATH, outputs=("n_tokens", "ids_sha256"), keep_text=False), "n_tokens", "ids_sha256")
    assert all((got[i].n_tokens, got[i].ids_sha256) == (len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want.items())
    pieces = pack(df, PATH).select("doc_id", "start", "length", "ids").toPandas().sort_values(["doc_id", "start"])
    for i, g in pieces.groupby("doc_id"):
        assert np.concatenate(g["ids"].to_list()).tolist() == [*want[i], 2]


def test_personal_data_rules_and_shards(docs, texts):
    df = docs
    found = _by_id(find_personal_data(df), "base")
    at = texts[1].index("a.b@c.example")
    assert [(x.s, x.e) for x in found[1].base] == [(at, at + 13)] and not found[2].base
    rules = _by_id(robust_outliers(df), "n_words", "n_dup_lines")
    assert all(rules[i].n_words == len(t.split()) for i, t in texts.items())
    placed = interleave(df.select("doc_id", "source", F.length("text").alias("n")), 2)
    assert sorted(r.n for r in placed.collect()) == sorted(map(len, texts.values()))
