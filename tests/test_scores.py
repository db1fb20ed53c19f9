"""Scores, reports and JSON against a plain version that looks substrings up one by one and tries every cover."""

import json
import math
from functools import lru_cache

from pyspark.sql import functions as F

from credlens.operators.decompose import LABELS, THRESHOLDS, lexical_spans, scored
from credlens.operators.detectors import detect_all
from credlens.operators.lexical import dictionary_matches, leet_matches, lexical_matches, spanish_matches
from credlens.plans import report
from credlens.sources.lexicon import CULTURAL, PRIORITY

LISTS = {"palabras_es": ["hola", "amor", "casa", "pedro"], "nombres_es": ["pedro", "ana"], "otros": ["holaamor", "sol", "qwe"]}
VALUES = ["hola", "Hola1985", "h0la4mor", "p3dr0!!", "xx", "", "qwerty123", "AmorAmor2001", "ñandú", "casa12031999", "realmadridHOLA", "$0l", "abcabcabc", "Zz9#kQ", "holaholahola", "12/03/1999", "7aaaa7", "unohola1985-04-03", "@na"]
SWAPS = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "7": "t", "8": "b"}


def _lexicon(spark):
    rows = [(d, w, i) for d, ws in LISTS.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "dict_name string, word string, rank int")


def _lexical(v):
    """(place, start, end, name, word, guesses) of every substring, by plain lookups."""
    low, out = v.lower(), []
    cultural = {w: i for i, w in enumerate(CULTURAL)}  # a repeated one counts at its last place
    for s in range(len(v)):
        for e in range(s + 3, len(v) + 1):
            t = low[s:e]
            plain = "".join(SWAPS.get(c, c) for c in t)
            for d, ws in LISTS.items():
                if t in ws:
                    g = max(ws.index(t), 1)
                    out += [(0, s, e, d, None, g), (1, s, e, d, None, g)]
            if t in cultural:
                out.append((1, s, e, "cultural", None, max(cultural[t], 1)))
            if plain != t:
                for d in [*PRIORITY, "otros"]:
                    if plain in LISTS.get(d, ()):
                        out.append((2, s, e, d, plain, LISTS[d].index(plain) * 2 ** sum(c in SWAPS for c in t)))
                        break
    return out


def _alphabet(v):
    classes = ((str.islower, 26, 128), (str.isupper, 26, 128), (str.isdigit, 10, 128))
    n = sum(size for test, size, top in classes if any(ord(c) < top and test(c) for c in v))
    return n + 33 * any(32 <= ord(c) < 127 and not c.isalnum() for c in v) + 100 * any(ord(c) > 127 for c in v)


def _best(v, spans, size):
    """Least product over all covers, and the number of segments of one that has it, neighbouring brute force counted once."""
    @lru_cache(None)
    def cost(at):
        if at == len(v):
            return 1
        return min([size * cost(at + 1)] + [max(g, 1) * cost(e) for s, e, g in spans if s == at])

    return cost(0)


def test_one_cut_gives_what_the_three_lookups_give(spark):
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    lex = _lexicon(spark)
    got = sorted((r.value, r.place, r.start, r.end, r.name, r.word, r.guesses) for r in lexical_matches(values, lex).collect())
    want = [(r.value, 0, r.start, r.end, r.dict_name, None, r.guesses) for r in dictionary_matches(values, lex).collect()]
    want += [(r.value, 1, r.start, r.end, r.source, None, r.guesses) for r in spanish_matches(values, lex, only_es=False).collect()]
    want += [(r.value, 2, r.start, r.end, r.dict_name, r.deleeted, r.guesses) for r in leet_matches(values, lex).collect()]
    key = lambda x: tuple("" if y is None else str(y) for y in x)
    plain = [(v, p, s, e, n, w, g) for v in VALUES for p, s, e, n, w, g in _lexical(v)]
    assert sorted(got, key=key) == sorted(want, key=key) == sorted(plain, key=key)


def test_scores_equal_the_best_of_all_covers(spark):
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    own = {r.value: r.ms for r in values.select("value", detect_all(F.col("value")).alias("ms")).collect()}
    got = {r.value: r for r in scored(values, _lexicon(spark)).collect()}
    assert len(got) == len(VALUES)
    for v in VALUES:
        r, size = got[v], max(_alphabet(v), 1)
        spans = [(s, e, g) for _, s, e, _, _, g in _lexical(v)] + [(m.start, m.end, m.guesses) for m in own[v]]
        best, product = _best(v, tuple(spans), size), math.prod(int(x.guesses) for x in r.segments)
        assert product == best and "".join(x.token for x in r.segments) == v
        total = min(best * math.factorial(len(r.segments)), size ** len(v)) if v else 1
        assert int(r.guesses) == total and abs(r.guess_bits - math.log2(total)) < 1e-9
        assert r.score == sum(math.log2(total) >= t for t in THRESHOLDS) and r.score_label == LABELS[r.score]


def test_gates_hide_no_match(spark):
    from credlens.operators.detectors import DETECTORS

    values = spark.createDataFrame([(v,) for v in [*VALUES, "zyx", "987", "ñlk", "ÁBC", "αβγ", "20٠٤", "31121999", "asd", "mnb"]], "value string")
    every = F.concat(*[f(F.col("value")) for f in DETECTORS.values()])
    for r in values.select(detect_all(F.col("value")).alias("a"), every.alias("b")).collect():
        assert r.a == r.b


def test_reports_name_lists_sources_and_plain_words(spark):
    values = spark.createDataFrame([("holaXk",), ("p3dr0",), ("realmadrid",)], "value string")
    lex = spark.createDataFrame([("palabras_es", "hola", 0), ("otros", "pedro", 1)], "dict_name string, word string, rank int")
    done = report.evaluate(values, lex)
    text = {r.value: r.report for r in report.render(done).collect()}
    assert '[palabras_es: "hola"] + [bruteforce: ●● (2 chars)]' in text["holaXk"] and 'Coste dictionary "hola": 1' in text["holaXk"]
    assert '[leet→pedro: "p3dr0"]' in text["p3dr0"] and '[es:cultural: "realmadrid"]' in text["realmadrid"]
    docs = report.to_json(done).collect()
    assert all(v not in str(r) for r in docs for v in ("holaXk", "p3dr0", "pedro")) and len({r.value_sha256 for r in docs}) == 3
    one = [json.loads(r.json) for r in docs]
    assert all(x["breach_status"] == "skipped" and x["segments"] for x in one)


def test_calibrated_scores(spark):
    values = spark.createDataFrame([("casa",)], "value string")
    often = spark.createDataFrame([("casa", 5), ("hola", 995)], "token string, freq long")
    assert scored(values, _lexicon(spark), often).first().guesses == "200"
    assert sorted(m.guesses for m in lexical_spans(values, _lexicon(spark)).first().before) == [2, 2, CULTURAL.index("casa")]
