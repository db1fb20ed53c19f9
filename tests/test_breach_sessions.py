"""Breach ranges: outages, caches and consent; calibration of the matches that it is for."""

import os

from pyspark.sql import functions as F

from credlens.operators.breach import BreachSession, RangeCache, digest, failures, fetch_ranges, lookup, parse_ranges
from credlens.operators.decompose import scored
from credlens.plans.report import evaluate, render


def _provider(log, known, down=()):
    def fetch(prefix):
        with open(log, "a") as f:
            f.write(prefix + "\n")
        if prefix in down:
            raise OSError("down")
        return "\r\n".join(f"{d[5:]}:{n}" for d, n in known.items() if d.startswith(prefix)) + "\r\n" + "0" * 35 + ":0"

    return fetch


def _digests(spark, values):
    return dict(spark.createDataFrame([(v,) for v in values], "value string").select("value", digest(F.col("value"))).collect())


def test_an_outage_is_an_error_and_nothing_else(spark, tmp_path):
    values = spark.createDataFrame([("abc",), ("def",), ("ghi",)], "value string")
    d = _digests(spark, ["abc", "def", "ghi"])
    bodies = fetch_ranges(values, _provider(tmp_path / "log", {d["abc"]: 7}, {d["def"][:5]}))
    got = {r.value: (r.status, r.breach_count) for r in lookup(values, parse_ranges(bodies), failures(bodies)).collect()}
    assert got == {"abc": ("found", 7), "def": ("error", 0), "ghi": ("not_found", 0)}


def test_a_session_fetches_each_fresh_range_once_and_only_with_consent(spark, tmp_path):
    values = spark.createDataFrame([("abc",), ("abc",), ("def",), ("ghi",)], "value string")
    d, log, folder = _digests(spark, ["abc", "def", "ghi"]), str(tmp_path / "log"), str(tmp_path / "ranges")
    down = {d["def"][:5]}
    session = lambda consent=True, age=1e6, down=(): BreachSession(RangeCache(spark, folder, age), _provider(log, {d["abc"]: 7}, down), consent)
    seen = lambda s: {r.value: r.status for r in s.lookup(values).collect()}
    assert set(seen(session(consent=False)).values()) == {"skipped"} and not os.path.exists(log) and not os.path.exists(folder)
    first = session(down=down)
    assert seen(first) == {"abc": "found", "def": "error", "ghi": "not_found"} and first.fetched == 3
    assert len(open(log).readlines()) == 3
    second = session()  # the failed range alone is tried again
    assert seen(second)["def"] == "not_found" and second.fetched == 1
    third = session(down=set(x[:5] for x in d.values()))
    assert seen(third) == {"abc": "found", "def": "not_found", "ghi": "not_found"} and third.fetched == 0 and len(open(log).readlines()) == 4
    old = session(age=-1.0, down=down)
    assert seen(old)["def"] == "error" and old.fetched == 3


def test_reports_name_the_outage(spark, tmp_path):
    lexicon = spark.createDataFrame([("palabras_es", "hola", 0)], "dict_name string, word string, rank int")
    values = spark.createDataFrame([("hola",)], "value string")
    prefix = _digests(spark, ["hola"])["hola"][:5]
    down = BreachSession(RangeCache(spark, str(tmp_path / "r")), _provider(str(tmp_path / "log"), {}, {prefix}), True)
    row = render(evaluate(values, lexicon, down)).first()
    assert row.status == "error" and "error de red (omitida)" in row.report and row.risk_explanation != "" and "filtraciones" not in row.risk_explanation


def test_calibration_leaves_leet_matches_alone(spark):
    lexicon = spark.createDataFrame([("palabras_es", "hola", 6)], "dict_name string, word string, rank int")
    known = spark.createDataFrame([("h0la", 2), ("hola", 4), ("x", 94)], "token string, freq long")
    values = spark.createDataFrame([("h0la",), ("hola",)], "value string")
    plain, fitted = ({r.value: r.guesses for r in scored(values, lexicon, k).collect()} for k in (None, known))
    assert plain == {"h0la": "12", "hola": "6"} and fitted == {"h0la": "12", "hola": "25"}
