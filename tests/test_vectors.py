"""Known inputs and results of single operators."""

import math
import re

import pytest
from pyspark.sql import functions as F

from credlens.functions import features as f
from credlens.functions.attack import attack_seconds, format_duration, format_time
from credlens.operators import detectors as det
from credlens.operators import lexical
from credlens.operators.breach import digest, fetch_ranges, lookup, parse_ranges
from credlens.operators.decompose import bits_of, estimate, least_cost, scored
from credlens.plans import monitor, report, summary
from credlens.queries import PIECE, utf8_decode
from credlens.sources.corpus import line_counts, read_lines, valid_lines
from credlens.sources.lexicon import build_lexicon, coverage, cultural_terms, read_lexicons, write_lexicon


def values(spark, *vs):
    return spark.createDataFrame([(v,) for v in vs], "value string")


def column(spark, expr, *vs):
    rows = spark.createDataFrame(list(enumerate(vs)), "i int, value string").select("i", expr.alias("x")).collect()
    return [r.x for r in sorted(rows)]


def found(spark, detector, v):
    m = values(spark, v).select(F.explode(detector(F.col("value"))).alias("m")).select("m.*")
    return [r.asDict() for r in m.collect()]


def lex(spark, **lists):
    return spark.createDataFrame([(d, w, r) for d, ws in lists.items() for w, r in ws.items()], "dict_name string, word string, rank int")


def test_masks_sizes_and_bits(spark):
    mask = f.charset_mask(F.col("value"))
    assert column(spark, mask, "abcxyz", "ABC", "123", "!@#$%^&*()", "ñáéíóú", "aA1!", "aA1!ñ", "\t", "a\t", " ") == [1, 2, 4, 8, 16, 15, 31, 0, 1, 8]
    assert column(spark, f.charset_size(mask), "aA1!ñ", "aA1", "a1", "\t") == [195, 62, 36, 0]
    assert column(spark, f.charset_bits(F.length("value"), f.charset_size(mask)), "P@ssw0rd", "\t", "") == pytest.approx([8 * math.log2(95), 0, 0])
    assert column(spark, F.array_join(f.composition(mask), "+"), "aA1") == ["minúsculas+mayúsculas+dígitos"]


def test_entropy_and_buckets(spark):
    assert column(spark, f.shannon_per_char(F.col("value")), "", "a", "ab", "abcd", "aaaabbbb", "password") == pytest.approx([0, 0, 1, 2, 1, 2.75])
    assert column(spark, f.entropy_bucket(F.col("value").cast("double")), "0.4", "0.5", "0.99", "13.249", "13.5", "-1", "1e9") == [0, 0.5, 0.5, 13, 13.5, 0, 99999]


def test_dates(spark):
    of = lambda v: [(m["format"], m["year"], m["month"], m["day"]) for m in found(spark, det.dates, v)]
    assert of("hola1985") == [("YYYY", 1985, None, None)]
    assert ("YYYY-MM-DD", 2024, 3, 15) in of("2024-03-15") and not any(x[0] == "YYYY-MM-DD" for x in of("2024-13-40"))
    assert {x[0] for x in of("12031985") if len(x[0]) == 8} == {"DDMMYYYY", "MMDDYYYY"}
    assert [x[0] for x in of("12311999") if len(x[0]) == 8] == ["MMDDYYYY"]
    assert ("DDMMYY", 1999, 12, 31) in of("311299") and ("DDMMYY", 2025, 1, 1) in of("010125") and not of("999999")
    assert of("aaa²²bb1989cc") == [("YYYY", 1989, None, None)]
    assert [m["token"] for m in found(spark, det.date_years, "1920201985")] == ["1920", "2019"]


def test_keyboard_and_sequences(spark):
    of = lambda v: [(m["token"], m["direction"], m["guesses"]) for m in found(spark, det.keyboard, v)]
    assert of("qwerty") == [("qwerty", "right", 120)] and of("0987")[0][1] == "left" and of("klñ") and not of("qaz") and not of("qw")
    seq = lambda v: [(m["token"], m["direction"], m["kind"]) for m in found(spark, det.sequences, v)]
    assert seq("abc") == [("abc", "asc", "alphabetic")] and seq("9876") == [("9876", "desc", "numeric")]
    assert [s[0] for s in seq("abc...123")] == ["abc", "123"] and not seq("a1b") and not seq("ace") and not seq("ab")
    assert [s[0] for s in seq("abcba")] == ["abc"] and [s[0] for s in seq("abacdeXYZ")] == ["cde", "XYZ"]


def test_repetitions(spark):
    one = lambda v: [(m["token"], m["count"], m["guesses"]) for m in found(spark, det.repetition_single, v)]
    assert one("aaaa") == [("aaaa", 4, 104)] and not one("aab") and [x[0] for x in one("aaabbb")] == ["aaa", "bbb"]
    two = lambda v: [(m["token"], m["base"], m["count"]) for m in found(spark, det.repetition_period, v)]
    assert two("abab") == [("abab", "ab", 2)] and two("xyzxyz") == [("xyzxyz", "xyz", 2)] and not two("abcd") and two("AaAa")[0][0] == "AaAa"
    assert ("aaaa", "aa", 2) in two("aaaa")


def test_lexical_matches(spark):
    words = lex(spark, otros={"a": 0, "ba": 1, "cba": 2, "hola": 5})
    got = lexical.dictionary_matches(values(spark, "xcbax", "HolaMundo"), words).select("token", "rank").collect()
    assert {tuple(r) for r in got} == {("cba", 2), ("Hola", 5)}
    cultural = lexical.spanish_matches(values(spark, "madrid2024", "RealMadrid", "tequiero!"), words).select("value", "source").distinct().collect()
    assert {r.value for r in cultural} == {"madrid2024", "RealMadrid", "tequiero!"}
    ranks = {r.word: r["rank"] for r in cultural_terms(spark).collect()}
    assert ranks["sevilla"] == 14 and ranks["valencia"] == 15 and len(ranks) == 46
    leet = lexical.leet_matches(values(spark, "p3dr0", "3l3ctr!c1d4d"), lex(spark, nombres_es={"pedro": 10}, palabras_es={"pedro": 999, "electricidad": 342})).collect()
    by = {r.value: r for r in leet}
    assert (by["p3dr0"].dict_name, by["p3dr0"]["rank"]) == ("palabras_es", 999)
    assert (by["3l3ctr!c1d4d"].substitutions, by["3l3ctr!c1d4d"].guesses) == (5, 10_944)
    assert {r.value: r.token for r in lexical.deleetified(values(spark, "h0la", "h0", "hola")).collect()} == {"h0la": "hola"}
    m = spark.createDataFrame([("x", "Hola", 7), ("x", "otra", 9)], "value string, token string, guesses long")
    cal = {r.token: r.guesses for r in lexical.calibrated(m, spark.createDataFrame([("hola", 4), ("y", 6)], "token string, freq long")).collect()}
    assert cal == {"Hola": 2, "otra": 9}


def test_least_cost_and_estimates():
    assert least_cost(6, 26, [])[0] == 26**6
    assert least_cost(6, 26, [(0, 6, 42)]) == (42, [0])
    assert least_cost(5, 26, [(0, 3, 1)])[0] == 676 and least_cost(5, 26, [(0, 3, 0)])[0] == 676
    assert least_cost(3, 26, [(0, 3, 999_999)])[0] == 26**3
    assert least_cost(6, 26, [(0, 4, 100), (2, 6, 100), (0, 6, 50)])[0] == 50
    assert estimate("abcdef", 26, [("d", i, i + 2, 2) for i in (0, 2, 4)])[0] == 48
    assert estimate("a" * 15, 26, [("d", i, i + 1, 5) for i in range(15)])[0] == 26**15
    assert estimate("Xk3#mQ!w2", 95, [])[0] == 95**9 and estimate("", 0, []) == (1, [])
    assert bits_of(1 << 2000) == 2000.0 and bits_of(1) == 0.0


def test_scores(spark):
    got = {r.value: r for r in scored(values(spark, "hola", "Xk3#mQ!w2", ""), lex(spark, palabras_es={"hola": 3})).collect()}
    assert (got["hola"].guesses, got["hola"].score, got["hola"].score_label) == ("3", 0, "Trivial")
    assert got["Xk3#mQ!w2"].guesses == str(95**9) and got["Xk3#mQ!w2"].score == 3 and got[""].score == 0


def test_times(spark):
    seconds = (1e-7, 1e-4, 0.5, 1, 45, 60, 3599, 3600, 86_400, 432_000, 5000 * 31_536_000)
    assert column(spark, format_time(F.col("value").cast("double")), *map(str, seconds)) == ["< 1 μs", "< 1 ms", "< 1 segundo", "1 segundo", "45 segundos", "1 minuto", "59 minutos", "1 hora", "1 día", "5 días", "> 1.000 años"]
    assert column(spark, attack_seconds(F.col("value"), "gpu_consumer_sha1"), "1e10") == [0.5]
    assert column(spark, format_duration(F.col("value").cast("double")), "45", "90", "3599", "3600", "7350") == ["45s", "1m30s", "59m59s", "1h00m", "2h02m"]
    with pytest.raises(KeyError):
        attack_seconds(F.lit(1), "nobody")


def test_summaries(spark):
    h = spark.createDataFrame([("shannon", 0.0, 100), ("shannon", 1.0, 100), ("shannon", 2.0, 100)], "entropy_type string, bucket_min double, count long")
    assert summary.entropy_summary(h).first().p90_shannon_entropy == pytest.approx(2.35)
    assert summary.entropy_summary(h.limit(0)).first().p50_shannon_entropy == 0.0
    n = summary.length_summary(spark.createDataFrame([(6, 100), (7, 200), (8, 400), (9, 200), (12, 100)], "length int, count long")).first()
    assert (n.sample_size, n.avg_length, n.median_length, n.min_length, n.max_length) == (1000, 8.2, 8, 6, 12)
    c = summary.charset_summary(spark.createDataFrame([(4, 200), (1, 100), (3, 50), (5, 600), (12, 50)], "charset_mask int, count long")).first()
    assert [float(x) for x in c] == [20, 15, 95, 5]


def test_breach(spark):
    v = values(spark, "password", "other", "padded")
    d = {r.value: r.d for r in v.select("value", digest(F.col("value")).alias("d")).collect()}
    bodies = {d["password"][:5]: f"{d['password'][5:].lower()}:12\r\nBAD\r\nAAA:x\r\n\r\n", d["padded"][:5]: f"{d['padded'][5:]}:0"}
    ranges = fetch_ranges(v, lambda p: bodies.get(p, ""))
    assert all(len(r.prefix) == 5 for r in ranges.collect())
    got = {r.value: (r.breach_count, r.status) for r in lookup(v, parse_ranges(ranges)).collect()}
    assert got == {"password": (12, "found"), "other": (0, "not_found"), "padded": (0, "not_found")}


def test_lines_are_split_and_decoded(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hola\r\nhola \n\xffabc\ncafe\xcc\x81\n\nx\ry\n")
    lines = read_lines(spark, str(tmp_path))
    assert [(r.value, r.had_invalid) for r in lines.collect()] == [("hola", False), ("hola ", False), ("�abc", True), ("café", False), ("", False), ("x\ry", False)]
    c = line_counts(lines).first()
    assert (c.lines_read, c.lines_valid, c.lines_invalid) == (6, 5, 1) and valid_lines(lines, 2).count() == 2


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "palabras_es.txt").write_text("# head\n Hola \n\nmundo\nhola\nadiós\n")
    assert [(r.dict_name, r.word, r["rank"]) for r in read_lexicons(spark, str(tmp_path)).orderBy("rank").collect()] == [("palabras_es", "hola", 0), ("palabras_es", "mundo", 1), ("palabras_es", "adiós", 2)]
    built = build_lexicon(spark.createDataFrame([("Uno",), ("dos",), ("no",), ("tres",)], "word string"), spark.createDataFrame([("dos", 9)], "word string, freq long"))
    assert [r.word for r in built.orderBy("rank").collect()] == ["dos", "tres", "uno"] and tuple(coverage(built).first()) == (1, 2)
    write_lexicon(built, str(tmp_path / "out"), ("made here",))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["# made here", "dos", "tres", "uno"]


def test_reports(spark):
    words = lex(spark, palabras_es={"hola": 3})
    text = report.render(report.evaluate(values(spark, "holaXk"), words)).first()
    assert "RIESGO: " in text.report and "●●" in text.report and "Xk" not in text.report
    doc = report.to_json(report.evaluate(values(spark, "holaXk", "x" * 129), words)).collect()
    assert len(doc) == 1 and "hola" not in doc[0].json


def test_progress(spark):
    rows = [("a", "running", 5000, "2024-01-01 00:00:00"), ("b", "running", 0, None), ("c", "completed", 9, None)]
    p = spark.createDataFrame(rows, "filename string, status string, lines_processed long, started string").withColumn("started_at", F.col("started").cast("timestamp_ntz"))
    got = {r.filename: (r.speed, r.eta) for r in monitor.speed_eta(p, "2024-01-01 00:01:40", 10_000).collect()}
    assert got == {"a": (50.0, "1m40s"), "b": (0.0, "—")}
    assert [r.filename for r in monitor.pending(p.select("filename"), p).collect()] == ["a", "b"]


def test_whole_pages_are_decoded(spark, tmp_path):
    pages = [*spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect(), (-1, "ñ" * 500 + "\r\n"), (-2, "a" * 149 + "\r\n" + "日" * 99), (-3, "�" + "a" * 300), (-4, ""), (-5, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = set()
    for k, html in pages:
        raw = (html or "").encode()
        for i in range(0, max(1, len(raw)), PIECE):
            text = raw[i : i + PIECE].decode(errors="replace")
            want.add((k, i // PIECE, re.sub(r"(?:\r\n|\n|\r)\Z", "", text), "�" in text) if html is not None else (k, 0, None, None))
    got = [tuple(r) for r in utf8_decode(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(r[3] or False for r in got) > 5
