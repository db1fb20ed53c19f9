"""Detectors of dates, keyboard runs, repetitions and sequences: string columns to arrays of matches.

A detector is a function of a string column that returns an array of MATCH structs, in code points, end
exclusive. DETECTORS is the registry; further detectors are added to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import full_year, is_ascii_digits

META = ("format string", "year int", "month int", "day int", "length int", "direction string", "row int", "keys_in_row int", "kind string", "base string", "period int", "count int", "cost_base long")
MATCH = "array<struct<type:string,start:int,end:int,token:string,guesses:long," + ",".join(m.replace(" ", ":") for m in META) + ">>"
#: Guesses for a full date and a year, and keyboard rows.
FULL_DATE, YEAR = 73_000, 200
ROWS = ("1234567890", "qwertyuiop", "asdfghjklñ", "zxcvbnm")


def _match(match_type: str, start: Column, end: Column, token: Column, guesses: Column, **meta: Column) -> Column:
    fields = [F.lit(match_type).alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), token.alias("token"), guesses.cast("long").alias("guesses")]
    for m in META:
        name, t = m.split()
        fields.append(meta.get(name, F.lit(None)).cast(t).alias(name))
    return F.struct(*fields)


def regex_spans(s: Column, pattern: str) -> Column:
    """array<struct<start, token>> of non-overlapping matches: the texts between them give their places. Most strings have none, which one search tells."""
    tokens = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    gaps = F.split(s, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,token:string>>").alias("out"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(tokens)), tokens, lambda g, t: F.struct(F.length(g).alias("g"), t.alias("t")))
    done = F.aggregate(pairs, start, lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["t"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("start"), x["t"].alias("token")))).alias("out")))
    return F.when(s.rlike(pattern), done["out"]).otherwise(F.array().cast("array<struct<start:int,token:string>>"))


def _windows(s: Column, size: int) -> Column:
    """Every window of ASCII digits, with its start."""
    starts = F.when(F.length(s) >= size, F.sequence(F.lit(0), F.length(s) - size)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(s, i + 1, size).alias("w"))), lambda x: is_ascii_digits(x["w"]))


def _valid(y: Column, m: Column, d: Column) -> Column:
    """Whether a calendar date exists, for years from 1 on."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= most)


def date_iso(s: Column) -> Column:
    found = regex_spans(s, r"(?:19|20)\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{2}")
    part = lambda x, at, n: F.substring(x["token"], at, n).try_cast("int")
    dated = F.filter(found, lambda x: _valid(part(x, 1, 4), part(x, 6, 2), part(x, 9, 2)))
    return F.transform(dated, lambda x: _match("date", x["start"], x["start"] + 10, x["token"], F.lit(FULL_DATE), format=F.lit("YYYY-MM-DD"), year=part(x, 1, 4), month=part(x, 6, 2), day=part(x, 9, 2)))


def date_years(s: Column) -> Column:
    return F.transform(regex_spans(s, r"(?:19|20)\p{Nd}{2}"), lambda x: _match("date", x["start"], x["start"] + 4, x["token"], F.lit(YEAR), format=F.lit("YYYY"), year=x["token"].try_cast("int")))


def date_8(s: Column) -> Column:
    def one(x: Column, day: int, month: int, name: str) -> Column:
        num = lambda at, n: F.substring(x["w"], at, n).cast("int")
        y, m, d = num(5, 4), num(month, 2), num(day, 2)
        return F.when(y.between(1900, 2099) & _valid(y, m, d), _match("date", x["start"], x["start"] + 8, x["w"], F.lit(FULL_DATE), format=F.lit(name), year=y, month=m, day=d))

    both = F.transform(_windows(s, 8), lambda x: F.array(one(x, 1, 3, "DDMMYYYY"), one(x, 3, 1, "MMDDYYYY")))
    return F.array_compact(F.flatten(both))


def date_6(s: Column) -> Column:
    def one(x: Column) -> Column:
        num = lambda at: F.substring(x["w"], at, 2).cast("int")
        y = full_year(num(5))
        return F.when(_valid(y, num(3), num(1)), _match("date", x["start"], x["start"] + 6, x["w"], F.lit(FULL_DATE), format=F.lit("DDMMYY"), year=y, month=num(3), day=num(1)))

    return F.array_compact(F.transform(_windows(s, 6), one))


def dates(s: Column) -> Column:
    return F.concat(date_iso(s), date_years(s), date_8(s), date_6(s))


def _runs(codes: Column) -> Column:
    """array<struct<start, end, delta>> of greedy runs over array<struct<cls, ord>>: at least three, one class (0: none), steps of +1 or -1. A run of two gives way to one that starts at its second character; after a longer one the scan goes on behind it."""
    run = "array<struct<start:int,end:int,delta:int>>"
    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("cls"), F.lit(0).alias("ord"), F.lit(0).alias("from"), F.lit(0).alias("delta"), F.array().cast(run).alias("out"))

    def step(a: Column, x: Column) -> Column:
        diff = x["ord"] - a["ord"]
        here = F.when((x["cls"] != 0) & (x["cls"] == a["cls"]) & (F.abs(diff) == 1) & (a["i"] > 0), diff).otherwise(0)
        goes_on = (a["delta"] != 0) & (here == a["delta"])
        ends = (a["delta"] != 0) & (here != a["delta"]) & (a["i"] - a["from"] >= 3)
        return F.struct(
            (a["i"] + 1).alias("i"), x["cls"].alias("cls"), x["ord"].alias("ord"),
            F.when(goes_on, a["from"]).otherwise(a["i"] - 1).alias("from"),
            F.when(goes_on, a["delta"]).when(ends, 0).otherwise(here).alias("delta"),
            F.when(ends, F.concat(a["out"], F.array(F.struct(a["from"].alias("start"), a["i"].alias("end"), a["delta"].alias("delta"))))).otherwise(a["out"]).alias("out"),
        )

    def finish(a: Column) -> Column:
        last = F.array(F.struct(a["from"].alias("start"), a["i"].alias("end"), a["delta"].alias("delta")))
        return F.when((a["delta"] != 0) & (a["i"] - a["from"] >= 3), F.concat(a["out"], last)).otherwise(a["out"])

    return F.aggregate(codes, first, step, finish)


def _slice(s: Column, r: Column) -> Column:
    return F.substring(s, r["start"] + 1, r["end"] - r["start"])


def keyboard(s: Column) -> Column:
    def code(c: Column) -> Column:
        cls, at = F.lit(0), F.lit(0)
        for i, row in enumerate(ROWS):
            place = F.instr(F.lit(row), c)
            cls, at = F.when(place > 0, i + 1).otherwise(cls), F.when(place > 0, place).otherwise(at)
        return F.struct(cls.alias("cls"), at.alias("ord"))

    def match(r: Column) -> Column:
        n = r["end"] - r["start"]
        row = F.element_at(F.filter(F.array(*[F.when(F.instr(F.lit(x), F.substring(F.lower(s), r["start"] + 1, 1)) > 0, F.lit(i)) for i, x in enumerate(ROWS)]), lambda x: x.isNotNull()), 1)
        keys = F.element_at(F.array(*[F.lit(len(x)) for x in ROWS]), row + 1)
        return _match("keyboard", r["start"], r["end"], _slice(s, r), n * 2 * keys, length=n, direction=F.when(r["delta"] == 1, "right").otherwise("left"), row=row, keys_in_row=keys)

    return F.transform(_runs(F.transform(F.split(F.lower(s), ""), code)), match)


def sequences(s: Column) -> Column:
    def code(c: Column) -> Column:
        return F.struct(F.when(c.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]$"), 1).when(c.rlike(r"^\p{L}$"), 2).otherwise(0).alias("cls"), F.ascii(c).alias("ord"))

    def match(r: Column) -> Column:
        n = r["end"] - r["start"]
        numeric = F.substring(s, r["start"] + 1, 1).rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]$")
        return _match("sequence", r["start"], r["end"], _slice(s, r), n * 4, length=n, direction=F.when(r["delta"] == 1, "asc").otherwise("desc"), kind=F.when(numeric, "numeric").otherwise("alphabetic"))

    return F.transform(_runs(F.transform(F.split(F.lower(s), ""), code)), match)


def repetition_single(s: Column) -> Column:
    def match(x: Column) -> Column:
        n, base = F.length(x["token"]), F.substring(s, x["start"] + 1, 1)
        size = F.when(base.rlike(r"^\p{Nd}$"), 10).when(base.rlike("^[a-zA-Z]$"), 26).otherwise(33)
        return _match("repetition", x["start"], x["start"] + n, F.substring(s, x["start"] + 1, n), size * n, kind=F.lit("single"), base=base, count=n, cost_base=size)

    return F.transform(regex_spans(F.lower(s), r"(?s)(.)\1{2,}"), match)


def _alphabet(base: Column) -> Column:
    n = F.when(base.rlike("[a-z]"), 26).otherwise(0) + F.when(base.rlike("[A-Z]"), 26).otherwise(0) + F.when(base.rlike(r"\p{Nd}"), 10).otherwise(0) + F.when(base.rlike(r"[^\p{L}\p{Nd}]"), 33).otherwise(0)
    return F.greatest(n, F.lit(1)).cast("long")


def repetition_period(s: Column) -> Column:
    def of(period: int) -> Column:
        def match(x: Column) -> Column:
            n, base = F.length(x["token"]), F.substring(s, x["start"] + 1, period)
            cost = _alphabet(base)
            power = cost
            for _ in range(period - 1):
                power = power * cost
            return _match("repetition", x["start"], x["start"] + n, F.substring(s, x["start"] + 1, n), power * (n / period).cast("long"), kind=F.lit("period"), base=base, period=F.lit(period), count=n / period, cost_base=power)

        return F.transform(regex_spans(F.lower(s), rf"(?s)(.{{{period}}})\1+"), match)

    return F.concat(of(2), of(3), of(4))


def repetitions(s: Column) -> Column:
    return F.concat(repetition_single(s), repetition_period(s))


#: In the order in which the model sees their matches.
DETECTORS: dict[str, Callable[[Column], Column]] = {"date": dates, "keyboard": keyboard, "repetition": repetitions, "sequence": sequences}


def _neighbours(rows: tuple[str, ...]) -> str:
    """A pattern of any three characters that follow each other in a row, in either direction."""
    threes = [r[i : i + 3] for row in rows for r in (row, row[::-1]) for i in range(len(row) - 2)]
    return "|".join(threes)


#: Strings without these have no match of the detector; any other string may have one.
GATES: dict[str, Callable[[Column], Column]] = {
    "date": lambda s: s.rlike(r"[0-9]{6}|(?:19|20)\p{Nd}{2}"),
    "keyboard": lambda s: F.lower(s).rlike(_neighbours(ROWS)),
    "sequence": lambda s: F.lower(s).rlike(r"[^\x00-\x7F]|" + _neighbours(("0123456789", "abcdefghijklmnopqrstuvwxyz"))),
}


def detect_all(s: Column) -> Column:
    """All detectors, each only where its gate is open."""
    none = F.array().cast(MATCH)
    return F.concat(*[F.when(GATES[name](s), f(s).cast(MATCH)).otherwise(none) if name in GATES else f(s) for name, f in DETECTORS.items()])


#: What matches of further detectors count as in pattern statistics.
SHOWN: dict[str, Callable[[Column], Column]] = {}


def register(name: str, detector: Callable[[Column], Column], gate: Callable[[Column], Column] | None = None, shown: Callable[[Column], Column] | None = None) -> None:
    """Adds a detector: from then on profiles, the scoring model and views of matches use it. It gives an array of matches (see found_by) of type `name`; gate tells cheaply where it may find something; shown is its pattern in statistics, which must hold no text of the input (by default the length)."""
    if name in DETECTORS:
        raise ValueError(f"there is a detector {name!r} already")
    DETECTORS[name] = detector
    if gate is not None:
        GATES[name] = gate
    SHOWN[name] = shown or (lambda m: F.concat(F.lit("len="), (m["end"] - m["start"]).cast("string")))


def unregister(name: str) -> None:
    for held in (DETECTORS, GATES, SHOWN):
        held.pop(name, None)


def found_by(name: str, pattern: str, guesses: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A detector of the non-overlapping matches of a regular expression; guesses of the matched text."""
    return lambda s: F.transform(regex_spans(s, pattern), lambda x: _match(name, x["start"], x["start"] + F.length(x["token"]), x["token"], guesses(x["token"])))


def matches_view(values: DataFrame, name: str) -> DataFrame:
    """values with a row for each match of any detector, also as a view for SQL."""
    made = values.select("*", F.inline(detect_all(F.col("value"))))
    made.createOrReplaceTempView(name)
    return made


def pattern_repr(m: Column) -> Column:
    """What a match counts as in pattern statistics; holds no text of the input."""
    n = F.concat(F.lit("len="), m["length"].cast("string"), F.lit(";dir="), m["direction"])
    return (
        F.when(m["type"] == "date", F.concat(F.lit("format="), m["format"]))
        .when(m["type"] == "keyboard", n)
        .when(m["type"] == "sequence", F.concat(n, F.lit(";kind="), m["kind"]))
        .when(m["type"] == "repetition", F.concat(F.lit("kind="), m["kind"], F.lit(";count="), m["count"].cast("string")))
        .otherwise(F.coalesce(*[F.when(m["type"] == name, f(m)) for name, f in SHOWN.items()], F.lit(None).cast("string")))
    )
