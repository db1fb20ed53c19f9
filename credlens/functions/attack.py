"""Attack times and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Guesses per second of each scenario.
SCENARIOS = {"online_throttled": 1e1, "cpu_sha1": 1e7, "gpu_consumer_sha1": 1e10, "gpu_rig_sha1": 1e11, "argon2id_modern": 1e1}
#: Units in seconds, with singular and plural.
UNITS = ((1, "segundo", "segundos"), (60, "minuto", "minutos"), (3_600, "hora", "horas"), (86_400, "día", "días"), (31_536_000, "año", "años"))
MILLENNIUM = 31_536_000_000


def attack_seconds(guesses: Column, scenario: str) -> Column:
    """Mean time: half the guesses at the scenario's rate. Unknown scenarios raise KeyError."""
    return guesses.cast("double") / (2 * SCENARIOS[scenario])


def format_time(seconds: Column) -> Column:
    out = F.when(seconds < 1e-6, "< 1 μs").when(seconds < 1e-3, "< 1 ms").when(seconds < 1, "< 1 segundo")
    tops = [u[0] for u in UNITS[1:]] + [MILLENNIUM]
    for (size, one, many), top in zip(UNITS, tops, strict=True):
        n = F.floor(seconds / size).cast("long")
        out = out.when(seconds < top, F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}")))
    return out.otherwise("> 1.000 años")


def attack_times(guesses: Column) -> Column:
    """Map of each scenario to its time as text."""
    return F.create_map(*[c for name in SCENARIOS for c in (F.lit(name), format_time(attack_seconds(guesses, name)))])


def format_duration(seconds: Column) -> Column:
    """45s, 1m30s, 2h02m."""
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), two(F.floor(seconds % 60)), F.lit("s")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"), two(F.floor(seconds % 3600 / 60)), F.lit("m")))
    )
