"""Lookups of substrings in ranked word lists, by a trie or by joins; optional calibration by observed frequencies."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import deleet, is_leet, substitutions
from ..sources.lexicon import PRIORITY, cultural_terms
from .automaton import Sieve, sieve_of, sieved, word_lists, word_places

LEAST = 3
#: Words, and characters of the longest, up to which those that occur are sent to the executors: some 100 MB. More are joined by shuffles.
BROADCAST_WORDS, LONGEST = 500_000, 64
#: Words up to which all come to the driver; of more only those that occur, and what lists say of them up to so many for each word.
FEW, LISTS = 20_000, 4


class Met(NamedTuple):
    """Words that occur in some values, or None if they are too many; what lets them through; whether words are left out that don't occur."""

    words: pa.Array | None
    sieve: Sieve | None
    fewer: bool


def _sent(words: DataFrame) -> pa.Array | None:
    """Words (gram) as the driver gets them, or None if their number or length doesn't allow it."""
    got = words.limit(BROADCAST_WORDS + 1).toArrow()["gram"].combine_chunks()
    return got if len(got) <= BROADCAST_WORDS and max(map(len, got.to_pylist()), default=0) <= LONGEST else None


def met(values: DataFrame, listed: DataFrame, forms: dict[str, str]) -> Met:
    """Which of the distinct words (gram) occur in forms of values, of large lists at least: a sieve of all words finds substrings that may be among them, and the distinct ones are joined with them."""
    longest, n = listed.agg(F.coalesce(F.max(F.length("gram")), F.lit(0)), F.count(F.lit(1))).first()
    if n <= min(FEW, BROADCAST_WORDS) and longest <= LONGEST:
        return Met(_sent(listed), None, False)
    sieve = sieve_of(listed, n, longest)
    words = _sent(sieved(values, sieve, forms, LEAST).join(listed, "gram", "left_semi"))
    return Met(words, sieve, words is None or len(words) < n)


def _among(rows: DataFrame, column: str, words: Met) -> DataFrame:
    """Rows of lists whose word occurs."""
    if not words.fewer or words.words is None:
        return rows
    kept = rows.sparkSession.createDataFrame(pa.table({column: words.words}))
    return rows.join(F.broadcast(kept), column, "left_semi")


def found(values: DataFrame, words: DataFrame, form: Column | None = None) -> DataFrame:
    """values with start, end and gram of each substring of at least LEAST characters that is among words (gram, ...), joined with them. Words that occur are looked up by a trie sent to the executors if their checked number and length allow it; more are met by a shuffle of the substrings that a sieve lets through."""
    made, forms = values.withColumn("__form", F.lower("value") if form is None else form), {"form": "__form"}
    known = met(made, words.select("gram").where("gram is not null").distinct(), forms)
    if known.words is None:
        return word_places(made, known.sieve, forms, LEAST).drop("form").join(words, "gram")
    return word_places(made, known.words.to_pylist(), forms, LEAST).drop("form").join(F.broadcast(_among(words, "gram", known)), "gram")


def _token() -> Column:
    return F.substring("value", F.col("start") + 1, F.col("end") - F.col("start"))


def dictionary_matches(values: DataFrame, lexicon: DataFrame) -> DataFrame:
    """values x (start, end, token, dict_name, rank, guesses): one row for each word list that holds a substring. The lexicon is broadcast if its checked size allows it."""
    hits = found(values, lexicon.select(F.col("word").alias("gram"), "dict_name", "rank"))
    return hits.withColumn("token", _token()).withColumn("guesses", F.greatest("rank", F.lit(1)).cast("long")).drop("gram")


def spanish_matches(values: DataFrame, lexicon: DataFrame, only_es: bool = True) -> DataFrame:
    """values x (start, end, token, source, rank, guesses) of regional terms and of word lists, by default those whose name ends with _es."""
    lists = lexicon.where(F.col("dict_name").endswith("_es")) if only_es else lexicon
    terms = cultural_terms(values.sparkSession).select(F.lit("cultural").alias("source"), "word", "rank").unionByName(lists.select(F.col("dict_name").alias("source"), "word", "rank"))
    hits = found(values, terms.select(F.col("word").alias("gram"), "source", "rank"))
    return hits.withColumn("token", _token()).withColumn("guesses", F.greatest("rank", F.lit(1)).cast("long")).drop("gram")


def leet_matches(values: DataFrame, lexicon: DataFrame) -> DataFrame:
    """values x (start, end, token, deleeted, dict_name, rank, substitutions, guesses): substrings with a substitution character whose plain form is a word, each with the first word list by priority."""
    first = lexicon.groupBy(F.col("word").alias("gram")).agg(F.min(F.struct(_place().alias("place"), "dict_name", "rank")).alias("hit"))
    met = found(values, first, deleet(F.col("value"))).withColumn("token", _token())
    met = met.where(is_leet(F.col("token"))).withColumn("substitutions", substitutions(F.col("token")))
    hits = met.select(*values.columns, "start", "end", "token", "substitutions", F.col("gram").alias("deleeted"), "hit.dict_name", "hit.rank")
    return hits.withColumn("guesses", (F.col("rank") * F.pow(F.lit(2.0), F.col("substitutions"))).cast("long"))


def _place() -> Column:
    """A word list's place among those that come first in substitution lookups."""
    return F.coalesce(F.try_element_at(F.map_from_arrays(F.array(*[F.lit(d) for d in PRIORITY]), F.array(*[F.lit(i) for i in range(len(PRIORITY))])), F.col("dict_name")), F.lit(len(PRIORITY)))


_FORMS = {"0": "__low", "1": "__plain"}


def _made(values: DataFrame) -> DataFrame:
    return values.withColumn("__low", F.lower("value")).withColumn("__plain", deleet(F.col("value")))


def _met_in_lists(values: DataFrame, lexicon: DataFrame) -> Met:
    words = lexicon.select(F.col("word").alias("gram")).unionByName(cultural_terms(values.sparkSession).select(F.col("word").alias("gram")))
    return met(_made(values), words.where("gram is not null").distinct(), _FORMS)


def _entries(lexicon: DataFrame) -> DataFrame:
    """form, gram, place, name, rank: what the lists say of a word as it is (form 0; place 0 dictionary, 1 spanish) and as a plain form (1; place 2 leet)."""
    as_is = lambda x, name: F.struct(F.lit(0).alias("form"), F.lit(x).alias("place"), name.alias("name"), F.col("rank").cast("int").alias("rank"))
    lists = lexicon.select(F.col("word").alias("gram"), F.inline(F.array(as_is(0, F.col("dict_name")), as_is(1, F.col("dict_name")))))
    regional = cultural_terms(lexicon.sparkSession).select(F.col("word").alias("gram"), F.lit(0).alias("form"), F.lit(1).alias("place"), F.lit("cultural").alias("name"), F.col("rank").cast("int").alias("rank"))
    first = lexicon.groupBy(F.col("word").alias("gram")).agg(F.min(F.struct(_place().alias("at"), "dict_name", "rank")).alias("hit"))
    plain = first.select("gram", F.lit(1).alias("form"), F.lit(2).alias("place"), F.col("hit.dict_name").alias("name"), F.col("hit.rank").cast("int").alias("rank"))
    return lists.unionByName(regional).unionByName(plain).select("form", "gram", "place", "name", "rank")


def _type(place: Column) -> Column:
    return F.when(place == 0, "dictionary").when(place == 1, "spanish").otherwise("leet")


def _guesses(place: Column, rank: Column, as_is: Column) -> Column:
    return F.when(place == 2, (rank * F.pow(F.lit(2.0), substitutions(as_is))).cast("long")).otherwise(F.greatest(rank, F.lit(1)).cast("long"))


def _part(low: Column, start: Column, end: Column) -> Column:
    return F.substring(low, start + 1, end - start)


def lexical_matches(values: DataFrame, lexicon: DataFrame, words: Met | None = None) -> DataFrame:
    """value, place (0 dictionary, 1 spanish, 2 leet), type, start, end, name, word, guesses: all three lookups with one walk. A substring is looked up as it is, and by its plain form if that differs, which it does if it has a substitution character."""
    values = values.select("value")
    words = words or _met_in_lists(values, lexicon)
    entries = _entries(_among(lexicon, "word", words))
    known = entries.groupBy("form", "gram").agg(F.collect_list(F.struct("place", "name", "rank")).alias("xs"))
    places = word_places(_made(values), words.sieve if words.words is None else words.words.to_pylist(), _FORMS, LEAST)
    kept = places.withColumn("form", F.col("form").cast("int")).withColumn("as_is", _part(F.lower("value"), F.col("start"), F.col("end"))).where("form = 0 or gram <> as_is")
    hits = kept.join(known if words.words is None else F.broadcast(known), ["form", "gram"]).select("value", "start", "end", "as_is", "gram", F.inline("xs"))
    place = F.col("place")
    return hits.select("value", "place", _type(place).alias("type"), "start", "end", "name", F.when(place == 2, F.col("gram")).alias("word"), _guesses(place, F.col("rank"), F.col("as_is")).alias("guesses"))


def with_lexical_matches(values: DataFrame, lexicon: DataFrame) -> DataFrame:
    """values with every: their matches of lexical_matches as an array of (place, start, end, name, type, guesses, word), sorted. Rows stay where they are if the words that occur can be sent to them; otherwise matches are gathered by value."""
    words = _met_in_lists(values, lexicon)
    most = LISTS * BROADCAST_WORDS
    entries = None if words.words is None else _entries(_among(lexicon, "word", words)).limit(most + 1).toArrow()
    if entries is None or len(entries) > most:
        span = F.struct("place", "start", "end", "name", "type", "guesses", "word")
        listed = lexical_matches(values, lexicon, words).groupBy("value").agg(F.array_sort(F.collect_list(span)).alias("every"))
        return values.join(listed, "value", "left")
    low = F.lower("value")
    placed = word_lists(_made(values), entries, list(_FORMS.values()), LEAST)
    as_is = lambda x: _part(low, x["start"], x["end"])
    one = lambda x: F.struct(x["place"].alias("place"), x["start"].alias("start"), x["end"].alias("end"), x["name"].alias("name"), _type(x["place"]).alias("type"), _guesses(x["place"], x["rank"], as_is(x)).alias("guesses"), F.when(x["place"] == 2, x["gram"]).alias("word"))
    kept = F.filter("hits", lambda x: (x["place"] < 2) | (x["gram"] != as_is(x)))
    return placed.select(*[F.col(f"`{c}`") for c in values.columns], F.array_sort(F.transform(kept, one)).alias("every"))


def calibrated(matches: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Matches whose guesses are the tokens' total over the frequency of their token, if it has one: (token, freq)."""
    total = frequencies.agg(F.coalesce(F.sum("freq"), F.lit(1)).alias("total_freq"))
    known = frequencies.where("freq > 0").select(F.col("token").alias("known"), "freq")
    joined = matches.join(known, F.lower(matches["token"]) == F.col("known"), "left").crossJoin(F.broadcast(total))
    new = F.greatest(F.expr("total_freq div freq"), F.lit(1))
    return joined.withColumn("guesses", F.when(F.col("freq").isNotNull(), new).otherwise(F.col("guesses"))).withColumn("calibrated", F.col("freq").isNotNull()).withColumnRenamed("freq", "empirical_freq").drop("known", "total_freq")


def deleetified(values: DataFrame) -> DataFrame:
    """value, token: whole values with a substitution character whose plain form has 3 to 64 letters and nothing else."""
    return values.withColumn("token", deleet(F.col("value"))).where(is_leet(F.col("value")) & F.col("token").rlike(r"^\p{L}{3,64}$"))
