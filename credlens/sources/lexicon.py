"""Ranked word lists: reading, building and writing; lookups join with them as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import is_word

#: Regional terms in their order; a repeated one counts at its last place.
CULTURAL = (
    "realmadrid", "barca", "barça", "atletico", "athletic", "betis", "valencia", "sevilla", "villarreal", "espanyol", "celta", "rayo",
    "madrid", "barcelona", "sevilla", "valencia", "zaragoza", "malaga", "bilbao", "granada", "murcia", "alicante", "cordoba", "vigo",
    "andalucia", "cataluna", "cataluña", "galicia", "euskadi",
    "tequiero", "miamor", "amor", "cariño", "carino", "vida", "casa", "familia", "amigos", "feliz", "navidad", "verano", "invierno",
    "españa", "espana", "hola", "futbol", "campeon", "campeón",
)
#: Dictionaries that come first in substitution lookups.
PRIORITY = ("palabras_es", "nombres_es", "apellidos_es", "toponimos_es")
SCHEMA = "dict_name string, word string, rank int"


def cultural_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, i) for w, i in {w: i for i, w in enumerate(CULTURAL)}.items()], "word string, rank int")


def read_lexicons(spark: SparkSession, path: str) -> DataFrame:
    """Words of all *.txt under path: stripped, lower-cased, without blanks and # comments; the first of equals counts; ranks from 0 without gaps."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("dict_name"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    words = files.select("dict_name", "pos", F.lower(F.regexp_replace("line", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("word")).where("word <> '' and not startswith(word, '#')")
    first = words.groupBy("dict_name", "word").agg(F.min("pos").alias("pos"))
    return first.select("dict_name", "word", (F.row_number().over(Window.partitionBy("dict_name").orderBy("pos")) - 1).alias("rank"))


def ranked(rows: DataFrame, order: Sequence[Column], parts: int = 64, rank: str = "rank") -> DataFrame:
    """rows with their place from 0 without gaps in an order of columns that no two rows share. A bounded sample gives bounds of ranges; rows are counted by range and numbered within theirs, so that no task has more than a range, whatever is tied in the first column."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = rows.withColumn("__key", key)
    # Some 32 rows for each bound; the sample's size doesn't follow the table's.
    n = rows.count()
    sample = keyed.select("__key").sample(fraction=min(1.0, 32.0 * parts / max(1, n)), seed=7).orderBy("__key").limit(64 * parts).collect()
    bounds = [sample[len(sample) * i // parts].asDict()["__key"] for i in range(1, parts)] if len(sample) >= parts else []
    kinds = rows.sparkSession.createDataFrame([], keyed.select("__key").schema).schema["__key"].dataType
    least = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kinds.fields, strict=True)]) for b in bounds]) if bounds else None
    placed = keyed.withColumn("__range", F.size(F.filter(least, lambda b: b <= F.col("__key"))) if bounds else F.lit(0))
    counts = {r["__range"]: r["n"] for r in placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one for each range
    before, upto = [], 0
    for i in range(len(bounds) + 1):
        before.append(upto)
        upto += counts.get(i, 0)
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in before]), F.col("__range") + 1)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) - 1
    return placed.withColumn(rank, (offset + inside).cast("int")).drop("__key", "__range")


def build_lexicon(lemmas: DataFrame, frequencies: DataFrame) -> DataFrame:
    """word, freq and rank of lemmas (word) by frequency (word, freq), absent ones 0; ties by word."""
    known = lemmas.select(F.lower(F.trim("word")).alias("word")).where(is_word(F.col("word"))).distinct()
    joined = known.join(frequencies, "word", "left").select("word", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))
    return ranked(joined, (-F.col("freq"), F.col("word")))


def coverage(lexicon: DataFrame) -> DataFrame:
    return lexicon.agg(F.count_if(F.col("freq") > 0).alias("in_corpus"), F.count_if(F.col("freq") == 0).alias("not_in_corpus"))


def write_lexicon(lexicon: DataFrame, path: str, header: tuple[str, ...] = ()) -> None:
    """One word on a line by rank, after header lines marked as comments."""
    spark = lexicon.sparkSession
    head = spark.createDataFrame([(i - len(header), f"# {h}") for i, h in enumerate(header)], "rank int, value string")
    body = lexicon.select("rank", F.col("word").alias("value"))
    head.unionByName(body).orderBy("rank").select("value").coalesce(1).write.mode("overwrite").text(path)
