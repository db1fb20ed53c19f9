"""A corpus pipeline: quality, repeated lines, near duplicates, personal data, packing.

Each stage gets the documents that its predecessor kept and returns documents with the same columns; the
last returns packed pieces. Stages write texts anew where they change them, and n_chars with them.

Defined results of every stage: a null text counts as an empty one, and stays null where nothing changes it;
a null id is an id that no other row has; ties go to the smallest id; repeated rows are judged alike; columns
beside doc_id and text are carried along, whatever their names; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.llm import crf
from credlens.llm.common import Stored, parts_for, table, text_or_empty
from credlens.llm.components import connected
from credlens.llm.line_dedup import dedup_lines
from credlens.llm.minhash import near_texts
from credlens.llm.packing import pack
from credlens.llm.pii import mask_personal_data
from credlens.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_or_empty())), F.lit(0))).first()[0]


def _parted(docs: DataFrame, n_bytes: int) -> DataFrame:
    """docs in parts that follow the bytes of the texts, so that a small table doesn't get a file for each shuffle partition."""
    return docs.coalesce(parts_for(docs.sparkSession, n_bytes))


def _carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work on doc_id and text, beside which the other columns are carried under names that clash with nothing; n_chars of the text that comes out."""
    names = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = work(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    if "n_chars" in names:
        done = done.withColumn(names["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(names[c]).alias(c) if c in names else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; repeated rows stay or go together."""
    field = crf.fit(docs, table(spark, sf_dir, "labels"))
    return _carried(docs, lambda d: crf.classify(d, field).where("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in a document with a smaller id; a document that loses all its lines stays as an empty one. Rows that share an id keep what they share."""
    n_bytes = _bytes(docs)
    return _parted(_carried(docs, lambda d: dedup_lines(d, n_bytes=n_bytes)), n_bytes)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group. Documents are linked if their texts are near copies as they come here, or if they were so whole: the line stage takes from a copy the lines that it shares, and what is left of it resembles nothing. Rows without an id stay; of rows that share an id and a text one stays."""
    store, n_docs, n_bytes = Stored(spark), docs.count(), _bytes(docs)
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    whole = table(spark, sf_dir, "documents", "doc_id", "text").join(ids, "doc_id", "left_semi")
    # Stored one after the other, so that the two don't share the executors' memory.
    linked = [store.write(near_texts(texts, shingle=5, percent=80).where("component_id <> doc_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")), n_docs) for texts in (docs.select("doc_id", "text"), _parted(whole, n_bytes))]
    gone = connected(linked[0].unionByName(linked[1]), store, 2 * n_docs).where("node <> component").select(F.col("node").alias("doc_id"))
    stay = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return _parted(stay.unionByName(docs.where("doc_id is null")).select(*docs.columns), n_bytes)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets masked by their kind in brackets."""
    n_bytes = _bytes(docs)
    return _parted(_carried(docs, lambda d: mask_personal_data(d, n_bytes=n_bytes)), n_bytes)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens; a row each for every piece of every row, repeats included."""
    return pack(docs.select("doc_id", "text"), tokenizer())


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: The quality stage fits a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Stored(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
