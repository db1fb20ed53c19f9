"""How the supplied tables stand in for a corpus, lexicons, breach ranges and progress records."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import is_word
from .corpus import tokens, weighted

_local: list[str] = []
_lexicons: list[DataFrame] = []

#: Strings that give every detector something to find. Plain enough SQL for other engines too; {part} and so on name the tables.
SYNTH = """
WITH w AS (SELECT p_partkey AS k, p_size AS z, lower(split_part(p_name, ' ', 1)) AS w, p_name AS n FROM {part}),
d AS (SELECT DISTINCT w, substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 10) AS d FROM {lineitem} JOIN w ON l_partkey = k)
SELECT DISTINCT value FROM (
  SELECT w || substr(d, 9, 2) || substr(d, 6, 2) || substr(d, 1, 4) AS value FROM d
  UNION ALL SELECT w || d FROM d
  UNION ALL SELECT w || substr(d, 9, 2) || substr(d, 6, 2) || substr(d, 3, 2) FROM d
  UNION ALL SELECT repeat(substr(w, 1, 2), 3) || CAST(z AS STRING) FROM w
  UNION ALL SELECT repeat(substr(w, 1, 1), 4) || CAST(k AS STRING) FROM w
  UNION ALL SELECT substr('qwertyuiop', CAST(1 + k % 7 AS INT), 4) || CAST(z AS STRING) FROM w
  UNION ALL SELECT upper(substr('lkjhgfdsa', CAST(1 + k % 6 AS INT), 4)) || CAST(z AS STRING) FROM w
  UNION ALL SELECT substr('abcdefghij', CAST(1 + k % 7 AS INT), 4) || CAST(z AS STRING) FROM w
  UNION ALL SELECT substr('9876543210', CAST(1 + k % 7 AS INT), 4) || w FROM w
  UNION ALL SELECT translate(w, 'aeiost', '431057') || '!' || CAST(z AS STRING) FROM w
  UNION ALL SELECT replace(translate(n, 'aeiost', '@3!0$7'), ' ', '') FROM w
  UNION ALL SELECT c_name FROM {customer}
  UNION ALL SELECT CASE c_custkey % 4 WHEN 0 THEN 'Hola' WHEN 1 THEN 'RealMadrid' WHEN 2 THEN 'cariño' ELSE 'abcba' END || CAST(c_nationkey AS STRING) FROM {customer}
  UNION ALL SELECT s_name FROM {supplier}
) AS every"""


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores or shuffle partitions: few bytes of strings can be much work, which adaptive coalescing doesn't see."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where all of Spark is one process."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="streams-"))
    return _local[0]


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of the documents with their counts."""
    return weighted(tokens(table(spark, sf_dir, "documents").select("text")))


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value and weight 1 of SYNTH."""
    names = ("part", "lineitem", "customer", "supplier")
    return spread(spark.sql(SYNTH, **{n: table(spark, sf_dir, n) for n in names})).withColumn("weight", F.lit(1).cast("long"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked words of the documents for each language, and of product names."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where(is_word(F.col("word")))
    said = words.groupBy(F.concat(F.lit("palabras_"), "lang").alias("dict_name"), "word").agg(F.count(F.lit(1)).alias("n"))
    named = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where(is_word(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nombres_es").alias("dict_name"), "word", "n")
    order = Window.partitionBy("dict_name").orderBy(F.desc("n"), "word")
    # Read by several joins of a plan; far smaller than the documents.
    made = said.unionByName(named).select("dict_name", "word", (F.row_number().over(order) - 1).alias("rank")).persist()
    _lexicons.append(made)
    return made


def release() -> None:
    """Frees the word lists that queries have kept; plans that still use one compute it again."""
    while _lexicons:
        _lexicons.pop().unpersist()


def breach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all words of the documents with their counts, but for those that begin with 1, 5, 9 or D, which count as not found; those that end with 0 are padding with count 0."""
    words = tokens(table(spark, sf_dir, "documents").select("text")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    d = F.upper(F.sha1(F.col("value").cast("binary")))
    held = words.select(d.alias("d"), "n").where(~F.substring("d", 1, 1).isin("1", "5", "9", "D"))
    return held.select(F.substring("d", 1, 5).alias("prefix"), F.substring("d", 6, 35).alias("suffix"), F.when(F.endswith("d", F.lit("0")), F.lit(0)).otherwise(F.col("n")).cast("long").alias("count"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each user of the events, with its status by user."""
    u = F.col("user_id")
    status = F.when(u % 4 == 0, "running").when(u % 4 == 1, "completed").when(u % 4 == 2, "failed").otherwise("pending")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("lines_processed"), F.count_if(F.col("value") > 5).alias("lines_valid"), F.min("ts").alias("started_at"), F.max("ts").alias("ended"))
    return e.select(F.concat(F.lit("part-"), u.cast("string"), F.lit(".txt")).alias("filename"), status.alias("status"), "lines_processed", "lines_valid", "started_at", F.when(u % 4 == 1, F.col("ended")).alias("finished_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each event type and user, of the dataset with the type's name."""
    e = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"), F.count(F.lit(1)).alias("lines_valid"))
    ids = datasets(spark, sf_dir).select(F.col("id").alias("dataset_id"), F.col("name").alias("event_type"))
    return e.join(ids, "event_type").select((F.col("dataset_id") * 1_000_000 + F.col("user_id")).alias("id"), "dataset_id", F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.col("started_at")).alias("started_at"), "finished_at", F.lit("completed").alias("status"), "lines_valid")


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset for each event type; those that start with a letter up to m count as leaked."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", F.when(F.col("name") < "n", "leaked").otherwise("user_submitted").alias("dataset_type"))
