"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .alignment import align_documents
from .chunked_bpe import encode_decode
from .common import Stored, table, text_or_empty
from .embedding_dedup import near_vectors
from .line_dedup import dedup_lines
from .minhash import near_texts
from .packing import pack
from .pii import find_personal_data, spans_text
from .quality_rules import robust_outliers
from .sharding import interleave
from .suffix_dedup import remove_repeats
from .token_files import checksums, write_ids
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    field = crf.fit(docs, table(spark, sf_dir, "labels"))
    # Only the id travels beside the text.
    named = docs.select("doc_id", "text", crf.held_out(F.col("doc_id")).alias("held_out"))
    return crf.classify(named, field, keep_text=False).select("doc_id", "held_out", "score", "predicted")


def op2_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_proportional_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    t = text_or_empty()
    sized = docs.select("doc_id", "source", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"))
    return interleave(sized, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_oph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, percent=80)


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_email"), of(1).alias("n_ip"), of(2).alias("n_card"), of(3).alias("n_phone"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.array_sort(F.concat("base", "added", "secrets"))).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size("secrets").cast("long").alias("n_secret"), spans_text(F.col("secrets")).alias("secret_spans"),
        (F.size("base") + F.size("added") + F.size("secrets")).cast("long").alias("n_spans"),
    )


def op6_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer()).drop("ids")


def op7_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_decode(docs, tokenizer(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_addressable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return checksums(write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), Stored(spark).folder()))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_line_crf, op2_interval_tree_repeats, op3_proportional_interleave, op4_perfect_hash_lines, op5_bootstrapped_pii, op6_hilbert_packing, op7_chunk_reuse_bpe, op8_hyperplane_dedup, op9_oph_dedup, op10_robust_outliers, op11_cross_tokenizer_alignment, op12_bit_sliced_whitening, op13_addressable_ids)}

_STRIP = r"""regexp_replace(regexp_replace(l, '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '')"""
ORACLE_SQL: dict[str, str] = {
    "op8_hyperplane_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op9_oph_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN list_aggregate(w[i:i + 3], 'string_agg', chr(32)) ELSE list_aggregate(w, 'string_agg', chr(32)) END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT doc_id, g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM s) WHERE k > 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) USING (doc_id)""",
    "op4_perfect_hash_lines": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
k AS (SELECT doc_id, i, l, translate({_STRIP}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
m AS (SELECT key, min(doc_id) AS low FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, i, l, coalesce(low < k.doc_id, false) AS dropped FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
}
