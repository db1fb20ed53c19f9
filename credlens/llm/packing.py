"""Packing of tokenised documents in the order of a Hilbert curve.

Each document's token counts are hashed to a vector of HASHED dimensions, normalised and projected by a
seeded Gaussian matrix to DIMS dimensions; the cell of that point on a Hilbert curve is the document's
key. Documents are range-sorted by (key, id), so that neighbours along the curve stand together, and laid
end to end: a document's place in the stream is the sum of tokens in earlier partitions plus those before
it in its own. The stream is cut every `size` tokens; only the last sequence needs padding.

Defined results: null and empty texts hold the end id alone; ties of keys go by id; repeated rows are
packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, map_arrow, parts_for, utf8_slices
from .tokens import word_bpe

HASHED, DIMS, BITS = 64, 4, 10


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (n, dims): undo excess rotations from the top bit down, Gray-decode, interleave."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def _projection(seed: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Slot and sign of each id, and the matrix."""
    rng = np.random.default_rng(seed)
    table = rng.integers(0, HASHED, 1 << 16), rng.choice([-1.0, 1.0], 1 << 16)
    return table, rng.standard_normal((HASHED, DIMS))


def curve_keys(ids: np.ndarray, lengths: np.ndarray, seed: int = 5) -> np.ndarray:
    """Hilbert key of each document; ids end to end."""
    table, project = _projection(seed)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    slot = ids.astype(np.int64) & 0xFFFF
    v = np.bincount(doc * HASHED + table[0][slot], weights=table[1][slot], minlength=len(lengths) * HASHED).reshape(-1, HASHED)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    y = (v / np.where(norm == 0, 1, norm)) @ project
    # A projected unit vector is close to standard normal; the logistic curve spreads it evenly over cells.
    cells = np.clip((1 << BITS) / (1 + np.exp(-1.7 * y)), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def tokenised(df: DataFrame, tokenizer_path: str, text: str, key: str, end_id: int) -> DataFrame:
    """key, curve key, number of tokens and ids (unsigned integers of 2 or 4 bytes) with end_id behind."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        end = np.array([end_id], dtype=bpe.dtype).tobytes()
        for part, raw, off in utf8_slices(batches):
            raw, off = bpe.plain(raw, off)
            data = raw.tobytes()
            texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            out = [x + end for x in bpe.encode_all(texts)]
            n = np.array([len(x) for x in out]) // bpe.dtype.itemsize
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve_keys(bpe.ids(b"".join(out)), n)), pa.array(n), pa.array(out, type=pa.binary())], names=["key", "curve", "n", "ids"])

    return map_arrow(rows, run, f"key {kind}, curve long, n long, ids binary", keeps="words")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of tokens before each row in its partition."""
    total = 0
    for b in batches:
        n = b.column(b.schema.get_field_index("n")).to_numpy()
        upto = total + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto - n)], names=[*b.schema.names, "before"])
        total = int(upto[-1]) if len(upto) else total


def pack(df: DataFrame, tokenizer_path: str, size: int = 4096, text: str = "text", key: str = "doc_id", end_id: int = 2) -> DataFrame:
    """One row per piece: key, start, length, ids (array<int>), ids_crc32, doc_tokens, sequence_id, offset."""
    store = Stored(df.sparkSession)
    plain = store.write(tokenised(df, tokenizer_path, text, key, end_id))
    kind = plain.schema["key"].dataType.simpleString()
    n_bytes = plain.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    ordered = plain.repartitionByRange(parts_for(df.sparkSession, n_bytes), "curve", "key").sortWithinPartitions("curve", "key").select("key", "n", "ids", F.spark_partition_id().alias("pid"))
    laid = store.write(map_arrow(ordered, _running, f"key {kind}, n long, ids binary, pid int, before long", keeps="words"))
    store.drop(plain)
    # One row for each partition of the sort, whatever the number of documents.
    parts = laid.groupBy("pid").agg(F.sum("n").alias("total"))
    starts = parts.select("pid", (F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("pid")) - F.col("total")).alias("base"))
    placed = laid.join(F.broadcast(starts), "pid").select("key", "n", "ids", (F.col("base") + F.col("before")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for b in batches:
            out: list[tuple] = []
            for k, n, ids, at in zip(*[c.to_pylist() for c in b.columns], strict=True):
                whole, start = bpe.ids(ids).astype("<u4"), 0
                while start < n:
                    length = min(n - start, size - (at + start) % size)
                    piece = whole[start : start + length]
                    out.append((k, start, length, piece.astype(np.int32), zlib.crc32(piece.tobytes()), n, (at + start) // size, (at + start) % size))
                    start += length
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(cols, kinds, strict=True)], names=["key", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return map_arrow(placed, run, f"key {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long", keeps="words").withColumnRenamed("key", key)
