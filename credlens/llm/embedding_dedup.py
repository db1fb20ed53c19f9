"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, connected components.

Equal vectors form classes; only one of each goes on, with its count. Each gets a sketch of BITS signs.
A table's key is signs of hyperplanes of its own, so that tables miss a pair independently; classes with
equal keys meet in a bucket, where those whose sketch differs from another one's in at most NEAR signs are
candidates. The candidates of a bucket meet again with their vectors, and cosines in double precision give
links: first with one centre, then of all that it leaves over, so that a group of alike vectors costs one
check for each. Components of links, not of candidates, are the groups; inside each one cosines of all pairs
are computed, block by block, and summed to counts where they arise, so no pairs are put out. The number of
signs in a key follows the number of classes, and the number of tables follows from it, so that a pair at
the threshold is missed with a probability of at most MISS.

Defined results: null ids, null or zero vectors and vectors with null or non-finite components have no
links and are their own component; vectors of different lengths don't link; repeated rows count as
different vectors with one id; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, map_arrow
from .components import blocks, connected, labels_of, map_blocks, star_edges
from .rolling import mix

BITS, NEAR = 256, 72
BUCKET, BLOCK = 1024, 1024
MISS = 1e-6


def plan_tables(n: int, threshold: float, occupancy: int = BUCKET) -> tuple[int, int]:
    """Signs in a key and number of tables for n vectors."""
    r = max(1, math.ceil(math.log2(max(2, n) / occupancy)))
    agree = (1 - math.acos(threshold) / math.pi) ** r
    return r, max(4, math.ceil(math.log(MISS) / math.log(1 - agree)))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(-1, size)


def _sketch(signs: int, tables: int, seed: int = 11):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, vectors = b.column(0).to_numpy(), b.column(1)
            width = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(width).tolist():
                at = np.flatnonzero(width == d)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, 10**6 + d)).standard_normal((d, BITS + signs * tables))
                bits = x @ planes[d] > 0
                sketch, own = np.packbits(bits[:, :BITS], axis=1), bits[:, BITS:].reshape(-1, signs, tables)
                key = np.full((len(at), tables), d, np.uint64)
                for k in range(signs):
                    key = key * np.uint64(2) + own[:, k]
                key = mix(key + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rows = [x.tobytes() for x in sketch]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[at], tables)), pa.array([s for s in rows for _ in range(tables)], pa.binary())], names=["bucket", "id", "sketch"])

    return run


def _near(t: pa.Table) -> pa.RecordBatch | None:
    """The rows of a block whose sketch is near that of another one."""
    words = _matrix(t["sketch"], BITS // 8).view(np.uint64)
    hit = np.zeros(len(words), bool)
    for s in range(0, len(words), 256):
        apart = np.zeros((min(256, len(words) - s), len(words)), np.uint16)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[s : s + 256, None, w] ^ words[None, :, w])
        at = np.arange(len(apart))
        apart[at, s + at] = BITS
        hit[s : s + 256] = (apart <= NEAR).any(axis=1)
    return t.select(["bucket", "bi", "bj", "id"]).filter(pa.array(hit)).combine_chunks().to_batches()[0] if hit.any() else None


def _unit(vectors: pa.ListArray, at: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors; each is scaled by its largest component first, so that no square leaves the range of doubles."""
    x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucket_links(threshold: float):
    """Links between the vectors of a block, fewest that connect them: those of one centre, then those of what it leaves over with all."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids, vectors = t["id"].to_numpy(), t["v"].combine_chunks()
        width = np.diff(vectors.offsets.to_numpy())
        a, b = [], []
        for d in np.unique(width).tolist():
            at = np.flatnonzero(width == d)
            x = _unit(vectors, at, d)
            own = x @ x[0] >= threshold
            own[0] = True
            a.append(at[own])
            b.append(np.full(int(own.sum()), at[0]))
            left = np.flatnonzero(~own)
            for s in range(0, len(left), 256):
                i, j = np.nonzero(x[left[s : s + 256]] @ x.T >= threshold)
                a.append(at[left[s + i]])
                b.append(at[j])
        return star_edges(ids, labels_of(len(ids), np.concatenate(a), np.concatenate(b)))

    return run


def _counts(threshold: float):
    """Number of links of each vector inside a block."""

    def run(t: pa.Table) -> pa.RecordBatch:
        ids, weight, part = (t[c].to_numpy() for c in ("id", "weight", "part"))
        bi, bj = t["bi"][0].as_py(), t["bj"][0].as_py()
        vectors = t["v"].combine_chunks()
        width = np.diff(vectors.offsets.to_numpy())
        n = np.zeros(len(ids), np.int64)
        for d in np.unique(width).tolist():
            at = np.flatnonzero(width == d)
            x = _unit(vectors, at, d)
            for s in range(0, len(at), 256):
                hit = x[s : s + 256] @ x.T >= threshold
                # A block of two different parts counts the pairs between them only.
                if bi != bj:
                    hit &= part[at[s : s + 256], None] != part[None, at]
                hit[np.arange(len(hit)), s + np.arange(len(hit))] = False
                n[at[s : s + 256]] += hit @ weight[at]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    return run


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """key, n_links, component_id and kept for each row of df."""
    spark = df.sparkSession
    store = Stored(spark)
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{key}`").alias("id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # Unequal vectors with two equal 64-bit hashes are out of the question.
    # The others get a null h, which joins with nothing, and are spread by their id.
    hashed = rows.withColumn("g", F.when(good, F.xxhash64("v")).otherwise(F.xxhash64("id"))).withColumn("h", F.when(good, F.xxhash64(F.lit(1), "v")))
    classes = store.write(hashed.where("h is not null").groupBy("g", "h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")))
    signs, tables = plan_tables(classes.count(), threshold)
    sketched = map_arrow(classes.select("id", "v"), _sketch(signs, tables), "bucket long, id long, sketch binary", 1000)
    near = map_blocks(blocks(sketched, "bucket", "id", BUCKET), "bucket", _near, "bucket long, bi int, bj int, id long", 2000)
    links = map_blocks(near.join(classes.select("id", "v"), "id"), "bucket", _bucket_links(threshold), "u long, v long", 1000)
    root = store.write(connected(links.distinct(), store).select(F.col("node").alias("id"), "component"))
    members = classes.select("id", "weight", "v").join(root, "id")
    found = map_blocks(blocks(members, "component", "id", BLOCK), "component", _counts(threshold), "id long, n long", 1000)
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    judged = classes.select("g", "h", "id", "weight").join(linked, "id", "left").join(root, "id", "left").select(
        "g", "h", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    done = hashed.drop("v").join(judged, ["g", "h"], "left")
    component = F.coalesce("component_id", "id")
    return done.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
