"""Connected components, and work on groups whose rows are split into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, map_arrow


#: A node with more than 1 / HUB of all edge ends is a hub; there are at most HUB of them.
HUB, SPREAD = 1024, 64


def _with_lowest(rows: DataFrame, low: DataFrame, hubs: list) -> DataFrame:
    """rows (u, v) with m of their u; the rows of a hub are spread over SPREAD keys, and its m is copied to each."""
    hot = F.col("u").isin(hubs) if hubs else F.lit(False)
    salted = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("v"), F.lit(SPREAD))).otherwise(0).cast("int"))
    many = low.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(many, ["u", "salt"]).drop("salt")


def connected(edges: DataFrame, store: Stored, n_edges: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (u, v): the smallest node reachable. Large-star and small-star steps until nothing changes, which takes about the logarithm of the number of nodes; a star's minimum is pre-aggregated, and a hub's edges are spread, so that it costs no task more than its share. n_edges: about how many there are or at most can be."""
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    e = store.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), n_edges)
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        ends = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = [r.u for r in ends.where(F.col("n") > max(1000, 2 * before[0] // HUB)).select("u").collect()]
        low = ends.select("u", F.least("m", "u").alias("m"))
        large = _with_lowest(both, low, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_lowest(large, least, hubs).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u > v").distinct()
        old, e = e, store.write(small, before[0])
        after = state(e)
        store.drop(old)
        if after == before:
            break
        before = after
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def bucket_stars(banded: DataFrame, store: Stored, n_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (bucket, id, ...): those in buckets of two rows at least, and the distinct star edges (u, v) from each row to its bucket's smallest id; at most one edge for each row."""
    sizes = banded.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").drop("last")
    several = store.write(banded.join(sizes, "bucket"), n_rows)
    return several.drop("centre"), several.where("id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).distinct()


def star_blocks(edges: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Edges' ends with their data: rows (id, ...) of the members u of each centre v in blocks of about `most`, each block with a copy of the centre's row; columns component (the centre), bi, bj, small (a member)."""
    sizes = edges.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("c"))
    members = edges.join(sizes, "v").select(F.col("u").alias("id"), F.col("v").alias("component"), F.pmod(F.xxhash64("u"), F.col("c")).cast("int").alias("bi"), F.lit(True).alias("small"))
    centres = sizes.select(F.col("v").alias("id"), F.col("v").alias("component"), F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("bi"), F.lit(False).alias("small"))
    return members.unionByName(centres).join(rows, "id").withColumn("bj", F.lit(0))


def cross_blocks(rows: DataFrame, group: str, key: str, root: str, most: int) -> DataFrame:
    """Rows of groups that hold two roots at least, in blocks (bi, bj) in which every row outside its group's most frequent root (small) meets every row of the group once. A group of n rows with s small ones costs n * s / most ** 2 blocks: nothing where one root holds all, and never all pairs of a large root."""
    counts = rows.groupBy(group, root).agg(F.count(F.lit(1)).alias("k"))
    mains = counts.groupBy(group).agg(F.sum("k").alias("n"), F.max(F.struct("k", root)).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    sizes = mains.select(group, F.col(f"m.{root}").alias("main"), F.ceil(F.col("n") / most).cast("int").alias("c"), F.ceil((F.col("n") - F.col("m.k")) / most).cast("int").alias("d"))
    placed = rows.join(sizes, group)
    part = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = placed.select(*rows.columns, part("c").alias("bj"), over("d").alias("bi"), F.lit(False).alias("small"))
    few = placed.where(F.col(root) != F.col("main")).select(*rows.columns, part("d").alias("bi"), over("c").alias("bj"), F.lit(True).alias("small"))
    return every.unionByName(few)


def blocks(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Rows of groups of two at least, with block columns bi <= bj and part: a group of up to `most` rows is the block (0, 0); the rows of a larger one are dealt to c parts and copied to the c blocks that pair their part with each part, so that every pair of rows meets in a block of at most about 2 * most rows."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    parts = F.ceil(F.col("n") / most).cast("int")
    placed = rows.join(sizes, group).withColumn("c", parts).withColumn("part", F.pmod(F.xxhash64(key), F.col("c")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).withColumn("bi", F.least("part", "other")).withColumn("bj", F.greatest("part", "other")).drop("n", "c", "other")


def map_blocks(rows: DataFrame, group: str, f: Callable[[pa.Table], pa.RecordBatch | None], schema: str, batch: int = 500) -> DataFrame:
    """f on each block's rows, which come together in one task; only one block is held at a time."""
    met = rows.repartition(F.col(group), F.col("bi"), F.col("bj")).sortWithinPartitions(group, "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for b in batches:
            g, i, j = (b.column(b.schema.get_field_index(c)).to_numpy() for c in (group, "bi", "bj"))
            new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(g) else np.zeros(0, int)
            for s, e in zip(new.tolist(), np.r_[new[1:], len(g)].tolist() if len(new) else [], strict=True):
                this = int(g[s]), int(i[s]), int(j[s])
                if this != name and held:
                    if (out := f(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                name = this
                held.append(b.slice(s, e - s))
        if held and (out := f(pa.Table.from_batches(held))) is not None:
            yield out

    return map_arrow(met, run, schema, batch)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over edges (a, b), within one block."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def star_edges(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch | None:
    """Each node with the first of its component in the block."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[label[at]])], names=["u", "v"]) if len(at) else None
