"""Removal of lines that other documents hold, through a sharded minimal perfect hash.

Line keys are hashed to 128 bits. Keys found in at least two documents are dealt to shards by hash; each
shard gets a minimal perfect hash (levels of bit arrays, each with the keys that collide in the ones
before) that indexes compact arrays: a 64-bit fingerprint, a count and the smallest document id.
Documents send packed probes (hashes and line numbers, no text) to the shards, where one task at a time
holds one shard's arrays. Keys with more than 1 / HOT of all occurrences, HOT of them at most, are
resolved where the documents are read, so that no shard gets a hot line's probes.

Defined results: null and empty texts are one empty line; null ids sort behind all others and count as
one document; repeated rows each get the same result; columns named as outputs are replaced; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, map_arrow, utf8_slices, without
from .rolling import RangeHash, mix

OUT = ("n_lines", "n_dropped")
HOT = 4096
KEYS_PER_SHARD = 1 << 14
LAST_ID = np.iinfo(np.int64).max
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def line_keys(raw: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of keys with at least `least` code points: text index, line number, two hashes."""
    breaks = np.flatnonzero(raw == 10)
    # Every text has one line more than line breaks.
    per = np.searchsorted(breaks, off[1:], side="left") - np.searchsorted(breaks, off[:-1], side="left")
    n_lines = per + 1
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    first = np.cumsum(n_lines) - n_lines
    number = np.arange(len(doc)) - first[doc]
    inner = np.arange(len(breaks)) + 1 + np.searchsorted(off[1:], breaks, side="right")  # its place among all line starts
    start = np.empty(len(doc), np.int64)
    start[first] = off[:-1]
    start[inner] = breaks + 1
    end = np.empty(len(doc), np.int64)
    end[first + per] = off[1:]
    end[inner - 1] = breaks
    solid = np.append(np.flatnonzero(~_BLANK[raw]), len(raw))
    start = np.minimum(solid[np.searchsorted(solid, start)], end)
    last = np.searchsorted(solid, end) - 1
    end = np.where(last >= 0, np.maximum(solid[last] + 1, start), start)
    chars = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    long = chars[end] - chars[start] >= least
    s, e, low = start[long], end[long], _LOWER[raw]
    return doc[long], number[long], RangeHash(low, 0).ranges(s, e), RangeHash(low, 1).ranges(s, e)


def _ids(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in utf8_slices(batches):
            doc, _, a, b = line_keys(raw, off, least)
            ids = _ids(part, "id")[doc]
            order = np.lexsort((b, a))
            a, b, ids = a[order], b[order], ids[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64)), pa.array(np.minimum.reduceat(ids, new)), pa.array(np.maximum.reduceat(ids, new)), pa.array(np.diff(np.r_[new, len(a)]))], names=["a", "b", "low", "high", "n"])

    return run


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: level by level, keys alone in their slot take it."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = np.cumsum([0, *[int(x.sum()) for x in levels]])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = 2 * len(keys)
            at = cls.slots(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index; keys not built in get any index, or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            at = self.slots(keys[left], i, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
        for s in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-s // 8), at))[:s].astype(bool))
            at += -(-s // 8)
        return cls(levels)


class Shard:
    """A perfect hash and the arrays that it indexes."""

    def __init__(self, mph: bytes, fingerprints: bytes, counts: bytes, lowest: bytes) -> None:
        self.mph = PerfectHash.from_bytes(mph)
        self.fingerprints, self.counts, self.lowest = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(lowest, np.int64)

    def lowest_id(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The smallest id of a document with this key; LAST_ID for keys that aren't in the shard."""
        at = self.mph(a)
        return np.where((at >= 0) & (self.fingerprints[at] == b), self.lowest[at], LAST_ID) if len(self.fingerprints) else np.full(len(a), LAST_ID)


INDEX = "shard int, kind int, mph binary, x binary, y binary, z binary"


def _build(t: pa.Table) -> pa.Table:
    """A row of arrays for a shard; keys that share their first hash with one before them get a row of their own."""
    a, b, n, low = (t[c].to_numpy() for c in ("a", "b", "n", "low"))
    rows = []
    while len(a):
        _, first = np.unique(a, return_index=True)
        keys = a[first].view(np.uint64)
        mph = PerfectHash.build(keys)
        order = first[np.argsort(mph(keys))]
        rows.append((t["shard"][0].as_py(), 0, mph.to_bytes(), b[order].tobytes(), n[order].tobytes(), low[order].tobytes()))
        rest = np.ones(len(a), bool)
        rest[first] = False
        a, b, n, low = a[rest], b[rest], n[rest], low[rest]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(list(c), type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "kind", "mph", "x", "y", "z"])


def _probes(least: int, bits: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Packed probes by shard (kind 1), and dropped lines of hot keys (shard -1): x hashes, y text index and line, z uid and id by text."""
    hot_a, hot_b, hot_low = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in utf8_slices(batches):
            doc, line, a, b = line_keys(raw, off, least)
            if not len(doc):
                continue
            who = np.stack([part.column(part.schema.get_field_index("uid")).to_numpy(), _ids(part, "id")], axis=1)
            shard = (a >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
            if len(hot_a):
                at = np.minimum(np.searchsorted(hot_a, a), len(hot_a) - 1)
                is_hot = (hot_a[at] == a) & (hot_b[at] == b)
                shard[is_hot & (hot_low[at] >= who[doc, 1])] = -2  # the document that keeps it
                shard[is_hot & (hot_low[at] < who[doc, 1])] = -1
            order = np.argsort(shard, kind="stable")
            new = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]])
            out = []
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
                rows = order[s:e]
                if (k := int(shard[rows[0]])) == -2:
                    continue
                docs, local = np.unique(doc[rows], return_inverse=True)
                out.append((k, 1, None, np.concatenate([a[rows], b[rows]]).tobytes(), np.concatenate([local, line[rows]]).astype(np.uint32).tobytes(), who[docs].tobytes()))
            if out:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "kind", "mph", "x", "y", "z"])

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard come together, its arrays first."""
    shard, index = None, []
    for batch in batches:
        uids, keys, lines = [], [], []
        for k, kind, mph, x, y, z in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                shard, index = k, [*(index if shard == k else []), Shard(mph, x, y, z)]
                continue
            hashes, where, who = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint32), np.frombuffer(z, np.int64).reshape(-1, 2)
            n = len(hashes) // 2
            local, line = where[:n], where[n:]
            drop = np.ones(n, bool)
            if k >= 0:
                if shard != k:
                    continue  # no key of this shard is in two documents
                drop = np.minimum.reduce([i.lowest_id(hashes[:n], hashes[n:]) for i in index]) < who[local, 1]
            if not drop.any():
                continue
            local, line = local[drop], line[drop]
            order = np.argsort(local, kind="stable")
            local, line = local[order], line[order]
            new = np.flatnonzero(np.r_[True, local[1:] != local[:-1]])
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(local)], strict=True):
                uids.append(int(who[local[s], 0]))
                keys.append(int(who[local[s], 1]))
                lines.append(line[s:e].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(keys, pa.int64()), pa.array(lines, pa.binary())], names=["uid", "key", "lines"])


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", least: int = 10, n_bytes: int | None = None) -> DataFrame:
    """df with its text replaced by the lines that stay, and n_lines and n_dropped. n_bytes: about how many the texts have, if known; the keys get files by it."""
    spark = df.sparkSession
    store = Stored(spark)
    kept = without(df, *OUT)
    raw_id = F.col(f"`{key}`").cast("long")
    slim = kept.select(raw_id.alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = map_arrow(slim, _counts(least), "a long, b long, low long, high long, n long").groupBy("a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    keys = store.write(found.where("low < high").drop("high"), None if n_bytes is None else n_bytes // (2 * least))
    n_keys, n_all, = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(6, int(max(1, n_keys) // KEYS_PER_SHARD).bit_length())
    # Keys with at least 1 / HOT of the occurrences: there can't be more than HOT of them.
    hot = keys.where(F.col("n") >= max(1000, -(-n_all // HOT))).select("a", "b", "low").toPandas()
    ha, hb, hl = hot["a"].to_numpy(np.int64).view(np.uint64), hot["b"].to_numpy(np.int64).view(np.uint64), hot["low"].to_numpy(np.int64)
    order = np.argsort(ha)
    shard = F.shiftrightunsigned("a", 64 - bits).cast("int")
    index = keys.select("a", "b", "low", "n", shard.alias("shard")).groupBy("shard").applyInArrow(_build, INDEX)
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns if c.lower() != text.lower()] or [F.lit(0)]).alias("r"), raw_id.alias("id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    probes = map_arrow(rows.select("id", "uid", "text"), _probes(least, bits, (ha[order], hb[order], hl[order])), INDEX)
    routed = index.unionByName(probes).withColumn("part", F.when(F.col("shard") < 0, F.xxhash64("z")).otherwise(F.col("shard").cast("long")))
    met = routed.repartition(F.col("part")).sortWithinPartitions("shard", "kind").drop("part")
    drops = map_arrow(met, _probe, "uid long, key long, lines binary").groupBy("uid", "key").agg(F.collect_list("lines").alias("lines"))
    both = rows.withColumn("key", F.coalesce("id", F.lit(int(LAST_ID)))).join(drops, ["uid", "key"], "left").select("r", "text", "lines")
    schema = T.StructType([both.schema["r"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = map_arrow(both, _apply, schema)
    cols = [F.col("text").alias(c) if c.lower() == text.lower() else F.col(f"r.`{c}`") for c in kept.columns]
    return done.select(*cols, *OUT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, n, gone = [], [], []
        for t, drops in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = (t or "").split("\n")
            if drops:
                out = set(np.frombuffer(b"".join(drops), np.uint32).tolist())
                texts.append("\n".join([x for i, x in enumerate(lines) if i not in out]))
                gone.append(len(out))
            else:
                texts.append(t or "")
                gone.append(0)
            n.append(len(lines))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["r", "text", "n_lines", "n_dropped"])
