"""Whitening of embeddings from exact integer cross-products, counted on bit planes.

Each entry c becomes x = floor(1024 c) + 100000. In a slice of rows, bit b of x minus its dimension's least value
is packed across the rows into 64-bit words; the cross-product of two dimensions is the sum over pairs of their
planes of 2 ** (a + b) times the set bits of both words. Tasks add these sums up as integers and put out one row for
each pair of dimensions, Spark adds the rows up, and n * sum(xy) - sum(x) * sum(y) centres them as integers
before anything is divided. Only dims ** 2 of them and the 3 * dims sums reach the driver, where eigh runs.

Defined results: rows with a null vector, one with null or non-finite entries, an empty one, or one whose length isn't the
commonest (of equals the longest) are left out; repeated rows and ids, null ids too, count and come out once each; with
no rows left the result is empty. A component without variance (at most 1e-12 of all) has null for whitened, and
identity_error leaves it out; all variance 0 gives null for explained. deviation is null where it doesn't fit a long. Entries
beyond 2 ** 46 / 1024 in size are refused with an OverflowError. Columns named as outputs are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored, without

SCALE, SHIFT = 1024, 100_000
#: Rows of a slice at most, bytes of its entries, bits of its planes.
ROWS, SLICE, PLANES = 1 << 13, 1 << 22, 1 << 22
LARGEST = 1 << 46
#: Share of the trace up to which a component counts as having no variance.
FLAT = 1e-12
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_EXACT = T.DecimalType(38, 0)


def integers(c: np.ndarray) -> np.ndarray:
    """x of each entry."""
    y = np.floor(SCALE * c.astype(np.float64))
    if len(y) and np.abs(y).max() > LARGEST:
        raise OverflowError(f"an entry is larger than {LARGEST // SCALE} in size")
    return y.astype(np.int64) + SHIFT


def planes(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bit planes (sum of widths, words) of non-negative x - low (rows, dims); dimension by dimension, lowest bit first."""
    y = (x - low).T
    dim = np.repeat(np.arange(len(width)), width)
    bit = np.arange(len(dim)) - np.repeat(np.cumsum(width) - width, width)
    bits = ((y[dim] >> bit[:, None]) & 1).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.uint64)


def cross_products(x: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sums over rows of (x - low)_i * (x - low)_j for i <= j, exact, as Python integers where longs may not hold them."""
    d, p = len(width), planes(x, low, width)
    first, total = np.r_[0, np.cumsum(width)], int(width.sum())
    wide = 2 * int(width.max(initial=0)) + int(len(x)).bit_length() > 62
    weight = np.array([1 << int(b) for w in width for b in range(w)], dtype=object if wide else np.int64)
    out = np.zeros((d, d), dtype=object if wide else np.int64)
    some = np.flatnonzero(width)
    for i in some:
        later = some[some >= i]
        for a in range(first[i], first[i + 1]):
            common = np.bitwise_count(p[first[i] : total] & p[a]).sum(axis=1, dtype=np.int64)
            part = np.add.reduceat(common * weight[first[i] :], first[later] - first[i])
            out[i, later] += part * weight[a]
    return out


@dataclass
class Whitening:
    """A fitted transform: n, sums of x, and for each component its axis, eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    flat: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); components without variance are 0."""
        centred = self.deviations(x).astype(np.float64) / self.n
        return np.where(self.flat, 0.0, (centred @ self.axes) / np.sqrt(np.where(self.flat, 1.0, self.values)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S of each entry, exact."""
        most = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)])
        kind = np.int64 if most < 1 << 61 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def squared(self, x: np.ndarray) -> list[int]:
        q = self.deviations(x)
        if q.dtype != object and q.size and int(np.abs(q).max()) ** 2 * self.dims >= 1 << 63:
            q = q.astype(object)
        return [int(v) for v in (q * q).sum(axis=1)]


def _entries(batch: pa.RecordBatch, dims: int | None, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of vectors of one length with their x; `vector` has no nulls inside."""
    at = batch.schema.get_field_index("vector")
    step = max(1, min(ROWS, most // (8 * dims))) if dims else ROWS
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        flat = part.column(at).flatten().to_numpy(zero_copy_only=False)
        yield part, integers(flat).reshape(part.num_rows, dims)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.withColumn("vector", v).where(v.isNotNull() & (F.size(v) > 0)).where(~bad)


def _totals(rows: DataFrame) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The commonest length and for each of its dimensions: rows, least x, greatest x, sum of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            col = b.column(0)
            sizes = np.diff(col.offsets.to_numpy())
            flat, start = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                x = integers(flat[start[sizes == d][:, None] + np.arange(d)])
                total = np.array([int(v) for v in x.sum(axis=0)], dtype=object)
                new = [len(x), x.min(axis=0), x.max(axis=0), total]
                old = held.get(d)
                held[d] = new if old is None else [old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), old[3] + total]
        for d, (n, low, high, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(low), pa.array(high), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["dims", "i", "n", "low", "high", "total"])

    parts = rows.select("vector").mapInArrow(run, "dims int, i int, n long, low long, high long, total decimal(38,0)")
    sums = parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))
    # The longest of the commonest lengths; a row for each of its dimensions.
    best = sums.groupBy("dims").agg(F.max("n").alias("m")).orderBy(F.desc("m"), F.desc("dims")).limit(1).select("dims")
    found = sums.join(F.broadcast(best), "dims").collect()
    found.sort(key=lambda r: r["i"])
    return (found[0]["dims"] if found else 0), [(r["n"], r["low"], r["high"], int(r["total"])) for r in found]


def scatter(rows: DataFrame, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sums over all rows of (x - low)_i * (x - low)_j, as a matrix of Python integers."""
    d = len(low)
    # Wide or long-ranged vectors have many planes: fewer rows at once, 64 at least.
    most = max(8 * d * 64, min(SLICE, PLANES // max(1, int(width.sum())) * 8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((d, d), dtype=object), False
        for b in batches:
            for _, x in _entries(b, d, most):
                total, some = total + cross_products(x, low, width), True
        if some:
            i, j = np.triu_indices(d)
            for a in range(0, len(i), 1 << 16):
                s = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(i[s], pa.int32()), pa.array(j[s], pa.int32()), pa.array([Decimal(int(v)) for v in total[i[s], j[s]]], pa.decimal128(38, 0))], names=["i", "j", "v"])

    parts = rows.select("vector").mapInArrow(run, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("v", _EXACT)]))
    out = np.zeros((d, d), dtype=object)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dims * (dims + 1) / 2 rows
        out[i, j] = out[j, i] = int(v)
    return out


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """From usable rows with a column `vector` of one length."""
    d, each = _totals(rows)
    if not d:
        return None
    n, low = each[0][0], np.array([e[1] for e in each], np.int64)
    width = np.array([(e[2] - e[1]).bit_length() for e in each])
    products = scatter(rows.where(F.size("vector") == d), low, width)
    shifted = np.array([e[3] - n * e[1] for e in each], dtype=object)
    centred = n * products - np.outer(shifted, shifted)
    # Python divides integers with one rounding.
    cov = np.array([[v / (n * n) for v in row] for row in centred.tolist()], np.float64)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: min(components, d)]
    trace = sum(centred[i, i] for i in range(d)) / (n * n)
    values, axes = values[order], axes[:, order]
    flat = values <= FLAT * trace
    return Whitening(n, [e[3] for e in each], axes, values, [float(v / trace) if trace > 0 else None for v in np.maximum(values, 0)], flat)


def whiten(df: DataFrame, vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row of df without its vector for each usable row and component: component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    kept = without(df, *OUT)
    kept_names = [c for c in kept.columns if c.lower() != vector.lower()]
    plain = usable(df.select(F.struct(*[F.col(f"`{c}`") for c in kept_names] or [F.lit(0).alias("0")]).alias("r"), F.col(f"`{vector}`").alias("v")), "v").select("r", "vector")
    model = fit(plain, components)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return kept.select(*[F.col(f"`{c}`") for c in kept_names]).where("false").selectExpr("*", *[f"cast(null as {k.split()[1]}) as {k.split()[0]}" for k in kinds.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _entries(b, model.dims):
                w = model.whiten(x)
                sq = [v if v < 1 << 63 else None for v in model.squared(x)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sq, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))], names=["r", "deviation", "w"])

    schema = T.StructType([plain.schema["r"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    done = Stored(spark).write(plain.where(F.size("vector") == model.dims).mapInArrow(run, schema))
    error = identity_error(done, [k for k in range(len(model.values)) if not model.flat[k]])
    pieces = done.select("r", "deviation", F.posexplode("w").alias("k", "value"))
    flat, share = F.array(*[F.lit(bool(f)) for f in model.flat]), F.array(*[F.lit(e).cast("double") for e in model.explained])
    return pieces.select(
        *[F.col(f"r.`{c}`") for c in kept_names], (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.get(flat, F.col("k")), F.col("value")).alias("whitened"), F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(done: DataFrame, which: list[int]) -> float:
    """Largest entry of the covariance of w minus the identity, over all rows and the given components; means first, then centred products."""
    if not which:
        return 0.0
    means = done.agg(*[F.avg(F.get("w", F.lit(k))).alias(f"m{k}") for k in which]).first()
    c = lambda k: F.get("w", F.lit(k)) - F.lit(means[f"m{k}"])
    pairs = [(i, j) for i in which for j in which if i <= j]
    cov = done.agg(*[F.avg(c(i) * c(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
