"""Document quality from a linear-chain conditional random field over lines.

Each line gets binned features of its bytes; its emission score for "good" sums weights of its own bins
and of those of the line before and the line after. Forward-backward gives each line's marginal; their
mean, weighted by line length, is put on the scale of the labels by a logistic curve. The field is fitted
on the driver from at most `most_docs` labelled documents of at most `most_lines` lines each, chosen by
hash; a document's label stands for each of its lines.

Defined results: null and empty texts are one empty line and get a score like any other; without
labelled rows every weight is 0 and every score 0.5; repeated rows score alike; null labels aren't used;
columns named as outputs are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, utf8_slices, without
from .rolling import RangeHash

BINS = 8
#: Byte classes, three counters of 21 bits to a 64-bit word.
_CLASSES = [
    [chr(c) for c in range(65, 91)], [chr(c) for c in range(97, 123)], list("0123456789"),
    list("#*$%&<>|"), list("!?"), list("|"),
    list(" \t\r\x0b\x0c"), list(".,;:"), [],
]
_FIELD = 21
_TABLES = np.zeros((3, 256), np.uint64)
for _i, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _TABLES[_i // 3, ord(_c)] += np.uint64(1 << (_FIELD * (_i % 3)))
_TABLES[2, 128:] += np.uint64(1 << (2 * _FIELD))
_SHARES = np.array([0.001, 0.01, 0.03, 0.08, 0.2, 0.5, 0.9])
_LENGTHS = np.array([1, 8, 24, 64, 160, 400, 1200])
_WORDS = np.array([2, 3, 4, 5, 6.5, 8, 12])
FEATURES = 12
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def line_features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines, FEATURES), lines per text, and line weights (bytes + 1)."""
    breaks = np.flatnonzero(raw == 10)
    n_lines = np.searchsorted(breaks, off[1:], side="left") - np.searchsorted(breaks, off[:-1], side="left") + 1
    first = np.cumsum(n_lines) - n_lines
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    inner = np.arange(len(breaks)) + 1 + np.searchsorted(off[1:], breaks, side="right")
    start, end = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    start[first], start[inner] = off[:-1], breaks + 1
    end[first + n_lines - 1], end[inner - 1] = off[1:], breaks
    counts = []
    for table in _TABLES:
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw], out=sums[1:])
        span = sums[end] - sums[start]
        counts += [((span >> np.uint64(_FIELD * k)) & np.uint64((1 << _FIELD) - 1)).astype(np.float64) for k in range(3)]
    for i in np.flatnonzero(end - start >= 1 << _FIELD).tolist():  # lines that a counter can't hold
        seen = np.bincount(raw[start[i] : end[i]], minlength=256)
        for k in range(9):
            counts[k][i] = seen @ (_TABLES[k // 3] >> np.uint64(_FIELD * (k % 3)) & np.uint64(1)).astype(np.int64)
    upper, lower, digit, symbol, shout, bar, blank, stop, high = counts
    size = (end - start).astype(np.float64)
    some = np.maximum(size, 1)
    h = RangeHash(raw).ranges(start, end)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(doc), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    words, stutter = _stutter(raw, off, start)
    share = lambda x: np.searchsorted(_SHARES, x, side="right")
    bins = np.stack([
        np.searchsorted(_LENGTHS, size, side="right"), share(upper / np.maximum(upper + lower, 1)), share(digit / some), share(symbol / some), share(shout / some), share(bar / some),
        np.searchsorted(_WORDS, (size - blank) / (blank + 1), side="right"), share(high / some), share(stop / some), np.where(again & (size > 0), 1, 0), np.where(np.arange(len(doc)) == first[doc], 1, 0), share(stutter / np.maximum(words, 1)),
    ], axis=1).astype(np.uint8)
    return bins, n_lines, size + 1


def _stutter(raw: np.ndarray, off: np.ndarray, line_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each line, and how many of them equal the word before them."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_BLANK[raw]
    step = np.diff(solid)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = np.setdiff1d(off[1:-1], a)  # texts that touch: a word ends and another begins
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[(solid[cut] == 1) & (solid[cut + 1] == 1)]
    if len(cut):
        a, b = np.sort(np.r_[a, cut]), np.sort(np.r_[b, cut])
    line = np.searchsorted(line_start, a, side="right") - 1
    h = RangeHash(raw).ranges(a, b)
    same = np.zeros(len(a), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    n = len(line_start)
    return np.bincount(line, minlength=n), np.bincount(line[same], minlength=n)


def _neighbours(bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Column indices (lines, 3 * FEATURES) of own, previous and next bins; outside a text the index of an unused weight."""
    cell = np.arange(FEATURES) * BINS + bins
    none = 3 * FEATURES * BINS
    before, after = np.full_like(cell, none), np.full_like(cell, none)
    before[1:], after[:-1] = cell[:-1] + FEATURES * BINS, cell[1:] + 2 * FEATURES * BINS
    first = np.cumsum(n_lines) - n_lines
    before[first], after[first + n_lines - 1] = none, none
    return np.concatenate([cell, before, after], axis=1)


def forward_backward(emit: np.ndarray, n_lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of "good" from the left (own emission included) and from the right, for all texts side by side. trans[i, j]: exp of the score of i -> j."""
    order = np.argsort(-n_lines, kind="stable")
    first, n = (np.cumsum(n_lines) - n_lines)[order], n_lines[order]
    most = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, most + 1), side="right")  # texts with more than t lines
    left, right = np.empty_like(emit), np.zeros_like(emit)
    step = lambda x, m: np.log((np.exp(x) * m[1, 1] + m[0, 1]) / (np.exp(x) * m[1, 0] + m[0, 0]))
    for t in range(most):
        at = first[: live[t]] + t
        left[at] = np.clip(emit[at] + (step(left[at - 1], trans) if t else 0), -30, 30)
    for t in range(most - 2, -1, -1):
        at = first[: live[t + 1]] + t
        right[at] = step(np.clip(emit[at + 1] + right[at + 1], -30, 30), trans.T)
    return left, right


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def blank(cls) -> LineField:
        return cls(np.zeros(3 * FEATURES * BINS + 1), np.ones((2, 2)))

    def marginals(self, bins: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        left, right = forward_backward(self.weights[_neighbours(bins, n_lines)].sum(axis=1), n_lines, self.trans)
        return 1 / (1 + np.exp(-(left + right)))

    def quality(self, bins: np.ndarray, n_lines: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.marginals(bins, n_lines)
        first = np.cumsum(n_lines) - n_lines
        q = np.add.reduceat(p * size, first) / np.add.reduceat(size, first) if len(n_lines) else np.zeros(0)
        return q, p

    def score(self, q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.shift)))


def _fit(bins: np.ndarray, n_lines: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int, l2: float = 1e-3) -> LineField:
    """Gradient ascent (Adam) on the conditional likelihood of the lines' labels."""
    field = LineField.blank()
    if not len(label) or label.min() == label.max():
        return field
    cells, y = _neighbours(bins, n_lines), np.repeat(label.astype(np.float64), n_lines)
    first = np.cumsum(n_lines) - n_lines
    later = np.ones(len(y), bool)
    later[first] = False
    now = np.flatnonzero(later)
    # Each document weighs as much as any other, and each label as much as the other.
    share = label.mean()
    weight = np.repeat(np.where(label == 1, 0.5 / share, 0.5 / (1 - share)) / n_lines, n_lines) / len(label)
    moves = np.zeros((2, 2))
    m = [np.zeros_like(field.weights), np.zeros((2, 2))]
    v = [np.zeros_like(field.weights), np.zeros((2, 2))]
    seen = np.stack([np.bincount(2 * y[now - 1].astype(int) + y[now].astype(int) == k, weights=weight[now], minlength=2)[1] for k in range(4)]).reshape(2, 2)
    for k in range(1, rounds + 1):
        trans = np.exp(moves)
        left, right = forward_backward(field.weights[cells].sum(axis=1), n_lines, trans)
        error = (y - 1 / (1 + np.exp(-(left + right)))) * weight
        grad = np.bincount(cells.ravel(), weights=np.repeat(error, cells.shape[1]), minlength=len(field.weights)) - l2 * field.weights / len(label)
        grad[-1] = 0
        a, b = left[now - 1], field.weights[cells[now]].sum(axis=1) + right[now]
        joint = np.stack([trans[0, 0] * np.ones_like(a), trans[0, 1] * np.exp(b), trans[1, 0] * np.exp(a), trans[1, 1] * np.exp(a + b)])
        expected = (joint / joint.sum(axis=0) * weight[now]).sum(axis=1).reshape(2, 2)
        for i, (x, g) in enumerate(((field.weights, grad), (moves, seen - expected))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x += 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-9)
        np.clip(moves, -3, 3, out=moves)
    field.trans = np.exp(moves)
    q, _ = field.quality(bins, n_lines, size)
    z = np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    a, b = 1.0, 0.0
    for _ in range(30):  # Newton steps of a logistic regression with a weak pull to (1, 0)
        p = 1 / (1 + np.exp(-(a * z + b)))
        r = p * (1 - p)
        g = np.array([((label - p) * z).sum() - (a - 1), (label - p).sum() - b])
        hess = np.array([[(r * z * z).sum() + 1, (r * z).sum()], [(r * z).sum(), r.sum() + 1]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
    field.slope, field.shift = float(a), float(b)
    return field


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw, off in utf8_slices(batches):
        bins, n_lines, size = line_features(raw, off)
        at = np.r_[0, np.cumsum(n_lines)]
        yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("key")), part.column(part.schema.get_field_index("label")), pa.array(n_lines, pa.int64()),
                                          pa.array([bins[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()), pa.array([size[a:b].astype(np.int64).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=["key", "label", "n", "bins", "size"])


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_docs: int = 6000, most_lines: int = 2000, rounds: int = 60) -> LineField:
    """A field from labelled documents that aren't held out; the sample's bounds are most_docs and most_lines."""
    named = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(~held_out(F.col("key"))).groupBy("key").agg(F.min("label").alias("label"))
    chosen = named.orderBy(F.xxhash64("key"), "key").limit(most_docs)
    # At most most_docs rows of two numbers.
    sample = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key")
    kind = sample.schema["key"].dataType.simpleString()
    rows = map_arrow(sample, _packed, f"key {kind}, label int, n long, bins binary, size binary").where(F.col("n") <= most_lines).dropDuplicates(["key"]).toPandas().sort_values("key")
    if rows.empty:
        return LineField.blank()
    bins = np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(-1, FEATURES)
    return _fit(bins, rows["n"].to_numpy(np.int64), np.frombuffer(b"".join(rows["size"]), np.int64).astype(np.float64), rows["label"].to_numpy(np.int64), rounds)


def classify(df: DataFrame, field: LineField, text: str = "text", threshold: float = 0.3, lines: bool = False, keep_text: bool = True) -> DataFrame:
    """df (without its text unless keep_text) with score and predicted, and with lines also line_marginals (array<float>, one for each line)."""
    out = ["score", "predicted", *(["line_marginals"] if lines else [])]
    kept = without(df, *out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in utf8_slices(batches, "_text"):
            bins, n_lines, size = line_features(raw, off)
            q, p = field.quality(bins, n_lines, size)
            score = field.score(q)
            cols = [part.column(0), *([part.column(1)] if keep_text else []), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            if lines:
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_lines)].astype(np.int32)), pa.array(p.astype(np.float32))))
            yield pa.RecordBatch.from_arrays(cols, names=["r", *(["_text"] if keep_text else []), *out])

    other = [c for c in kept.columns if c.lower() != text.lower()]
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in other] or [F.lit(0).alias("_")]).alias("r"), F.col(f"`{text}`").cast("string").alias("_text"))
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *([T.StructField("line_marginals", T.ArrayType(T.FloatType()))] if lines else [])]
    done = map_arrow(rows, run, T.StructType([rows.schema["r"], *([T.StructField("_text", T.StringType())] if keep_text else []), *extra]))
    back = [F.col("_text").alias(c) if c.lower() == text.lower() else F.col(f"r.`{c}`") for c in kept.columns if keep_text or c.lower() != text.lower()]
    return done.select(*back, *out)
