"""Near-duplicate texts: one-permutation MinHash with optimal densification, banded buckets, exact check.

A text's set holds the hashes of its distinct shingles; texts with equal sets form classes, of which one
goes on. One hash of each shingle picks a bin by its top bits and the least value per bin is the
signature; an empty bin takes the value of the first filled bin in an order that only the bin decides, so
each bin agrees with the probability of the sets' similarity. BANDS bands of ROWS bins give buckets.
Candidates are stars: an edge from each text to the smallest id of its bucket. Edges whose signatures agree
enough (or whose sets are too small to tell) are checked on the full sets, in blocks of one centre. What is
linked so is settled. Where a bucket still holds texts of different components, those outside its largest
component are compared by signature with all of it; texts that agree across components form neighbourhoods,
and in these the full sets are intersected, again only across components and in order of likeness. A bucket
of near copies that all link to its centre costs one check for each text; components of links are the result.

Defined results: null and empty texts and texts without words have an empty set and no links; texts with
fewer words than a shingle have one shingle of all words; rows that share an id are one document, linked
with all that any of its texts is linked with; null ids link with nothing; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, map_arrow, utf8_slices
from .components import bucket_stars, connected, cross_blocks, labels_of, map_blocks, star_blocks, star_edges
from .rolling import RangeHash, mix

BIN_BITS = 7
BINS = 1 << BIN_BITS
ROWS = 4
BANDS = BINS // ROWS
#: Sets below this size are too small for their signatures to tell how alike they are.
SMALL = 64
#: Of BINS bins, agreement below this is over six standard deviations from a similarity of 0.8.
LEAST_AGREE = 0.56
#: Rows of a block of signatures, of full sets across components, and of one centre's members.
BUCKET, BLOCK, MEMBERS = 1024, 512, 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.stack([np.random.default_rng((78, b)).permutation(BINS) for b in range(BINS)])


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never crosses texts."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_BLANK[raw]
    step = np.diff(solid)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = np.unique(off[1:-1])
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[(solid[cut] == 1) & (solid[cut + 1] == 1)]
    return (np.sort(np.r_[a, cut]), np.sort(np.r_[b, cut])) if len(cut) else (a, b)


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts end to end, sorted within each, and n + 1 bounds."""
    n, low = len(off) - 1, _LOWER[raw]
    a, b = words(low, off)
    h = RangeHash(low).ranges(a, b)
    doc = np.searchsorted(off, a, side="right") - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    m = max(0, len(h) - k + 1)
    s = np.zeros(m, np.uint64)
    for j in range(k):
        s += h[j : j + m] * _ODD[j]
    whole = doc[:m] == doc[k - 1 :][:m]
    s, owner = mix(s[whole]), doc[:m][whole]
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        extra = mix(np.array([(h[first[d] : first[d] + count[d]] * _ODD[: count[d]]).sum(dtype=np.uint64) for d in few.tolist()], np.uint64) + _ODD[32 + count[few]])
        s, owner = np.r_[s, extra], np.r_[owner, few]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    if len(s):
        new = np.r_[True, (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])]
        s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(n + 1))


def signatures(s: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """(n, BINS) one-permutation signatures with optimal densification; rows of empty sets are 0."""
    n = len(bound) - 1
    out, filled = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    owner = np.repeat(np.arange(n), np.diff(bound))
    at = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    if len(s):
        # Sorted hashes come bin by bin, the least first.
        new = np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]
        out[owner[new], at[new]], filled[owner[new], at[new]] = mix(s[new] << np.uint64(BIN_BITS)), True
    i, b = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for k in range(BINS):
        if not len(i):
            break
        source = _ORDERS[b, k]
        hit = filled[i, source]
        out[i[hit], b[hit]] = out[i[hit], source[hit]]
        i, b = i[~hit], b[~hit]
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in utf8_slices(batches):
            s, bound = shingles(raw, off, k)
            n = np.diff(bound)
            sums = []
            for odd in (1, 2):
                total = np.zeros(len(s) + 1, np.uint64)
                np.cumsum(mix(s * _ODD[60 + odd]), out=total[1:])
                sums.append((total[bound[1:]] - total[bound[:-1]]).view(np.int64))
            sig = signatures(s, bound)
            keys = np.zeros((len(n), BANDS), np.uint64)
            for r in range(ROWS):
                keys = mix(keys + sig[:, r::ROWS] * _ODD[40 + r])
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _ODD[50])
            low = (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array([x.tobytes() for x in keys], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "n", "g", "h", "bands", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["bucket", "id"])


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal bins for each row of x against each of y, less what chance gives bytes."""
    same = np.empty((len(x), len(y)), np.float32)
    for i in range(len(x)):
        same[i] = (x[i] == y).mean(axis=1)
    return (same - 1 / 256) / (1 - 1 / 256)


def _likely(n: np.ndarray, sketch: np.ndarray, few: np.ndarray, every: np.ndarray, root: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the rows few x every with different roots that may reach the similarity, and how much they agree."""
    a, b, how = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for s in range(0, len(few), 128):
        x = few[s : s + 128]
        like = agreement(sketch[x], sketch[every])
        low, high = np.minimum(n[x, None], n[None, every]), np.maximum(n[x, None], n[None, every])
        i, j = np.nonzero((low >= share * high - 1e-9) & ((low < SMALL) | (like >= LEAST_AGREE)) & (root[x, None] != root[None, every]))
        a.append(x[i])
        b.append(every[j])
        how.append(like[i, j])
    return np.concatenate(a), np.concatenate(b), np.concatenate(how)


def _star_filter(share: float):
    """Edges (u, v) whose sketches and set sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, n, m, x, y = b.columns
            n, m = n.to_numpy(), m.to_numpy()
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, BINS) for c in (x, y))
            like = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            low = np.minimum(n, m)
            keep = (low >= share * np.maximum(n, m) - 1e-9) & ((low < SMALL) | (like >= LEAST_AGREE))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep))

    return run


def _bucket_agreement(share: float):
    """Star edges between the texts of a block that agree across roots."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids, n, root, small = (t[c].to_numpy() for c in ("id", "n", "root", "small"))
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        # A text may stand here twice, among the few and among all.
        names, at = np.unique(ids, return_inverse=True)
        a, b, _ = _likely(n, sketch, np.flatnonzero(small), np.flatnonzero(~small), root, share)
        return star_edges(names, labels_of(len(names), at[a], at[b]))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, off in utf8_slices(batches):
            s, bound = shingles(raw, off, k)
            low = (signatures(s, bound) & np.uint64(255)).astype(np.uint8)
            at = bound.tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "set", "sketch"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _check_stars(percent: int):
    """Links of a centre with the members in its block."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids, small = t["id"].to_numpy(), t["small"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        centre = np.flatnonzero(~small).tolist()  # one row for each of its texts
        u = [int(ids[i]) for i in np.flatnonzero(small).tolist() if any(_alike(sets[i], sets[c], percent) for c in centre)]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([int(ids[centre[0]])] * len(u), pa.int64())], names=["u", "v"]) if u else None

    return run


def _check_across(percent: int):
    """Links of a block across roots, fewest that connect them."""

    def run(t: pa.Table) -> pa.RecordBatch | None:
        ids, small, old = (t[c].to_numpy() for c in ("id", "small", "root"))
        sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
        a, b, how = _likely(np.array([len(x) for x in sets]), sketch, np.flatnonzero(small), np.flatnonzero(~small), old, percent / 100)
        order = np.argsort(-how, kind="stable")
        names, at = np.unique(old, return_inverse=True)
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        u, v = [], []
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if (p := find(at[i])) != (q := find(at[j])) and _alike(sets[i], sets[j], percent):
                root[max(p, q)] = min(p, q)
                u.append(ids[i])
                v.append(ids[j])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]) if u else None

    return run


def near_texts(df: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept for each row of df; links are pairs of sets with 100 * intersection >= percent * union."""
    store = Stored(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sketched = store.write(map_arrow(rows, _sketch(shingle), "id long, n long, g long, h long, bands binary, sketch binary"))
    usable = F.col("id").isNotNull() & (F.col("n") > 0)
    # Tables get files by these: texts, their rows in buckets, and bytes of their sets.
    n_texts, n_bytes = sketched.where(usable).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)) * 8).first()
    n_banded = n_texts * BANDS
    classes = store.write(sketched.where(usable).groupBy("g", "h").agg(F.min("id").alias("rep")), n_texts)
    # An id may stand for several classes, with a row for each.
    reps = store.write(sketched.where(usable).join(classes, ["g", "h"]).where("id = rep").dropDuplicates(["id", "g", "h"]).select("id", "n", "bands", "sketch"), n_texts, n_texts * (8 * BANDS + BINS))
    several_texts = sketched.where(usable).groupBy("id").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("h").alias("h0"), F.max("h").alias("h1")).where("g0 < g1 or h0 < h1").select("id")
    same = store.write(sketched.where(usable).select("id", "g", "h").join(several_texts, "id").join(classes, ["g", "h"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct(), n_texts)
    banded = map_arrow(reps.select("id", "bands"), _bands, "bucket long, id long", 2000)
    several, stars = bucket_stars(banded, store, n_banded)
    ends = stars.join(reps.select(F.col("id").alias("u"), "n", "sketch"), "u").join(reps.select(F.col("id").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("other")), "v")
    likely = store.write(map_arrow(ends.select("u", "v", "n", "m", "sketch", "other"), _star_filter(percent / 100), "u long, v long", 2000).distinct(), n_banded)
    # Stored first, so that Spark knows whether its size allows a broadcast before it shuffles the texts.
    involved = store.write(several.select("id").distinct(), n_texts)
    sets = store.write(map_arrow(rows.join(involved, "id").dropDuplicates(["id", "text"]).select("id", "text"), _sets(shingle), "id long, set binary, sketch binary"), n_texts, n_bytes)
    # Links are made distinct, so that the few files are not the tasks that compare.
    links = store.write(map_blocks(star_blocks(likely, sets.drop("sketch"), MEMBERS), "component", _check_stars(percent), "u long, v long", 200).unionByName(same).distinct(), n_banded)
    store.drop(likely, involved, same)
    first = store.write(connected(links, store, n_banded).select(F.col("node").alias("id"), F.col("component").alias("root")), n_texts)
    rooted = lambda ids: ids.join(first, "id", "left").withColumn("root", F.coalesce("root", "id"))
    met = cross_blocks(rooted(several), "bucket", "id", "root", BUCKET).join(reps.select("id", "n", "sketch"), "id")
    agreeing = map_blocks(met, "bucket", _bucket_agreement(percent / 100), "u long, v long", 2000)
    around = store.write(rooted(connected(agreeing, store, n_banded).select(F.col("node").alias("id"), "component")), n_texts)
    store.drop(several)
    across = store.write(map_blocks(cross_blocks(around, "component", "id", "root", BLOCK).join(sets, "id"), "component", _check_across(percent), "u long, v long", 200).distinct(), n_texts)
    store.drop(sets, around)
    root = store.write(connected(links.unionByName(across), store, n_banded).select(F.col("node").alias("rep"), "component"), n_texts)
    store.drop(links, across, first, reps)
    named = classes.join(root, "rep", "left").select("g", "h", F.coalesce("component", "rep").alias("component"))
    # Rows without a set are spread by their id; they join with nothing.
    slim = sketched.select("id", "n", F.when(usable, F.col("g")).otherwise(F.xxhash64("id")).alias("g"), F.when(usable, F.col("h")).alias("h"))
    done = slim.join(named, ["g", "h"], "left").withColumn("c", F.coalesce("component", "id"))
    return done.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("c") == F.col("id"), F.lit(True)).alias("kept"))
