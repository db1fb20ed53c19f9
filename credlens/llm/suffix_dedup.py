"""Removal of byte strings that documents with smaller ids hold, through maximal repeats of enhanced suffix arrays.

Every window of WINDOW bytes has a minimizer: the least hash of the SEED-byte strings in it. Runs of
windows with one minimizer are cut out as segments and dealt to buckets by it, so equal windows meet in a
bucket wherever they stand. In a bucket equal segments are kept once, with their occurrences; one that
occurs several times stands in the suffix array twice. Windows whose hash occurs once are put aside; the
suffixes at the others are sorted, with their longest common prefixes, and a stack scan of those finds the
intervals of the common-prefix tree. An interval whose suffixes have different left neighbours (the start
of a segment differs from anything) is a repeat; it goes out with all its occurrences. Bytes under an
occurrence go if another one stands in a document with a smaller id. Matches never cross segments' ends, but
segments overlap by all but one byte of a window, so the union over buckets is that over whole texts.
Segments that one slice of texts holds FREQUENT times are resolved in a suffix array of the slice, and only
those of its smallest id go on to their bucket, so that a passage of very many documents fills none.

`maximal_repeats` goes on from there to whole texts: the stretches of each document whose windows all repeat
are its suffixes' ends, and the suffixes at windows with different left neighbours in the texts are sorted
whole, one group for each window, equal ones once; the same stack scan gives the maximal repeats of any length.

Defined results: null counts as empty text; texts shorter than a window lose nothing; rows that share an
id are taken for repeats of one document, and null ids for one document behind all others; an empty table
gives an empty table. `maximal_repeats` takes one row of each id and leaves out null ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, map_arrow, parts_for, utf8_slices
from .rolling import RangeHash, mix

WINDOW, SEED = 50, 12
SPAN = WINDOW - SEED + 1
LAST_ID = np.iinfo(np.int64).max
#: Bytes of text for each bucket; they keep a task's memory level.
BUCKET_TEXT = 4 << 20
#: Bytes that are hashed at once, and windows that are cut at once.
HASH_BYTES, CUT_WINDOWS = 1 << 20, 1 << 22
#: How hard segments and texts are compressed for their shuffles.
LEVEL = 6
#: A segment that a slice holds so often is resolved there.
FREQUENT = 8
_POSITION = np.uint64(30)
Arrays = tuple[np.ndarray, ...]


def segments(raw: np.ndarray, off: np.ndarray) -> Arrays:
    """Starts, lengths and bucket hashes of the runs of windows that share a minimizer; windows never cross texts. A run may be cut in two, where the work is, too."""
    parts = []
    for i in range(0, max(1, len(raw) - WINDOW + 1), CUT_WINDOWS):
        end = min(len(raw), i + CUT_WINDOWS + WINDOW - 1)
        inner = off[np.searchsorted(off, i, side="right") : np.searchsorted(off, end, side="left")] - i
        start, length, h = _segments(raw[i:end], np.r_[0, inner, end - i])
        parts.append((start + i, length, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(raw: np.ndarray, off: np.ndarray) -> Arrays:
    n = len(raw) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = RangeHash(raw).windows(SEED)
    # The first of equal hashes counts: the position stands in the low bits.
    low = (h >> np.uint64(34) << _POSITION) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n], low[SPAN - size :][: n])
    at = (low & np.uint64((1 << 30) - 1)).astype(np.int64)
    ok = np.ones(n + 1, bool)
    ok[n] = False
    ends = off[1:-1]
    for k in range(1, WINDOW):  # starts whose window would reach beyond their text
        bad = ends - k
        ok[bad[(bad >= 0) & (bad < n)]] = False
    new = ok[:-1].copy()
    new[1:] &= ~ok[:-2] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    # A run ends before the next run or the next window that isn't one.
    stop = np.flatnonzero(np.r_[(ok[:-1] & (~ok[1:] | np.r_[new[1:], True]))])
    return first, stop - first + WINDOW, mix(h[at[first]] + np.uint64(12345))


def _gather(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    to = np.cumsum(length)
    idx = np.ones(int(to[-1]) if len(to) else 0, np.int64)
    if len(idx):
        idx[0] = start[0]
        idx[to[:-1]] = start[1:] - start[:-1] - length[:-1] + 1
    return raw[np.cumsum(idx)]


def _planes(x: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane, for compression."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplanes(data: bytes, at: int, n: int, dtype: str) -> tuple[np.ndarray, int]:
    kind = np.dtype(dtype)
    d = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
    return np.cumsum(np.ascontiguousarray(d.T).view(kind).ravel(), dtype=kind), at + n * kind.itemsize


def _merged(batches: Iterator[pa.RecordBatch], least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes: a packed row for each bucket then holds more segments."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _packed_cuts(ids: np.ndarray, at: np.ndarray, long: np.ndarray, n_parts: int) -> list[tuple[int, bytes]]:
    """Removed runs (id, start, end) by part of the last stage, compressed."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    part = ids % n_parts
    order = np.lexsort((at, ids, part))
    part, ids, at, end = part[order], ids[order], at[order], (at + long)[order]
    edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    return [(int(part[s]), press.compress(np.array([e - s], np.int64).tobytes() + _planes(ids[s:e]) + _planes(at[s:e]) + _planes(end[s:e]))) for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False)]


def _unpacked_cuts(data: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, at = _unplanes(data, 8, n, "<i8")
    start, at = _unplanes(data, at, n, "<i8")
    end, _ = _unplanes(data, at, n, "<i8")
    return np.stack([ids, start, end])


BUCKETED = "bucket long, meta binary, bytes binary, part long, cut binary"


def _resolved(raw: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, Arrays]:
    """Which segments go on to their bucket, and the removed runs (id, start, length) of the others, which are frequent here and stand in a document with a smaller id too."""
    key = RangeHash(raw).ranges(start, start + length)
    _, group, times = np.unique(key, return_inverse=True, return_counts=True)
    hot = np.flatnonzero(times[group] >= FREQUENT)
    none = np.ones(len(start), bool), (np.zeros(0, np.int64),) * 3
    if not len(hot):
        return none
    off = np.r_[0, np.cumsum(length[hot])]
    _, long, who, at, low = bucket_repeats(_gather(raw, start[hot], length[hot]), off, ids[hot], pos[hot])
    least = np.full(len(times), LAST_ID)
    np.minimum.at(least, group[hot], ids[hot])
    on = none[0]
    on[hot] = ids[hot] <= least[group[hot]]
    gone = who > low
    return on, (who[gone], at[gone], long[gone])


def _cut(n_buckets: int, n_parts: int | None = None):
    """Packed segments by bucket; with n_parts also what a slice resolves itself, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL)
        for part, raw, off in utf8_slices(_merged(batches)):
            names = part.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            start, length, h = segments(raw, off)
            if not len(start):
                continue
            doc = np.searchsorted(off, start, side="right") - 1
            out: list[tuple] = []
            if n_parts is not None:
                on, cuts = _resolved(raw, start, length, names[doc], start - off[doc])
                start, length, h, doc = start[on], length[on], h[on], doc[on]
                out += [(p % n_buckets, None, None, p, c) for p, c in (_packed_cuts(*cuts, n_parts) if len(cuts[0]) else [])]
            bucket = (h % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            start, length, bucket, doc = start[order], length[order], bucket[order], doc[order]
            new = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            for s, e in zip(new.tolist(), new[1:].tolist(), strict=False):
                docs, local = np.unique(doc[s:e], return_inverse=True)
                head = np.array([e - s, len(docs)], np.int64).tobytes()
                meta = head + _planes(names[docs]) + _planes(local.astype(np.uint32)) + _planes((start[s:e] - off[doc[s:e]]).astype(np.uint32)) + length[s:e].astype(np.uint8).tobytes()
                out.append((int(bucket[s]), press.compress(meta), press.compress(_gather(raw, start[s:e], length[s:e]).tobytes()), None, None))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "meta", "bytes", "part", "cut"])

    return run


def _unpack(metas: list[bytes], texts: list[bytes]) -> Arrays:
    """All segments of a bucket: bytes end to end, offsets, document ids, positions."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    raws, lens, ids, pos = [], [], [], []
    for m, t in zip(metas, texts, strict=True):
        data = press.decompress(m)
        n, d = np.frombuffer(data, np.int64, 2).tolist()
        docs, at = _unplanes(data, 16, d, "<i8")
        local, at = _unplanes(data, at, n, "<u4")
        p, at = _unplanes(data, at, n, "<u4")
        lens.append(np.frombuffer(data, np.uint8, n, at).astype(np.int64))
        ids.append(docs[local])
        pos.append(p.astype(np.int64))
        raws.append(np.frombuffer(press.decompress(t), np.uint8))
    length = np.concatenate(lens)
    return np.concatenate(raws), np.r_[0, np.cumsum(length)], np.concatenate(ids), np.concatenate(pos)


def _chunks(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of segments with at most HASH_BYTES bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + HASH_BYTES, side="right")) - 1)
        yield i, j
        i = j


def lcp_intervals(root: np.ndarray, lcp: np.ndarray, low: np.ndarray, varied: np.ndarray) -> Arrays:
    """Stack scan of sorted suffixes: depth, first, last and least document of each interval of the common-prefix tree that is deep enough and whose left neighbours differ. lcp[i]: with the suffix before, 0 at a root's first; varied: running count of changes of the left neighbour."""
    depth_out, first_out, last_out, low_out = [], [], [], []
    n = len(root)
    lcps, lows, changes = [*lcp.tolist(), 0], low.tolist(), varied.tolist()
    stack: list[list[int]] = []
    for i in range(1, n + 1):
        d, lb, least = lcps[i], i - 1, lows[i - 1]
        while stack and stack[-1][0] > d:
            depth, lb, least_in = stack.pop()
            least = min(least, least_in)
            if changes[i - 1] > changes[lb]:
                depth_out.append(depth)
                first_out.append(lb)
                last_out.append(i - 1)
                low_out.append(least)
        if d >= WINDOW:
            if stack and stack[-1][0] == d:
                stack[-1][2] = min(stack[-1][2], least)
            else:
                stack.append([d, lb, least])
    return tuple(np.array(x, np.int64) for x in (depth_out, first_out, last_out, low_out))


def bucket_repeats(raw: np.ndarray, off: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> Arrays:
    """Maximal repeats of a bucket: repeat number, length, document id and position of each occurrence, and the least id that holds the repeat."""
    length = np.diff(off)
    h0, h1 = np.empty(len(length), np.uint64), np.empty(len(length), np.uint64)
    for i, j in _chunks(off):
        o = off[i : j + 1] - off[i]
        for which, h in enumerate((h0, h1)):
            h[i:j] = RangeHash(raw[off[i] : off[j]], which).ranges(o[:-1], o[1:])
    order = np.lexsort((ids, h1, h0))
    new = np.r_[True, (h0[order][1:] != h0[order][:-1]) | (h1[order][1:] != h1[order][:-1])]
    seg_first = np.flatnonzero(new)  # into order: occurrences of each distinct segment, by id
    n_occ = np.diff(np.r_[seg_first, len(order)])
    lead = order[seg_first]
    seg_low = ids[lead]
    text, seg_len = _gather(raw, off[:-1][lead], length[lead]), length[lead]
    seg_off = np.r_[0, np.cumsum(seg_len)]
    del h0, h1, raw
    # Windows of distinct segments whose hash occurs twice at least; a table of counts first, since most occur once.
    windows = seg_len - WINDOW + 1
    first_window = np.r_[0, np.cumsum(windows)]
    seg = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    inside = (np.arange(len(seg)) - np.repeat(first_window[:-1], windows)).astype(np.int32)
    start = (seg_off[:-1][seg] + inside).astype(np.int64)
    h = np.empty(len(seg), np.uint64)
    for i, j in _chunks(seg_off):
        w = slice(first_window[i], first_window[j])
        h[w] = RangeHash(text[seg_off[i] : seg_off[j]]).windows(WINDOW)[start[w] - seg_off[i]]
    # A segment that occurs several times has its first window, and with it the whole segment, in the array twice.
    copies = np.flatnonzero(n_occ > 1)
    extra = np.r_[np.zeros(len(seg), bool), np.ones(len(copies), bool)]
    seg, inside = np.r_[seg, copies.astype(np.int32)], np.r_[inside, np.zeros(len(copies), np.int32)]
    start, h = np.r_[start, seg_off[:-1][copies]], np.r_[h, h[first_window[:-1][copies]]]
    bits = max(10, int(len(h)).bit_length())
    cell = (h >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero((np.bincount(cell, minlength=1 << bits) >= 2)[cell])
    del cell
    by = maybe[np.argsort(h[maybe], kind="stable")]
    g = h[by]
    if len(g):
        same = np.r_[False, g[1:] == g[:-1]]
        twin = same | np.r_[same[1:], False]
        by, root = by[twin], np.cumsum(~same)[twin]
    else:
        by, root = by[:0], np.zeros(0, np.int64)
    # Left neighbours: a segment's first window has one of its own.
    left = np.where(inside[by] > 0, text[np.maximum(start[by] - 1, 0)].astype(np.int64), -1 - np.arange(len(by)))
    if len(by):
        edge = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        varied = np.minimum.reduceat(left, edge) != np.maximum.reduceat(left, edge)
        keep = np.repeat(varied, np.diff(np.r_[edge, len(root)]))
        by, root, left = by[keep], root[keep], left[keep]
    reach = seg_off[1:][seg[by]] - start[by]
    most = int(reach.max()) if len(by) else 0
    width = -(-max(most, 8) // 8) * 8
    cols = np.arange(width)
    body = np.zeros((len(by), width), np.uint8)
    for s in range(0, len(by), 1 << 16):
        at = start[by[s : s + (1 << 16)], None] + cols
        body[s : s + (1 << 16)] = np.where(cols < reach[s : s + (1 << 16), None], text[np.minimum(at, len(text) - 1)], 0)
    words = body.view(">u8").astype(np.uint64)
    order2 = np.lexsort((*(words[:, k] for k in range(words.shape[1] - 1, WINDOW // 8 - 1, -1)), root)) if len(by) else np.zeros(0, np.int64)
    by, root, left, reach, body = by[order2], root[order2], left[order2], reach[order2], body[order2]
    lcp = np.zeros(len(by), np.int64)
    if len(by) > 1:
        differ = body[1:] != body[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.where(root[1:] == root[:-1], np.minimum(first, np.minimum(reach[1:], reach[:-1])), 0)
    del body, words
    changes = np.cumsum(np.r_[0, left[1:] != left[:-1]]) if len(left) else np.zeros(0, np.int64)
    depth, lb, rb, least = lcp_intervals(root, lcp, seg_low[seg[by]], changes)
    # Members of intervals as (segment, place, length); a copy stands for occurrences that its twin puts out.
    size = rb - lb + 1
    member = np.repeat(lb - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    number, long, low = np.repeat(np.arange(len(depth)), size), np.repeat(depth, size), np.repeat(least, size)
    own = ~extra[by[member]]
    number, long, low, member = number[own], long[own], low[own], member[own]
    who, place = seg[by[member]], inside[by[member]]
    times = n_occ[who]
    occurrence = np.repeat(seg_first[who] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    at = order[occurrence]
    return np.repeat(number, times), np.repeat(long, times), ids[at], pos[at] + np.repeat(place, times), np.repeat(low, times)


def _per_bucket(give):
    """give on the arrays of each bucket, whose rows come together; what slices resolved passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, metas, texts = None, [], []
        for b in batches:
            passed = b.filter(b.column(4).is_valid())
            if passed.num_rows:
                yield passed.select(["part", "cut"])
            for k, m, t in zip(*[c.to_pylist() for c in b.columns[:3]], strict=True):
                if m is None:
                    continue
                if k != name and metas:
                    if (out := give(*bucket_repeats(*_unpack(metas, texts)))) is not None:
                        yield out
                    metas, texts = [], []
                name = k
                metas.append(m)
                texts.append(t)
        if metas and (out := give(*bucket_repeats(*_unpack(metas, texts)))) is not None:
            yield out

    return run


def _bucketed(rows: DataFrame, n_bytes: int, n_parts: int | None = None) -> DataFrame:
    n_buckets = max(64, -(-n_bytes // BUCKET_TEXT))
    cut = map_arrow(rows.select("id", "text"), _cut(n_buckets, n_parts), BUCKETED)
    # Segments hold some three times the text.
    return cut.repartition(parts_for(rows.sparkSession, 3 * n_bytes), "bucket").sortWithinPartitions("bucket")


def _rows(df: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows, rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _regions(text: bytes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a text's repeats, and for each the end of the stretch around it whose windows all repeat."""
    starts = np.array([s for s, _ in spans], np.int64)
    step = np.zeros(len(text) + 2, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + np.array([n for _, n in spans], np.int64) - WINDOW + 1, -1)
    alone = np.flatnonzero(np.cumsum(step) == 0)
    places = np.unique(starts)
    return places, alone[np.searchsorted(alone, places)] - 1 + WINDOW


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every start of a repeat: two hashes of its window, its left neighbour (-1: there is none) and its place."""
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for i, text, spans in zip(*[c.to_pylist() for c in b.columns], strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            at, _ = _regions(raw.tobytes(), [(x["start"], x["long"]) for x in spans])
            for k in (0, 1):
                cols[k].append(RangeHash(raw, k).ranges(at, at + WINDOW).view(np.int64))
            cols[2].append(np.where(at > 0, raw[np.maximum(at - 1, 0)].astype(np.int64), -1))
            cols[3].append(np.full(len(at), i))
            cols[4].append(at)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["a", "b", "left", "id", "at"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes at chosen places, up to the end of their stretch."""
    for batch in batches:
        for i, text, spans, chosen in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = (text or "").encode()
            end = dict(zip(*[x.tolist() for x in _regions(data, [(x["start"], x["long"]) for x in spans])], strict=True))
            rows = [(x["a"], x["b"], x["left"], i, x["at"], data[x["at"] : end[x["at"]]]) for x in chosen]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for s in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[s : s + 1000], strict=True), kinds, strict=True)], names=["a", "b", "left", "id", "at", "tail"])


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    u, v = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
    differ = np.flatnonzero(u != v)
    return int(differ[0]) if len(differ) else n


def _intervals(t: pa.Table) -> pa.Table:
    """The maximal repeats among the suffixes of one window: their length, and the suffixes (t) that begin with them."""
    rows = sorted(zip(t["tail"].to_pylist(), t["t"].to_pylist(), t["lefts"].to_pylist(), t["n"].to_pylist(), strict=True))
    # A suffix that occurs several times stands in the array twice.
    tails, names, left = [], [], []
    for tail, name, lefts, n in rows:
        for k in range(min(n, 2)):
            # Occurrences with one left neighbour differ in nothing; with several, or without one, they do.
            tails.append(tail)
            names.append(name)
            left.append(lefts[0] if len(lefts) == 1 and lefts[0] >= 0 else -1 - 2 * len(left) - k)
    lcp = np.array([0, *[_common(x, y) for x, y in zip(tails, tails[1:], strict=False)]], np.int64)
    side = np.array(left, np.int64)
    changes = np.cumsum(np.r_[0, side[1:] != side[:-1]])
    depth, lb, rb, _ = lcp_intervals(np.zeros(len(tails), np.int64), lcp, np.zeros(len(tails), np.int64), changes)
    out = [(t["a"][0].as_py(), t["b"][0].as_py(), nr, d, sorted(set(names[i : j + 1]))) for nr, (d, i, j) in enumerate(zip(depth.tolist(), lb.tolist(), rb.tolist(), strict=True))]
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.list_(pa.int64())), strict=True)], names=["a", "b", "nr", "length", "ts"])


def repeat_occurrences(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Maximal repeats of at least WINDOW bytes in all texts, one row for each occurrence: a and b (hashes of the first window) and nr name the repeat; id and start (in bytes) are the place. Rows with the same id and text count once; those that share only their id are texts of their own."""
    store = Stored(df.sparkSession)
    rows, n = _rows(df, text, key)
    # Each text under a name of its own.
    named = rows.where("id is not null").dropDuplicates(["id", "text"]).withColumn("uid", F.xxhash64("id", "text"))
    names = store.write(named.select(F.col("id").alias("own"), F.col("uid").alias("id")))
    rows = named.select(*[F.col("uid").alias("id") if c == "id" else F.col(c) for c in rows.columns])

    def give(_number, long, ids, at, _low):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), pa.array(long)], names=["id", "start", "long"]) if len(ids) else None

    found = store.write(map_arrow(_bucketed(rows, n), _per_bucket(give), "id long, start long, long long", 64).distinct())
    held = rows.join(found.groupBy("id").agg(F.collect_list(F.struct("start", "long")).alias("spans")), "id")
    starts = store.write(map_arrow(held.select("id", "text", "spans"), _starts, "a long, b long, left long, id long, at long"))
    varied = starts.groupBy("a", "b").agg(F.min("left").alias("low"), F.max("left").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1 and (low < high or low < 0)").select("a", "b")
    chosen = starts.join(varied, ["a", "b"]).groupBy("id").agg(F.collect_list(F.struct("a", "b", "left", "at")).alias("chosen"))
    tails = map_arrow(held.join(chosen, "id").select("id", "text", "spans", "chosen"), _tails, "a long, b long, left long, id long, at long, tail binary")
    tails = store.write(tails.withColumn("t", F.xxhash64(F.lit(7), "tail")))
    # Different suffixes only, so that a passage of very many documents is one row of its window.
    classes = tails.groupBy("a", "b", "t").agg(F.first("tail").alias("tail"), F.collect_set("left").alias("lefts"), F.count(F.lit(1)).alias("n"))
    repeats = store.write(classes.groupBy("a", "b").applyInArrow(_intervals, "a long, b long, nr long, length long, ts array<long>"))
    store.drop(found, starts)
    places = repeats.select("a", "b", "nr", "length", F.explode("ts").alias("t")).join(tails.select("a", "b", "t", "id", F.col("at").alias("start")), ["a", "b", "t"]).drop("t")
    return places.join(names, "id").drop("id").withColumnRenamed("own", "id")


def maximal_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Maximal repeats, one row each: length and occurrences, an array of (id, start) in bytes. Where a repeat may have more occurrences than a row can hold, use repeat_occurrences."""
    return repeat_occurrences(df, text, key).groupBy("a", "b", "nr", "length").agg(F.collect_list(F.struct("id", "start")).alias("occurrences")).select("length", "occurrences")


def _packed_texts(n_parts: int):
    """Rows of ids and texts by part of the last stage, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL)
        for part, raw, off in utf8_slices(_merged(batches, 8 << 20), most=8 << 20):
            ids = part.column(0)
            to = ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False) % n_parts
            known, data = ids.is_valid().to_numpy(zero_copy_only=False), raw.tobytes()
            order = np.argsort(to, kind="stable")
            edge = np.r_[np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]]), len(order)].tolist()
            names = ids.fill_null(0).to_numpy(zero_copy_only=False)
            out = []
            for s, e in zip(edge, edge[1:], strict=False):
                at = order[s:e]
                head = np.array([e - s], np.int64).tobytes() + np.stack([names[at], known[at], np.diff(off)[at]]).astype(np.int64).tobytes()
                out.append((int(to[at[0]]), 1, press.compress(head + b"".join([data[off[i] : off[i + 1]] for i in at.tolist()]))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "body"])

    return run


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, kept (binary), n_bytes, n_removed, n_spans and spans, an array of (s, e) in bytes, for each row of df."""
    store = Stored(df.sparkSession)
    rows, n = _rows(df, text, key)
    n_parts = parts_for(df.sparkSession, n) | 1

    def give(_number, long, ids, at, low):
        gone = ids > low
        cut = _packed_cuts(ids[gone], at[gone], long[gone], n_parts) if gone.any() else []
        return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.binary())], names=["part", "cut"]) if cut else None

    cuts = store.write(map_arrow(_bucketed(rows, n, n_parts), _per_bucket(give), "part long, cut binary", 64))
    texts = map_arrow(rows, _packed_texts(n_parts), "part long, kind int, body binary")
    met = cuts.select("part", F.lit(0).alias("kind"), F.col("cut").alias("body")).unionByName(texts).repartition(n_parts, "part").sortWithinPartitions("part", "kind")
    return map_arrow(met, _apply, "id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<s:long,e:long>>").withColumnRenamed("id", key)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part come together, its cuts before its texts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    part, held, ready = None, [], None
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in batches:
        for p, kind, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if p != part:
                part, held, ready = p, [], None
            if kind == 0:
                held.append(_unpacked_cuts(body))
                continue
            if ready is None:
                ready = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
                ready = ready[:, np.lexsort((ready[1], ready[0]))]
                held = []
            data = press.decompress(body)
            m = int(np.frombuffer(data, np.int64, 1)[0])
            names, known, sizes = np.frombuffer(data, np.int64, 3 * m, 8).reshape(3, m)
            whole = np.r_[0, np.cumsum(sizes)] + 8 + 24 * m
            find = np.where(known == 1, names, LAST_ID)
            first, last = np.searchsorted(ready[0], find, side="left").tolist(), np.searchsorted(ready[0], find, side="right").tolist()
            kept, removed, spans = [], [], []
            for a, b, x, y in zip(first, last, whole[:-1].tolist(), whole[1:].tolist(), strict=True):
                mine = []
                if b > a:
                    s, e = ready[1, a:b], np.maximum.accumulate(ready[2, a:b])
                    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    mine = list(zip(s[new].tolist(), e[np.r_[new[1:] - 1, len(e) - 1]].tolist(), strict=True))
                at, pieces = x, []
                for s, e in mine:
                    pieces.append(data[at : x + s])
                    at = x + e
                kept.append(b"".join([*pieces, data[at:y]]))
                removed.append(y - x - len(kept[-1]))
                spans.append([{"s": s, "e": e} for s, e in mine])
            yield pa.RecordBatch.from_arrays([pa.array(names, mask=known == 0), pa.array(kept, pa.binary()), pa.array(sizes), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, span)], names=["id", "kept", "n_bytes", "n_removed", "n_spans", "spans"])
