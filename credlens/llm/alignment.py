"""Alignment of two tokenizers' tokens and counts of aligned id pairs, through sharded minimal perfect hashes.

Tokenizer A is a byte-level BPE file, B a sentencepiece model with a dummy space before the text. Places where tokens
of both end cut a text into groups; each token of A is linked to each of B in its group. A pair's count is the number of
documents that hold it linked.

Documents are dealt to slices by a hash. One pass aligns them, numbers each slice's distinct pairs by places and packs them, with
the documents that hold each, for 2 ** SHARD_BITS shards; of a document it keeps what doesn't depend on counts and
the places that it links, with how often. The pairs of a shard are put together along a tree and get a minimal perfect
hash with the keys it indexes, to verify lookups. Each bundle of slices adds its counts up in a dense vector indexed by that hash,
and the vectors are summed along the same tree. Slices then look up their pairs, and the documents gather their
counts by places; no text is read or aligned again. What is collected is the highest count of each id of A, at most one
number for each entry of the vocabulary.

Words repeat, so chunks of text (white space and what follows up to the next) are aligned once in a worker and kept: both
tokenizers end tokens at the chunks' borders, except where other white space or carriage returns stand before them; such
texts are aligned whole.

Defined results: a text that is null or empty, or isn't its tokens' bytes for A or B, has no tokens (zeros, empty
groups_sha256); repeated rows count as documents of their own; ids may be null or shared; columns named as
outputs are replaced, others are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import LONGEST, OTHER_SPACE, alone_in, distinct_chunks, joinable, load_library, runs, token_lengths
from .common import SLICE_BYTES, Stored, kept_by, map_arrow, parts_for, utf8_slices, without
from .line_dedup import PerfectHash

OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
SHARD_BITS = 7
#: Vectors or key sets that a node of the tree puts together.
FAN = 64
#: Chunks and links that a worker keeps; links of a group that are spread out as they are.
KEPT, KEPT_LINKS, WIDE = 450_000, 4_500_000, 10_000
#: Bytes aligned at once: with a space before each text still few enough for small tables of the hashes.
SLICE = SLICE_BYTES - (1 << 14)
#: Pairs that a task holds before it puts them out.
HELD = 1_000_000
JOINED = 100
_ODD = re.compile(rb"(?:\r|" + OTHER_SPACE + rb")[ \t\n\x0b\x0c]|\xe2\x96\x81")
_RARE = (b"\r", b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe2\x96\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_OVER = re.compile("[^ \t\n\x0b\x0c][ \t\n\x0b\x0c]")
_BREAKS = " \t\n\x0b\x0c"
_BLANK = np.isin(np.arange(256), list(_BREAKS.encode()))
_loaded: dict[tuple[str, str], Aligner] = kept_by("aligner")


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level tokens: printable Latin-1 stands for itself, other bytes for characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Chunks' alignments: counts of tokens, groups and links, the groups as text, and pairs with how often each is linked."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = load_library(path_a, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_lengths = token_lengths(self.a)
        letters, special = _byte_alphabet(), {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = [special.get(i) or bytes(letters[c] for c in self.a.id_to_token(i) or "") for i in range(len(self.a_lengths))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_lengths = np.array(list(map(len, self.b_bytes)), np.int64)
        #: Whether no piece goes on from other characters to white space, so that chunks can be encoded one by one.
        self.parts = not any(_OVER.search(p.replace("▁", " ")) for p in pieces)
        #: Decimal ids of A with a comma or a bar behind them, then those of B with a comma or a semicolon.
        names = [f"{i}{sign}".encode() for n, signs in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for sign in signs]
        self.names, self.name_sizes = np.frombuffer(b"".join(names), np.uint8), np.array(list(map(len, names)), np.int64)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        #: For each chunk: whether it is its tokens' bytes, tokens of A and B, groups, links, and its pairs' first place.
        self.facts, self.first = np.zeros((0, 5), np.int64), np.zeros(1, np.int64)
        self.pairs, self.times, self.texts = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def _encode_a(self, text: bytes) -> np.ndarray:
        return np.array(self.a.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)

    def _encode_b(self, text: bytes) -> np.ndarray:
        """Ids of a text that begins with white space, as they are behind another character; without self.parts, with a space, which is the library's own."""
        if not self.parts:
            return np.array(self.b.encode(text[1:].decode("utf-8", "replace")), np.int64)
        ids = np.array(self.b.encode("a" + text.decode("utf-8", "replace")), np.int64)
        return ids[1:] if self.b_bytes[ids[0]] == b" a" else ids[:0]

    def _dealt(self, chunks: list[bytes]) -> tuple[list[bytes], list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
        """The chunks in another order, their ids of A end to end and how many each has, and those of B. Chunks that may stand behind any other are encoded end to end."""
        near, far = [], []
        for c in chunks:
            (near if self.parts and joinable(c) else far).append(c)
        bundles = [near[i : i + JOINED] for i in range(0, len(near), JOINED)]
        texts = ["a" + b"".join(x).decode("utf-8", "replace") for x in bundles]
        made_a, made_b = self.a.encode_batch_fast(texts, add_special_tokens=False), self.b.encode(texts, num_threads=1)
        order, ids, counts = [], ([], []), ([], [])
        for x, ea, eb in zip(bundles, made_a, made_b, strict=True):
            upto, cut = np.cumsum(list(map(len, x))), []
            for found, lengths, before in ((np.array(ea.ids, np.int64), self.a_lengths, 1), (np.array(eb, np.int64), self.b_lengths, 2)):
                ends = np.cumsum(lengths[found]) - before
                at = np.searchsorted(ends, upto)
                if at[-1] == len(ends) - 1 and ends[0] == 0 and (ends[at] == upto).all():
                    cut.append((found[1:], np.diff(np.r_[0, at])))
            if len(cut) < 2:
                far += x
                continue
            order += x
            for k in (0, 1):
                ids[k].append(cut[k][0])
                counts[k].append(cut[k][1])
        for c in far:
            for k, found in enumerate((self._encode_a(c), self._encode_b(c))):
                ids[k].append(found)
                counts[k].append([len(found)])
        return order + far, ids[0], np.concatenate(counts[0]), ids[1], np.concatenate(counts[1])

    def _learn(self, chunks: list[bytes]) -> None:
        chunks, of_a, n_a, of_b, n_b = self._dealt(chunks)
        a, b = np.concatenate(of_a), np.concatenate(of_b)
        data, sizes = b"".join(chunks), np.array(list(map(len, chunks)))
        spans = lambda ids, lengths, n: np.diff(np.r_[0, np.cumsum(lengths[ids])][np.r_[0, np.cumsum(n)]])
        right = (spans(a, self.a_lengths, n_a) == sizes) & (spans(b, self.b_lengths, n_b) == sizes)
        if not right.all() or b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
            cut_a, cut_b = np.r_[0, np.cumsum(n_a)].tolist(), np.r_[0, np.cumsum(n_b)].tolist()
            is_it = lambda c, known, ids: b"".join(map(known.__getitem__, ids.tolist())) == c
            right = np.array([is_it(c, self.a_bytes, a[cut_a[i] : cut_a[i + 1]]) and is_it(c, self.b_bytes, b[cut_b[i] : cut_b[i + 1]]) for i, c in enumerate(chunks)])
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            n_a, n_b = n_a * right, n_b * right
        upto = np.cumsum(np.where(right, sizes, 0))
        ends_a, ends_b = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        common = np.intersect1d(ends_a, ends_b)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        per_a, per_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        upto_group = np.searchsorted(common, upto, side="right")
        n_groups = np.diff(np.r_[0, upto_group])
        links = per_a * per_b
        n_links = np.diff(np.r_[0, np.cumsum(links)][np.r_[0, upto_group]])
        first_a, first_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        # Pairs of narrow groups token by token; those of wide ones by distinct ids.
        narrow = links <= WIDE
        wide_a = np.flatnonzero(narrow[group_a]) if len(a) else np.zeros(0, np.int64)
        times = per_b[group_a[wide_a]]
        left = np.repeat(wide_a, times)
        inside = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        right_b = first_b[group_a[left]] + inside
        keys, groups, counts = [(a[left] << 32) | b[right_b]], [group_a[left]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(~narrow).tolist():
            ua, ca = np.unique(a[first_a[g] : first_a[g] + per_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + per_b[g]], return_counts=True)
            keys.append(((ua[:, None] << 32) | ub).ravel())
            counts.append((ca[:, None] * cb).ravel())
            groups.append(np.full(len(keys[-1]), g))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        chunk = np.searchsorted(upto_group, np.concatenate(groups), side="right")
        order = np.lexsort((keys, chunk))
        keys, counts, chunk = keys[order], counts[order], chunk[order]
        new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (chunk[1:] != chunk[:-1])]) if len(keys) else np.zeros(0, np.int64)
        keys, chunk, counts = keys[new], chunk[new], np.add.reduceat(counts, new) if len(new) else counts
        # Each group's ids of A, then those of B, each with the sign behind it.
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + first_b[group_a]] = 2 * a + (np.r_[group_a[1:], -1] != group_a)
        code[np.arange(len(b)) + (first_a + per_a)[group_b]] = 2 * (len(self.a_bytes) + b) + (np.r_[group_b[1:], -1] != group_b)
        size = self.name_sizes[code]
        at = np.repeat((np.cumsum(self.name_sizes) - self.name_sizes)[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        shown = self.names[at].tobytes()
        cut = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n_a + n_b)]].tolist()
        start = len(self.facts)
        self.index.update(zip(chunks, range(start, start + len(chunks)), strict=True))
        self.facts = np.concatenate([self.facts, np.stack([right, n_a, n_b, n_groups, n_links], axis=1).astype(np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(chunk, minlength=len(chunks)))])
        self.pairs, self.times = np.concatenate([self.pairs, keys]), np.concatenate([self.times, counts])
        self.texts += [shown[s : e - 1] for s, e in zip(cut, cut[1:], strict=False)]

    def align(self, raw: np.ndarray, off: np.ndarray) -> Aligned:
        """Texts, UTF-8 end to end with n + 1 offsets."""
        # A space before each text that isn't empty.
        solid = np.flatnonzero(np.diff(off) > 0)
        data = np.insert(raw, off[solid], 32)
        off = off + np.searchsorted(solid, np.arange(len(off)))
        text = data.tobytes()
        alone = alone_in(text, off, _RARE, _ODD, []) if self.parts else np.diff(off) > 0
        need, pieces, docs = [], [], []
        for s, e in runs(alone):
            if alone[s]:
                need.append(text[off[s] : off[e]])
                pieces.append(np.array([len(need) - 1]))
                docs.append(np.array([s]))
            else:
                first, last, which, doc = distinct_chunks(data[off[s] : off[e]], off[s : e + 1] - off[s], _BLANK)
                pieces.append(len(need) + which)
                docs.append(s + doc)
                need += [text[x:y] for x, y in zip((first + off[s]).tolist(), (last + off[s]).tolist(), strict=True)]
        missing = list(set(need).difference(self.index))
        if missing and (len(self.index) + len(missing) > KEPT or len(self.pairs) > KEPT_LINKS):
            self._clear()
            missing = list(set(need))
        for i in range(0, len(missing), 20_000):
            self._learn(missing[i : i + 20_000])
        at = np.array([self.index[c] for c in need], np.int64)
        for c in missing:
            if len(c) > LONGEST:
                del self.index[c]
        none = [np.zeros(0, np.int64)]
        return Aligned(self, at[np.concatenate(pieces + none)], np.concatenate(docs + none), len(off) - 1)


class Aligned:
    """Texts as runs of chunks."""

    def __init__(self, of: Aligner, chunks: np.ndarray, doc: np.ndarray, n: int) -> None:
        ok = np.ones(n, bool)
        ok[doc[of.facts[chunks, 0] == 0]] = False
        keep = ok[doc]
        self.of, self.chunks, self.doc, self.n = of, chunks[keep], doc[keep], n
        self.cut = np.searchsorted(self.doc, np.arange(self.n + 1))

    def totals(self) -> np.ndarray:
        """n_a, n_b, n_groups, n_links of each text."""
        upto = np.zeros((len(self.chunks) + 1, 4), np.int64)
        np.cumsum(self.of.facts[self.chunks, 1:], axis=0, out=upto[1:])
        return upto[self.cut[1:]] - upto[self.cut[:-1]]

    def groups(self) -> list[bytes]:
        shown, chunks = self.of.texts, self.chunks.tolist()
        return [b";".join(map(shown.__getitem__, chunks[s:e])) for s, e in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True)]

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, and for each text and pair that it links: text, index of the pair, times."""
        m = max(1, len(self.of.facts))
        both, times = np.unique(self.doc * m + self.chunks, return_counts=True)
        doc, chunk = both // m, both % m
        first, size = self.of.first[chunk], self.of.first[chunk + 1] - self.of.first[chunk]
        row = np.repeat(np.arange(len(chunk)), size)
        at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        keys, where = np.unique(self.of.pairs[at], return_inverse=True)
        n = max(1, len(keys))
        code = doc[row] * n + where
        order = np.argsort(code, kind="stable")
        code, times = code[order], (times[row] * self.of.times[at])[order]
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        return keys, code[new] // n, code[new] % n, np.add.reduceat(times, new) if len(new) else times


def aligner(path_a: str, path_b: str) -> Aligner:
    """One instance for each worker process."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def shard_of(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SHARD_BITS)).astype(np.int64)


def _longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def _picked(data: bytes, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the texts end to end, and their offsets."""
    texts = [data[off[i] : off[i + 1]] for i in rows.tolist()]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BinaryType(): pa.binary(), T.StringType(): pa.string()}


class Places:
    """Distinct pairs of a slice in ascending order, each with its place, given as they come in, and how many documents hold it."""

    def __init__(self, first: int = 0) -> None:
        self.keys, self.place, self.counts, self.upto = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), first

    def add(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of ascending different keys."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        new[inside] = self.keys[at[inside]] != keys[inside]
        where = at[new]
        self.keys, self.counts = np.insert(self.keys, where, keys[new]), np.insert(self.counts, where, 0)
        self.place = np.insert(self.place, where, self.upto + np.arange(len(where)))
        self.upto += len(where)
        at += np.cumsum(new) - new
        self.counts[at] += counts
        return self.place[at]


def _binaries(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Runs of values as bytes."""
    if int(cut[-1]) * values.itemsize >= 1 << 31:
        raise ValueError("a text links more pairs than a row can hold")
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _pairs(path_a: str, path_b: str, schema: T.StructType):
    """Documents with what doesn't depend on counts and the places of their pairs (no shard), and packed distinct pairs of each slice by shard, with their places and the number of documents that hold each."""

    def batch(n: int, row: dict, types: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([row[f.name] if f.name in row else pa.nulls(n, _ARROW.get(f.dataType, types.field("r").type)) for f in schema], names=schema.names)

    def packed(piece: int, held: Places, types: pa.Schema) -> pa.RecordBatch:
        shard = shard_of(held.keys)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
        row = {c: _binaries(x[order], cut) for c, x in (("keys", held.keys), ("counts", held.counts), ("places", held.place.astype("<u4")))}
        return batch(len(cut) - 1, row | {"slice": pa.array([piece] * (len(cut) - 1), pa.int64()), "shard": pa.array(shard[order][cut[:-1]], pa.int32())}, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, held, types = aligner(path_a, path_b), {}, None
        for part, raw, off in utf8_slices(batches, most=SLICE):
            data, types = raw.tobytes(), part.schema
            where, r = part.column(types.get_field_index("slice")).to_numpy(), part.column(types.get_field_index("r"))
            for piece in np.unique(where).tolist():
                mine = np.flatnonzero(where == piece)
                made = both.align(*_picked(data, off, mine))
                keys, doc, pair, times = made.linked()
                places = held.setdefault(piece, Places()).add(keys, np.bincount(pair, minlength=len(keys)))
                cut = np.searchsorted(doc, np.arange(made.n + 1))
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in made.groups()]
                row = {"slice": pa.array([piece] * len(mine), pa.int64()), "r": r.take(pa.array(mine)), OUT[-1]: pa.array(digests, pa.string())}
                row |= dict(zip(OUT, map(pa.array, made.totals().T), strict=False))
                yield batch(len(mine), row | {"places": _binaries(places[pair].astype("<u4"), cut), "counts": _binaries(times, cut)}, types)
            if sum(len(x.keys) for x in held.values()) > HELD:
                for piece, x in held.items():
                    if len(x.keys):
                        yield packed(piece, x, types)
                held = {piece: Places(x.upto) for piece, x in held.items()}
        for piece, x in held.items():
            if len(x.keys):
                yield packed(piece, x, types)

    return run


NODE = "shard int, node long, data binary"


def _union(t: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([_longs(x) for x in t["data"].to_pylist()]))
    return pa.table({"shard": t["shard"][:1], "node": t["node"][:1], "data": pa.array([keys.tobytes()], pa.binary())})


def _sum(t: pa.Table) -> pa.Table:
    total = np.sum([_longs(x) for x in t["data"].to_pylist()], axis=0, dtype=np.int64)
    return pa.table({"shard": t["shard"][:1], "node": t["node"][:1], "data": pa.array([total.tobytes()], pa.binary())})


def tree(rows: DataFrame, nodes: int, combine, last=None, schema: str = NODE) -> DataFrame:
    """The data of each shard's nodes (shard, node, data) put together, FAN at a time: shard and data, or what `last` makes of the uppermost nodes in place of combine."""
    while nodes > 1:
        nodes = -(-nodes // FAN)
        top = last is not None and nodes == 1
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("shard", "node").applyInArrow(last if top else combine, schema if top else NODE)
    return rows if last is not None else rows.select("shard", "data")


def _index(t: pa.Table) -> pa.Table:
    """A shard's minimal perfect hash and its keys in the order of their indexes. Made where the keys meet: a step of its own behind it would hold two Python workers for each task, and those that the aligners don't live in would load them again in the second pass."""
    keys = _longs(_union(t)["data"][0].as_py())
    mph = PerfectHash.build(keys.view(np.uint64))
    return pa.table({"shard": t["shard"][:1], "mph": pa.array([mph.to_bytes()], pa.binary()), "keys": pa.array([keys[np.argsort(mph(keys.view(np.uint64)))].tobytes()], pa.binary())})


def _places(mph: bytes, known: bytes, keys: np.ndarray) -> np.ndarray:
    """Indexes of keys, verified; every key that was counted is known."""
    at = PerfectHash.from_bytes(mph)(keys.view(np.uint64))
    if (at < 0).any() or (_longs(known)[at] != keys).any():
        raise ValueError("a pair isn't in its shard's hash")
    return at


def _dense(packed: pa.Table, index: pa.Table) -> pa.Table:
    """The counts of a bundle of slices as a vector indexed by the shard's hash."""
    if not packed.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
    mph, known = index["mph"][0].as_py(), index["keys"][0].as_py()
    out = np.zeros(len(known) // 8, np.int64)
    for k, n in zip(packed["keys"].to_pylist(), packed["counts"].to_pylist(), strict=True):
        out[_places(mph, known, _longs(k))] += _longs(n)  # a row holds a key once
    return pa.table({"shard": packed["shard"][:1], "node": packed["node"][:1], "data": pa.array([out.tobytes()], pa.binary())})


def _looked_up(best: np.ndarray):
    """Places of pairs with their counts in the whole table, doubled, and 1 more for an id's highest."""

    def run(packed: pa.Table, index: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return pa.table({"slice": pa.array([], pa.int64()), "places": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        mph, known, total = index["mph"][0].as_py(), index["keys"][0].as_py(), _longs(index["total"][0].as_py())
        found = []
        for k in map(_longs, packed["keys"].to_pylist()):
            n = total[_places(mph, known, k)]
            found.append((2 * n + (n == best[k >> 32])).tobytes())
        return pa.table({"slice": packed["slice"], "places": packed["places"], "counts": pa.array(found, pa.binary())})

    return run


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The highest count of each id of A in a shard."""
    for b in batches:
        for keys, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids, where = np.unique(_longs(keys) >> 32, return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, where, _longs(total))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most)], names=["a", "most"])


def _gather(schema: T.StructType):
    """Rows of a slice come together, its counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, counts = None, np.zeros(0, np.int64)
        for part, raw, off in utf8_slices(batches, "places"):
            col = lambda c, s, e: part.column(part.schema.get_field_index(c)).slice(s, e - s)  # noqa: B023, E731
            where, is_doc = (col(c, 0, part.num_rows).to_numpy() for c in ("slice", "kind"))
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1).tolist(), len(where)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if where[s] != piece:
                    piece, counts = where[s], np.zeros(0, np.int64)
                at, n = raw[off[s] : off[e]].view("<u4"), _longs(b"".join(col("counts", s, e).to_pylist()))
                if not is_doc[s]:
                    counts = np.r_[counts, np.zeros(max(0, int(at.max(initial=0)) + 1 - len(counts)), np.int64)]
                    counts[at] = n
                    continue
                cut, sums = (off[s : e + 1] - off[s]) // 4, []
                for x in (n * (counts[at] & 1), n * (counts[at] >> 1)):
                    upto = np.r_[0, np.cumsum(x)][cut]
                    sums.append(pa.array(np.diff(upto)))
                yield pa.RecordBatch.from_arrays([col("r", s, e), *[col(c, s, e) for c in OUT[:4]], *sums, col(OUT[-1], s, e)], names=schema.names)

    return run


def align_documents(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """df without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    spark = df.sparkSession
    store = Stored(spark)
    kept = without(df, *OUT)
    others = [c for c in kept.columns if c.lower() != text.lower()]
    whole = kept.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("0")]).alias("r"), F.col(f"`{text}`").cast("string").alias("text"))
    n_bytes = whole.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_slices = parts_for(spark, n_bytes)
    rows = whole.withColumn("slice", F.pmod(F.xxhash64(F.to_json("r"), "text"), F.lit(n_slices)).cast("long"))
    fixed = [T.StructField("r", rows.schema["r"].dataType), *[T.StructField(c, T.LongType()) for c in OUT[:4]], T.StructField(OUT[-1], T.StringType())]
    of_pairs = [T.StructField("slice", T.LongType()), T.StructField("shard", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("keys", "places", "counts")]]
    schema = T.StructType([*of_pairs, *fixed])
    aligned = store.write(map_arrow(rows.select("slice", "r", "text").repartitionById(n_slices, F.col("slice").cast("int")), _pairs(path_a, path_b, schema), schema, keeps="aligner"))
    packed = aligned.where("shard is not null")
    bundles = -(-n_slices // FAN)
    node = F.floor(F.col("slice") / FAN)
    index = store.write(tree(packed.select("shard", F.col("slice").alias("node"), F.col("keys").alias("data")), max(2, n_slices), _union, _index, "shard int, mph binary, keys binary"))
    spread = lambda t: t.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))))
    bundled = packed.withColumn("node", node)
    dense = bundled.select("shard", "node", "keys", "counts").groupBy("shard", "node").cogroup(spread(index).groupBy("shard", "node")).applyInArrow(_dense, NODE)
    totals = tree(dense, bundles, _sum)
    counted = store.write(index.join(totals.withColumnRenamed("data", "total"), "shard"))
    best = counted.select("keys", "total").mapInArrow(_highest, "a long, most long").groupBy("a").agg(F.max("most").alias("most")).toPandas()  # at most a row for each id of A
    highest = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    highest[best["a"].to_numpy(np.int64)] = best["most"]
    found = bundled.select("shard", "node", "slice", "keys", "places").groupBy("shard", "node").cogroup(spread(counted).groupBy("shard", "node")).applyInArrow(_looked_up(highest), "slice long, places binary, counts binary")
    docs = aligned.where("shard is null").select("slice", F.lit(1).alias("kind"), "places", "counts", *[f.name for f in fixed])
    met = docs.unionByName(found.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    schema = T.StructType([*fixed[:-1], *[T.StructField(c, T.LongType()) for c in OUT[4:-1]], fixed[-1]])
    done = map_arrow(met.repartitionById(n_slices, F.col("slice").cast("int")).sortWithinPartitions("slice", "kind"), _gather(schema), schema)
    return done.select(*[F.col(f"r.`{c}`") for c in others], *OUT)
