"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut behind every place where a rolling (gear) hash of the last 16 bytes has its top bits zero, so
that equal passages give equal chunks whatever stands before them. A document becomes the list of its chunks'
96-bit hashes, dealt to a part by its id and text; a chunk goes, with the parts that ask for it, to the
bucket of its hash. One that several parts ask for is encoded there, once for the whole job, and its ids go
to each of these parts; one that a single part asks for goes on as it is, and is encoded there, once.
A chunk that is frequent within one slice of texts is dealt to as many as SPREAD buckets, and encoded in each.
A chunk keeps the ids of what lies between its first and its last white space. At a join the open ends are put
together and encoded anew with a word on either side; if the ids of these words don't come out as both chunks
have them, with more words, until they agree exactly.

Defined results: null counts as empty text; empty texts have no ids and decode to an empty text;
repeated rows each get their result; input columns named as outputs are replaced; an empty table gives
an empty table.
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

from .common import map_arrow, parts_for, utf8_slices, without
from .tokens import Generations, WordBPE, word_bpe

CHUNK_BITS, MOST_BYTES = 11, 1 << 16
#: Least bytes of a slice, and how hard chunks are compressed.
CUT_BYTES, LEVEL = 1 << 23, 6
#: Bytes of a chunk's hash that name it.
NAME = 12
CACHE_BYTES = 48 << 20
#: A chunk that a slice holds so often is spread over so many buckets.
FREQUENT, SPREAD = 8, 64
#: Words at a chunk's ends that a join may be tested with.
CONTEXT = 2
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
_SPACE = re.compile(rb"[\t-\r ]")
_END = re.compile(rb"[^\t-\r ]*\Z")
_GEAR = np.random.default_rng(616).integers(0, 1 << 32, 256, dtype=np.uint32)
Entry = tuple[bytes, bytes | None, bytes, bytes, bytes]


def cuts(raw: np.ndarray, off: np.ndarray) -> list[list[int]]:
    """Bounds of each text's chunks in raw."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    at = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0)
    ends = at[at - off[np.searchsorted(off, at, side="right") - 1] >= 15] + 1
    first, last = np.searchsorted(ends, off[:-1], side="right").tolist(), np.searchsorted(ends, off[1:], side="left").tolist()
    out, every = [], ends.tolist()
    for a, b, i, j in zip(off[:-1].tolist(), off[1:].tolist(), first, last, strict=True):
        bounds = [a, *every[i:j], b] if b > a else [a]
        if any(y - x > MOST_BYTES for x, y in zip(bounds, bounds[1:], strict=False)):
            bounds = [a, *[z for x, y in zip(bounds, bounds[1:], strict=False) for z in [*range(x + MOST_BYTES, y, MOST_BYTES), y]]]
        out.append(bounds)
    return out


class ChunkEncoder:
    """Encodes chunks and repairs their joins."""

    def __init__(self, bpe: WordBPE, cache_bytes: int = CACHE_BYTES) -> None:
        self.bpe, self.chunks, self.joins = bpe, Generations(cache_bytes), Generations(cache_bytes // 4)
        self.encoded = self.reused = 0

    def entry(self, chunk: bytes) -> Entry:
        """What stands before the first white space, the ids between it and the last (None: there is none), what stands behind that, and the first and last words between."""
        self.encoded += 1
        if (first := _SPACE.search(chunk)) is None:
            return chunk, None, b"", b"", b""
        tail = _END.search(chunk, first.start()).start()
        words = chunk[first.start() : tail].split()
        return chunk[: first.start()], self.bpe.encode_words(words), chunk[tail:], b" ".join(words[:CONTEXT]), b" ".join(words[-CONTEXT:])

    def encode(self, chunks: list[bytes]) -> bytes:
        """The ids of one text from its chunks; those met before aren't encoded again."""
        found = []
        for c in chunks:
            if (e := self.chunks.get(c)) is None:
                e = self.entry(c)
                self.chunks.put(c, e, 2 * len(c) + 200)
            else:
                self.reused += 1
            found.append(e)
        return self.assemble([found])[0]

    def assemble(self, texts: list[list[Entry]]) -> list[bytes]:
        """The ids of texts from their chunks' entries."""
        plans, wanted = [], {}
        for entries in texts:
            plan, left, open_end = [], b"", b""
            for head, ids, tail, first, last in entries:
                open_end += head
                if ids is not None:
                    if open_end or (left and first):
                        plan.append((left, open_end, first))
                    plan.append(ids)
                    left, open_end = last, tail
            if open_end:
                plan.append((left, open_end, b""))
            plans.append(plan)
            for x in plan:
                if type(x) is tuple and x not in wanted:
                    wanted[x] = self.joins.get(x)
        new = [x for x, ids in wanted.items() if ids is None]
        words = 1
        while new:
            if words > CONTEXT:
                raise RuntimeError(f"no agreement around {new[0]!r}")
            sides = [(left.split()[-words:], right.split()[:words]) for left, _, right in new]
            self.bpe.learn([w for a, b in sides for w in (*a, *b)])
            texts_of = [b" ".join([*a, *([x[1]] if x[1] else []), *b]).decode("utf-8", "replace") for x, (a, b) in zip(new, sides, strict=True)]
            again = []
            for x, (a, b), got in zip(new, sides, self.bpe.library.encode_batch(texts_of, add_special_tokens=False), strict=True):
                ids = np.array(got.ids, self.bpe.dtype).tobytes()
                before, behind = self.bpe.encode_words(a), self.bpe.encode_words(b)
                if len(ids) >= len(before) + len(behind) and ids.startswith(before) and ids.endswith(behind):
                    wanted[x] = ids[len(before) : len(ids) - len(behind)]
                    self.joins.put(x, wanted[x], sum(map(len, x)) + len(wanted[x]) + 200)
                else:
                    again.append(x)
            new, words = again, 2 * words
        return [b"".join([wanted[x] if type(x) is tuple else x for x in plan]) for plan in plans]


def _pack(rows: list[tuple[bytes, ...]]) -> bytes:
    """Rows of byte strings, compressed: column by column, with lengths; None has length -1."""
    import zstandard

    head = np.array([len(rows), len(rows[0])], np.int64).tobytes()
    size = np.array([[-1 if x is None else len(x) for x in r] for r in rows], np.int32).T.tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + size + b"".join([x or b"" for c in zip(*rows, strict=True) for x in c]))


def _unpack(data: bytes) -> list[tuple[bytes | None, ...]]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    size = np.frombuffer(data, np.int32, n * k, 16)
    ends = np.cumsum(np.maximum(size, 0)) + 16 + 4 * n * k
    flat = [None if s < 0 else data[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
    return list(zip(*[flat[i * n : (i + 1) * n] for i in range(k)], strict=True))


def _cut(path: str, n_buckets: int):
    """Rows (bucket, kind, part, body, r): kind 0 holds packed chunks with the parts that ask for them, kind 1 one text's chunk hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bpe = word_bpe(path)
        # Slices grow with the number of buckets, so that their rows don't get too short to compress.
        for part, raw, off in utf8_slices(batches, most=min(64 << 20, max(CUT_BYTES, n_buckets << 12))):
            parts = part.column(part.schema.get_field_index("part")).to_pylist()
            raw, off = bpe.plain(raw, off)
            data, chunks, lists = raw.tobytes(), {}, []
            for bounds, p in zip(cuts(raw, off), parts, strict=True):
                mine = []
                for x, y in zip(bounds, bounds[1:], strict=False):
                    c = data[x:y]
                    h = xxhash.xxh3_128_digest(c)[:NAME]
                    mine.append(h)
                    if (seen := chunks.get(h)) is None:
                        chunks[h] = [c, {p}, 1]
                    else:
                        seen[1].add(p)
                        seen[2] += 1
                lists.append(b"".join(mine))
            salt = int.from_bytes(min(chunks)[:4], "little") % SPREAD if chunks else 0
            by: dict[int, list[tuple[bytes, ...]]] = {}
            for h, (c, asked, n) in chunks.items():
                k = int.from_bytes(h[:8], "little")
                by.setdefault((k + (salt if n >= FREQUENT else 0)) % n_buckets, []).append((h, c, np.array(sorted(asked), np.int32).tobytes()))
            r = part.column(part.schema.get_field_index("r"))
            if by:
                yield _rows(list(by), 0, [-1] * len(by), [_pack(x) for x in by.values()], pa.nulls(len(by), r.type))
            yield _rows(parts, 1, parts, lists, r)

    return run


def _rows(bucket: list[int], kind: int, part: list[int], body: list[bytes], r: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * len(body), pa.int32()), pa.array(part, pa.int32()), pa.array(body, pa.binary()), r], names=["bucket", "kind", "part", "body", "r"])


def _encode(path: str):
    """Encodes the chunks of each bucket, whose rows come together, once; puts them out by part. Texts pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkEncoder(word_bpe(path))
        held, at, kind = {}, None, None

        def give() -> pa.RecordBatch:
            coder.bpe.learn([c for c, asked in held.values() if len(asked) > 1])
            by: dict[int, list[tuple]] = {}
            for h, (c, asked) in held.items():
                # A text alone stands for an entry that is still to be made.
                e = coder.entry(c) if len(asked) > 1 else (c, None, None, None, None)
                for p in asked:
                    by.setdefault(p, []).append((h, *e))
            return _rows([0] * len(by), 0, list(by), [_pack(x) for x in by.values()], pa.nulls(len(by), kind))

        for b in batches:
            buckets, kinds, bodies = (b.column(i).to_pylist() for i in (0, 1, 3))
            kind = b.column(4).type
            for k, one, body in zip(buckets, kinds, bodies, strict=True):
                if one:
                    continue
                if k != at and held:
                    yield give()
                    held = {}
                at = k
                for h, c, asked in _unpack(body):
                    mine = set(np.frombuffer(asked, np.int32).tolist())
                    if h in held:
                        held[h][1].update(mine)
                    else:
                        held[h] = (c, mine)
            texts = b.filter(pa.array([k == 1 for k in kinds]))
            if texts.num_rows:
                yield texts
        if held:
            yield give()

    return run


def _assemble(path: str, outputs: tuple[str, ...]):
    """Rows of a part come together, its chunks before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        coder, known, at = ChunkEncoder(bpe), {}, None
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        for b in batches:
            parts, kinds, bodies = (b.column(i).to_pylist() for i in (0, 1, 2))
            texts, rows = [], []
            for i, (p, kind, body) in enumerate(zip(parts, kinds, bodies, strict=True)):
                if p != at:
                    known, at = {}, p
                if kind == 0:
                    got = _unpack(body)
                    bpe.learn([x[1] for x in got if x[3] is None])
                    known.update((x[0], x[1:] if x[3] is not None else coder.entry(x[1])) for x in got)
                else:
                    texts.append([known[body[j : j + NAME]] for j in range(0, len(body), NAME)])
                    rows.append(i)
            if not rows:
                continue
            cols: dict[str, list] = {n: [] for n in outputs}
            for encoded in coder.assemble(texts):
                ids = bpe.ids(encoded).tolist()
                if "n_tokens" in cols:
                    cols["n_tokens"].append(len(ids))
                if "ids" in cols:
                    cols["ids"].append(ids)
                if "ids_sha256" in cols:
                    cols["ids_sha256"].append(hashlib.sha256(" ".join(map(bpe.numbers.__getitem__, ids)).encode()).hexdigest())
                if "decoded" in cols or "decoded_sha256" in cols:
                    decoded = bpe.decode(ids)
                    if "decoded" in cols:
                        cols["decoded"].append(decoded)
                    if "decoded_sha256" in cols:
                        cols["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(3).take(pa.array(rows)), *[pa.array(cols[n], type=types.get(n, pa.string())) for n in outputs]], names=["r", *outputs])

    return run


def _chunked(df: DataFrame, tokenizer_path: str, text: str, key: str, r) -> tuple[DataFrame, int]:
    inner = df.select(r.alias("r"), F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    n_bytes = inner.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = parts_for(df.sparkSession, n_bytes)
    slim = inner.select("r", "text", F.pmod(F.xxhash64("k", "text"), F.lit(n)).cast("int").alias("part"))
    fields = [T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("body", T.BinaryType()), T.StructField("r", slim.schema["r"].dataType)]
    return map_arrow(slim, _cut(tokenizer_path, n), T.StructType(fields), 2000, keeps="words"), n


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), keep_text: bool = True) -> DataFrame:
    """df (without its text unless keep_text) with the outputs named: n_tokens, ids, decoded, and SHA-256 digests of the ids (decimal, joined by a space) and of the decoded text."""
    kept = without(df, *outputs)
    rest = [c for c in kept.columns if keep_text or c.lower() != text.lower()]
    chunked, n = _chunked(df, tokenizer_path, text, key, F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("_")]))
    met = chunked.repartition(n, "bucket").sortWithinPartitions("bucket", "kind")
    encoded = map_arrow(met, _encode(tokenizer_path), met.schema, 200, keeps="words").select("part", "kind", "body", "r")
    placed = encoded.repartition(n, "part").sortWithinPartitions("part", "kind")
    kinds = [T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs]
    done = map_arrow(placed, _assemble(tokenizer_path, outputs), T.StructType([placed.schema["r"], *kinds]), 200, keeps="words")
    return done.select(*[F.col(f"r.`{c}`") for c in rest], *outputs)


def reuse(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row: n_chunks in all texts and n_encoded, different ones."""
    chunked, _ = _chunked(df, tokenizer_path, text, key, F.lit(0))
    lists = chunked.where("kind = 1 and length(body) > 0").select(F.explode(F.expr(f"transform(sequence(0, length(body) div {NAME} - 1), i -> substring(body, {NAME} * i + 1, {NAME}))")).alias("h"))
    return lists.groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"), F.count(F.lit(1)).alias("n_encoded"))
