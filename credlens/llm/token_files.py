"""Token ids as files of directly addressable codes: any token is read without decoding those around it.

Ids are split into chunks of bits, lowest first. Level 0 holds the first chunk of every token, level k the chunk k of
those whose ids reach that far; a continuation bit at each chunk says whether another follows, and its place on the next
level is the number of set bits before it, from a directory of counts for each 512 bits. The chunks' widths are
those with the least size for the ids of a file. A file also holds its documents' ids and first tokens.

Documents are range-sorted by (id, text hash); a task writes its part as files of some FILE_TOKENS tokens, a document in
one file always, under names of their own, and puts out a row for each. Only these rows, stored as the folder's
manifest, say which files count, so a task that runs twice or is lost midway leaves nothing but files that nobody reads. Files
are written and read through pyarrow's file systems, in a folder that the driver and all executors share.

Defined results: null and empty texts hold the end id alone; ids are integers, null ids stand before all others and come back
null; rows that share an id go by their texts' hashes; an empty table gives a folder without files; other columns aren't
stored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import map_arrow, parts_for, utf8_slices

MAGIC = b"DACIDS01"
FILE_TOKENS = 1 << 21
BLOCK, WORD = 512, 64
PAGE = 1 << 12
MANIFEST = "pid int, seq int, file string, n_docs long, n_tokens long, n_bytes long"


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths with the least total of chunk bits, continuation bits and their directory."""
    most = max(1, int(ids.max(initial=1)).bit_length())
    above = [len(ids), *[int(np.count_nonzero(ids >= 1 << c)) for c in range(1, most)]]
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (most + 1)
    for c in range(most - 1, -1, -1):
        best[c] = min((above[c] * (end - c + (1 + WORD / BLOCK if end < most else 0)) + best[end][0], [end - c, *best[end][1]]) for end in range(c + 1, most + 1))
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bits end to end, eight of them in `width` bytes, and at least eight bytes more."""
    if width % 8:
        v = np.zeros(-(-len(values) // 8) * 8, np.uint64)
        v[: len(values)] = values
        v, out = v.reshape(-1, 8), np.zeros((len(v) // 8, width), np.uint8)
        for byte in range(width):
            for i in range(8 * byte // width, min(7, (8 * byte + 7) // width) + 1):
                shift = i * width - 8 * byte
                out[:, byte] |= ((v[:, i] << np.uint64(shift)) if shift >= 0 else (v[:, i] >> np.uint64(-shift))).astype(np.uint8)
        data = out.tobytes()
    else:
        data = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : width // 8]).tobytes()
    return data + bytes(-len(data) % 8 + 8)


def unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    rows = -(-n // 8)
    data = data[: rows * width] if len(data) >= rows * width else np.pad(data, (0, rows * width - len(data)))
    data, out = data.reshape(rows, width), np.zeros((rows, 8), np.uint32)
    for i in range(8):
        for byte in range(i * width // 8, (i * width + width - 1) // 8 + 1):
            shift = 8 * byte - i * width
            x = data[:, byte].astype(np.uint32)
            out[:, i] |= (x << np.uint32(shift)) if shift >= 0 else (x >> np.uint32(-shift))
    return out.ravel()[:n] & np.uint32((1 << width) - 1)


def encode_file(keys: np.ndarray, n_null: int, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a file: header, keys, first tokens, then for each level its chunks, continuation bits and directory."""
    ids, chosen = ids.astype(np.uint32), widths(ids)
    sections, levels, left = [keys.astype("<i8").tobytes(), np.r_[0, np.cumsum(counts)].astype("<i8").tobytes()], [], ids
    for i, w in enumerate(chosen):
        levels += [w, len(left)]
        sections.append(pack_bits(left & np.uint32((1 << w) - 1), w))
        left = left >> np.uint32(w)
        if i + 1 < len(chosen):
            more = left > 0
            flags = np.packbits(more, bitorder="little")
            flags = np.pad(flags, (0, -len(flags) % (BLOCK // 8)))
            per = np.bitwise_count(flags.view(np.uint64)).reshape(-1, BLOCK // WORD).sum(axis=1, dtype=np.int64)
            sections += [flags.tobytes(), (np.cumsum(per) - per).astype("<u8").tobytes()]
            left = left[more]
    offsets = np.cumsum([0, *map(len, sections)])
    head = np.array([len(keys), n_null, len(ids), len(chosen), *levels, *offsets], "<i8").tobytes()
    return MAGIC + np.array([len(head)], "<i8").tobytes() + head + b"".join(sections)


class TokenFile:
    """A file read through read_at(length, offset): whole, by document, or token by token."""

    def __init__(self, read_at: Callable[[int, int], bytes]) -> None:
        self.read_at, self.pages = read_at, {}
        start = read_at(16, 0)
        if start[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int(np.frombuffer(start, "<i8", 1, 8)[0])
        head = np.frombuffer(read_at(size, 16), "<i8").tolist()
        self.n_docs, self.n_null, self.n_tokens, n = head[:4]
        self.levels = [(head[4 + 2 * i], head[5 + 2 * i]) for i in range(n)]
        self.offsets = [16 + size + x for x in head[4 + 2 * n :]]

    def _section(self, i: int) -> bytes:
        return self.read_at(self.offsets[i + 1] - self.offsets[i], self.offsets[i])

    def keys(self) -> pa.Array:
        values = np.frombuffer(self._section(0), "<i8")
        return pa.array(values, mask=np.arange(len(values)) < self.n_null)

    def starts(self) -> np.ndarray:
        return np.frombuffer(self._section(1), "<i8")

    def ids(self) -> np.ndarray:
        """All ids, from the last level to the first."""
        out = np.zeros(0, np.uint32)
        for i, (w, n) in reversed(list(enumerate(self.levels))):
            above, out = out, unpack_bits(np.frombuffer(self._section(2 + 3 * i), np.uint8), n, w)
            if i + 1 < len(self.levels):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(self._section(3 + 3 * i), np.uint8), count=n, bitorder="little").view(bool))
                out[at] |= above << np.uint32(w)
        return out

    def _gather(self, where: np.ndarray, n: int) -> np.ndarray:
        """n bytes from each offset, read in pages that are kept."""
        at = where[:, None] + np.arange(n)
        page = at // PAGE
        out = np.zeros(at.shape, np.uint8)
        for p in np.unique(page).tolist():
            if p not in self.pages:
                if len(self.pages) >= 4096:
                    self.pages.clear()
                self.pages[p] = np.frombuffer(self.read_at(min(PAGE, self.offsets[-1] - p * PAGE), p * PAGE), np.uint8)
            hit = page == p
            out[hit] = self.pages[p][at[hit] - p * PAGE]
        return out

    def get(self, where: np.ndarray) -> np.ndarray:
        """The ids at these places; a chunk, a block of bits and a count are read for each level that an id reaches."""
        out, rows, at, shift, section = np.zeros(len(where), np.uint32), np.arange(len(where)), where.astype(np.int64), 0, 2
        for i, (w, _) in enumerate(self.levels):
            bit = at * w
            window = self._gather(self.offsets[section] + bit // 8, 8).view("<u8").ravel()
            chunk = (window >> (bit % 8).astype(np.uint64)) & np.uint64((1 << w) - 1)
            out[rows] |= chunk.astype(np.uint32) << np.uint32(shift)
            if i + 1 == len(self.levels) or not len(at):
                break
            block = at // BLOCK
            flags = np.unpackbits(self._gather(self.offsets[section + 1] + block * (BLOCK // 8), BLOCK // 8), axis=1, bitorder="little")
            before = np.arange(BLOCK) < (at % BLOCK)[:, None]
            rank = self._gather(self.offsets[section + 2] + block * 8, 8).view("<i8").ravel() + (flags * before).sum(axis=1, dtype=np.int64)
            more = flags[np.arange(len(at)), at % BLOCK].astype(bool)
            rows, at, shift, section = rows[more], rank[more], shift + w, section + 3
        return out


def _place(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def open_file(path: str) -> TokenFile:
    system, where = _place(path)
    file = system.open_input_file(where)
    return TokenFile(lambda n, at: file.read_at(n, at))


def write_ids(df: DataFrame, tokenizer_path: str, path: str, text: str = "text", key: str = "doc_id", end_id: int = 2) -> DataFrame:
    """Writes the folder `path` and returns its manifest with each file's first token in the whole (base)."""
    spark, path = df.sparkSession, path.rstrip("/")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # The hash parts rows that share an id.
    tied = rows.withColumn("tie", F.xxhash64("text"))
    dealt = tied.repartitionByRange(parts_for(spark, n_bytes), "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text", F.spark_partition_id().alias("pid"))
    system, folder = _place(path)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, (system, folder) = byte_bpe(tokenizer_path), _place(path)
        kind = bpe.dtype if end_id < 1 << 8 * bpe.dtype.itemsize else np.dtype("<u4")
        seq, pid, held, n = 0, 0, [], 0

        def write() -> pa.RecordBatch:
            nonlocal seq, held, n
            keys = pa.chunked_array([k for k, *_ in held]).combine_chunks()
            counts = np.concatenate([c for _, c, _ in held])
            data = encode_file(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.null_count, counts, np.concatenate([i for *_, i in held]))
            name = f"{pid:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(data)
            row = ([pid], [seq], [name], [len(keys)], [int(counts.sum())], [len(data)])
            seq, held, n = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["pid", "seq", "file", "n_docs", "n_tokens", "n_bytes"])

        for part, raw, off in utf8_slices(batches):
            found, counts = bpe.encode(raw, off)
            ids = np.insert(found.astype(kind, copy=False), np.cumsum(counts), end_id)
            counts, pid = counts + 1, part.column(2)[0].as_py()
            held.append((part.column(0), counts, ids))
            n += int(counts.sum())
            if n >= FILE_TOKENS:
                yield write()
        if held:
            yield write()

    map_arrow(dealt, run, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (with its folder), n_docs, n_tokens, n_bytes and base, a row for each file of the folder."""
    path = path.rstrip("/")
    files = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    parts = files.groupBy("pid").agg(F.sum("n_tokens").alias("total"))
    # One row for each part of the sort.
    bases = parts.select("pid", (F.sum("total").over(Window.partitionBy(F.lit(0)).orderBy("pid")) - F.col("total")).alias("part_base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("pid").orderBy("seq")) - F.col("n_tokens")
    placed = files.withColumn("inside", inside).join(bases, "pid")
    return placed.select(F.concat(F.lit(f"{path}/"), "file").alias("file"), "n_docs", "n_tokens", "n_bytes", (F.col("part_base") + F.col("inside")).alias("base"))


def _by_document(files: DataFrame, kind: str, of: Callable[[np.ndarray], object], arrow: pa.DataType, name: str, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = open_file(path)
                keys, at, ids = f.keys(), f.starts(), f.ids()
                for i in range(0, len(keys), 2000):
                    cut = at[i : i + 2001]
                    values = [of(ids[a:e]) for a, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys[i : i + 2000], pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array(values, arrow)], names=["id", "start", "n_tokens", name])

    spark = files.sparkSession
    n_bytes = files.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # A few files to a task.
    dealt = files.select("file", "base").repartition(parts_for(spark, 4 * n_bytes), "file")
    return dealt.mapInArrow(run, f"id long, start long, n_tokens long, {name} {kind}").withColumnRenamed("id", key)


def read_documents(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids of every document of a manifest's files."""
    return _by_document(files, "array<int>", lambda x: x.astype(np.int32), pa.list_(pa.int32()), "ids", key)


def checksums(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 (of ids as little-endian unsigned 32-bit integers) of every document."""
    return _by_document(files, "long", lambda x: zlib.crc32(x.astype("<u4", copy=False)), pa.int64(), "ids_crc32", key)


def tokens_at(files: DataFrame, positions: DataFrame, position: str = "position") -> DataFrame:
    """positions with token: the id at each place of the whole, null where there is none. Reads pages around these places only."""
    cell = lambda c: F.floor(c / FILE_TOKENS)
    covered = files.select("file", "base", "n_tokens", F.explode(F.sequence(cell(F.col("base")), cell(F.col("base") + F.col("n_tokens") - 1))).alias("cell"))
    others = [c for c in positions.columns if c.lower() != "token"]
    wanted = positions.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("r"), F.col(f"`{position}`").cast("long").alias("p"))
    asked = wanted.select("p").where("p is not null").distinct().withColumn("cell", cell(F.col("p")))
    met = asked.join(covered, "cell").where("p >= base and p < base + n_tokens").select("file", "p", (F.col("p") - F.col("base")).alias("at"))
    dealt = met.repartition("file", F.floor(F.col("at") / (16 * PAGE))).sortWithinPartitions("file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            paths, p, at = b.column(0).to_numpy(zero_copy_only=False), b.column(1), b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(paths[1:] != paths[:-1]) + 1).tolist(), len(paths)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if paths[i] != name:
                    name, f = paths[i], open_file(paths[i])
                yield pa.RecordBatch.from_arrays([p[i:j], pa.array(f.get(at[i:j]).astype(np.int64))], names=["p", "token"])

    found = map_arrow(dealt, run, "p long, token long", rows=10_000)
    return wanted.join(found, "p", "left").select(*[F.col(f"r.`{c}`") for c in others], "token")
