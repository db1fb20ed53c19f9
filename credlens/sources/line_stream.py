"""Lines of files as a data source whose places are (file, byte): a large file is split over tasks and micro-batches.

A line belongs to the range of bytes in which it begins, so any cut of a file into ranges gives every line once. The stream
keeps a log of plans in its own folder: plan n holds the ranges of batch n, and every tenth also how far each file is
planned. An offset is a plan's number; a batch that is run again reads the same ranges. A file is taken in the order
of names, up to its size when it was planned; what is appended later is planned later, so a last line without a line end should
be finished before it is listed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value binary, file string, start long, end long"
#: Bytes of a micro-batch, of a task's share of it, and of one read.
BATCH_BYTES, SPLIT_BYTES, BLOCK = 1 << 30, 1 << 26, 1 << 23
SNAPSHOT = 10

#: file, first byte, byte after the last.
Range = tuple[str, int, int]


def place(path: str):
    """pyarrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of all files under a path, or of the file that it is, by name."""
    from pyarrow import fs

    system, where = place(path)
    one = system.get_file_info(where)
    if one.type == fs.FileType.File:
        return [(one.path, one.size)]
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(where, recursive=True)) if f.type == fs.FileType.File)


def lines_in(file, size: int, begin: int, end: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Blocks (bytes from the first start on, starts, ends behind the line end) of the lines that begin in [begin, end)."""
    if begin >= end:
        return
    at, tail = begin, b""
    if begin:  # the line before may reach over
        at = begin - 1
        while at < size:
            block = file.read_at(min(BLOCK, size - at), at)
            if (cut := block.find(b"\n")) >= 0:
                at += cut + 1
                break
            at += len(block)
        else:
            return
    first = at
    while first < end:
        block = tail + file.read_at(min(BLOCK, size - first - len(tail)), first + len(tail))
        last = first + len(block) >= size
        cuts = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
        ends = np.r_[cuts, len(block)] if last and (not len(cuts) or cuts[-1] < len(block)) else cuts
        starts = np.r_[0, ends[:-1]][: len(ends)]
        mine = starts < end - first
        starts, ends = starts[mine], ends[mine]
        if len(starts):
            yield block, first + starts, first + ends
        if last or not mine.all():
            return
        used = int(ends[-1]) if len(ends) else 0
        first, tail = first + used, block[used:]


def _batches(ranges: Sequence[Range]) -> Iterator[pa.RecordBatch]:
    for path, begin, end in ranges:
        system, where = place(path)
        with system.open_input_file(where) as file:
            for block, starts, ends in lines_in(file, file.size(), begin, end):
                yield _record(block, starts, ends, path)


def _record(block: bytes, starts: np.ndarray, ends: np.ndarray, path: str) -> pa.RecordBatch:
    """The lines without their line end; a line's place in the block is its start minus that of the block."""
    base = int(starts[0])
    offsets = np.r_[starts, ends[-1]] - base
    raw = np.frombuffer(block, np.uint8)[: int(offsets[-1])]
    stop = ends - base
    feed = raw[stop - 1] == 10
    keep = np.ones(len(raw), bool)
    keep[stop[feed] - 1] = False
    sizes = np.diff(offsets) - feed
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(raw[keep])])
    return pa.RecordBatch.from_arrays([values.cast(pa.binary()), pa.array([path]).take(pa.array(np.zeros(len(sizes), np.int32))), pa.array(starts), pa.array(ends)], names=["value", "file", "start", "end"])


@dataclass
class Share(InputPartition):
    ranges: list[Range]


def shares(ranges: Sequence[Range], split: int) -> list[Share]:
    """Ranges cut to pieces of at most `split` bytes, and small ones put together up to it."""
    out, held, n = [], [], 0
    for path, begin, end in ranges:
        while begin < end:
            take = min(end - begin, split - n)
            held.append((path, begin, begin + take))
            begin, n = begin + take, n + take
            if n >= split:
                out.append(Share(held))
                held, n = [], 0
    return out + ([Share(held)] if held else [])


class PlanLog:
    """The plans of a stream, and how far each file is planned."""

    def __init__(self, folder: str) -> None:
        self.system, self.folder = place(folder)
        self.load()

    def load(self) -> None:
        self.done: dict[str, int] = {}
        numbers = self.numbers()
        snaps = [n for n in numbers if n % SNAPSHOT == 0]
        for n in [n for n in numbers if not snaps or n >= snaps[-1]]:
            plan = self.read(n)
            self.done |= plan.get("done", {})
            self._apply(plan["ranges"])
        self.last = numbers[-1] if numbers else 0

    def _apply(self, ranges) -> None:
        for path, _, end in ranges:
            self.done[path] = max(self.done.get(path, 0), end)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        there = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(f.base_name.split(".")[0]) for f in there if f.base_name.endswith(".json"))

    def read(self, n: int) -> dict:
        with self.system.open_input_stream(f"{self.folder}/{n:09d}.json") as f:
            return json.loads(f.read())

    def add(self, ranges: list[Range]) -> None:
        self._apply(ranges)
        self.last += 1
        plan = {"ranges": ranges} | ({"done": self.done} if self.last % SNAPSHOT == 0 else {})
        where = f"{self.folder}/{self.last:09d}.json"
        self.system.create_dir(self.folder, recursive=True)
        with self.system.open_output_stream(where + ".new") as f:
            f.write(json.dumps(plan).encode())
        self.system.move(where + ".new", where)

    def forget_after(self, n: int) -> None:
        """Drops plans that no batch was begun for."""
        for x in self.numbers():
            if x > n:
                self.system.delete_file(f"{self.folder}/{x:09d}.json")
        self.load()

    def ranges(self, after: int, last: int) -> list[Range]:
        """Those of the plans behind one up to another."""
        return [tuple(r) for n in range(after + 1, last + 1) for r in self.read(n)["ranges"]]

    def left(self, path: str) -> list[Range]:
        """What isn't planned yet of the files under a path, in order."""
        return [(f, self.done.get(f, 0), size) for f, size in listed(path) if size > self.done.get(f, 0)]


def upto(ranges: list[Range], until: tuple[str, int] | None) -> list[Range]:
    """Ranges before a place, or all."""
    if until is None:
        return ranges
    return [(f, a, b if f < until[0] else min(b, until[1])) for f, a, b in ranges if f < until[0] or (f == until[0] and a < until[1])]


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.log = options["path"], PlanLog(options["log"])
        self.batch, self.split = int(options.get("batchbytes", BATCH_BYTES)), int(options.get("splitbytes", SPLIT_BYTES))
        self.files = int(options["files"]) if options.get("files") else None
        self.until = tuple(json.loads(options["until"])) if options.get("until") else None

    def initialOffset(self) -> dict:
        return {"plan": 0}

    def latestOffset(self) -> dict:
        """Plans the next batch, if anything is left."""
        ranges, n = [], 0
        for path, begin, end in upto(self.log.left(self.path), self.until):
            if n >= self.batch or len(ranges) == self.files:
                break
            end = min(end, begin + self.batch - n)
            ranges.append((path, begin, end))
            n += end - begin
        if ranges:
            self.log.add(ranges)
        return {"plan": self.log.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return shares(self.log.ranges(start["plan"], end["plan"]), self.split)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition.ranges)


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.ranges, self.split = [tuple(r) for r in json.loads(options["ranges"])], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        return shares(self.ranges, self.split)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _batches(partition.ranges)


class LineSource(DataSource):
    """Options: path and log, for streams (batchbytes, splitbytes, files for each batch, and until, a place [file, byte] as JSON, besides); ranges as JSON for single reads."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def read_ranges(spark: SparkSession, ranges: list[Range], split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format("byte_lines").option("ranges", json.dumps(ranges)).option("splitbytes", str(split)).load()


def read_stream(spark: SparkSession, path: str, log: str, batch: int = BATCH_BYTES, split: int = SPLIT_BYTES, until: tuple[str, int] | None = None, files: int | None = None) -> DataFrame:
    spark.dataSource.register(LineSource)
    made = spark.readStream.format("byte_lines").option("path", path).option("log", log).option("batchbytes", str(batch)).option("splitbytes", str(split))
    for name, value in (("until", json.dumps(until) if until else None), ("files", files)):
        made = made.option(name, str(value)) if value else made
    return made.load()
