"""Helpers that the corpus operators share: table access, shared storage and Arrow slicing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a vectorised kernel handles at once; bounds a worker's memory.
SLICE_BYTES = 1 << 21
#: Bytes in a range- or hash-dealt part: SMALL_PART up to MANY_PARTS parts, then up to LARGE_PART.
SMALL_PART, LARGE_PART, MANY_PARTS = 16 << 20, 128 << 20, 16_384
#: Rows in a file of a table that a loop writes again and again.
FILE_ROWS = 1 << 20
_local: list[str] = []
#: What kernels keep in a worker process, by the kernel's name.
_kept: dict[str, dict] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary folder where all of Spark is one process."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return found
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tables-"))
    return _local[0]


def parts_for(spark: SparkSession, n_bytes: int) -> int:
    """A number of parts that follows the bytes dealt out, so that a part stays level as the input grows."""
    return max(spark.sparkContext.defaultParallelism, min(-(-n_bytes // SMALL_PART), MANY_PARTS), -(-n_bytes // LARGE_PART))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Stored:
    """Tables written to the shared folder to cut lineage; they go when the session's process ends, or on drop()."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []
        atexit.register(self._at_exit)

    def folder(self) -> str:
        """A new path in the shared folder, deleted like a table."""
        self.paths.append(path := f"{shared_dir(self.spark)}/tables/{uuid.uuid4().hex}")
        return path

    def write(self, df: DataFrame, n_rows: int | None = None, n_bytes: int = 0) -> DataFrame:
        """n_rows, n_bytes: about how many rows and bytes there are or at most can be, so that a small table doesn't get a file for each shuffle partition; whole rounds of tasks."""
        path = self.folder()
        if n_rows is not None:
            cores = self.spark.sparkContext.defaultParallelism
            n = max(parts_for(self.spark, n_bytes), -(-n_rows // FILE_ROWS))
            df = df.coalesce(-(-n // cores) * cores)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes what these frames were read from; nothing may read them afterwards."""
        for df in frames:
            for path in list(self.paths):
                if path.rpartition("/")[2] in "".join(df.inputFiles()[:1]):
                    _delete(self.spark, path)
                    self.paths.remove(path)

    def _at_exit(self) -> None:
        try:
            for path in self.paths:
                _delete(self.spark, path)
        except Exception:  # noqa: BLE001  the gateway may be gone by then
            pass


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names the operator puts out itself; the operator's columns replace them."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def kept_by(name: str) -> dict:
    """What the kernel of this name keeps in this process; a worker that goes on to another kernel lets it go."""
    return _kept.setdefault(name, {})


def let_go(keeps: str) -> None:
    for name, loaded in _kept.items():
        if name != keeps:
            loaded.clear()


def map_arrow(df: DataFrame, f, schema, rows: int = 500, keeps: str = "") -> DataFrame:
    """mapInArrow; f gets batches of at most `rows` rows, cut from Spark's, whose bytes spark.sql.execution.arrow.maxBytesPerBatch bounds. keeps: the kernel whose kept things f uses; workers serve one stage after another, and those of others are let go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        return f(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def utf8_slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with the column's UTF-8 bytes end to end and n + 1 offsets; null counts as empty. A slice holds at most `most` bytes unless one row alone is longer."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        n, off = len(col), None
        if not n:
            continue
        _, o, data = col.buffers()
        off = np.frombuffer(o, dtype=np.int64)[col.offset : col.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
