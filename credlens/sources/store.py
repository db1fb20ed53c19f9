"""Histogram tables with additive merges on plain Parquet, for several writers at once.

A commit writes its rows as a new folder of each table and then claims the next manifest, a file that only one writer can
create: the live folders of every table with their level, the last batch of every query, and what is deleted. A writer that
loses the claim reads the new manifest and tries again with the folders it has. Readers see the newest manifest, so a commit
counts as a whole or not at all, and a batch that is run again changes nothing.

Folders are levelled: FAN of one level of a table are put together into one of the next, ranged by key, so that a row is
written about log(commits) / log(FAN) times. Deleting a dataset marks it in the manifest; its rows in folders up to then
don't count any more and go when their folders are put together.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Key columns of each histogram; the other columns are added up.
KEYS = {
    "length_histogram": ("dataset_id", "length"),
    "charset_histogram": ("dataset_id", "charset_mask"),
    "entropy_histogram": ("dataset_id", "entropy_type", "bucket_min"),
    "pattern_stats": ("dataset_id", "pattern_type", "pattern_repr"),
    "token_frequencies": ("dataset_id", "token_type", "token"),
    "score_histogram": ("dataset_id", "score"),
    "dataset_totals": ("dataset_id", "mode"),
}
#: Key columns of tables of records, of which the newest by `version` counts.
RECORDS = {"file_progress": ("dataset_id", "filename"), "ingestion_runs": ("id",), "datasets": ("id",)}
#: Longest representation and token that are kept; cut before grouping, so that no two rows share a key.
REPR_LEN, TOKEN_LEN = 255, 64
#: Columns that no two records of a table share.
UNIQUE = {"datasets": ("name",)}
#: Folders of one level that are put together; manifests after which what they replaced goes; manifests that are kept.
FAN, GRACE, KEPT = 8, 3, 10
#: Lost claims after which a writer gives up.
TRIES = 200
#: Rows that a new store holds: the dataset of single events.
SEED = [(0, "user_queries", "user_submitted")]
RULES = {
    "score_histogram": "score not between 0 and 4", "datasets": "dataset_type not in ('leaked', 'user_submitted')",
    "file_progress": "status not in ('pending', 'running', 'completed', 'failed')", "ingestion_runs": "status not in ('running', 'completed', 'failed', 'interrupted')",
}


def merge_counts(old: DataFrame, delta: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of both, with the other columns summed by key."""
    return summed(old.unionByName(delta, allowMissingColumns=True), keys)


def summed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows with all but the keys summed; a time of update is the latest."""
    return rows.groupBy(*keys).agg(*[(F.max(c) if c == "updated_at" else F.sum(c)).alias(c) for c in rows.columns if c not in keys])


def newest(rows: DataFrame, keys: tuple[str, ...], bare: bool = True) -> DataFrame:
    """The row of each key with the highest version; bare: without the version."""
    last = Window.partitionBy(*keys).orderBy(F.desc("version"))
    kept = rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")
    return kept.drop("version") if bare else kept


class HistogramStore:
    """A folder with the folders of each table and the manifests."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.written = 0  # bytes, for measurements

    # Files.

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _local(self) -> str | None:
        """The path as the operating system knows it, if it does."""
        return "/" + self.path[5:].lstrip("/") if self.path.startswith("file:") else self.path if self.path.startswith("/") and self._fs(self.path)[0].getScheme() == "file" else None

    def _claim(self, seq: int, text: str) -> bool:
        """Creates the manifest of a number with its whole content; False if it is there already."""
        name, fresh = f"_log/{seq:012d}.json", f"_log/{uuid.uuid4().hex}.new"
        if local := self._local():
            os.makedirs(f"{local}/_log", exist_ok=True)
            with open(f"{local}/{fresh}", "w") as f:
                f.write(text)
            try:
                os.link(f"{local}/{fresh}", f"{local}/{name}")  # fails if the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{local}/{fresh}")
        fs, where = self._fs(f"{self.path}/{fresh}")
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.rename(where, self._fs(f"{self.path}/{name}")[1]):  # a distributed file system's rename refuses a taken name
            return True
        fs.delete(where, False)
        return False

    def _numbers(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/_log")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self) -> dict:
        """The newest manifest; `_kept` are the numbers that are there."""
        for _ in range(TRIES):
            numbers = self._numbers()
            if not numbers:
                return {"seq": 0, "tables": {}, "batches": {}, "deleted": {}, "gone": [], "_kept": []}
            where = f"{self.path}/_log/{numbers[-1]:012d}.json"
            if local := self._local():
                try:
                    with open(f"{local}/_log/{numbers[-1]:012d}.json") as f:
                        return json.load(f) | {"_kept": numbers}
                except FileNotFoundError:
                    continue  # others went on meanwhile
            return json.loads("".join(r.value for r in self.spark.read.text(where).collect())) | {"_kept": numbers}
        raise RuntimeError(f"no manifest of {self.path} can be read")

    def _publish(self, change: Callable[[dict], dict | None]) -> bool:
        """Claims the manifest that change makes of the newest one, again if another writer was first; False if change gives None."""
        for attempt in range(TRIES):
            old = self._manifest()
            kept = old.pop("_kept")
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return False
            new["seq"] = old["seq"] + 1
            late = [g for g in new["gone"] if g[0] + GRACE < new["seq"]]
            new["gone"] = [g for g in new["gone"] if g not in late]
            if self._claim(new["seq"], json.dumps(new)):
                for _, where in late:
                    self._delete(f"{self.path}/{where}")
                for n in kept:
                    if n + KEPT < new["seq"]:
                        self._delete(f"{self.path}/_log/{n:012d}.json")
                return True
            time.sleep(min(0.5, 0.01 * 2 ** min(attempt, 6)) * (0.5 + uuid.uuid4().int % 1000 / 1000))
        raise RuntimeError(f"another writer of {self.path} was first {TRIES} times")

    # Rows.

    def _write(self, table: str, rows: DataFrame) -> str:
        """A new folder of rows that keep their table's rules; no manifest names it yet."""
        where = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{where}")
        fs, at = self._fs(f"{self.path}/{where}")
        self.written += fs.getContentSummary(at).getLength()
        if table in RULES and (broken := check(table, self.spark.read.parquet(f"{self.path}/{where}")).limit(1).count()):
            self._delete(f"{self.path}/{where}")
            raise ValueError(f"{broken} row or more of {table} break its constraint: {RULES[table]}")
        return where

    def _raw(self, manifest: dict, table: str, folders: list) -> DataFrame:
        """Rows of folders ([path, level, seq]) without those of deleted datasets; records with their version."""
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{where}" for where, *_ in folders])
        gone = {int(k): n for k, n in manifest["deleted"].get(table, {}).items() if n >= min(seq for *_, seq in folders)}
        owner = "id" if table == "datasets" else "dataset_id"
        if not gone and table not in RECORDS:
            return rows
        seqs = F.create_map(*[F.lit(x) for where, _, seq in folders for x in (where.rpartition("/")[2], seq)])
        rows = rows.withColumn("_seq", F.element_at(seqs, F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/[^/]*$", 1)))
        if gone and owner in rows.columns:
            deleted = F.try_element_at(F.create_map(*[F.lit(x) for k, n in gone.items() for x in (k, n)]), F.col(owner).cast("int"))
            rows = rows.where(deleted.isNull() | (F.col("_seq") > deleted))
        if table in RECORDS:
            known = F.col("version") if "version" in rows.columns else F.lit(None)
            rows = rows.withColumn("version", F.coalesce(known.cast("long"), F.col("_seq").cast("long")))
        return rows.drop("_seq")

    def _rows(self, manifest: dict, table: str, folders: list, whole: bool = True) -> DataFrame:
        rows = self._raw(manifest, table, folders)
        if table in KEYS:
            return summed(rows, KEYS[table])
        return newest(rows, RECORDS[table], whole) if table in RECORDS else rows

    def read(self, table: str) -> DataFrame | None:
        manifest = self._manifest()
        folders = manifest["tables"].get(table)
        return self._rows(manifest, table, folders) if folders else None

    # Changes.

    def commit(self, batch: str | None, deltas: dict[str, DataFrame], number: int = 0) -> bool:
        """Adds all deltas at once; False if this batch of this name, or a later one, was committed before."""
        done = lambda m: batch is not None and m["batches"].get(batch, -1) >= number
        if done(self._manifest()):
            return False
        made: dict[str, str] = {}
        try:
            for table, delta in deltas.items():
                made[table] = self._write(table, delta.withColumn("updated_at", F.current_timestamp()) if table == "dataset_totals" else delta)

            def add(m: dict) -> dict | None:
                if done(m):
                    return None
                for table, where in made.items():
                    self._unique(m, table, where)
                    m["tables"].setdefault(table, []).append([where, 0, m["seq"] + 1])
                if batch is not None:
                    m["batches"][batch] = number
                return m

            added = self._publish(add)
        except BaseException:
            self._drop(made.values())
            raise
        if not added:
            self._drop(made.values())
            return False
        self.compact()
        return True

    def _drop(self, folders) -> None:
        for where in folders:
            self._delete(f"{self.path}/{where}")

    def _unique(self, manifest: dict, table: str, where: str) -> None:
        """Refuses rows of a new folder whose unique columns another record has."""
        if table not in UNIQUE:
            return
        new = self.spark.read.parquet(f"{self.path}/{where}")
        keys, on = RECORDS[table], list(UNIQUE[table])
        every = new.select(*on, *keys)
        if folders := manifest["tables"].get(table):
            every = every.unionByName(self._rows(manifest, table, folders).join(new.select(*keys), list(keys), "left_anti").select(*on, *keys))
        if twice := every.distinct().groupBy(*on).count().where("count > 1").first():
            raise ValueError(f"{table} has {tuple(twice)[:-1]} already")

    def compact(self) -> None:
        """Puts FAN folders of one level of a table together, level by level, until no level has as many."""
        again = True
        while again:
            again, manifest = False, self._manifest()
            for table, folders in manifest["tables"].items():
                for level in sorted({x[1] for x in folders}):
                    if len(some := [x for x in folders if x[1] == level]) >= FAN:
                        again |= self._merge(manifest, table, some, level + 1)
                        break

    def _merge(self, manifest: dict, table: str, some: list, level: int) -> bool:
        rows = self._rows(manifest, table, some, whole=False)
        keys = [c for c in (KEYS.get(table) or RECORDS.get(table) or ()) if c in rows.columns]
        where = self._write(table, rows.repartitionByRange(*keys) if keys else rows)

        def put(m: dict) -> dict | None:
            # Another writer was faster, or something was deleted from them meanwhile.
            if any(x not in m["tables"].get(table, []) for x in some) or m["deleted"].get(table) != manifest["deleted"].get(table):
                return None
            m["tables"][table] = [x for x in m["tables"][table] if x not in some] + [[where, level, m["seq"] + 1]]
            m["gone"] += [[m["seq"] + 1, x[0]] for x in some]
            return m

        if not self._publish(put):
            self._drop([where])
            return False
        return True

    def record(self, table: str, rows: DataFrame) -> None:
        """New states of records."""
        self.commit(None, {table: rows})

    def replace(self, table: str, rows: DataFrame, dataset_id: int) -> None:
        """Derived rows of one dataset anew, those of others as they were."""
        where = self._write(table, rows)

        def put(m: dict) -> dict:
            m["deleted"].setdefault(table, {})[str(dataset_id)] = m["seq"]
            m["tables"].setdefault(table, []).append([where, 0, m["seq"] + 1])
            return m

        self._publish(put)
        self.compact()

    def delete_dataset(self, dataset_id: int) -> None:
        """Deletes a dataset with all its rows in all tables, at once."""

        def put(m: dict) -> dict:
            for table in m["tables"]:
                m["deleted"].setdefault(table, {})[str(dataset_id)] = m["seq"]
            return m

        self._publish(put)

    def reset(self, seed: bool = False) -> None:
        """No tables, no log of batches; with seed, the datasets that a new store holds."""
        self._delete(self.path)
        if seed:
            self.record("datasets", self.spark.createDataFrame(SEED, "id long, name string, dataset_type string"))

    def dataset(self, name: str) -> int:
        """The id of a dataset that must be there."""
        rows = self.read("datasets")
        found = rows.where(F.col("name") == name).select("id").first() if rows is not None else None
        if found is None:
            raise ValueError(f"no dataset {name!r}")
        return found[0]

    def ensure_dataset(self, name: str, kind: str = "leaked") -> int:
        """The id of a dataset, a new one if there is none of this name. Writers that are new at once agree: the rule of unique names lets one of them through."""
        for _ in range(TRIES):
            rows = self.read("datasets")
            if rows is not None and (found := rows.where(F.col("name") == name).select("id").first()):
                return found[0]
            top = rows.agg(F.max("id")).first()[0] if rows is not None else None
            new = self.spark.createDataFrame([((top or 0) + 1, name, kind)], "id long, name string, dataset_type string")
            try:
                self._new_dataset(new)
            except ValueError:
                continue
        raise RuntimeError(f"no id for {name!r}")

    def _new_dataset(self, new: DataFrame) -> None:
        """A dataset whose id and name must both be free when the manifest is claimed."""
        wanted, where = new.first(), self._write("datasets", new)

        def put(m: dict) -> dict:
            folders = m["tables"].get("datasets")
            taken = F.col("name").eqNullSafe(wanted.name) | (F.col("id") == wanted.id)
            if folders and self._rows(m, "datasets", folders).where(taken).first():
                raise ValueError(f"dataset {wanted.id} or {wanted.name!r} is taken")
            m["tables"].setdefault("datasets", []).append([where, 0, m["seq"] + 1])
            return m

        try:
            self._publish(put)
        except ValueError:
            self._drop([where])
            raise
        self.compact()


def get_or_create(datasets: DataFrame, wanted: DataFrame) -> DataFrame:
    """datasets (id, name, dataset_type) with new ids for the names in wanted that it lacks."""
    new = wanted.dropDuplicates(["name"]).join(datasets, "name", "left_anti")
    top = datasets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = new.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(Window.orderBy("name"))).alias("id"), "name", "dataset_type")
    return datasets.select("id", "name", "dataset_type").unionByName(fresh)


def check(table: str, rows: DataFrame) -> DataFrame:
    """Rows that break a constraint of their table."""
    return rows.where(RULES.get(table, "false"))
