"""A table that changes by key, with one version at a time: copy-on-write by bucket of the key, and a manifest put in place at once.

Rows lie in a fixed number of buckets by a hash of their key. A batch of changes writes anew only the buckets that it
touches, to a folder of its own, and then puts the next manifest in place: the folder of every bucket and the last batch of
each writer. A reader lists the folders of one manifest, so it sees one version whatever is being written. A manifest is
renamed into place under a number that only one writer can take; who comes second applies the batch to the new version. A
batch that is sent again, under a number its writer has used, changes nothing.

The rename must fail where the name is taken, which holds for HDFS; on a local disk two drivers could meet between the look
and the rename, and object stores would need a conditional put, so they are not for this.

Defined results: null is a key like another; of several changes of a key in a batch the last by ``order`` holds, of equal
ones the greatest as JSON; a delete and an upsert of one key in a batch: the upsert holds; an empty batch makes a version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators.state import last_of_each, without
from quire.sources.scratch import stored

Changes = DataFrame | Callable[[DataFrame], DataFrame]

#: Times that a batch is applied anew because another writer came first.
ATTEMPTS = 10


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    folders: dict[int, str]
    batches: dict[str, int]

    def text(self) -> str:
        return json.dumps({**self.__dict__, "folders": {str(k): v for k, v in self.folders.items()}})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(**{**d, "keys": tuple(d["keys"]), "folders": {int(k): v for k, v in d["folders"].items()}})


class CommittedTable:
    """The table in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    @staticmethod
    def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, *order: str | Column) -> CommittedTable:
        """A new table of the last of ``rows`` of each key."""
        table = CommittedTable(rows.sparkSession, path)
        first = Manifest(0, rows.schema.json(), tuple(keys), buckets, {}, {})
        folders = table._written(last_of_each(rows, keys, *order), first)
        if not table._put(Manifest(1, first.schema, first.keys, buckets, folders, {})):
            raise FileExistsError(f"{path} has a table already")
        return table

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, or the newest."""
        numbers = self.versions()
        n = version if version is not None else max(numbers)
        if n not in numbers:
            raise KeyError(f"version {n} is not there")
        stream = self._fs.open(self._hadoop(self._name(n)))
        try:
            return Manifest.of(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, which later batches do not change."""
        return self._rows(self.manifest(version))

    def apply(self, writer: str, batch: int, upserts: Changes | None = None, deletes: Changes | None = None, *order: str | Column) -> int:
        """Upserts rows and deletes keys in one step, unless ``writer`` has applied this batch or a later one; the version after it.

        Changes may be a function of the rows they are applied to: it is asked again where another writer came first.
        """
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if batch <= now.batches.get(writer, -1):
                return now.version
            keys = list(now.keys)
            schema = StructType.fromJson(json.loads(now.schema))
            of = lambda changes: changes(self._rows(now)) if callable(changes) else changes
            new = last_of_each(of(upserts), keys, *order) if upserts is not None else self.spark.createDataFrame([], schema)
            new = stored(new.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), "changes")
            gone = new.select(*keys)
            gone = stored(gone.unionByName(of(deletes).select(*keys)), "keys") if deletes is not None else gone
            touched = [r[0] for r in gone.select(self._bucket(now).alias("b")).distinct().collect()]  # no more than there are buckets
            kept = without(self._rows(now, touched), gone, keys)
            written = self._written(kept.unionByName(new), now)
            folders = {b: f for b, f in now.folders.items() if b not in touched} | written
            if self._put(Manifest(now.version + 1, now.schema, now.keys, now.buckets, folders, now.batches | {writer: batch})):
                return now.version + 1
        raise RuntimeError(f"{self.path}: {ATTEMPTS} other writers came first")

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all manifests but the last ``keep`` and the folders that none of those has; no batch may be under way, and no
        reader may use an older version. How many folders went."""
        numbers = self.versions()
        live = {f for n in numbers[-keep:] for f in self.manifest(n).folders.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._hadoop(self._name(n)), False)
        data, n = self._hadoop(f"{self.path}/data"), 0
        for write in self._fs.listStatus(data) if self._fs.exists(data) else []:
            parts = [s.getPath() for s in self._fs.listStatus(write.getPath()) if s.isDirectory()]
            dead = [p for p in parts if f"{write.getPath().getName()}/{p.getName()}" not in live]
            for p in dead:
                n += self._fs.delete(p, True)
            if len(dead) == len(parts):
                self._fs.delete(write.getPath(), True)
        return n

    def _name(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.xxhash64(*m.keys), F.lit(m.buckets)).cast("int")

    def _rows(self, m: Manifest, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{f}" for b, f in sorted(m.folders.items()) if buckets is None or b in buckets]
        schema = StructType.fromJson(json.loads(m.schema))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _written(self, rows: DataFrame, m: Manifest) -> dict[int, str]:
        """Writes ``rows`` by bucket to a new folder; the part of it that each bucket got. A large bucket is written by several tasks."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket(m)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        parts = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/data/{name}")) if s.isDirectory()]
        return {int(p.split("=")[1]): f"{name}/{p}" for p in parts if p.startswith("_bucket=")}

    def _put(self, m: Manifest) -> bool:
        """Whether the manifest took its number."""
        draft, final = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._hadoop(self._name(m.version))
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(m.text().encode()))
        finally:
            out.close()
        if not self._fs.exists(final) and self._fs.rename(draft, final):
            return True
        self._fs.delete(draft, False)
        return False


def release_claims(reviews: CommittedTable, writer: str, batch: int, as_of: int, expiry: int = 1800) -> int:
    """Clears the claims of reviews not submitted that nobody has renewed for ``expiry`` seconds (J5); the version after it."""

    def cleared(rows: DataFrame) -> DataFrame:
        late = rows.where(F.col("submitted_s").isNull() & F.col("claimed_by").isNotNull() & (as_of - F.col("claimed_at") > expiry))
        return late.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in ("claimed_by", "claimed_at")})

    return reviews.apply(writer, batch, cleared)
