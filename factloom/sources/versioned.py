"""Tables of immutable Parquet folders with snapshots: merge by key, compaction, and readers pinned to a version.

A table's state is a manifest, a small JSON file that lists its folders: base folders hold each key once, change
folders hold newer rows and deletions in order of version. A merge writes one change folder, a compaction folds the
changes into a new base; both become visible by creating the next manifest, which fails if another writer made that
version first. A writer that dies leaves folders that no manifest names, and readers keep the version they opened.

Rows of all folders are dealt to buckets by a hash of their key, so looking up a few keys opens their buckets only.
Base rows are never shuffled to read a snapshot unless the changes are too many to be broadcast: Spark decides by
their size.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
BUCKET, VERSION, DELETED = "_bucket", "_version", "_deleted"


class VersionConflict(RuntimeError):
    """Another writer committed the version first; the merge can be tried again on top of it."""


@dataclass(frozen=True)
class Manifest:
    version: int
    key: str
    schema: str
    buckets: int
    base: list[str] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class VersionedTable:
    """A table under `path`. All methods that write return the new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # -- manifests

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        folder = self._file(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, the newest whole one by default."""
        for v in [version] if version is not None else reversed(self.versions()):
            stream = self._fs.open(self._file(f"{self.path}/manifests/{v:012d}.json"))
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                return Manifest(**json.loads(text))
            except ValueError:
                if version is not None:
                    raise
        raise FileNotFoundError(f"{self.path} has no snapshot")

    def _commit(self, m: Manifest) -> int:
        try:
            out = self._fs.create(self._file(f"{self.path}/manifests/{m.version:012d}.json"), False)
        except Exception as e:
            if "exists" in str(e):
                raise VersionConflict(f"version {m.version} of {self.path} is there already") from e
            raise
        try:
            out.write(bytearray(json.dumps(m.__dict__).encode()))
        finally:
            out.close()
        return m.version

    def _next(self) -> int:
        return max(self.versions(), default=-1) + 1

    # -- writing

    def _write(self, rows: DataFrame, m: Manifest) -> str:
        name = f"data/{uuid.uuid4().hex}"
        key = F.coalesce(F.col(m.key), F.raise_error(F.lit(f"null {m.key}")).cast(dict(rows.dtypes)[m.key]))
        rows = rows.withColumn(m.key, key).withColumn(BUCKET, _bucket(F.col(m.key), m.buckets)).withColumn(VERSION, F.lit(m.version).cast("long"))
        rows.repartition(BUCKET, F.pmod(F.xxhash64(m.key, F.lit(1)), F.lit(8))).sortWithinPartitions(BUCKET, m.key).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return name

    def create(self, rows: DataFrame, key: str, buckets: int = BUCKETS) -> int:
        """Makes the table from rows that hold each key once."""
        m = Manifest(self._next(), key, rows.schema.json(), buckets)
        single = F.count(F.lit(1)).over(Window.partitionBy(key)) == 1
        rows = rows.withColumn(DELETED, F.when(single, F.lit(False)).otherwise(F.raise_error(F.lit(f"repeated {key}")).cast("boolean")))
        return self._commit(Manifest(m.version, key, m.schema, buckets, [self._write(rows, m)], []))

    def merge(self, changes: DataFrame, deleted: Column | None = None, order: str | None = None, onto: int | None = None) -> int:
        """Inserts rows of new keys, replaces those of known keys, and removes keys whose change is `deleted` (a
        condition on the changes). A key with several changes takes the one of greatest `order`; without `order` that is
        an error, as in SQL MERGE. With `onto` the merge is made on top of that version only, for changes computed from
        its rows; if there is a newer one, it is a conflict."""
        version = self._next()  # before the manifest is read: what another writer commits from here on makes this one fail
        if onto is not None and version != onto + 1:
            raise VersionConflict(f"{self.path} has moved on from version {onto}")
        old = self.manifest()
        m = Manifest(version, old.key, old.schema, old.buckets)
        columns = StructType.fromJson(json.loads(old.schema)).names
        rows = changes.withColumn(DELETED, F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False))
        if order:
            nth = F.row_number().over(Window.partitionBy(old.key).orderBy(F.desc(order)))
            rows = rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
        else:
            single = F.count(F.lit(1)).over(Window.partitionBy(old.key)) == 1
            rows = rows.withColumn(DELETED, F.when(single, F.col(DELETED)).otherwise(F.raise_error(F.lit(f"repeated {old.key}")).cast("boolean")))
        folder = self._write(rows.select(*columns, DELETED), m)
        return self._commit(Manifest(m.version, old.key, old.schema, old.buckets, old.base, [*old.changes, folder]))

    def compact(self) -> int:
        """Folds all changes into a new base; older versions stay readable until `expire`."""
        version = self._next()  # before the manifest is read: what another writer commits from here on makes this one fail
        old = self.manifest()
        m = Manifest(version, old.key, old.schema, old.buckets)
        folder = self._write(self._rows(old).withColumn(DELETED, F.lit(False)), m)
        return self._commit(Manifest(m.version, old.key, old.schema, old.buckets, [folder], []))

    def expire(self, keep: int = 2) -> list[str]:
        """Removes manifests before the newest `keep`, and the folders that only they name. Run it when no reader
        holds an older version and no writer is at work."""
        gone, stay = self.versions()[:-keep], self.versions()[-keep:]
        used = {f for v in stay for f in (lambda x: x.base + x.changes)(self.manifest(v))}
        old = {f for v in gone for f in (lambda x: x.base + x.changes)(self.manifest(v))} - used
        for v in gone:
            self._fs.delete(self._file(f"{self.path}/manifests/{v:012d}.json"), False)
        for f in old:
            self._fs.delete(self._file(f"{self.path}/{f}"), True)
        return sorted(old)

    # -- reading

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default. The DataFrame keeps that version, whatever is written later."""
        return self._rows(self.manifest(version))

    def lookup(self, keys: list, version: int | None = None) -> DataFrame:
        """The rows of a short list of keys; only their buckets are read."""
        m = self.manifest(version)
        kind = StructType.fromJson(json.loads(m.schema))[m.key].dataType.simpleString()
        asked = self.spark.createDataFrame([(k,) for k in keys], f"k {kind}")
        buckets = sorted({r[0] for r in asked.select(_bucket(F.col("k"), m.buckets)).collect()})
        return self._rows(m, F.col(BUCKET).isin(*buckets) & F.col(m.key).isin(*keys))

    def _rows(self, m: Manifest, condition: Column | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(m.schema))
        held = StructType([*schema.fields]).add(DELETED, "boolean").add(VERSION, "long").add(BUCKET, "integer")

        def read(folders: list[str]) -> DataFrame:
            parts = [self.spark.read.schema(held).parquet(f"{self.path}/{f}") for f in folders]
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more)
            return out.filter(condition) if condition is not None else out

        base = read(m.base)
        if not m.changes:
            return base.select(*schema.names)
        nth = F.row_number().over(Window.partitionBy(m.key).orderBy(F.desc(VERSION)))
        newest = read(m.changes).withColumn("_nth", nth).filter("_nth = 1")
        kept = base.join(newest.select(m.key), m.key, "left_anti").select(*schema.names)
        return kept.unionByName(newest.filter(~F.col(DELETED)).select(*schema.names))
