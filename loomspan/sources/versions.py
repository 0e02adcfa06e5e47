"""Versions of a table in a folder: numbered manifests, each committed only if no other writer was faster; and tables by
key whose changes rewrite the touched buckets alone."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LostRace(RuntimeError):
    """Another writer committed a version after the one that this change began from; nothing of it is visible."""


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that all executors share, removed when the driver ends: in spark.checkpoint.dir, or in the warehouse
    where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/loomspan-{what}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


class Manifest:
    """What a folder's current version consists of. A version is a file of its own, whose number is one more."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._fs_package = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs
        self._folder = self._path(f"{self.root}/_manifest")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._folder.getFileSystem(self._conf)

    def read(self) -> tuple[int, dict]:
        """The newest version's number and content; 0 and nothing at the beginning."""
        if not self._fs.exists(self._folder):
            return 0, {}
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        found = sorted(n for n in names if n.endswith(".json"))
        if not found:
            return 0, {}
        return int(found[-1][:-5]), json.loads(self.spark.read.text(f"{self.root}/_manifest/{found[-1]}").first()[0])

    def commit(self, began: int, content: dict) -> int:
        """Version ``began`` + 1, unless it is there already."""
        new = self._path(f"{self.root}/_manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs_package, "Options$Rename"), 1)
        options[0] = getattr(self._fs_package, "Options$Rename").NONE
        try:
            self._fs_package.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(new, self._path(f"{self.root}/_manifest/{began + 1:012d}.json"), options)
        except Exception as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise LostRace(f"version {began + 1} of {self.root} is another writer's") from None
            raise
        return began + 1


class BucketedTable:
    """Rows by key in ``buckets`` folders. A change reads and writes the buckets that hold its keys; the manifest keeps
    the others' folders as they are, so readers of an older version go on, and equal keys never lie in two buckets."""

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets, self.manifest = spark, root.rstrip("/"), key, buckets, Manifest(spark, root)

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def folders(self) -> dict[str, str]:
        return self.manifest.read()[1].get("buckets", {})

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None where there are none yet."""
        _, content = self.manifest.read()
        return self._rows(content, only)

    def _rows(self, content: dict, only: list[int] | None = None) -> DataFrame | None:
        paths = [p for b, p in content.get("buckets", {}).items() if only is None or int(b) in only]
        return self.spark.read.schema(content["schema"]).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else None

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # ``buckets`` numbers at most

    def _write(self, began: int, content: dict, touched: list[int], rows: DataFrame) -> list[int]:
        version = uuid.uuid4().hex
        out = rows.withColumn("__bucket", self.bucket())
        out.repartitionByRange("__bucket", self.key).write.partitionBy("__bucket").parquet(f"{self.root}/{version}")
        at = self.manifest._path(f"{self.root}/{version}")
        there = {f.getPath().getName() for f in self.manifest._fs.listStatus(at)}
        kept = {b: p for b, p in content.get("buckets", {}).items() if int(b) not in touched}
        kept |= {str(b): f"{version}/__bucket={b}" for b in touched if f"__bucket={b}" in there}
        self.manifest.commit(began, {"buckets": kept, "schema": rows._jdf.schema().toDDL()})
        return touched

    def upsert(self, rows: DataFrame) -> list[int]:
        """Inserts rows, in place of those with the same keys; returns the buckets that were written. A key that the
        change itself has twice is refused."""
        if rows.groupBy(self.key).count().where("count > 1").limit(1).count():
            raise ValueError(f"a {self.key} occurs twice in one change")
        began, content = self.manifest.read()
        touched = self._touched(rows)
        old = self._rows(content, touched)
        merged = rows if old is None else old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True)
        return self._write(began, content, touched, merged.select(*rows.columns, *[c for c in merged.columns if c not in rows.columns])) if touched else []

    def delete(self, keys: DataFrame) -> list[int]:
        """Removes the rows of these keys (a column of the key's name); buckets without one stay as they are."""
        began, content = self.manifest.read()
        asked = self._touched(keys)
        old = self._rows(content, asked)
        hit = [] if old is None else self._touched(old.join(keys.select(self.key).distinct(), self.key, "left_semi"))
        return self._write(began, content, hit, self._rows(content, hit).join(keys, self.key, "left_anti")) if hit else []

    def get(self, keys: list) -> DataFrame | None:
        """Rows of a few keys, from their buckets alone."""
        kind = next((f.dataType for f in self.read().schema if f.name == self.key), None) if self.folders() else None
        if kind is None:
            return None
        asked = self._touched(self.spark.createDataFrame([(k,) for k in keys], "k string").select(F.col("k").cast(kind).alias(self.key)))
        rows = self.read(asked)
        return None if rows is None else rows.where(F.col(self.key).isin(*keys))
