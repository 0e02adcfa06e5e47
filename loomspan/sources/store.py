"""Versioned copies of results, a result cache, appended logs and run tables: all Parquet in folders."""

from __future__ import annotations

import datetime as dt
import json
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Copies:
    """Copies of slow results. A copy is a folder of its own; a small pointer file, replaced last, says which is
    current, so readers see a whole copy, and a refresh that fails leaves the copy before it in place."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str):
        return self._path(f"{self.root}/{name}/current.json")

    def write(self, name: str, df: DataFrame, as_of: dt.datetime, views: tuple[str, ...] = (), sort: str | None = None) -> dict:
        began = time.time()
        version = f"v={as_of:%Y%m%dT%H%M%S}-{time.time_ns()}"
        (df.sortWithinPartitions(sort) if sort else df).write.parquet(f"{self.root}/{name}/{version}")
        meta = {"name": name, "version": version, "as_of": as_of.isoformat(), "rows": self.spark.read.parquet(f"{self.root}/{name}/{version}").count(), "seconds": round(time.time() - began, 3), "views": list(views)}
        new = self._path(f"{self.root}/{name}/new.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        self._replace(new, self._pointer(name))
        return meta

    def _replace(self, new, old) -> None:
        """Renames over the pointer in one step, so that readers find the pointer before or the one after."""
        spark = self.spark.sparkContext
        fs = spark._jvm.org.apache.hadoop.fs
        options = spark._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, old, options)

    def prune(self, name: str, keep: int = 2) -> list[str]:
        """Removes all but the ``keep`` newest versions, the current one always kept; readers of the one before go on.
        Returns what was removed."""
        current = (self.meta(name) or {}).get("version")
        folder = self._path(f"{self.root}/{name}")
        found = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        versions = sorted((v for v in found if v.startswith("v=")), key=lambda v: int(v.rpartition("-")[2]))
        gone = [v for v in versions[: max(0, len(versions) - keep)] if v != current]
        for v in gone:
            self._fs.delete(self._path(f"{self.root}/{name}/{v}"), True)
        return gone

    def meta(self, name: str) -> dict | None:
        if not self._fs.exists(self._pointer(name)):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/{name}/current.json").first()[0])

    def missing(self, names: list[str]) -> list[str]:
        return [n for n in names if self.meta(n) is None]

    def read(self, name: str) -> DataFrame:
        if (meta := self.meta(name)) is None:
            raise LookupError(f"no copy of {name} yet")
        return self.spark.read.parquet(f"{self.root}/{name}/{meta['version']}")

    def has_column(self, name: str, column: str) -> bool:
        return column in self.read(name).columns

    def lookup(self, name: str, column: str, value: str) -> DataFrame:
        """Rows by a text value, without case, as the sources' collation has it."""
        return self.read(name).where(F.lower(F.col(column).cast("string")) == value.lower())

    def copy_or_live(self, name: str, live: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
        meta = self.meta(name)
        return (self.read(name), meta["as_of"]) if meta else (live(), None)


class ResultCache:
    """Collected results by (statement, parameters, scope); an entry keeps the time at which it was computed."""

    def __init__(self, seconds: float = 300, most: int = 256, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.most, self.clock = seconds, most, clock
        self._held: OrderedDict[tuple, tuple[float, object]] = OrderedDict()

    def get(self, key: tuple):
        held = self._held.get(key)
        if held is None or self.clock() - held[0] > self.seconds:
            self._held.pop(key, None)
            return None
        self._held.move_to_end(key)
        return held[1]

    def put(self, key: tuple, value: object) -> None:
        self._held[key] = (self.clock(), value)
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)

    def pop(self, key: tuple) -> None:
        self._held.pop(key, None)

    def run(self, df: DataFrame, statement: str, params: dict, scope_key: str, cap: int = 200, refresh: bool = False, now: dt.datetime | None = None):
        """(rows, as_of) of at most ``cap`` rows, from the cache if they are there."""
        key = (statement, tuple(sorted((k, str(v)) for k, v in params.items())), scope_key)
        if not refresh and (held := self.get(key)):
            return held
        value = (df.limit(cap).collect(), now or dt.datetime.now())
        self.put(key, value)
        return value


def next_run(now: dt.datetime, times: list[str]) -> dt.datetime:
    """The next HH:MM, strictly after now."""
    slots = sorted(dt.time.fromisoformat(t) for t in times)
    today = [dt.datetime.combine(now.date(), t) for t in slots]
    return next((t for t in today if t > now), dt.datetime.combine(now.date() + dt.timedelta(1), slots[0]))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def all_logs(*parts: DataFrame) -> DataFrame:
    """Log files of several layouts as one, by time; what a file lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("ts")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Insert or update by key: of equal keys the newest row stays."""
    by = Window.partitionBy(*keys).orderBy(F.desc(stamp))
    return old.unionByName(new).withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def purged(conversations: DataFrame, turns: DataFrame, before: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Without conversations that are too old or deleted, and without their turns."""
    kept = conversations.where((F.col("updated") >= F.lit(before)) & ~F.col("deleted"))
    return kept, turns.join(kept.select("conv_id"), "conv_id", "left_semi")


def redacted(log: DataFrame, denied: list[str], columns: list[str], by: str = "request_id", what: str = "database") -> DataFrame:
    """Rows that name something denied, and every row of the same request, with their texts replaced. A row without a
    request is one of its own."""
    bad = log.where(F.col(what).isin(*denied) & F.col(by).isNotNull()).select(by).distinct().withColumn("__bad", F.lit(True))
    marked = log.join(bad, by, "left").withColumn("__bad", F.coalesce("__bad", F.col(what).isin(*denied)))
    return marked.select(*[F.when(F.col("__bad"), F.lit("(withheld)")).otherwise(F.col(c).cast("string")).alias(c) if c in columns else F.col(c) for c in log.columns])


def csv_bytes(df: DataFrame, cap: int = 10_000) -> bytes:
    """The first ``cap`` rows of a result as CSV with a byte-order mark, for spreadsheets. Whole results go through ``df.write.csv``."""
    return df.limit(cap).toPandas().to_csv(index=False).encode("utf-8-sig")


def csv_name(what: str, as_of: dt.datetime) -> str:
    return f"{what}_{as_of:%Y-%m-%d_%H%M}.csv"
