"""What a table's Parquet footers say of it: rows, and the bounds of columns, without reading data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "boolean")
_STAMPS = ("timestamp_ntz", "timestamp")


def bounds(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: ``n`` rows, and low_c, high_c of these columns, as the footers' statistics have them.

    The counts and bounds are aggregates that the Parquet source answers itself. It doesn't do so for points in time, so
    these are read as the whole numbers that they are in the file (microseconds), at the place that the file's own layout
    gives them; files of a table have one layout. A column of another kind, or one without statistics, is refused by the
    plan not being answered so (``only_footers``).
    """
    apart = spark.newSession()
    apart.conf.set("spark.sql.sources.useV1SourceList", "avro")
    apart.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    layout = apart.read.parquet(path).schema
    kinds = {f.name: f.dataType.simpleString() for f in layout}
    if wrong := [c for c in columns if kinds.get(c) not in _NUMBERS + _STAMPS]:
        raise ValueError(f"no bounds of {wrong} in footers")
    as_stored = T.StructType([T.StructField(f.name, T.LongType() if f.dataType.simpleString() in _STAMPS else f.dataType) for f in layout])
    found = apart.read.schema(as_stored).parquet(path).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    return found.select("n", *[_time(f"{n}_{c}", kinds[c]) for c in columns for n in ("low", "high")])


def _time(column: str, kind: str):
    stamp = F.timestamp_micros(F.col(column)).cast("timestamp_ntz" if kind == "timestamp_ntz" else "timestamp")
    return (stamp if kind in _STAMPS else F.col(column)).alias(column)


def only_footers(df: DataFrame) -> bool:
    """Whether the plan has no scan but those that the footers answer."""
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BatchScan" in line or "FileScan" in line]
    return bool(scans) and all("PushedAggregation: [COUNT(*)" in line for line in scans)


class Horizons:
    """Rows and newest days of tables, read once for each folder and kept for a while: a scope narrows rows, not files,
    so a horizon is kept by (folder, table, column, scope)."""

    def __init__(self, spark: SparkSession, seconds: float = 300, clock=None) -> None:
        from .store import ResultCache

        self.spark = spark
        self.cache = ResultCache(seconds, 1024, *([clock] if clock else []))

    def rows(self, folder: str, table: str) -> int:
        return self._kept((folder, table, None, None), lambda: bounds(self.spark, f"{folder}/{table}.parquet", []).first()["n"])

    def newest(self, folder: str, table: str, column: str, scope_key: str = "*", scoped: DataFrame | None = None) -> dt.date | None:
        """The newest day of a column: of the footers, or of ``scoped``, the rows that a scope leaves."""

        def read():
            if scoped is None:
                high = bounds(self.spark, f"{folder}/{table}.parquet", [column]).first()[f"high_{column}"]
            else:
                high = scoped.agg(F.max(column)).first()[0]
            return high.date() if isinstance(high, dt.datetime) else high

        return self._kept((folder, table, column, scope_key), read)

    def _kept(self, key: tuple, read):
        held = self.cache.get(key)
        if held is None:
            held = (read(),)
            self.cache.put(key, held)
        return held[0]
