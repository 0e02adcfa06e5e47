"""A table of rows by key in versions: upsert, delete, set attributes. For vectors, chunks and registries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Copies


class KeyedTable:
    """Every change writes a new version beside the old one and then moves the pointer; readers see whole versions."""

    def __init__(self, copies: Copies, name: str, key: str) -> None:
        self.copies, self.name, self.key = copies, name, key

    def read(self) -> DataFrame:
        return self.copies.read(self.name)

    def exists(self) -> bool:
        return self.copies.meta(self.name) is not None

    def _write(self, df: DataFrame, now: dt.datetime) -> dict:
        return self.copies.write(self.name, df, now)

    def upsert(self, rows: DataFrame, now: dt.datetime) -> dict:
        if not self.exists():
            return self._write(rows, now)
        return self._write(self.read().join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True), now)

    def replace_source(self, rows: DataFrame, source: str, now: dt.datetime, column: str = "source") -> dict:
        """All rows of one source at once: what it no longer has goes."""
        kept = self.read().where(F.col(column) != source) if self.exists() else rows.limit(0)
        return self._write(kept.unionByName(rows, allowMissingColumns=True), now)

    def delete(self, where: Column, now: dt.datetime) -> dict:
        return self._write(self.read().where(~F.coalesce(where, F.lit(False))), now)

    def set(self, where: Column, now: dt.datetime, **values: object) -> dict:
        return self._write(self.read().withColumns({c: F.when(where, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}), now)

    def get(self, keys: list) -> DataFrame:
        return self.read().where(F.col(self.key).isin(*keys))


def files(spark, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below a folder: (name, path, size, modified), without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
