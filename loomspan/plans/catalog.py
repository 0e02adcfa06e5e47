"""The semantic catalog: curated views with grain, keys, scope column, kinds and freshness, registered per scope."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SCHEMAS, table
from .dialect import ANSI, SPARK, Dialect
from .guard import Denied, validate_definition
from .scope import EVERYTHING, Scope

TABLES = list(SCHEMAS)
KINDS = frozenset("text int decimal date datetime time bool binary".split())


@dataclass(frozen=True)
class View:
    """``kinds`` names every column; ``scope`` and ``fresh`` are among them. ``sql`` gives the body for a dialect."""

    name: str
    grain: str
    keys: tuple[str, ...]
    kinds: dict[str, str]
    sql: Callable[[Dialect], str]
    scope: str = "Factory"
    fresh: str | None = None
    base: bool = False

    def __post_init__(self) -> None:
        for column in (*self.keys, *([] if self.base else [self.scope]), *([self.fresh] if self.fresh else [])):
            if column not in self.kinds:
                raise ValueError(f"{self.name}: {column} is no column")
        if unknown := set(self.kinds.values()) - KINDS:
            raise ValueError(f"{self.name}: no kinds {sorted(unknown)}")
        body = re.sub(r"'[^']*'", "''", self.sql(ANSI)).strip().lower()
        outer = body
        while (shorter := re.sub(r"\([^()]*\)", "", outer)) != outer:
            outer = shorter
        if not body.startswith("select") or "order by" in outer or re.search(r"[:@]\w", body):
            raise ValueError(f"{self.name}: a view is one SELECT without WITH, parameters or a sort")


class Catalog:
    """Views of one database. ``load`` registers tables and views of a folder of Parquet tables for a scope."""

    def __init__(self, views: list[View]) -> None:
        self.views = {v.name: v for v in views}
        if len(self.views) != len(views):
            raise ValueError("two views of one name")

    def load(self, spark: SparkSession, folder: str, scope: Scope = EVERYTHING) -> "Loaded":
        return Loaded(self, spark, folder, scope)

    def needed(self, sql: str) -> list[View]:
        """The views that a text names, and those that these name, in the order of definition."""
        names = set(re.findall(r"\w+", sql))
        out: dict[str, View] = {}
        for view in reversed(list(self.views.values())):
            if view.name in names:
                out[view.name] = view
                names |= set(re.findall(r"\w+", view.sql(ANSI)))
        return list(reversed(out.values()))

    def with_views(self, sql: str) -> str:
        """A statement for another engine: the views it names as CTEs before it."""
        parts = [f"{v.name} AS (\n{v.sql(ANSI).strip()}\n)" for v in self.needed(sql)]
        if not parts:
            return sql
        head = "WITH " + ",\n".join(parts)
        body = sql.strip()
        return f"{head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"{head}\n{body}"


class Loaded:
    """The catalog over one folder for one scope. A view is a plan; the scope's filter lies inside it, below whatever
    a query adds, and Catalyst pushes it on. Views are resolved once and reused."""

    def __init__(self, catalog: Catalog, spark: SparkSession, folder: str, scope: Scope) -> None:
        self.catalog, self.spark, self.folder, self.scope = catalog, spark, folder, scope
        self._done: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def view(self, name: str) -> DataFrame:
        if name not in self._done:
            view = self.catalog.views[name]
            body = view.sql(SPARK)
            before = list(self.catalog.views)
            validate_definition(self.spark, body, {*TABLES, *before[: before.index(name)]})
            inner = {v.name: self.view(v.name) for v in self.catalog.needed(body)}
            inner |= {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", body)}
            df = self._run(body, inner)
            if df.columns != list(view.kinds):
                raise Denied(f"{name} has columns {df.columns}, not those that are declared")
            keep = None if view.base else self.scope.rows(view.scope)
            self._done[name] = df if keep is None else df.where(keep)
        return self._done[name]

    def _run(self, body: str, inner: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
        for name, df in inner.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(body, args=args or {})

    def sql(self, body: str, args: dict | None = None) -> DataFrame:
        """A guarded statement over the scoped views and, without a scope, the tables."""
        inner = {v.name: self.view(v.name) for v in self.catalog.needed(body)}
        if self.scope.unrestricted:
            inner |= {t: self.table(t) for t in TABLES if re.search(rf"\b{t}\b", body)}
        return self._run(body, inner, args)

    def newest(self, name: str) -> DataFrame:
        """One row with the newest day in a view's freshness column, in scope."""
        view = self.catalog.views[name]
        return self.view(name).agg(F.max(F.col(view.fresh)).cast("date").alias("newest"))
