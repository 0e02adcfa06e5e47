"""Parameterised queries: a view, filters on typed parameters, and a list, a grouping or a count.

A tool is declared once. ``frame`` compiles it to DataFrame calls, with parameter values as literals and never as
text; an optional parameter that isn't given leaves no predicate behind. ``statement`` writes the same query as SQL.
Dimensions, measures and sort columns that a question may choose come from the tool's own list.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, Loaded
from .dialect import ANSI, SPARK, Dialect

Params = dict[str, object]


def literal(value: object) -> str:
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


@dataclass(frozen=True)
class Filter:
    """``op`` on a column: eq, ne, ge, lt, contains, in, not_in, null, latest (the view's newest day). ``param`` names
    the parameter, else ``value`` is fixed; an ``optional`` one without a value is left out."""

    column: str
    op: str
    param: str | None = None
    value: object = None
    optional: bool = False

    def of(self, params: Params) -> object:
        return params.get(self.param) if self.param else self.value

    def given(self, params: Params) -> bool:
        value = self.of(params)
        if self.op in ("null", "latest") or value not in (None, "", ()):
            return True
        if not self.optional:
            raise ValueError(f"{self.param or self.column}: a value is needed")
        return False

    def predicate(self, df: DataFrame, params: Params) -> Column | None:
        c, v = F.col(self.column), self.of(params)
        return {
            "eq": lambda: c == F.lit(v), "ne": lambda: c != F.lit(v), "ge": lambda: c >= F.lit(v), "lt": lambda: c < F.lit(v), "gt": lambda: c > F.lit(v),
            "contains": lambda: c.contains(F.lit(v)), "in": lambda: c.isin(*v), "not_in": lambda: ~c.isin(*v), "null": lambda: c.isNull(),
            "latest": lambda: None,
        }[self.op]()

    def sql(self, view: str, params: Params) -> str:
        c, v = self.column, self.of(params)
        return {
            "eq": lambda: f"{c} = {literal(v)}", "ne": lambda: f"{c} <> {literal(v)}", "ge": lambda: f"{c} >= {literal(v)}", "lt": lambda: f"{c} < {literal(v)}", "gt": lambda: f"{c} > {literal(v)}",
            "contains": lambda: f"{c} LIKE '%' || {literal(v)} || '%'", "in": lambda: f"{c} IN ({', '.join(map(literal, v))})", "not_in": lambda: f"{c} NOT IN ({', '.join(map(literal, v))})",
            "null": lambda: f"{c} IS NULL", "latest": lambda: f"{c} = (SELECT max({c}) FROM {view})",
        }[self.op]()


def window(column: str) -> tuple[Filter, Filter]:
    """A half-open window of days."""
    return Filter(column, "ge", "from"), Filter(column, "lt", "to")


def given(*pairs: str) -> tuple[Filter, ...]:
    """Optional equalities: "Column=parameter"."""
    return tuple(Filter(*x.split("=")[:1], "eq", x.split("=")[1], optional=True) for x in pairs)


@dataclass(frozen=True)
class Tool:
    name: str
    view: str
    filters: tuple[Filter, ...] = ()
    columns: tuple[str, ...] = ()
    dims: tuple[str, ...] = ()
    measures: dict[str, str | Callable[[Dialect], str]] = field(default_factory=dict)
    having: str | None = None
    order: tuple[str, ...] = ()
    top: int = 200
    distinct: bool = False
    params: Params = field(default_factory=dict)
    may_group: tuple[str, ...] = ()
    may_measure: dict[str, str] = field(default_factory=dict)
    may_sort: tuple[str, ...] = ()

    def chosen(self, params: Params) -> tuple[Params, tuple[str, ...], dict[str, str | Callable[[Dialect], str]], tuple[str, ...]]:
        p = self.params | params
        dims, measures, order = self.dims, dict(self.measures), self.order
        if groups := p.get("dims"):
            if bad := set(groups) - set(self.may_group):
                raise ValueError(f"{self.name} doesn't group by {sorted(bad)}")
            dims = tuple(groups)
        if names := p.get("measures"):
            if bad := set(names) - set(self.may_measure):
                raise ValueError(f"{self.name} has no measure {sorted(bad)}")
            measures |= {n: self.may_measure[n] for n in names}
        if by := p.get("order_by"):
            column = str(by).split()[0]
            if column not in self.may_sort:
                raise ValueError(f"{self.name} doesn't sort by {column}")
            order = (str(by), *(o for o in order if o.split()[0] != column))
        if measures:  # a sort column that the chosen grouping doesn't have falls away
            order = tuple(o for o in order if o.split()[0] in (*dims, *measures)) or tuple(dims)
        return p, dims, measures, order

    def frame(self, catalog: Loaded, **params: object) -> DataFrame:
        p, dims, measures, order = self.chosen(params)
        df = view = catalog.view(self.view)
        for f in self.filters:
            if f.op == "latest":
                day = view.agg(F.max(f.column).alias("__day"))
                df = df.join(F.broadcast(day), F.col(f.column) == F.col("__day")).drop("__day")  # one row
            elif f.given(p):
                df = df.where(f.predicate(df, p))
        if measures:
            aggs = [F.expr(m if isinstance(m, str) else m(SPARK)).alias(n) for n, m in measures.items()]
            df = df.groupBy(*dims).agg(*aggs)
            if self.having:
                df = df.where(F.expr(self.having))
        else:
            df = df.select(*self.columns)
            df = df.distinct() if self.distinct else df
        keys = [getattr(F.col(o.split()[0]), "desc_nulls_last" if o.endswith(" desc") else "asc_nulls_last")() for o in order]
        return df.orderBy(*keys).limit(self.top) if keys else df

    def statement(self, catalog: Catalog, **params: object) -> str:
        p, dims, measures, order = self.chosen(params)
        where = [f.sql(self.view, p) for f in self.filters if f.given(p)]
        head = [*dims, *(f"{m if isinstance(m, str) else m(ANSI)} AS {n}" for n, m in measures.items())] if measures else list(self.columns)
        sql = f"SELECT {'DISTINCT ' * self.distinct}{', '.join(head)} FROM {self.view}" + (" WHERE " + " AND ".join(where) if where else "")
        if measures and dims:
            sql += " GROUP BY " + ", ".join(dims)
        if measures and self.having:
            sql = f"SELECT * FROM ({sql}) g WHERE {self.having}"
        if order:
            sql += " ORDER BY " + ", ".join(f"{o} NULLS LAST" for o in order) + f" LIMIT {self.top}"
        return catalog.with_views(sql)
