"""All registered queries of the engine, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.boards import BOARDS
from .plans.tools import Tool
from .plans.toolset import TOOLS
from .plans.views import CATALOG, PUBLIC
from .queries import decisions, history, indexes, relational, text

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Days as text, so that any engine's rows compare alike."""
    return df.select(*[df[c].cast("string").alias(c) if kind == "date" else df[c] for c, kind in df.dtypes])


def _texts(sql: str, dates: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS varchar) AS {c}' for c in dates)}) FROM (\n{sql}\n) q" if dates else sql


def _tools() -> tuple[dict[str, Query], dict[str, str]]:
    def run(tool: Tool) -> Query:
        return lambda spark, sf: plain(tool.frame(CATALOG.load(spark, sf)))

    def statement(tool: Tool) -> str:
        kinds = CATALOG.views[tool.view].kinds
        shown = (tool.params.get("dims") or tool.dims) if tool.measures else tool.columns
        return _texts(tool.statement(CATALOG), [c for c in shown if kinds[c] == "date"])

    def board(f) -> Query:
        return lambda spark, sf: plain(f(CATALOG.load(spark, sf)))

    queries = {f"tool_{t.name}": run(t) for t in TOOLS} | {f"tool_{n}": board(f) for n, (f, _) in BOARDS.items()}
    return queries, {f"tool_{t.name}": statement(t) for t in TOOLS} | {f"tool_{n}": CATALOG.with_views(sql) for n, (_, sql) in BOARDS.items()}


def _views() -> tuple[dict[str, Query], dict[str, str]]:
    """Each view whole. Decimal columns are compared at two digits."""

    def whole(name: str) -> Query:
        return lambda spark, sf: plain(CATALOG.load(spark, sf).view(name).selectExpr(*_columns(name)))

    def statement(name: str) -> str:
        return _texts(CATALOG.with_views(f"SELECT {', '.join(_columns(name))} FROM {name}"), [c for c, k in CATALOG.views[name].kinds.items() if k == "date"])

    return {f"view_{n[3:]}": whole(n) for n in PUBLIC}, {f"view_{n[3:]}": statement(n) for n in PUBLIC}


def _columns(name: str) -> list[str]:
    kinds = {"decimal": "round(CAST({c} AS double), 2) AS {c}", "int": "CAST({c} AS bigint) AS {c}"}
    return [kinds.get(k, "{c}").format(c=c) for c, k in CATALOG.views[name].kinds.items()]


def _all() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    statements: dict[str, str] = {}
    for q, s in (_views(), _tools()):
        queries |= q
        statements |= s
    for area in (relational, decisions, text, indexes, history):
        queries |= {n: f for n, (f, _) in area.QUERIES.items()}
        statements |= {n: sql for n, (_, sql) in area.QUERIES.items() if sql}
    return queries, statements


def queries() -> dict[str, Query]:
    return _all()[0]


def oracle_sql() -> dict[str, str]:
    return _all()[1]
