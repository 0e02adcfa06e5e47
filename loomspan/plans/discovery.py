"""What is there: tables with their columns, keys and sizes, read from the session's catalog and Parquet footers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modifiers import sensitive
from ..sources.tables import SCHEMAS, table


@dataclass(frozen=True)
class Described:
    name: str
    rows: int
    columns: dict[str, str]
    hidden: tuple[str, ...]


def assemble(spark: SparkSession, folder: str, names: list[str] | None = None) -> list[Described]:
    """Tables that may be offered: not empty, with their sensitive columns named. Counts come from the footers."""
    out = []
    for name in names or list(SCHEMAS):
        df = table(spark, folder, name)
        if n := df.count():
            out.append(Described(name, n, dict(df.dtypes), tuple(c for c in df.columns if sensitive(c))))
    return out


def sample_candidates(tables: list[Described], most_rows: int = 200_000, budget: int = 150) -> list[tuple[str, str]]:
    """Text columns of small tables, whose values are worth listing."""
    return [(t.name, c) for t in tables if t.rows <= most_rows for c, k in t.columns.items() if k == "string" and c not in t.hidden][:budget]


def sampled(df: DataFrame, column: str) -> list[str] | None:
    """The values of a column that has 1 to 30 of them and none that looks personal."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(31).collect()]
    personal = [v for v in values if "@" in v or sum(c.isdigit() for c in v) > 8]
    return sorted(values) if 1 <= len(values) <= 30 and not personal else None


def carried(new: dict[str, list[str]], old: dict[str, list[str]], excluded: set[str]) -> dict[str, list[str]]:
    """New samples replace old ones; others stay unless they are excluded now."""
    return {k: v for k, v in {**old, **new}.items() if k not in excluded}


def usage(statements: DataFrame, column: str = "statement") -> DataFrame:
    """How often tables are named after FROM and JOIN."""
    names = F.regexp_extract_all(F.lower(column), F.lit(r"\b(?:from|join)\s+([a-z_][\w.]*)"), F.lit(1))
    return statements.select(F.explode(names).alias("table")).groupBy("table").agg(F.count("*").alias("n"))
