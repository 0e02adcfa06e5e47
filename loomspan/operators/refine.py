"""The result algebra: reshaping a result that is already there.

The order of application is fixed: filters; then distinct or grouping; then a scalar; then the sort, if its column
survives; then the columns to keep (only of plain rows); then the limit, from either end. Rows have no order in Spark,
so a result carries its position in ``__pos`` (``ordered``), which is what "first" and "last" mean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUANTITY = re.compile(r"qty|quantity|pieces|pcs|value|amount|output|target|checked|defects|rejected|passed|count|total|price|size", re.I)
_RATE = re.compile(r"rate|pct|percent|dhu|avg|average|mean|ratio|share|efficiency|discount|tax", re.I)
_CODE = re.compile(r"(^|_)(id|key|no|code|number)$|id$|key$|no$", re.I)


class Refused(ValueError):
    """The rows at hand can't answer; the source has to be asked again."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class RefinePlan:
    filters: tuple[Filter, ...] = ()
    distinct: str | None = None
    group_by: str | None = None
    scalar: tuple[str, str | None] | None = None
    sort: tuple[str, bool] | None = None
    keep: tuple[str, ...] = ()
    limit: int | None = None
    from_end: bool = False
    page: int | None = None


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """Gives a result its positions: what it is ordered by, ascending, as one value that compares as they do. No row
    needs to know how many are before it, so a result of any size stays where it is."""
    if not order:
        raise Refused("without an order or keys there is no first and last")
    return df.withColumn("__pos", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def additive(df: DataFrame, column: str) -> bool:
    """Whether a column may be added up: a number named like a quantity, and not like a rate or a code."""
    return isinstance(df.schema[column].dataType, T.NumericType) and bool(_QUANTITY.search(column)) and not _RATE.search(column) and not _CODE.search(column)


def kept(df: DataFrame, f: Filter) -> Column:
    """A filter as a Column. Text is compared without case and outer blanks; a null passes ``neq`` alone; a value of
    another type passes nothing."""
    c, v = F.col(f.column), f.value
    if is_text(df, f.column):
        c = F.lower(F.trim(c))
        lowered = lambda x: F.lit(str(x).strip().lower())
        if not all(isinstance(x, str) for x in (v if isinstance(v, (list, tuple)) else [v])) and f.op not in ("neq", "contains"):
            return F.lit(False)
    else:
        lowered = F.lit
        if f.op == "contains":
            c, lowered = F.lower(c.cast("string")), lambda x: F.lit(str(x).lower())
        elif any(isinstance(x, str) for x in (v if isinstance(v, (list, tuple)) else [v])) and isinstance(df.schema[f.column].dataType, T.NumericType):
            return F.lit(f.op == "neq")
    made = {
        "eq": lambda: c == lowered(v), "neq": lambda: c != lowered(v), "in": lambda: c.isin(*[lowered(x) for x in v]), "contains": lambda: c.contains(lowered(v)),
        "gt": lambda: c > lowered(v), "gte": lambda: c >= lowered(v), "lt": lambda: c < lowered(v), "lte": lambda: c <= lowered(v), "between": lambda: c.between(lowered(v[0]), lowered(v[1])),
    }
    return F.coalesce(made[f.op](), F.lit(f.op == "neq"))


def bare_filter(df: DataFrame, values: list[str]) -> Filter:
    """Values without a column: accepted if exactly one column holds them all. One pass over the rows."""
    texts = [c for c in df.columns if is_text(df, c)]
    wanted = [v.strip().lower() for v in values]
    found = df.agg(*[F.min(F.lit(1)).alias("__one"), *[F.size(F.array_intersect(F.collect_set(F.when(F.lower(F.trim(c)).isin(*wanted), F.lower(F.trim(c)))), F.array(*map(F.lit, wanted)))).alias(c) for c in texts]]).first()
    hits = [c for c in texts if found[c] == len(set(wanted))]
    if len(hits) != 1:
        raise Refused(f"{values} stand in {len(hits)} columns")
    return Filter(hits[0], "in", tuple(values))


def apply(df: DataFrame, plan: RefinePlan, capped: bool = False) -> DataFrame:
    """The reshaped rows. A result that was cut at its cap must not be filtered, grouped, sorted or counted."""
    if capped and (plan.filters or plan.group_by or plan.distinct or plan.scalar or plan.sort):
        raise Refused("the rows were cut at their cap")
    out = df
    for f in plan.filters:
        out = out.where(kept(out, f))
    names = [c for c in out.columns if c != "__pos"]
    shaped = False
    if plan.distinct:
        c, key = plan.distinct, F.lower(F.trim(F.col(plan.distinct))) if is_text(out, plan.distinct) else F.col(plan.distinct)
        out = out.where(F.col(c).isNotNull()).groupBy(key.alias("__key")).agg(F.min_by(c, "__pos").alias(c), F.min("__pos").alias("__pos")).select(c, "__pos")
        shaped = True
    elif plan.group_by:
        sums = [F.sum(c).alias(c) for c in names if c != plan.group_by and additive(out, c)]
        out = out.groupBy(plan.group_by).agg(F.count("*").alias("Count"), *sums)
        shaped = True
    if plan.scalar:
        what, column = plan.scalar
        if what == "count":
            value = F.count_distinct(F.when(F.trim(F.col(column).cast("string")) != "", F.lower(F.trim(F.col(column).cast("string"))))) if column else F.count("*")
        else:
            value = F.coalesce(F.sum(column), F.lit(0))
        return out.agg(value.alias(what))
    order = [F.col("__pos")] if "__pos" in out.columns else [F.col(plan.group_by).asc_nulls_last()] if plan.group_by else []
    if plan.sort and plan.sort[0] in out.columns:
        c = F.lower(plan.sort[0]) if is_text(out, plan.sort[0]) else F.col(plan.sort[0])
        order = [c.desc_nulls_last() if plan.sort[1] else c.asc_nulls_last(), *order]
    if plan.limit:
        out = tail(out, plan.limit, order) if plan.from_end else out.orderBy(*order).limit(plan.limit)
    if plan.page and plan.limit is None:
        out = page(out, order, plan.page)
    if plan.keep and not shaped:
        out = out.select(*plan.keep, *(["__pos"] if "__pos" in out.columns else []))
    return out.drop("__pos")


def tail(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The last n rows of an order, in that order: the first n of it turned round, which Spark takes from each task."""
    return df.orderBy(*[_turned(o) for o in order]).limit(n).orderBy(*order)


def _turned(order: Column) -> Column:
    """The reverse of a sort order; what stood last (nulls) stands first."""
    text = str(order._jc.toString())
    inner = re.sub(r"\s(ASC|DESC)\sNULLS\s(FIRST|LAST)$", "", text)
    column = F.lower(inner[6:-1]) if inner.startswith("lower(") else F.col(inner)
    if " DESC NULLS LAST" in text:
        return column.asc_nulls_first()
    return column.desc_nulls_first()


def page(df: DataFrame, order: list[Column], number: int, size: int = 200, most: int = 2000) -> DataFrame:
    """A page of rows under an order; pages beyond ``most`` rows are refused."""
    if not order:
        raise Refused("pages need an order or keys")
    if (start := (number - 1) * size) > most:
        raise Refused(f"rows beyond {most} aren't paged")
    return df.orderBy(*order).offset(start).limit(size)


def capped(df: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """At most ``cap`` rows, and whether there were more: one row more is asked for, no count of all."""
    return df.limit(cap), df.limit(cap + 1).count() > cap


def summarize(df: DataFrame, cut: bool = False) -> DataFrame:
    """One row: the distinct values of the first text column that varies, the first date's range, the first quantity's
    total (null if the rows were cut). Which column varies is asked first, by the least and the greatest of each; the
    first text column stands for none."""
    names = [c for c in df.columns if c != "__pos"]
    texts = [c for c in names if is_text(df, c)]
    ends = df.agg(*[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"v{i}") for i, c in enumerate(texts)]).first() if len(texts) > 1 else None
    text = next((c for i, c in enumerate(texts) if ends is not None and ends[f"v{i}"]), texts[0] if texts else None)
    date = next((c for c in names if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None)
    quantity = next((c for c in names if additive(df, c)), None)
    null = F.lit(None).cast("string")
    return df.agg(F.count("*").alias("rows"), (F.count_distinct(text) if text else null).alias("values"), (F.min(date).cast("string") if date else null).alias("first"), (F.max(date).cast("string") if date else null).alias("last"), (F.sum(quantity).cast("double") if quantity and not cut else F.lit(None).cast("double")).alias("total"))


def natural_order(df: DataFrame, column: str, n: int, total_label: str = "Total") -> DataFrame:
    """Numbers inside text by their value, without case; blanks last, a total row behind all."""
    text = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
    # A number compares by how many digits it has without leading zeros, then by them.
    number = lambda x: F.ltrim(x, F.lit("0"))
    padded = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]"), F.struct(F.lit("0").alias("a"), F.length(number(x)).alias("b"), number(x).alias("c"))).otherwise(F.struct(x.alias("a"), F.lit(0).alias("b"), F.lit("").alias("c"))))
    return df.orderBy((text == total_label.lower()), (text == ""), padded, column).limit(n)
