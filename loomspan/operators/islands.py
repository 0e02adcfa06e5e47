"""What ordered rows carry on: the last value since the last reset, and the first that comes after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, sets: Column, resets: Column, most: int | None = None, name: str = "carried") -> DataFrame:
    """``rows`` with the value of the newest row, up to and with each one, that sets it, unless a later one resets it.

    How many resets came before tells the islands apart; within one the last value stands. With ``most``, a value is
    carried over so many rows, its own included. A row that both sets and resets sets.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    sets, resets = F.coalesce(sets, F.lit(False)), F.coalesce(resets, F.lit(False))
    island = F.sum(F.when(resets & ~sets, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(by)
    marked = rows.withColumns({"__island": island, "__place": place, "__set": F.when(sets, F.struct(F.col(value).alias("v"), place.alias("at")))})
    last = F.last("__set", ignorenulls=True).over(Window.partitionBy(*keys, "__island").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("__last", last)
    near = F.lit(True) if most is None else F.col("__place") - F.col("__last.at") < most
    return out.withColumn(name, F.when(near, F.col("__last.v"))).drop("__island", "__place", "__set", "__last")


def followed(rows: DataFrame, keys: list[str], order: list[str], when: Column, **columns: str) -> DataFrame:
    """``rows`` with columns of the next row of their key, where that one is so; null else."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({new: F.lead(F.when(when, F.col(old))).over(by) for new, old in columns.items()})


def next_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: dict[str, str], tie: str) -> DataFrame:
    """``left`` with values of the first right row of its keys at or after ``left_at`` (null if none), of equal times the
    one with the smallest ``tie``.

    Both sides go through one window as one stream from the end: each row is shuffled and sorted once.
    """
    types, kinds, names = dict(left.dtypes), dict(right.dtypes), left.columns
    row_type = "struct<" + ",".join(f"`{c}`:{types[c]}" for c in names) + ">"
    value_type = "struct<" + ",".join(f"`{new}`:{kinds[old]}" for new, old in values.items()) + ">"
    l = left.select(*keys, F.col(left_at).alias("__at"), F.struct(*names).alias("__row"), F.lit(None).cast(value_type).alias("__v"), F.lit(0).alias("__side"), F.lit(None).cast(kinds[tie]).alias("__tie"))  # noqa: E741
    r = right.select(*keys, F.col(right_at).alias("__at"), F.lit(None).cast(row_type).alias("__row"), F.struct(*[F.col(old).alias(new) for new, old in values.items()]).alias("__v"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"))
    coming = Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc("__side"), F.desc("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    seen = l.unionByName(r).withColumn("__next", F.last("__v", ignorenulls=True).over(coming)).where("__side = 0")
    return seen.select("__row.*", *[F.col(f"__next.{new}").alias(new) for new in values])
