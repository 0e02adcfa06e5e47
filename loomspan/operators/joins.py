"""Joins and windows that the engine's questions need, as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. The rows are ranked where they are before they are shuffled
    (Spark limits each task's groups first), so a key with very many rows is not sorted whole in one task."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def first_last(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The first and the last id of each key in natural order (length, then text); an aggregation, no window."""
    text = F.col(id_col).cast("string")
    key = F.struct(F.length(text), text)
    return df.groupBy(*keys).agg(F.min_by(text, key).alias("first_id"), F.max_by(text, key).alias("last_id"), F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, tie: str) -> DataFrame:
    """``left`` with the value of the latest right row of its keys at or before ``left_at`` (null if none).

    Both sides go through one window as one stream in time, carrying the last value seen: each row is shuffled and
    sorted once, where a join on the keys with a time condition would make every pair. A later ``tie`` wins.
    """
    names = left.columns
    types = dict(left.dtypes)
    l = left.select(*keys, F.col(left_at).alias("__at"), F.struct(*names).alias("__row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("__tie"))  # noqa: E741
    row_type = "struct<" + ",".join(f"`{c}`:{types[c]}" for c in names) + ">"
    r = right.select(*keys, F.col(right_at).alias("__at"), F.lit(None).cast(row_type).alias("__row"), F.col(value).alias("__v"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"))
    seen = Window.partitionBy(*keys).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("__side") == 0, F.struct("__v")), ignorenulls=True).over(seen)["__v"]
    return l.unionByName(r).withColumn("__carried", carried).where("__side = 1").select("__row.*", F.col("__carried").alias(value))


def parent_chain(nodes: DataFrame, id_col: str, parent_col: str, name_col: str, levels: int = 3) -> DataFrame:
    """(id, level0, level1, ...): a node's name and those of its parents."""
    out = nodes.select(F.col(id_col).alias("id"), F.col(name_col).alias("level0"), F.col(parent_col).alias("__p"))
    for n in range(1, levels):
        up = nodes.select(F.col(id_col).alias("__i"), F.col(name_col).alias(f"level{n}"), F.col(parent_col).alias("__next"))
        out = out.join(up, F.col("__p") == F.col("__i"), "left").drop("__p", "__i").withColumnRenamed("__next", "__p")
    return out.drop("__p")


def anti_share(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(bad, total): how many left rows have no match. The right side is made distinct, so no row counts twice."""
    keys = right.select(*on).distinct().withColumn("__hit", F.lit(1))
    return left.join(keys, on, "left").agg(F.count_if(F.col("__hit").isNull()).alias("bad"), F.count("*").alias("total"))


def companion(main: DataFrame, extra: DataFrame, on: list[str], order: list[str], most: int = 200, name: str = "extra") -> DataFrame:
    """``main`` with the columns of the first matching row of another source.

    As a source of its own would be asked: for the first ``most`` distinct key values of the main result, as text.
    Equal column names get the source's name behind them; rows without a match stay.
    """
    asked = main.select(*[F.col(c).cast("string").alias(c) for c in on]).distinct().orderBy(*on).limit(most)
    there = extra.select(*[F.col(c).cast("string").alias(c) if c in on else F.col(c) for c in extra.columns]).join(F.broadcast(asked), on, "left_semi")  # ``most`` rows
    first = latest_per_key(there, on, *[F.col(c).asc_nulls_last() for c in order])
    renamed = first.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c).alias(f"{c} ({name})" if c in main.columns else c) for c in first.columns])
    match = None
    for c in on:
        one = F.col(c).cast("string") == F.col(f"__{c}")
        match = one if match is None else match & one
    return main.join(renamed, match, "left").drop(*[f"__{c}" for c in on])


def closest_ahead(df: DataFrame, keys: list[str], ahead: str, least: Column, tie: str) -> DataFrame:
    """Of each key the row closest to ``least`` ahead, never closer."""
    return latest_per_key(df.where(F.col(ahead) >= least), keys, F.col(ahead).asc(), F.col(tie).asc())


def within_last(df: DataFrame, keys: list[str], day: str, days: int) -> DataFrame:
    """Rows of each key's own last days."""
    last = df.groupBy(*keys).agg(F.max(day).alias("__last"))
    return df.join(last, keys).where(F.datediff("__last", day) < days).drop("__last")


def gaps(df: DataFrame, day: str) -> DataFrame:
    """Days between the first and the last that don't occur."""
    days = df.select(F.col(day).alias("day")).distinct()
    every = days.agg(F.sequence(F.min("day"), F.max("day")).alias("d")).select(F.explode("d").alias("day"))
    return every.join(days, "day", "left_anti")
