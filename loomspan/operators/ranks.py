"""Exact order statistics of groups without a task that holds a group: ranks are narrowed down by histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import scratch

BUCKETS, FEW = 1024, 4096
#: States (a row for each group and rank) up to this number are broadcast, about 20 MB; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_ranks(rows: DataFrame, groups: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(groups, name, n, at): of each group's n values the one of each named rank, 1 being the smallest.

    ``ranks`` are Columns over n. The values between a rank's bounds are counted in BUCKETS equal ranges, the range with
    the rank becomes its bounds (its own least and greatest value), and so on, until the bounds are one value or hold FEW
    values at most, which are then ranked. What is shuffled is a count for each range that a task has met. Null and NaN
    are no values; a group without a value isn't returned.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"__g{i}") for i, g in enumerate(groups)]
    names = [f"__g{i}" for i in range(len(groups))]
    own = [F.col(g).alias(f"__o{i}") for i, g in enumerate(groups)]
    v = F.col(value).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(*own, *keys, v.alias("__v"))
    first = rows.groupBy(*names).agg(*[F.any_value(f"__o{i}").alias(g) for i, g in enumerate(groups)], F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    states = _written(first.select("*", asked.alias("a")).select(*names, *groups, "n", "low", "high", F.col("a.name").alias("name"), F.col("a.rank").alias("rank"), F.col("n").alias("among")))
    wide = (F.col("low") != F.col("high")) & (F.col("among") > FEW)
    while states.where(wide).limit(1).count():
        within = _within(rows, states.where(wide), names)
        share = (F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, so that no difference overflows
        ranges = within.withColumn("__b", F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int")).groupBy(*names, "name", "rank", "__b").agg(F.count("*").alias("among"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("among").over(Window.partitionBy(*names, "name").orderBy("__b"))
        hit = ranges.withColumn("__upto", upto).where((F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("among")))
        narrowed = hit.select(*names, "name", "low", "high", (F.col("rank") - F.col("__upto") + F.col("among")).alias("rank"), "among")
        states = _written(states.where(~wide).unionByName(states.where(wide).drop("low", "high", "rank", "among").join(narrowed, [*names, "name"])))
    open_ = states.where("low <> high")
    placed = _within(rows, open_, names).withColumn("__r", F.row_number().over(Window.partitionBy(*names, "name").orderBy("__v"))).where("__r = rank").select(*names, "name", F.col("__v").alias("at"))
    done = states.where("low = high").select(*groups, "name", "n", F.col("low").alias("at"))
    return done.unionByName(open_.join(placed, [*names, "name"]).select(*groups, "name", "n", "at"))


def _within(rows: DataFrame, states: DataFrame, names: list[str]) -> DataFrame:
    s = states.select(*[F.col(n).alias(f"{n}s") for n in names], "name", "rank", "low", "high")
    s = F.broadcast(s) if s.count() <= BROADCAST_ROWS else s
    on = F.col("__v").between(F.col("low"), F.col("high"))
    for n in names:
        on = on & (F.col(n) == F.col(f"{n}s"))
    return rows.join(s, on).drop(*[f"{n}s" for n in names])


def _wide(found: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    return found.groupBy(*groups).agg(F.any_value("n").alias("n"), *[c.alias(n) for n, c in values.items()])


def _of(name: str) -> Column:
    return F.max(F.when(F.col("name") == name, F.col("at")))


def nearest_ranks(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, n, a column for each share): the smallest value that at least that share of the values doesn't exceed."""
    ranks = {n: F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * s, 9))) for n, s in shares.items()}
    return _wide(at_ranks(rows, groups, value, ranks), groups, {n: _of(n) for n in shares})


def interpolated(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The same, on the line between the two values around (n - 1) times the share."""
    at = {n: F.round((F.col("n") - 1) * s, 9) for n, s in shares.items()}
    ranks = {f"{n} low": F.floor(p) + 1 for n, p in at.items()} | {f"{n} high": F.ceil(p) + 1 for n, p in at.items()}
    part = {n: F.any_value("n").cast("double") for n in shares}
    found = at_ranks(rows, groups, value, ranks)
    values = {n: _of(f"{n} low") + (_of(f"{n} high") - _of(f"{n} low")) * (F.round((part[n] - 1) * s, 9) - F.floor(F.round((part[n] - 1) * s, 9))) for n, s in shares.items()}
    return _wide(found, groups, values)
