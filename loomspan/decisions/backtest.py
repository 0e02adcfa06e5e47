"""Back-test of stored risk levels against how subjects ended. The steps' order is part of the method."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import lead_bucket, wilson

SUBJECT = ["Factory", "FileNo"]
LEAST_DATES, LEAST_FILES, LEAST_PER_LEVEL = 28, 60, 15


def cut(runs: DataFrame, rows: DataFrame, at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """The store as it was: later runs go, later outcomes become unknown."""
    kept = runs.where(F.col("started") <= F.lit(at))
    later = F.col("outcome_at") > F.lit(at)
    known = [F.when(later, F.lit(None)).otherwise(F.col(c)).cast(t).alias(c) if c.startswith("outcome_") else F.col(c) for c, t in rows.dtypes]
    return kept, rows.join(kept.select(F.col("id").alias("run_id")), "run_id", "left_semi").select(*known)


def usable_runs(runs: DataFrame) -> DataFrame:
    """Step 1: of each date the last run that stored levels and had no errors."""
    last = Window.partitionBy("day").orderBy(F.desc("started"), F.desc("id"))
    good = runs.withColumn("day", F.to_date("started")).where((F.col("predictions") > 0) & (F.col("errors") == 0))
    return good.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def missing_dates(runs: DataFrame) -> DataFrame:
    """Dates between the first and the last usable run without one."""
    days = usable_runs(runs).select("day")
    every = days.agg(F.sequence(F.min("day"), F.max("day")).alias("d")).select(F.explode("d").alias("day"))
    return every.join(days, "day", "left_anti")


def settling_run(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Step 2: which run settled a row: the latest that started at or before the outcome.

    Runs are few (one or two for each day), so all of them go to each task as one sorted array; rows may be any number.
    """
    starts = runs.agg(F.array_sort(F.collect_list(F.struct("started", "id"))).alias("starts"))
    before = F.filter("starts", lambda r: r["started"] <= F.col("outcome_at"))
    return rows.where("outcome_at IS NOT NULL").join(F.broadcast(starts)).select("id", "run_id", *SUBJECT, F.try_element_at(before, F.lit(-1))["id"].alias("settled_by"))


def compute(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Kept predictions with their subject's outcome: (run day, subject, level, ahead, adverse, enough)."""
    usable = usable_runs(runs).select(F.col("id").alias("run_id"), F.col("day").alias("RunDay"))
    kept = rows.join(usable, "run_id")
    settled = settling_run(rows, runs)
    own = settled.where("settled_by = run_id")
    rest = settled.join(own.select("id"), "id", "left_anti")
    often = rest.groupBy(*SUBJECT).agg(F.count("*").alias("n")).where("n > 1").select(*SUBJECT)
    resumed = own.select(*SUBJECT).distinct()
    revised = rows.where("revised > 0").select(*SUBJECT).distinct()
    ends = rows.join(rest.select("id"), "id", "left_semi").select(*SUBJECT, "outcome_at", "outcome_day", "outcome_dhu", "amber")
    again = kept.join(ends.select(*SUBJECT, F.col("outcome_at").alias("ended")), SUBJECT).where(F.col("RunDay") > F.to_date("ended")).select(*SUBJECT).distinct()
    gone = often.union(resumed).union(revised).union(again).distinct()
    good = ends.join(gone, SUBJECT, "left_anti")
    joined = kept.select("RunDay", *SUBJECT, "level", "window_days").join(good, SUBJECT)
    return joined.withColumn("ahead", F.datediff("outcome_day", "RunDay")).where("ahead >= 1").withColumn("adverse", (F.col("outcome_dhu") >= F.col("amber")).cast("int"))


def headline(joined: DataFrame) -> DataFrame:
    """For each subject the prediction closest to a window ahead, never closer."""
    by = Window.partitionBy(*SUBJECT).orderBy("ahead", "level")
    return joined.where("ahead >= window_days").withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def lead_grid(joined: DataFrame) -> DataFrame:
    """Adverse outcomes of all, by level and days ahead."""
    buckets = ["1-6", "7", "8-13", "14-20", "21-27", "28+"]
    return joined.withColumn("bucket", lead_bucket(F.col("ahead"))).groupBy("level").pivot("bucket", buckets).agg(F.concat_ws("/", F.sum("adverse"), F.count("level")))


def by_level(head: DataFrame) -> DataFrame:
    sums = head.groupBy("level").agg(F.count("*").alias("n"), F.sum("adverse").alias("adverse"))
    low, high = wilson(F.col("adverse"), F.col("n"))
    return sums.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


def verdict(levels: dict[str, tuple[int, int]], dates: int, files: int) -> str:
    """From (n, adverse) of each level. The minima suffice exactly at their values."""
    n = {k: v[0] for k, v in levels.items()}
    if dates < LEAST_DATES or files < LEAST_FILES or any(n.get(k, 0) < LEAST_PER_LEVEL for k in ("red", "amber", "green")):
        return "INSUFFICIENT"
    share = {k: a / m for k, (m, a) in levels.items() if m}
    if not share["red"] > share["amber"] > share["green"]:
        return "NOT ORDERED"
    return "SEPARATED" if _low(*levels["red"]) > _high(*levels["green"]) else "ORDERED"


def _interval(n: int, a: int) -> tuple[float, float]:
    from ..functions.stats import Z

    p, z2 = a / n, Z * Z
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z * (p * (1 - p) / n + z2 / (4 * n * n)) ** 0.5 / (1 + z2 / n)
    return middle - half, middle + half


def _low(n: int, a: int) -> float:
    return _interval(n, a)[0]


def _high(n: int, a: int) -> float:
    return _interval(n, a)[1]
