"""Evaluation runs: which earlier one is a baseline, and what became worse since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six scores, and the drop that blocks.
MEANS = {"hit_rate": "hit", "faithfulness": "faithful", "correctness": "correct", "citation_validity": "citation_valid"}
KINDS = {"not_found_ok": "not_found", "refuse_ok": "refuse"}
SCORES, DROP = [*MEANS, *KINDS], 0.05


def outage() -> Column:
    """A row that wasn't scored, or whose answer was a failure."""
    return F.coalesce(F.col("outage"), F.lit(False)) | F.col("correct").isNull()


def baseline(rows: DataFrame, current: str) -> DataFrame:
    """(run_id): the newest run before ``current`` in which every row is scored and that has all of its cases.

    Relational division: the cases of the current run are the divisor; a run covers them if it matches as many as there
    are. Runs are told apart by name, which sorts by time. Rows of one run and case count once.
    """
    cases = rows.where(F.col("run_id") == current).select("case_id").distinct()
    size = cases.agg(F.count("*").alias("size"))
    earlier = rows.where(F.col("run_id") < current)
    whole = earlier.groupBy("run_id").agg(F.max(outage().cast("int")).alias("gaps")).where("gaps = 0").select("run_id")
    matched = earlier.join(cases, "case_id", "left_semi").groupBy("run_id", "case_id").agg(F.lit(1).alias("one")).groupBy("run_id").agg(F.count("*").alias("matched"))
    covering = matched.join(F.broadcast(size)).where("matched = size").select("run_id")  # one row
    return covering.join(whole, "run_id").agg(F.max("run_id").alias("run_id")).where("run_id IS NOT NULL")


def compared(rows: DataFrame, current: str) -> DataFrame:
    """(score, before, after, cases, blocked) of the current run and its baseline over the cases that both have scored
    and whose kind is the same in both: a gap or a redefined case counts on neither side. Empty without a baseline."""
    columns = ["kind", *MEANS.values()]
    now = rows.where(F.col("run_id") == current)
    old = rows.join(F.broadcast(baseline(rows, current)), "run_id", "left_semi")  # one row
    side = lambda df, name: df.groupBy("case_id").agg(F.max(outage().cast("int")).alias(f"{name}_gap"), *[F.max(c).alias(f"{name}_{c}") for c in columns])
    both = side(now, "now").join(side(old, "old"), "case_id").where("now_gap = 0 AND old_gap = 0 AND now_kind <=> old_kind")
    means = []
    for name, column in [*MEANS.items(), *[(n, "correct") for n in KINDS]]:
        held = F.col("now_kind") == KINDS[name] if name in KINDS else F.lit(True)
        mean = lambda s: F.avg(F.when(held, F.col(f"{s}_{column}")))  # noqa: B023,E731
        means.append(F.struct(F.lit(name).alias("score"), mean("old").alias("before"), mean("now").alias("after"), F.count(F.when(held, 1)).alias("cases")))
    one = both.agg(F.array(*means).alias("m")).select(F.explode("m").alias("m")).select("m.*").where("before IS NOT NULL AND after IS NOT NULL")
    return one.select("score", "before", "after", "cases", (F.col("before") - F.col("after") > DROP + 1e-9).alias("blocked"))
