"""Risk levels of subjects (factory and file) from trailing windows of daily inspections, and their outcomes.

Ratios come from sums over a window, never from averages of daily ratios. Days are those of the data: a subject runs
as long as its plan reaches the last GRACE days before the newest day, and no clock is read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["Factory", "FileNo"]
# The measures' names, each with its part and its whole.
RATIOS = {
    "dhu": ("Defects", "Checked"),
    "reject_pct": ("Rejected", "Checked"),
    "ftp_pct": ("Passed", "Checked"),
    "defective_pct": ("DefectivePcs", "Checked"),
    "rectified_pct": ("Rectified", "DefectivePcs"),
}
COUNTS = list(dict.fromkeys(column for pair in RATIOS.values() for column in pair))
GRACE = 3


@dataclass(frozen=True)
class RiskRule:
    name: str
    measure: str
    amber: float
    red: float
    weight: int = 1
    min_checked: int = 200
    red_provisional: bool = False


RULES = [RiskRule("file_dhu", "dhu", 30.0, 45.0, 2, red_provisional=True), RiskRule("file_reject_pct", "reject_pct", 30.0, 45.0)]


def ratio(measure: str) -> Column:
    part, whole = RATIOS[measure]
    return F.bround(F.try_divide(100 * F.col(part), F.nullif(F.col(whole), F.lit(0))).cast("decimal(18,8)"), 2).cast("double")


def totals() -> list[Column]:
    return [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTS]


def collect(daily: DataFrame, newest: dt.date, days: int, most_subjects: int | None = None) -> DataFrame:
    """Sums over the last ``days`` days for each subject; more subjects than allowed are an error."""
    out = daily.where((F.col("Day") > F.lit(newest - dt.timedelta(days))) & (F.col("Day") <= F.lit(newest))).groupBy(*SUBJECT).agg(*totals())
    if most_subjects is not None and (n := out.count()) > most_subjects:
        raise ValueError(f"{n} subjects, {most_subjects} are allowed")
    return out


def trailing(daily: DataFrame, days: int, first: dt.date, last: dt.date, every: int = 1) -> DataFrame:
    """The same for many run days at once. A day belongs to a fixed few windows, so its sums are multiplied by those run
    days alone and grouped: no join of days with windows, and rows of one day are added up before."""
    days_of = daily.where((F.col("Day") <= F.lit(last)) & (F.date_add("Day", days - 1) >= F.lit(first))).groupBy(*SUBJECT, "Day").agg(*totals())
    since = lambda day: F.datediff(day, F.lit(first))
    low = F.ceil(F.greatest(since(F.col("Day")), F.lit(0)) / every).cast("int")
    high = F.floor(since(F.least(F.date_add("Day", days - 1), F.lit(last))) / every).cast("int")
    runs = F.transform(F.sequence(low, high), lambda k: F.date_add(F.lit(first), k * every))
    rows = days_of.where(low <= high).select(*SUBJECT, *COUNTS, F.explode(runs).alias("RunDay"))
    return rows.groupBy("RunDay", *SUBJECT).agg(*totals())


def rule_level(rule: RiskRule) -> Column:
    value = ratio(rule.measure)
    return F.when((F.col("Checked") < rule.min_checked) | value.isNull(), "info").when(value >= rule.red, "red").when(value >= rule.amber, "amber").otherwise("green")


def evaluate(sums: DataFrame, rules: list[RiskRule] | None = None) -> DataFrame:
    """The worst level of all rules, each rule's value, and the caveat of a red whose limit is provisional."""
    rules = rules or RULES
    levels = [rule_level(r) for r in rules]
    worst = F.lit("info")
    for name in ("green", "amber", "red"):
        worst = F.when(F.array_contains(F.array(*levels), name), name).otherwise(worst)
    shaky = [lv == "red" for lv, r in zip(levels, rules) if r.red_provisional]
    caveat = F.lit(False)
    for s in shaky:
        caveat = caveat | s
    return sums.withColumns({r.measure: ratio(r.measure) for r in rules} | {"level": worst, "caveat": caveat})


def last_days(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*SUBJECT).agg(F.max("Day").alias("EndDay"))


def final_windows(daily: DataFrame, days: int) -> DataFrame:
    """Each subject's own last ``days`` days. Rows of one day are added up before, so that a subject's window holds days."""
    days_of = daily.groupBy(*SUBJECT, "Day").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTS])
    end = days_of.withColumn("EndDay", F.max("Day").over(Window.partitionBy(*SUBJECT)))
    return end.where(F.datediff("EndDay", "Day") < days).groupBy(*SUBJECT, "EndDay").agg(*totals())


def still_running(plans: DataFrame, daily: DataFrame) -> DataFrame:
    """Subjects whose plan reaches the last GRACE days before the newest inspection."""
    newest = daily.agg(F.max("Day").alias("newest"))
    last = plans.groupBy(*SUBJECT).agg(F.max("Day").alias("LastPlan"))
    return last.join(F.broadcast(newest)).where(F.col("LastPlan") >= F.date_sub("newest", GRACE)).select(*SUBJECT, "LastPlan")


def plan_stalled(plans: DataFrame, daily: DataFrame) -> bool:
    """Whether the plan ends before the inspections do; then nothing may be settled."""
    a, b = plans.agg(F.max("Day")).first()[0], daily.agg(F.max("Day")).first()[0]
    return a is None or (b is not None and a < b - dt.timedelta(GRACE))


def open_predictions(predictions: DataFrame) -> DataFrame:
    """Each subject's newest prediction that has no outcome."""
    return predictions.where("outcome_level IS NULL").groupBy(*SUBJECT).agg(F.max_by(F.struct("run_id", "RunDay", "level"), "run_id").alias("p")).select(*SUBJECT, "p.*")


def settle(predictions: DataFrame, running: DataFrame, finals: DataFrame) -> DataFrame:
    """Outcomes for the newest open prediction of each subject that no longer runs."""
    done = open_predictions(predictions).join(running, SUBJECT, "left_anti")
    return done.join(finals.select(*SUBJECT, "EndDay", F.col("level").alias("outcome_level"), F.col("dhu").alias("outcome_dhu")), SUBJECT).select(*SUBJECT, "run_id", "level", "EndDay", "outcome_level", "outcome_dhu")


def current_outcomes(versions: DataFrame) -> DataFrame:
    """Of appended outcome versions (prediction_id, written, outcome_level), the newest, and how often it changed."""
    by = Window.partitionBy("prediction_id").orderBy("written")
    changed = versions.withColumn("changed", (F.lag("outcome_level").over(by) != F.col("outcome_level")).cast("int"))
    return changed.groupBy("prediction_id").agg(F.max_by("outcome_level", "written").alias("outcome_level"), F.sum(F.coalesce("changed", F.lit(0))).alias("revised"))


def written_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``predictions`` (id, outcome_level, outcome_totals, outcome_at, revised and more) after ``outcomes`` (id, level,
    totals, written) are recorded.

    An outcome that is there already and changes in level or totals counts as revised, so that a back-test can leave
    out subjects that were settled early and then moved. Outcomes of unknown predictions are not recorded.
    """
    new = outcomes.select(F.col("id").alias("__id"), F.col("level").alias("level_now"), F.col("totals").alias("totals_now"), "written")
    both = predictions.join(new, F.col("id") == F.col("__id"), "left")
    told, had = F.col("__id").isNotNull(), F.col("outcome_at").isNotNull()
    changed = told & had & ~(F.col("outcome_level").eqNullSafe(F.col("level_now")) & F.col("outcome_totals").eqNullSafe(F.col("totals_now")))
    values = {"outcome_level": F.when(told, F.col("level_now")).otherwise(F.col("outcome_level")), "outcome_totals": F.when(told, F.col("totals_now")).otherwise(F.col("outcome_totals")), "outcome_at": F.when(told, F.col("written")).otherwise(F.col("outcome_at")), "revised": F.col("revised") + changed.cast("int")}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in predictions.columns])


def due(dimensions: DataFrame, runs: DataFrame, day: dt.date) -> DataFrame:
    """Of ``dimensions`` (dimension, mapped) those with no run (dimension, started) on the day, with ``state``: "due", or
    "unmapped" for one that has rules but nothing to read, which could never write its run."""
    today = runs.where(F.to_date("started") == F.lit(day)).select("dimension").distinct()
    left = dimensions.join(today, "dimension", "left_anti")
    return left.select("dimension", F.when(F.col("mapped"), F.lit("due")).otherwise(F.lit("unmapped")).alias("state"))


def drift(rules: list[RiskRule], targets: DataFrame) -> DataFrame:
    """Configured amber limits that differ from the source's targets (Setting, Target)."""
    spark = targets.sparkSession
    own = spark.createDataFrame([(r.measure, r.amber) for r in rules], "measure string, amber double")
    return own.join(targets, own["measure"] == F.lower("Setting")).where(F.abs(F.col("amber") - F.col("Target")) > 1e-6).select("measure", "amber", "Target")


def problems(rules: list[RiskRule]) -> list[str]:
    out = [f"{r.name}: no measure {r.measure}" for r in rules if r.measure not in RATIOS]
    return out + [f"{r.name}: red is not above amber" for r in rules if r.red <= r.amber] + [f"{r.name}: min_checked below 1" for r in rules if r.min_checked < 1]
