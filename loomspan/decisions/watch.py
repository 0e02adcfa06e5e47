"""Watch rules: a value for each factory, its level, the health of all, and what needs attention."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Loaded

LEVELS = {"red": 0, "amber": 1, "green": 2, "info": 3}


@dataclass(frozen=True)
class WatchRule:
    """The SQL gives Factory and value. Without thresholds the level is info; ``below`` turns the comparison round."""

    name: str
    sql: str
    amber: float | None = None
    red: float | None = None
    below: bool = False
    weight: int = 1
    kind: str = "ops"
    label: str = ""


def level(value: Column, amber: float | None, red: float | None, below: bool = False) -> Column:
    """No value is green. Reaching a threshold is enough."""
    if amber is None and red is None:
        return F.lit("info")
    reaches = lambda limit: (value <= limit) if below else (value >= limit)
    out = F.when(value.isNull(), "green")
    if red is not None:
        out = out.when(reaches(red), "red")
    if amber is not None:
        out = out.when(reaches(amber), "amber")
    return out.otherwise("green")


RULES = [
    WatchRule("behind_schedule", "SELECT Factory, CAST(count(*) AS double) AS value FROM vw_ExportOrder WHERE Status <> 'Finished' AND ShipDate >= DATE '2000-05-31' AND ShipDate < DATE '2000-06-30' GROUP BY Factory", 40, 60, weight=3, label="orders"),
    WatchRule("shipping_next_30_days", "SELECT Factory, CAST(count(*) AS double) AS value FROM vw_ExportOrder WHERE ShipDate >= DATE '2000-06-30' AND ShipDate < DATE '2000-07-30' GROUP BY Factory", label="orders"),
    WatchRule("export_lcs_expiring_14_days", "SELECT Factory, CAST(count(*) AS double) AS value FROM vw_ExportLC WHERE Expiry >= DATE '2000-06-30' AND Expiry < DATE '2000-07-14' GROUP BY Factory", 10, 40, weight=2, label="credits"),
    WatchRule("lines_below_target", "SELECT Factory, round(100.0 * sum(CASE WHEN Output < Target THEN 1 ELSE 0 END) / count(*), 2) AS value FROM (SELECT Factory, Line, sum(Output) AS Output, max(Target) AS Target FROM vw_LineDailyOutput WHERE Day >= DATE '2000-06-23' AND Day < DATE '2000-06-30' GROUP BY Factory, Line HAVING max(Target) > 0) x GROUP BY Factory", 10, 30, weight=2, label="lines"),
    WatchRule("line_data_age", "SELECT Factory, CAST({days} AS double) AS value FROM (SELECT Factory, max(Day) AS newest FROM vw_LineDailyOutput WHERE Day < DATE '2000-06-30' GROUP BY Factory) x", 2, 7, kind="data"),
    WatchRule("dhu_today", "SELECT Factory, round(100.0 * sum(Defects) / nullif(sum(Checked), 0), 2) AS value FROM vw_LineDayQuality WHERE Day = DATE '2000-06-30' GROUP BY Factory", 25, 45, weight=3, label="quality"),
    WatchRule("reject_rate_today", "SELECT Factory, round(100.0 * sum(Rejected) / nullif(sum(Checked), 0), 2) AS value FROM vw_LineDayQuality WHERE Day = DATE '2000-06-30' GROUP BY Factory", 25, 45, weight=2, label="quality"),
    WatchRule("qc_data_age", "SELECT Factory, CAST({days} AS double) AS value FROM (SELECT Factory, max(Day) AS newest FROM vw_LineDayQuality WHERE Day < DATE '2000-06-30' GROUP BY Factory) x", 2, 7, kind="data"),
]


def run_rule(catalog: Loaded, rule: WatchRule) -> DataFrame:
    """One signal for each factory."""
    rows = catalog.sql(rule.sql.format(days="datediff(DATE '2000-06-30', newest)"))
    return rows.select(F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.label).alias("metric"), "Factory", "value", F.lit(rule.weight).alias("weight"), level(F.col("value"), rule.amber, rule.red, rule.below).alias("level"))


def run_all(catalog: Loaded, rules: list[WatchRule] | None = None) -> DataFrame:
    """All signals; a rule that can't be planned is left out."""
    out = None
    for rule in rules or RULES:
        try:
            one = run_rule(catalog, rule)
        except Exception:  # noqa: BLE001  a rule is user-written SQL
            continue
        out = one if out is None else out.unionByName(one)
    return out


def statement(catalog: Catalog) -> str:
    def verdict(r: WatchRule) -> str:
        if r.amber is None and r.red is None:
            return "'info'"
        return f"CASE WHEN value IS NULL THEN 'green' WHEN value {'<=' if r.below else '>='} {r.red} THEN 'red' WHEN value {'<=' if r.below else '>='} {r.amber} THEN 'amber' ELSE 'green' END"

    days = "date_diff('day', newest, DATE '2000-06-30')"
    parts = [f"SELECT '{r.name}' AS rule, '{r.kind}' AS kind, '{r.label}' AS metric, Factory, value, {r.weight} AS weight, {verdict(r)} AS level FROM ({r.sql.format(days=days)}) r" for r in RULES]
    return catalog.with_views("SELECT * FROM (" + " UNION ALL ".join(parts) + ") signals")


def health(signals: DataFrame) -> DataFrame:
    """100 (1 - (red + amber / 2) / levelled) over operational signals with a level, rounded half to even; null without any."""
    levelled = signals.where((F.col("kind") == "ops") & (F.col("level") != "info"))
    n, red, amber = F.count("*"), F.count_if(F.col("level") == "red"), F.count_if(F.col("level") == "amber")
    return levelled.agg(F.bround(F.try_divide(F.lit(100.0) * (n - red - amber * 0.5), n), 0).alias("health"), n.alias("levelled"), red.alias("red"), amber.alias("amber"))


def attention(signals: DataFrame, most: int = 5) -> DataFrame:
    """The worst signals: level, then weight, then value, then factory."""
    rank = F.element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))]), F.col("level"))
    return signals.where(F.col("level").isin("red", "amber")).orderBy(rank, F.desc("weight"), F.desc_nulls_last("value"), "Factory", "rule").limit(most)


def metrics(signals: DataFrame) -> DataFrame:
    """Sums by label."""
    return signals.where("metric != '' AND value IS NOT NULL").groupBy("metric").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("signals"))


def stale(stamp: dt.datetime | str | None, now: dt.datetime, most_minutes: int) -> bool:
    """A stamp that can't be read is stale."""
    try:
        at = dt.datetime.fromisoformat(stamp) if isinstance(stamp, str) else stamp
        return at is None or now - at > dt.timedelta(minutes=most_minutes)
    except ValueError:
        return True


def problems(rules: list[WatchRule]) -> list[str]:
    """What is wrong with rules before any runs."""
    out = [f"{r.name}: named twice" for i, r in enumerate(rules) if r.name in {x.name for x in rules[:i]}]
    for r in rules:
        if r.amber is not None and r.red is not None and (r.red > r.amber) == r.below:
            out.append(f"{r.name}: red is not beyond amber")
        if r.weight < 1:
            out.append(f"{r.name}: weight below 1")
    return out
