"""Queries of checks, watch rules, risk and back-test."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..decisions import backtest, playbook, quality, risk, watch
from ..functions.stats import Z
from ..plans.views import CATALOG
from ..sources.tables import table

NEWEST, DAYS = dt.date(2000, 6, 30), 60
FIRST, LAST, EVERY, WINDOW = dt.date(2000, 1, 1), dt.date(2000, 12, 30), 7, 28


def _daily(spark, sf):
    """What subjects sum up of vw_PlanQualityDay, by subject and day: its lines, buyers and orders make no groups."""
    return CATALOG.load(spark, sf).view("b_fileday")


def _texted(df):
    return df.select(*[df[c].cast("string").alias(c) if k == "date" else df[c] for c, k in df.dtypes])


def _ratio(part: str, whole: str) -> str:
    return f"CAST(round_even(CAST(100.0 * {part} / nullif({whole}, 0) AS decimal(18, 8)), 2) AS double)"


def _level(extra: str = "") -> str:
    one = lambda m: f"CASE WHEN Checked < 200 OR {m} IS NULL THEN 'info' WHEN {m} >= 45 THEN 'red' WHEN {m} >= 30 THEN 'amber' ELSE 'green' END"
    return f"list_reduce([{one('dhu')}, {one('reject_pct')}], lambda a, b: CASE WHEN 'red' IN (a, b) THEN 'red' WHEN 'amber' IN (a, b) THEN 'amber' WHEN 'green' IN (a, b) THEN 'green' ELSE 'info' END)"


SUMS = "CAST(sum(Checked) AS bigint) AS Checked, CAST(sum(Defects) AS bigint) AS Defects, CAST(sum(Rejected) AS bigint) AS Rejected"
RATED = f"SELECT *, {_ratio('Defects', 'Checked')} AS dhu, {_ratio('Rejected', 'Checked')} AS reject_pct"


def risk_levels(spark, sf):
    return risk.evaluate(risk.collect(_daily(spark, sf), NEWEST, DAYS)).select("Factory", "FileNo", "Checked", "dhu", "reject_pct", "level", "caveat")


def final_window(spark, sf):
    return _texted(risk.evaluate(risk.final_windows(_daily(spark, sf), DAYS)).select("Factory", "FileNo", "EndDay", "Checked", "dhu", "level"))


def _assessed(spark, sf):
    """Levels of all subjects on every run day: (RunDay, Factory, FileNo, level, dhu)."""
    return risk.evaluate(risk.trailing(_daily(spark, sf), WINDOW, FIRST, LAST, EVERY), [risk.RiskRule("file_dhu", "dhu", 30.0, 45.0, min_checked=20), risk.RiskRule("file_reject_pct", "reject_pct", 30.0, 45.0, min_checked=20)])


ASSESSED = f"""daily AS (SELECT * FROM vw_PlanQualityDay WHERE Day <= DATE '{LAST}'),
runs AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{FIRST}', TIMESTAMP '{LAST}', INTERVAL {EVERY} DAY)) AS date) AS RunDay),
assessed AS (SELECT *, {_level().replace('200', '20')} AS level FROM ({RATED} FROM (SELECT RunDay, Factory, FileNo, {SUMS} FROM runs INNER JOIN daily ON Day <= RunDay AND date_diff('day', Day, RunDay) < {WINDOW} GROUP BY RunDay, Factory, FileNo) s) r)"""


def trailing_levels(spark, sf):
    return _texted(_assessed(spark, sf).groupBy("RunDay", "level").agg(F.count("*").alias("n"), F.sum("Checked").alias("checked")))


def _predictions(spark, sf):
    """A store of predictions: one for each run day and subject, none settled yet."""
    return _assessed(spark, sf).select(F.datediff("RunDay", F.lit(FIRST)).cast("long").alias("run_id"), "RunDay", "Factory", "FileNo", "level", F.lit(None).cast("string").alias("outcome_level"))


def open_predictions(spark, sf):
    return _texted(risk.open_predictions(_predictions(spark, sf)))


def settled(spark, sf):
    """Subjects whose plan ended before the newest days get their last window as outcome."""
    daily = _daily(spark, sf).where(F.col("Day") <= F.lit(LAST))
    plans = CATALOG.load(spark, sf).view("vw_PlanDay").where(F.col("Day") <= F.lit(LAST)).select("Factory", F.concat(F.col("Style"), F.lit(" / "), F.col("Factory")).alias("FileNo"), "Day")
    finals = risk.evaluate(risk.final_windows(daily, WINDOW), [risk.RiskRule("file_dhu", "dhu", 30.0, 45.0, min_checked=20), risk.RiskRule("file_reject_pct", "reject_pct", 30.0, 45.0, min_checked=20)])
    return _texted(risk.settle(_predictions(spark, sf), risk.still_running(plans, daily), finals))


def _outcome_rows(spark, sf):
    """Predictions joined with their subject's last day and its ratio, as the back-test's inner step has them."""
    finals = risk.evaluate(risk.final_windows(_daily(spark, sf), WINDOW)).select("Factory", "FileNo", "EndDay", F.col("dhu").alias("outcome_dhu"))
    a = _assessed(spark, sf).select("RunDay", "Factory", "FileNo", "level", F.lit(WINDOW).alias("window_days"))
    joined = a.join(finals, ["Factory", "FileNo"]).withColumn("ahead", F.datediff("EndDay", "RunDay")).where("ahead >= 1")
    return joined.withColumn("adverse", (F.col("outcome_dhu") >= 30.0).cast("int"))


FINALS = f"finals AS ({RATED} FROM (SELECT Factory, FileNo, EndDay, {SUMS} FROM (SELECT *, max(Day) OVER (PARTITION BY Factory, FileNo) AS EndDay FROM vw_PlanQualityDay) x WHERE date_diff('day', Day, EndDay) < {WINDOW} GROUP BY Factory, FileNo, EndDay) s)"
JOINED = f"WITH {ASSESSED}, {FINALS}, joined AS (SELECT a.RunDay, a.Factory, a.FileNo, a.level, date_diff('day', a.RunDay, f.EndDay) AS ahead, CASE WHEN f.dhu >= 30 THEN 1 WHEN f.dhu IS NULL THEN NULL ELSE 0 END AS adverse FROM assessed a INNER JOIN finals f USING (Factory, FileNo) WHERE date_diff('day', a.RunDay, f.EndDay) >= 1)"


def lead_grid(spark, sf):
    """In the long form, so that any engine writes it alike."""
    from ..functions.stats import lead_bucket

    return _outcome_rows(spark, sf).groupBy("level", lead_bucket(F.col("ahead")).alias("bucket")).agg(F.sum("adverse").cast("long").alias("adverse"), F.count("*").alias("n"))


def wilson_by_level(spark, sf):
    return backtest.by_level(backtest.headline(_outcome_rows(spark, sf)))


def _wilson(sign: str) -> str:
    p, z2 = "(a / n)", Z * Z
    return f"round(({p} + {z2} / (2 * n)) / (1 + {z2} / n) {sign} {Z} * sqrt({p} * (1 - {p}) / n + {z2} / (4 * n * n)) / (1 + {z2} / n), 6)"


def backtest_store(spark, sf):
    """Orders as predictions of their customer, in weekly runs of which every seventh failed. A customer's newest order
    has the outcome, that of every thirteenth customer the one before too; every eleventh customer is revised."""
    week = F.floor(F.datediff("o_orderdate", F.lit(dt.date(1995, 1, 1))) / 7).cast("long")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), week.alias("run_id"), place.alias("place"))
    runs = orders.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("predictions")).select("id", F.expr("TIMESTAMP_NTZ '1995-01-01 09:00:00' + make_dt_interval(CAST(id * 7 AS int))").alias("started"), "predictions", F.when(F.col("id") % 7 == 6, 1).otherwise(0).alias("errors"))
    ended = (F.col("place") == 1) | ((F.col("place") == 2) & (F.col("o_custkey") % 13 == 0))
    end = F.date_add("day", (F.col("o_custkey") % 40 + 1).cast("int"))
    rows = orders.select(
        F.col("o_orderkey").alias("id"), "run_id", F.concat(F.lit("f"), F.col("o_custkey") % 3).alias("Factory"), F.concat(F.lit("c"), F.col("o_custkey")).alias("FileNo"), F.col("o_orderstatus").alias("level"), F.lit(7).alias("window_days"), F.lit(3.0).alias("amber"),
        F.when(ended, end.cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")).alias("outcome_at"), F.when(ended, end).alias("outcome_day"), F.when(ended, F.col("o_custkey") % 5 + 0.5).alias("outcome_dhu"), F.when((F.col("o_custkey") % 11 == 0) & ended, 1).otherwise(0).alias("revised"),
    )
    return _texted(backtest.compute(runs, rows).select("RunDay", "Factory", "FileNo", "level", "ahead", "adverse"))


STORE = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderstatus AS level, CAST(o_orderdate AS date) AS day, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS date)) // 7 AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders),
runs AS (SELECT run_id AS id, TIMESTAMP '1995-01-01 09:00:00' + to_days(CAST(run_id * 7 AS int)) AS started, run_id % 7 = 6 AS failed FROM o GROUP BY run_id),
r AS (SELECT *, CASE WHEN place = 1 OR (place = 2 AND c % 13 = 0) THEN day + CAST(c % 40 + 1 AS int) END AS outcome_day FROM o),
kept AS (SELECT r.*, CAST(started AS date) AS run_day FROM r JOIN runs ON runs.id = r.run_id WHERE NOT failed),
settled AS (SELECT r.*, (SELECT max(id) FROM runs WHERE started <= r.outcome_day + INTERVAL 6 HOUR) AS by_run FROM r WHERE outcome_day IS NOT NULL),
rest AS (SELECT * FROM settled WHERE by_run <> run_id),
gone AS (SELECT c FROM rest GROUP BY c HAVING count(*) > 1 UNION SELECT c FROM settled WHERE by_run = run_id UNION SELECT c FROM r WHERE c % 11 = 0 AND outcome_day IS NOT NULL UNION SELECT k.c FROM kept k JOIN rest e ON e.c = k.c WHERE k.run_day > e.outcome_day)
SELECT CAST(k.run_day AS varchar) AS RunDay, 'f' || (k.c % 3) AS Factory, 'c' || k.c AS FileNo, k.level, date_diff('day', k.run_day, e.outcome_day) AS ahead, CASE WHEN e.c % 5 + 0.5 >= 3.0 THEN 1 ELSE 0 END AS adverse
FROM kept k JOIN rest e ON e.c = k.c WHERE k.c NOT IN (SELECT c FROM gone) AND date_diff('day', k.run_day, e.outcome_day) >= 1"""


def _signals(spark, sf):
    return watch.run_all(CATALOG.load(spark, sf))


SIGNALS = watch.statement(CATALOG)


def _on_signals(sql: str) -> str:
    return f"WITH signals_all AS (\n{SIGNALS}\n)\n{sql}"


def action_options(spark, sf):
    costs = spark.createDataFrame([("extra inspection", 0.25), ("rework", 1.5)], "action string, rate double")
    sums = risk.evaluate(risk.collect(_daily(spark, sf), NEWEST, DAYS))
    with_levels = sums.withColumns({f"{r.measure}_level": risk.rule_level(r) for r in risk.RULES})
    return playbook.options(with_levels, costs).select("Factory", "FileNo", "level", "playbook", "action", "cost", "reasons")


def dimensions_due(spark, sf):
    """Order priorities as dimensions, orders as their runs: which had none on a day, and which have nothing to read."""
    o = table(spark, sf, "orders")
    dimensions = o.select(F.concat_ws(" / ", "o_orderpriority", "o_orderstatus").alias("dimension")).distinct().withColumn("mapped", ~F.col("dimension").endswith("P"))
    runs = o.where("o_orderkey % 50 = 0").select(F.concat_ws(" / ", "o_orderpriority", "o_orderstatus").alias("dimension"), F.col("o_orderdate").alias("started"))
    return risk.due(dimensions, runs, dt.date(1997, 6, 2))


DUE = "SELECT dimension, CASE WHEN dimension LIKE '%P' THEN 'unmapped' ELSE 'due' END AS state FROM (SELECT DISTINCT o_orderpriority || ' / ' || o_orderstatus AS dimension FROM orders) d WHERE dimension NOT IN (SELECT o_orderpriority || ' / ' || o_orderstatus FROM orders WHERE o_orderkey % 50 = 0 AND CAST(o_orderdate AS date) = DATE '1997-06-02')"


def outcomes_rewritten(spark, sf):
    """Orders as predictions, some with an outcome; later outcomes of every third are recorded."""
    o = table(spark, sf, "orders")
    had = F.col("o_orderkey") % 2 == 0
    predictions = o.select(F.col("o_orderkey").alias("id"), F.when(had, F.col("o_orderstatus")).alias("outcome_level"), F.when(had, F.floor("o_totalprice")).alias("outcome_totals"), F.when(had, F.col("o_orderdate")).alias("outcome_at"), (F.col("o_orderkey") % 5).cast("int").alias("revised"))
    outcomes = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("level"), F.floor("o_totalprice").alias("totals"), F.lit(dt.datetime(2000, 1, 1)).alias("written"))
    return risk.written_outcomes(predictions, outcomes).groupBy("outcome_level").agg(F.count("*").alias("n"), F.sum("revised").alias("revised"), F.sum("outcome_totals").alias("totals"), F.count_if(F.year("outcome_at") == 2000).alias("rewritten"))


REWRITTEN = "WITH p AS (SELECT *, o_orderkey % 2 = 0 AS had, o_orderkey % 3 = 0 AS told, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS level FROM orders) SELECT CASE WHEN told THEN level WHEN had THEN o_orderstatus END AS outcome_level, count(*) AS n, CAST(sum(o_orderkey % 5 + CASE WHEN told AND had AND level <> o_orderstatus THEN 1 ELSE 0 END) AS bigint) AS revised, CAST(sum(CASE WHEN told OR had THEN CAST(floor(o_totalprice) AS bigint) END) AS bigint) AS totals, count(*) FILTER (WHERE told OR (had AND year(o_orderdate) = 2000)) AS rewritten FROM p GROUP BY 1"


QUERIES = {f"dq_{c.name}": ((lambda spark, sf, c=c: quality.run_check(CATALOG.load(spark, sf), c)), quality.statement(CATALOG, c)) for c in quality.CHECKS} | {
    "dimensions_due": (dimensions_due, DUE),
    "outcomes_rewritten": (outcomes_rewritten, REWRITTEN),
    "watch_levels": (_signals, SIGNALS),
    "health_score": (lambda spark, sf: watch.health(_signals(spark, sf)), _on_signals("SELECT round_even(100.0 * (n - red - amber * 0.5) / n, 0) AS health, n AS levelled, red, amber FROM (SELECT count(*) AS n, count(*) FILTER (WHERE level = 'red') AS red, count(*) FILTER (WHERE level = 'amber') AS amber FROM signals_all WHERE kind = 'ops' AND level <> 'info') x")),
    "attention_top": (lambda spark, sf: watch.attention(_signals(spark, sf)), _on_signals("SELECT * FROM signals_all WHERE level IN ('red', 'amber') ORDER BY CASE level WHEN 'red' THEN 0 ELSE 1 END, weight DESC, value DESC NULLS LAST, Factory, rule LIMIT 5")),
    "watch_metrics": (lambda spark, sf: watch.metrics(_signals(spark, sf)), _on_signals("SELECT metric, round(sum(value), 2) AS total, count(*) AS signals FROM signals_all WHERE metric <> '' AND value IS NOT NULL GROUP BY metric")),
    "risk_levels": (risk_levels, CATALOG.with_views(f"SELECT Factory, FileNo, Checked, dhu, reject_pct, {_level()} AS level, Checked >= 200 AND coalesce(dhu >= 45, false) AS caveat FROM ({RATED} FROM (SELECT Factory, FileNo, {SUMS} FROM vw_PlanQualityDay WHERE Day > DATE '{NEWEST - dt.timedelta(DAYS)}' AND Day <= DATE '{NEWEST}' GROUP BY Factory, FileNo) s) r")),
    "final_window": (final_window, CATALOG.with_views(f"SELECT Factory, FileNo, CAST(EndDay AS varchar) AS EndDay, Checked, dhu, {_level()} AS level FROM ({RATED} FROM (SELECT Factory, FileNo, EndDay, {SUMS} FROM (SELECT *, max(Day) OVER (PARTITION BY Factory, FileNo) AS EndDay FROM vw_PlanQualityDay) x WHERE date_diff('day', Day, EndDay) < {DAYS} GROUP BY Factory, FileNo, EndDay) s) r")),
    "trailing_levels": (trailing_levels, CATALOG.with_views(f"WITH {ASSESSED} SELECT CAST(RunDay AS varchar) AS RunDay, level, count(*) AS n, CAST(sum(Checked) AS bigint) AS checked FROM assessed GROUP BY RunDay, level")),
    "open_predictions": (open_predictions, CATALOG.with_views(f"WITH {ASSESSED} SELECT Factory, FileNo, CAST(date_diff('day', DATE '{FIRST}', RunDay) AS bigint) AS run_id, CAST(RunDay AS varchar) AS RunDay, level FROM (SELECT *, row_number() OVER (PARTITION BY Factory, FileNo ORDER BY RunDay DESC) AS rn FROM assessed) x WHERE rn = 1")),
    "settled": (settled, CATALOG.with_views(f"""WITH {ASSESSED},
last_plan AS (SELECT Factory, Style || ' / ' || Factory AS FileNo, max(Day) AS LastPlan FROM vw_PlanDay WHERE Day <= DATE '{LAST}' GROUP BY 1, 2),
running AS (SELECT Factory, FileNo FROM last_plan WHERE LastPlan >= (SELECT max(Day) FROM daily) - 3),
fin AS (SELECT *, {_level().replace('200', '20')} AS outcome_level FROM ({RATED} FROM (SELECT Factory, FileNo, EndDay, {SUMS} FROM (SELECT *, max(Day) OVER (PARTITION BY Factory, FileNo) AS EndDay FROM daily) x WHERE date_diff('day', Day, EndDay) < {WINDOW} GROUP BY Factory, FileNo, EndDay) s) r),
op AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Factory, FileNo ORDER BY RunDay DESC) AS rn FROM assessed) x WHERE rn = 1)
SELECT op.Factory, op.FileNo, CAST(date_diff('day', DATE '{FIRST}', op.RunDay) AS bigint) AS run_id, op.level, CAST(fin.EndDay AS varchar) AS EndDay, fin.outcome_level, fin.dhu AS outcome_dhu
FROM op INNER JOIN fin ON op.Factory = fin.Factory AND op.FileNo = fin.FileNo WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.Factory = op.Factory AND r.FileNo = op.FileNo)""")),
    "lead_grid": (lead_grid, CATALOG.with_views(f"{JOINED} SELECT level, CASE WHEN ahead < 7 THEN '1-6' WHEN ahead = 7 THEN '7' WHEN ahead <= 13 THEN '8-13' WHEN ahead <= 20 THEN '14-20' WHEN ahead <= 27 THEN '21-27' ELSE '28+' END AS bucket, CAST(sum(adverse) AS bigint) AS adverse, count(*) AS n FROM joined GROUP BY 1, 2")),
    "wilson_by_level": (wilson_by_level, CATALOG.with_views(f"{JOINED} SELECT level, CAST(n AS bigint) AS n, CAST(a AS bigint) AS adverse, greatest(0.0, {_wilson('-')}) AS low, least(1.0, {_wilson('+')}) AS high FROM (SELECT level, CAST(count(*) AS double) AS n, CAST(sum(adverse) AS double) AS a FROM (SELECT *, row_number() OVER (PARTITION BY Factory, FileNo ORDER BY ahead, level) AS rn FROM joined WHERE ahead >= {WINDOW}) x WHERE rn = 1 GROUP BY level) y")),
    "backtest_store": (backtest_store, STORE),
    "action_options": (action_options, CATALOG.with_views(f"""WITH s AS (SELECT *, {_level()} AS level, CASE WHEN Checked < 200 OR dhu IS NULL THEN 'info' WHEN dhu >= 45 THEN 'red' WHEN dhu >= 30 THEN 'amber' ELSE 'green' END AS dl, CASE WHEN Checked < 200 OR reject_pct IS NULL THEN 'info' WHEN reject_pct >= 45 THEN 'red' WHEN reject_pct >= 30 THEN 'amber' ELSE 'green' END AS rl FROM ({RATED} FROM (SELECT Factory, FileNo, {SUMS} FROM vw_PlanQualityDay WHERE Day > DATE '{NEWEST - dt.timedelta(DAYS)}' AND Day <= DATE '{NEWEST}' GROUP BY Factory, FileNo) q) r)
SELECT Factory, FileNo, level, 'defects' AS playbook, 'extra inspection' AS action, round(Checked * 0.25, 2) AS cost, CASE WHEN Checked <= 0 THEN 'no quantity' ELSE '' END AS reasons FROM s WHERE level IN ('red', 'amber') AND dl IN ('red', 'amber')
UNION ALL SELECT Factory, FileNo, level, 'defects', 'line meeting', NULL, '' FROM s WHERE level IN ('red', 'amber') AND dl IN ('red', 'amber')
UNION ALL SELECT Factory, FileNo, level, 'rejects', 'rework', round(Rejected * 1.5, 2), CASE WHEN Rejected <= 0 THEN 'no quantity' ELSE '' END FROM s WHERE level IN ('red', 'amber') AND rl = 'red'
UNION ALL SELECT Factory, FileNo, level, 'rejects', 'stop line', NULL, 'no rate' FROM s WHERE level IN ('red', 'amber') AND rl = 'red'""")),
}
