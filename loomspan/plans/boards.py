"""The fixed questions that are more than one view with filters: status of a lot, block joins, and the dashboard."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import pct
from .catalog import Loaded

FROM, TO = dt.date(1997, 3, 1), dt.date(1997, 4, 1)


def _in(column: str, start: dt.date, end: dt.date) -> Column:
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def fabric_lot_status(catalog: Loaded, gr: int = 33) -> DataFrame:
    """A receipt with counts from two other views: each child is aggregated before it is joined."""
    receipt = catalog.view("vw_FabricReceipt").where(F.col("GR") == gr)
    rolls = catalog.view("vw_FabricRoll").where(F.col("GR") == gr).groupBy("GR").agg(F.count("*").alias("RollsSeen"), F.count_if(F.col("Shade") == "R").alias("ShadeR"))
    points = catalog.view("vw_FabricVisualInspection").where(F.col("GR") == gr).select("GR", "Points", "Result")
    return receipt.join(rolls, "GR", "left").join(points, "GR", "left").select("GR", "Buyer", "Rolls", "Yards", "RollsSeen", "ShadeR", "Points", "Result").orderBy("GR").limit(20)


FABRIC_LOT_STATUS = """
SELECT r.GR AS GR, r.Buyer AS Buyer, r.Rolls AS Rolls, r.Yards AS Yards,
       (SELECT count(*) FROM vw_FabricRoll x WHERE x.GR = r.GR) AS RollsSeen,
       (SELECT count(*) FROM vw_FabricRoll x WHERE x.GR = r.GR AND x.Shade = 'R') AS ShadeR,
       (SELECT max(Points) FROM vw_FabricVisualInspection x WHERE x.GR = r.GR) AS Points,
       (SELECT max(Result) FROM vw_FabricVisualInspection x WHERE x.GR = r.GR) AS Result
FROM vw_FabricReceipt r WHERE r.GR = 33
"""


def orders_by_file_id(catalog: Loaded, file_no: str = "Brand#13 / ASIA") -> DataFrame:
    """Natural order of the ids: by length, then by text."""
    text = F.col("ExportOrderID").cast("string")
    return catalog.view("vw_ExportOrder").where(F.col("FileNo") == file_no).orderBy(F.length(text), text).limit(200).select("ExportOrderID", "FileNo", "Buyer", "OrderQty")


ORDERS_BY_FILE_ID = """
SELECT ExportOrderID, FileNo, Buyer, OrderQty FROM vw_ExportOrder WHERE FileNo = 'Brand#13 / ASIA'
ORDER BY length(CAST(ExportOrderID AS varchar)), CAST(ExportOrderID AS varchar) LIMIT 200
"""


def lines_above_dhu_target(catalog: Loaded, factory: str = "ASIA", start: dt.date = dt.date(1997, 1, 1), end: dt.date = dt.date(1998, 1, 1)) -> DataFrame:
    """A ratio of sums by line, kept where it is above the factory's target, a scalar that is joined as one row."""
    target = catalog.view("vw_QCTarget").where((F.col("Factory") == factory) & (F.col("Setting") == "DHU")).agg(F.max("Target").alias("target"))
    lines = catalog.view("vw_LineDayQuality").where((F.col("Factory") == factory) & _in("Day", start, end)).groupBy("Factory", "Line").agg(F.sum("Checked").cast("long").alias("checked"), pct(F.col("Defects"), F.col("Checked")).alias("dhu"))
    return lines.where("checked > 0").join(F.broadcast(target)).where("dhu > target").select("Factory", "Line", "checked", "dhu", F.col("target").cast("double").alias("target")).orderBy(F.desc("dhu"), "Line").limit(200)


LINES_ABOVE = """
SELECT Factory, Line, CAST(sum(Checked) AS bigint) AS checked, round(100.0 * sum(Defects) / nullif(sum(Checked), 0), 2) AS dhu,
       CAST((SELECT max(Target) FROM vw_QCTarget WHERE Factory = 'ASIA' AND Setting = 'DHU') AS double) AS target
FROM vw_LineDayQuality WHERE Factory = 'ASIA' AND Day >= DATE '1997-01-01' AND Day < DATE '1998-01-01'
GROUP BY Factory, Line
HAVING sum(Checked) > 0 AND round(100.0 * sum(Defects) / nullif(sum(Checked), 0), 2) > (SELECT max(Target) FROM vw_QCTarget WHERE Factory = 'ASIA' AND Setting = 'DHU')
ORDER BY dhu DESC, Line LIMIT 200
"""


def _blocks(catalog: Loaded, start: dt.date, end: dt.date) -> DataFrame:
    """Six blocks of the planned lines in two passes over the work: what styles and buyers give, and what days give.

    Work in process is a balance of flows up to the window's end, for the styles that are planned in the window. The
    rows are added up to (Factory, Line, Style, Buyer) before anything is asked of a style, and lines without a name have
    a plan alone, as in a join on the name. The scope's filter is that of the views that say the same block by block.
    """
    on = ["Factory", "Line"]
    keep = catalog.scope.rows("Factory")
    scoped = lambda df: df if keep is None else df.where(keep)
    inside = _in("Day", start, end)
    buyers = catalog.view("b_order").select(F.col("OrderID").alias("__order"), F.coalesce("Buyer", F.lit("?")).alias("Buyer"))
    work = scoped(catalog.view("b_line")).where(F.col("Day") < F.lit(end)).join(buyers, F.col("OrderID") == F.col("__order"), "left").withColumn("Buyer", F.coalesce("Buyer", F.lit("?")))
    planned = inside & ((F.col("State") == "F") | (F.col("LineNo") < 4))
    flow = F.when(F.col("State") == "F", F.col("Qty")).when(F.col("State") == "O", -F.col("Qty"))
    per = work.groupBy(*on, F.col("Brand").alias("Style"), "Buyer").agg(
        F.count_if(planned).alias("plans"), F.sum(F.when(planned, F.greatest(F.lit(10), F.col("Qty")))).alias("target"), F.sum(F.when(inside, F.when(F.col("Flag") != "A", F.col("Qty")).otherwise(0))).alias("output"),
        F.sum(F.when(inside, F.col("Qty"))).alias("checked"), F.sum(F.when(inside, F.when(F.col("Flag") == "R", F.col("Qty")).otherwise(0))).alias("defects"), F.sum(flow).alias("flow"),
    )
    in_plan = F.max("plans").over(Window.partitionBy(*on, "Style")) > 0
    named = F.col("Factory").isNotNull() & F.col("Line").isNotNull()
    only = lambda c: F.when(named, c)
    total = lambda c: F.sum(only(F.col(c))).cast("long").alias(c)
    asked = F.when(F.col("plans") > 0, F.col("Buyer"))
    lines = per.withColumn("wip", F.when(in_plan & F.col("Style").isNotNull(), F.col("flow"))).groupBy(*on).agg(
        F.sum("plans").alias("plans"), F.sum("target").cast("long").alias("target"), F.count_distinct(asked).alias("buyers"), total("output"), total("checked"), total("defects"), total("wip"),
        F.array_join(F.array_sort(F.collect_set(only(F.when(F.col("plans") > 0, F.col("Style"))))), ", ").alias("styles"), F.max(named).alias("named"),
    )
    last = F.max(F.struct("Day", "LineNo")).over(Window.partitionBy("OrderID"))["LineNo"]
    days = scoped(catalog.view("b_work").withColumn("last", last)).where(inside).groupBy(*on, "Day").agg(F.max_by("last", "OrderID").alias("last"))
    crews = days.select(*on, (F.coalesce("last", F.lit(1)) * 10).alias("Workers")).groupBy(*on).agg((F.sum("Workers") * 480).cast("long").alias("minutes"), F.max("Workers").cast("long").alias("workers"))
    out = lines.where("plans > 0").join(crews, on, "left")
    return out.select(*on, "target", "buyers", "output", "checked", "defects", "minutes", "workers", "wip", F.when(F.col("named"), F.col("styles")).alias("styles"))


def production_by_line(catalog: Loaded, factory: str = "", start: dt.date = FROM, end: dt.date = TO) -> DataFrame:
    """All factories are computed together and one is kept: the blocks can be cached for all who ask."""
    out = _blocks(catalog, start, end).where("target > 0")
    out = out.where(F.col("Factory") == factory) if factory else out
    eff = F.round(F.try_divide(100.0 * F.col("output"), F.nullif(F.col("target"), F.lit(0))), 2)
    return out.select("*", eff.alias("efficiency"), F.round(F.try_divide(100.0 * F.col("defects"), F.nullif(F.col("checked"), F.lit(0))), 2).alias("dhu")).orderBy("Factory", "Line").limit(200)


BLOCKS = """
plan AS (SELECT Factory, Line, CAST(sum(Target) AS bigint) AS target, count(DISTINCT Buyer) AS buyers FROM vw_PlanDay WHERE Day >= DATE '1997-03-01' AND Day < DATE '1997-04-01' GROUP BY 1, 2),
st AS (SELECT DISTINCT Factory, Line, Style FROM vw_PlanDay WHERE Day >= DATE '1997-03-01' AND Day < DATE '1997-04-01'),
outp AS (SELECT Factory, Line, CAST(sum(Output) AS bigint) AS output FROM vw_PlanOutputDay WHERE Day >= DATE '1997-03-01' AND Day < DATE '1997-04-01' GROUP BY 1, 2),
qual AS (SELECT Factory, Line, CAST(sum(Checked) AS bigint) AS checked, CAST(sum(Defects) AS bigint) AS defects FROM vw_LineDayQuality WHERE Day >= DATE '1997-03-01' AND Day < DATE '1997-04-01' GROUP BY 1, 2),
mh AS (SELECT Factory, Line, CAST(sum(Minutes) AS bigint) AS minutes, CAST(max(Workers) AS bigint) AS workers FROM vw_LineDayManHours WHERE Day >= DATE '1997-03-01' AND Day < DATE '1997-04-01' GROUP BY 1, 2),
wip AS (SELECT f.Factory, f.Line, CAST(sum(Received - Delivered) AS bigint) AS wip FROM vw_CombinationFlowDay f WHERE Day < DATE '1997-04-01' AND EXISTS (SELECT 1 FROM st WHERE st.Factory = f.Factory AND st.Line = f.Line AND st.Style = f.Style) GROUP BY 1, 2),
sty AS (SELECT Factory, Line, string_agg(Style, ', ' ORDER BY Style) AS styles FROM st GROUP BY 1, 2),
b AS (SELECT plan.*, outp.output, qual.checked, qual.defects, mh.minutes, mh.workers, wip.wip, sty.styles FROM plan LEFT JOIN outp USING (Factory, Line) LEFT JOIN qual USING (Factory, Line) LEFT JOIN mh USING (Factory, Line) LEFT JOIN wip USING (Factory, Line) LEFT JOIN sty USING (Factory, Line))
"""

PRODUCTION_BY_LINE = f"""WITH {BLOCKS}
SELECT *, round(100.0 * output / nullif(target, 0), 2) AS efficiency, round(100.0 * defects / nullif(checked, 0), 2) AS dhu FROM b WHERE target > 0 ORDER BY Factory, Line LIMIT 200
"""

METRICS = ["lines", "target", "output", "checked", "defects", "minutes", "wip", "efficiency", "dhu"]


def dashboard(catalog: Loaded, factory: str = "", start: dt.date = FROM, end: dt.date = TO) -> DataFrame:
    """Metrics as rows, factories and All as columns: rollup with grouping(), unpivot, pivot."""
    b = _blocks(catalog, start, end)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c)
    sums = b.rollup("Factory").agg(F.grouping("Factory").alias("all"), F.count("*").cast("double").alias("lines"), *[total(c) for c in METRICS[1:7]])
    named = sums.select(F.when(F.col("all") == 1, "All").otherwise(F.col("Factory")).alias("Factory"), *METRICS[:7], F.round(100 * F.try_divide("output", "target"), 2).alias("efficiency"), F.round(100 * F.try_divide("defects", "checked"), 2).alias("dhu"))
    long = named.unpivot("Factory", METRICS, "metric", "value")
    names = ["All"] + [r[0] for r in catalog.table("region").select("r_name").orderBy("r_name").collect()]  # the scope's codes, a fixed few
    out = long.groupBy("metric").pivot("Factory", names).agg(F.max("value"))
    return (out.select("metric", factory) if factory else out).orderBy("metric").limit(30)


DASHBOARD = f"""WITH {BLOCKS},
s AS (SELECT CASE WHEN grouping(Factory) = 1 THEN 'All' ELSE Factory END AS Factory, CAST(count(*) AS double) AS lines, CAST(coalesce(sum(target), 0) AS double) AS target, CAST(coalesce(sum(output), 0) AS double) AS output, CAST(coalesce(sum(checked), 0) AS double) AS checked,
      CAST(coalesce(sum(defects), 0) AS double) AS defects, CAST(coalesce(sum(minutes), 0) AS double) AS minutes, CAST(coalesce(sum(wip), 0) AS double) AS wip FROM b GROUP BY ROLLUP (Factory)),
m AS (SELECT *, round(100 * output / nullif(target, 0), 2) AS efficiency, round(100 * defects / nullif(checked, 0), 2) AS dhu FROM s),
l AS (SELECT Factory, metric, value FROM m UNPIVOT (value FOR metric IN ({", ".join(METRICS)})))
SELECT metric, max(CASE WHEN Factory = 'All' THEN value END) AS "All", max(CASE WHEN Factory = 'AFRICA' THEN value END) AS "AFRICA", max(CASE WHEN Factory = 'AMERICA' THEN value END) AS "AMERICA",
       max(CASE WHEN Factory = 'ASIA' THEN value END) AS "ASIA", max(CASE WHEN Factory = 'EUROPE' THEN value END) AS "EUROPE", max(CASE WHEN Factory = 'MIDDLE EAST' THEN value END) AS "MIDDLE EAST"
FROM l GROUP BY metric
"""


def manpower_present_latest(catalog: Loaded) -> DataFrame:
    """Who was present on the newest day: distinct people by state, from the day's events."""
    e = catalog.table("events").select(F.to_date("ts").alias("day"), "user_id", "event_type", "value")
    newest = e.agg(F.max("day").alias("newest"))
    present = e.join(F.broadcast(newest), F.col("day") == F.col("newest"))
    return present.groupBy("day").agg(F.count_distinct("user_id").alias("people"), F.count_distinct(F.when(F.col("event_type") == "click", F.col("user_id"))).alias("clicking"), F.count("*").alias("entries")).select(F.col("day").cast("string").alias("day"), "people", "clicking", "entries").limit(1)


MANPOWER = """
SELECT CAST(CAST(ts AS date) AS varchar) AS day, count(DISTINCT user_id) AS people, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clicking, count(*) AS entries
FROM events WHERE CAST(ts AS date) = (SELECT max(CAST(ts AS date)) FROM events) GROUP BY 1
"""

#: name: (function of the catalog, SQL)
BOARDS = {
    "fabric_lot_status": (fabric_lot_status, FABRIC_LOT_STATUS),
    "orders_by_file_id": (orders_by_file_id, ORDERS_BY_FILE_ID),
    "lines_above_dhu_target_window": (lines_above_dhu_target, LINES_ABOVE),
    "production_by_line_window": (production_by_line, PRODUCTION_BY_LINE),
    "production_dashboard_window": (dashboard, DASHBOARD),
    "manpower_present_latest": (manpower_present_latest, MANPOWER),
}
