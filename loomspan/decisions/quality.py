"""Data-quality checks: how old, how many, what share; each gives one row and a verdict."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, Loaded

AS_OF = dt.date(2000, 6, 30)


@dataclass(frozen=True)
class Check:
    """``kind`` freshness: the SQL gives last_date, ``limit`` is days; count: n, most that is well (None: for
    information); share: bad and total, the largest share that is well."""

    name: str
    kind: str
    limit: float | None
    sql: str


def status(kind: str, limit: float | None, as_of: dt.date = AS_OF) -> Column:
    if kind == "freshness":
        age = F.datediff(F.lit(as_of), F.col("last_date"))
        return F.when(F.col("last_date").isNull() | (age > limit), "stale").otherwise("ok")
    if kind == "count":
        return F.lit("info") if limit is None else F.when(F.col("n") > limit, "issue").otherwise("ok")
    return F.when((F.col("total") > 0) & (F.col("bad") > F.lit(limit) * F.col("total")), "issue").otherwise("ok")


def run_check(catalog: Loaded, check: Check, as_of: dt.date = AS_OF) -> DataFrame:
    row = catalog.sql(check.sql)
    value = {"freshness": F.datediff(F.lit(as_of), F.col("last_date")).cast("double") if check.kind == "freshness" else None, "count": F.col("n").cast("double") if check.kind == "count" else None, "share": F.round(F.try_divide(F.col("bad").cast("double"), F.nullif(F.col("total"), F.lit(0))), 4) if check.kind == "share" else None}[check.kind]
    return row.select(F.lit(check.name).alias("check_name"), F.lit(check.kind).alias("kind"), value.alias("value"), status(check.kind, check.limit, as_of).alias("status"))


def report(catalog: Loaded, checks: list["Check"] | None = None, as_of: dt.date = AS_OF) -> tuple[DataFrame, dict[str, str]]:
    """All checks in one frame, and the errors of those that can't be planned; one bad check doesn't stop the rest."""
    frames, errors = [], {}
    for check in checks or CHECKS:
        try:
            frames.append(run_check(catalog, check, as_of))
        except Exception as e:  # noqa: BLE001  a check is user-written SQL
            errors[check.name] = str(e).splitlines()[0]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, errors


def statement(catalog: Catalog, check: Check, as_of: dt.date = AS_OF) -> str:
    day = f"DATE '{as_of}'"
    value, verdict = {
        "freshness": (f"CAST(date_diff('day', last_date, {day}) AS double)", f"CASE WHEN last_date IS NULL OR date_diff('day', last_date, {day}) > {check.limit} THEN 'stale' ELSE 'ok' END"),
        "count": ("CAST(n AS double)", "'info'" if check.limit is None else f"CASE WHEN n > {check.limit} THEN 'issue' ELSE 'ok' END"),
        "share": ("round(CAST(bad AS double) / nullif(total, 0), 4)", f"CASE WHEN total > 0 AND bad > {check.limit} * total THEN 'issue' ELSE 'ok' END"),
    }[check.kind]
    return catalog.with_views(f"SELECT '{check.name}' AS check_name, '{check.kind}' AS kind, {value} AS value, {verdict} AS status FROM (\n{check.sql}\n) c")


def _fresh(view: str, column: str, where: str = "") -> str:
    return f"SELECT max({column}) AS last_date FROM {view} {where}"


def _share(bad: str, source: str) -> str:
    return f"SELECT sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS bad, count(*) AS total FROM {source}"


DAY_OF_EVENTS = "SELECT max(CAST(ts AS date)) FROM events"

CHECKS = [
    Check("order_entries_fresh", "freshness", 3, _fresh("vw_ExportOrder", "PCD", "WHERE PCD < DATE '2001-06-30'")),
    Check("shipment_status_not_maintained", "share", 0.2, _share("Status <> 'Finished'", "vw_ExportOrder WHERE ShipDate < DATE '2000-03-31'")),
    Check("confirmed_orders_without_quantity", "count", None, "SELECT count(*) AS n FROM vw_ExportOrder WHERE coalesce(OrderQty, 0) = 0 AND PCD >= DATE '1996-01-01'"),
    Check("future_cancellations", "count", 0, "SELECT count(*) AS n FROM vw_CancelledExportOrder WHERE CancelledOn > DATE '2000-06-30'"),
    Check("master_lc_fresh", "freshness", 30, _fresh("vw_ExportLC", "Amended")),
    Check("lc_amendments_not_on_master", "count", None, "SELECT count(*) AS n FROM (SELECT ExportOrderID, ShipDate, row_number() OVER (PARTITION BY ExportOrderID ORDER BY ShipDate DESC, VersionNo DESC) AS rn FROM vw_PCDChangeHistory) h INNER JOIN vw_ExportLC m ON h.ExportOrderID = m.LCNo WHERE h.rn = 1 AND h.ShipDate > m.Expiry"),
    Check("bblc_fresh", "freshness", 7, _fresh("vw_BackToBackLC", "Expiry")),
    Check("bblc_close_flag_not_maintained", "share", 0.2, _share("coalesce(Closed, 'open') = 'open'", "vw_BackToBackLC WHERE Expiry < DATE '2000-06-30'")),
    Check("goods_receipts_fresh", "freshness", 3, _fresh("vw_GoodsReceipt", "ReceivedOn")),
    Check("po_dates_far_future", "count", 0, "SELECT count(*) AS n FROM vw_ExportOrder WHERE PCD > DATE '2001-06-30'"),
    Check("line_output_fresh", "freshness", 2, _fresh("vw_LineDailyOutput", "Day")),
    Check("line_rows_without_target", "share", 0.2, _share("coalesce(Target, 0) < 31", "vw_LineDailyOutput WHERE Day >= (SELECT max(Day) FROM vw_LineDailyOutput) - 30")),
    Check("line_targets_above_100_percent", "count", None, "SELECT count(*) AS n FROM vw_LineDailyOutput WHERE Output > Target AND Day >= (SELECT max(Day) FROM vw_LineDailyOutput) - 7"),
    Check("hourly_line_fresh", "freshness", 2, _fresh("vw_PlanOutputDay", "Day")),
    Check("hr_attendance_fresh", "freshness", 2, "SELECT max(CAST(ts AS date)) AS last_date FROM events"),
    Check("hr_punches_fresh", "freshness", 2, "SELECT max(CAST(ts AS date)) AS last_date FROM events WHERE event_type = 'click'"),
    Check("gate_punches_fresh", "freshness", 2, "SELECT max(CAST(ts AS date)) AS last_date FROM events WHERE event_type = 'view'"),
    Check("hr_overtime_fresh", "freshness", 2, "SELECT max(CAST(ts AS date)) AS last_date FROM events WHERE value > 50"),
    Check("hr_active_staff_without_attendance", "share", 0.05, f"SELECT sum(CASE WHEN p.user_id IS NULL THEN 1 ELSE 0 END) AS bad, count(*) AS total FROM customer c LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS date) = ({DAY_OF_EVENTS})) p ON c.c_custkey = p.user_id"),
    Check("hr_unknown_day_status", "count", None, f"SELECT count(*) AS n FROM events WHERE CAST(ts AS date) = ({DAY_OF_EVENTS}) AND event_type NOT IN ('click', 'view')"),
    Check("hr_overtime_barely_recorded", "share", 0.5, f"SELECT sum(CASE WHEN o.user_id IS NULL THEN 1 ELSE 0 END) AS bad, count(*) AS total FROM (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS date) = ({DAY_OF_EVENTS}) AND user_id IN (SELECT c_custkey FROM customer)) d LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE value > 90) o ON d.user_id = o.user_id"),
    Check("hr_attendance_covers_the_group", "share", 0.2, f"SELECT sum(CASE WHEN e.Factory IS NULL THEN 1 ELSE 0 END) AS bad, count(*) AS total FROM vw_Company m LEFT JOIN (SELECT DISTINCT r.r_name AS Factory FROM events v INNER JOIN customer c ON v.user_id = c.c_custkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey WHERE CAST(v.ts AS date) = ({DAY_OF_EVENTS})) e ON m.Factory = e.Factory"),
    Check("hr_salary_month_fresh", "freshness", 70, _fresh("vw_CuttingDaily", "Day")),
    Check("visitor_dates_missing", "share", 0.05, _share("FirstInvoice IS NULL", "vw_OrderShipment WHERE ShipDate >= DATE '1999-06-30'")),
    Check("qc_inspections_fresh", "freshness", 2, _fresh("vw_LineDayQuality", "Day")),
    Check("qc_defects_fresh", "freshness", 2, _fresh("vw_QCDefect", "Day")),
    Check("qc_factory_coverage", "share", 0, "SELECT sum(CASE WHEN x.n < y.most / 2 THEN 1 ELSE 0 END) AS bad, count(*) AS total FROM (SELECT Factory, count(*) AS n FROM vw_LineDayQuality WHERE Day >= (SELECT max(Day) FROM vw_LineDayQuality) - 30 AND Factory IN (SELECT Factory FROM vw_Company) GROUP BY Factory) x CROSS JOIN (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM vw_LineDayQuality WHERE Day >= (SELECT max(Day) FROM vw_LineDayQuality) - 30 GROUP BY Factory) z) y"),
    Check("qc_summary_job_lag", "count", 2, "SELECT CASE WHEN (SELECT max(Day) FROM vw_LineDayQuality) > (SELECT max(Day) FROM vw_LineDailyOutput) THEN 1 ELSE 0 END AS n"),
    Check("qc_targets_sane", "count", 0, "SELECT count(*) AS n FROM vw_QCTarget WHERE coalesce(Target, 0) <= 0 OR Target > 100"),
    Check("qc_inspections_without_a_file", "share", 0.05, "SELECT sum(CASE WHEN f.FileNo IS NULL THEN 1 ELSE 0 END) AS bad, count(*) AS total FROM vw_PlanQualityDay q LEFT JOIN vw_FileRef f ON q.FileNo = f.FileNo WHERE q.Day >= (SELECT max(Day) FROM vw_PlanQualityDay) - 90"),
    Check("prep_head_cutting_fresh", "freshness", 3, _fresh("vw_FabricRoll", "CutOn")),
    Check("prep_fabric_receipts_fresh", "freshness", 3, _fresh("vw_FabricReceipt", "ReceivedOn")),
    Check("prep_visual_inspection_fresh", "freshness", 3, _fresh("vw_FabricVisualInspection", "InspectedOn")),
    Check("prep_trims_inspection_fresh", "freshness", 3, _fresh("vw_TrimsInspection", "InspectedOn", "WHERE InspectedOn < DATE '2000-06-30'")),
]


def render(rows: list, as_of: dt.date = AS_OF) -> str:
    """The report as Markdown, what is wrong first."""
    order = {"stale": 0, "issue": 0, "info": 1, "ok": 2}
    lines = [f"# Data quality on {as_of}", "", "| check | kind | value | status |", "|-|-|-|-|"]
    return "\n".join(lines + [f"| {r['check_name']} | {r['kind']} | {'-' if r['value'] is None else r['value']} | {r['status']} |" for r in sorted(rows, key=lambda r: (order[r["status"]], r["check_name"]))])
