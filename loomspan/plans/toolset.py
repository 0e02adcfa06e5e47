"""The library of fixed questions. Each name is a query; its parameters' defaults are its example."""

from __future__ import annotations

import datetime as dt

from ..functions.measures import MEASURES, date_label, ratio, total
from .tools import Filter, Tool, given, window

YEAR = {"from": dt.date(1997, 1, 1), "to": dt.date(1998, 1, 1)}
MONTH = {"from": dt.date(1997, 3, 1), "to": dt.date(1997, 4, 1)}
TODAY = dt.date(2000, 6, 30)
FABRIC = given("Buyer=buyer", "FileNo=file", "Factory=factory")
SHORT = given("Buyer=buyer", "Factory=factory")


def _list(name, view, columns, order, *filters, top=200, params=YEAR, **more):
    return Tool(name, view, tuple(filters), columns=tuple(columns.split()), order=tuple(x.strip() for x in order.split(",")), top=top, params=params, **more)


def _sums(name, view, dims, measures, order, *filters, top=200, params=YEAR, **more):
    return Tool(name, view, tuple(filters), dims=tuple(dims.split()), measures=measures, order=tuple(x.strip() for x in order.split(",") if x), top=top, params=params, **more)


def _count(name, view, *filters, params=YEAR, **more):
    return Tool(name, view, tuple(filters), measures={"n": "count(*)", **more}, params=params)


def _days(column):
    return lambda d: date_label(d, column)


ROLL = "GR RollNo Buyer FileNo Color"
FACTORY = Filter("Factory", "eq", "factory")
ASIA = {"factory": "ASIA"}
QC = {"checked": total("Checked"), "defects": total("Defects"), "rejected": total("Rejected"), "dhu": ratio("Defects", "Checked"), "reject_pct": ratio("Rejected", "Checked"), "period": _days("Day")}
DHU = {"checked": total("Checked"), "defects": total("Defects"), "dhu": ratio("Defects", "Checked"), "period": _days("Day")}
OUTPUT = {"output": total("Checked - Rejected"), "checked": total("Checked"), "period": _days("Day")}
DEFECTS = {"n": "count(*)", "major": "CAST(sum(CASE WHEN Category = 'major' THEN 1 ELSE 0 END) AS bigint)", "period": _days("Day")}
ORDER_LIST = "ExportOrderID FileNo Buyer Style Status OrderQty PCD ShipDate"
LATE = (Filter("FirstInvoice", "null"),)
OPEN = Filter("Status", "not_in", value=("Finished", "Partial"))
SOON = {"today": dt.date(1998, 6, 1)}

TOOLS = [
    _list("fabric_bowing_by_roll", "vw_FabricRoll", f"{ROLL} Bowing CutOn", "Bowing desc, GR, RollNo", *window("CutOn"), *FABRIC),
    _sums("fabric_bowing_summary", "vw_FabricRoll", "Buyer", {"rolls": "count(*)", "mean": "round(avg(Bowing), 3)", "most": "max(Bowing)"}, "mean desc, Buyer", *window("CutOn"), *FABRIC, top=100),
    _list("fabric_shrinkage_by_roll", "vw_FabricRoll", f"{ROLL} Shrinkage CutOn", "Shrinkage, GR, RollNo", *window("CutOn"), *FABRIC, params=YEAR | ASIA),
    _sums("fabric_shrinkage_summary", "vw_FabricRoll", "Color", {"rolls": "count(*)", "mean": "round(avg(Shrinkage), 3)", "least": "min(Shrinkage)", "most": "max(Shrinkage)"}, "mean, Color", *window("CutOn"), *FABRIC, top=100),
    _sums("fabric_shade_summary", "vw_FabricRoll", "Shade", {"rolls": "count(*)", "receipts": "count(DISTINCT GR)", "buyers": "count(DISTINCT Buyer)"}, "rolls desc, Shade", *window("CutOn"), *FABRIC, top=100),
    _list("fabric_4point_failed", "vw_FabricVisualInspection", "GR Buyer Points Rolls InspectedOn", "Points desc, GR", *window("InspectedOn"), Filter("Result", "eq", value="Fail"), *SHORT),
    _list("fabric_4point_inspections", "vw_FabricVisualInspection", "GR Buyer Points Rolls Result InspectedOn", "InspectedOn desc, GR", *window("InspectedOn"), *SHORT),
    _list("fabric_receipts_window", "vw_FabricReceipt", "GR Buyer Rolls Yards ReceivedOn", "ReceivedOn desc, GR", *window("ReceivedOn"), *SHORT),
    _list("fabric_yarn_count", "vw_FabricYarnCount", "GR TestNo Buyer FileNo Count Result TestedOn", "TestedOn desc, GR, TestNo", *window("TestedOn"), *FABRIC),
    _list("fabric_gsm_tests", "vw_FabricGSMTest", "GR Buyer FileNo Samples AvgGSM MinGSM MaxGSM TestedOn", "TestedOn desc, GR", *window("TestedOn"), *FABRIC),
    _list("fabric_lab_tests_failed", "vw_FabricLabTest", "GR TestNo Buyer FileNo TestedOn", "TestedOn desc, GR, TestNo", *window("TestedOn"), Filter("Result", "eq", value="Fail"), *FABRIC),
    _list("fabric_lab_tests", "vw_FabricLabTest", "GR TestNo Buyer FileNo Result TestedOn", "TestedOn desc, GR, TestNo", *window("TestedOn"), *FABRIC),
    _sums("fabric_twisting_summary", "vw_FabricTwistingTest", "Buyer", {"tests": "count(*)", "mean": "round(avg(Twist), 3)", "most": "max(Twist)"}, "mean desc, Buyer", *window("TestedOn"), *FABRIC, top=100),
    _list("trims_failed_inspections", "vw_TrimsInspection", "InspectionID Buyer Supplier InspectedOn", "InspectedOn desc, InspectionID", *window("InspectedOn"), Filter("Result", "eq", value="Fail"), *FABRIC),
    _sums("trims_inspection_summary", "vw_TrimsInspection", "Supplier", {"n": "count(*)", "failed": "CAST(sum(CASE WHEN Result = 'Fail' THEN 1 ELSE 0 END) AS bigint)", "held": "CAST(sum(CASE WHEN Result = 'Hold' THEN 1 ELSE 0 END) AS bigint)"}, "failed desc, Supplier", *window("InspectedOn"), *FABRIC, top=100),
    _list("trims_metal_detection", "vw_MetalDetection", "Factory Line DetectedOn Pieces Found", "DetectedOn desc, Factory, Line", *window("DetectedOn"), *FABRIC),
    _list("trims_nickel_tests", "vw_NickelTest", "GR Buyer Samples Failed TestedOn", "TestedOn desc, GR", *window("TestedOn"), *SHORT),
    _list("pcd_history_by_eo", "vw_PCDChangeHistory", "ExportOrderID VersionNo ShipDate UpdatedBy Flag", "VersionNo", Filter("ExportOrderID", "eq", "eo"), top=50, params={"eo": 33}),
    _count("orders_count_by_factory_ship_window", "vw_ExportOrder", FACTORY, *window("ShipDate"), params=YEAR | ASIA),
    _count("ppm_meetings_count_by_factory_window", "vw_PPMMeeting", FACTORY, *window("MeetingDate"), params=YEAR | ASIA),
    _list("orders_by_factory_pcd_window", "vw_ExportOrder", ORDER_LIST, "PCD, ExportOrderID", FACTORY, *window("PCD"), params=YEAR | ASIA, may_sort=("OrderQty", "ShipDate")),
    _list("orders_by_factory_ship_window", "vw_ExportOrder", ORDER_LIST, "ShipDate, ExportOrderID", FACTORY, *window("ShipDate"), params=YEAR | ASIA | {"order_by": "OrderQty desc"}, may_sort=("OrderQty", "PCD")),
    _list("ppm_meetings_by_factory_window", "vw_PPMMeeting", "MeetingID Buyer MeetingDate State", "MeetingDate, MeetingID", FACTORY, *window("MeetingDate"), params=YEAR | ASIA),
    _list("upcoming_pcds_by_factory", "vw_ExportOrder", ORDER_LIST, "PCD, ExportOrderID", FACTORY, Filter("PCD", "ge", "today"), OPEN, top=20, params=SOON | ASIA, may_sort=("OrderQty",)),
    _list("upcoming_pcds_by_buyer", "vw_ExportOrder", ORDER_LIST, "PCD, ExportOrderID", Filter("Buyer", "contains", "buyer"), Filter("PCD", "ge", "today"), OPEN, top=20, params=SOON | {"buyer": "00001"}, may_sort=("OrderQty",)),
    _list("upcoming_pcds", "vw_ExportOrder", ORDER_LIST, "PCD, ExportOrderID", Filter("PCD", "ge", "today"), OPEN, top=20, params=SOON, may_sort=("OrderQty",)),
    _count("bblcs_expiring_count_window", "vw_BackToBackLC", *window("Expiry")),
    _list("bblcs_expiring_window", "vw_BackToBackLC", "BBLCNo Supplier Amount Expiry Closed", "Expiry, BBLCNo", *window("Expiry")),
    _list("lcs_expiring_window", "vw_ExportLC", "LCNo Buyer Amount Expiry AmendmentNo", "Expiry, LCNo", *window("Expiry")),
    _sums("lines_below_target_by_factory", "vw_LineDailyOutput", "Factory Line", {"output": total("Output"), "target": "max(Target)"}, "output, Line", FACTORY, Filter("Day", "latest"), having="output < target", params=ASIA, may_sort=("target",)),
    _sums("lines_below_target", "vw_LineDailyOutput", "Factory Line", {"output": total("Output"), "target": "max(Target)"}, "output, Line", Filter("Day", "latest"), having="output < target", params={}, may_sort=("target",)),
    _count("orders_past_ship_not_invoiced_count", "vw_OrderShipment", *window("ShipDate"), *LATE),
    _list("orders_past_ship_not_invoiced_by_factory", "vw_OrderShipment", "ExportOrderID Buyer OrderQty ShipDate", "ShipDate, ExportOrderID", FACTORY, *window("ShipDate"), *LATE, params=YEAR | ASIA),
    _list("orders_past_ship_not_invoiced", "vw_OrderShipment", "ExportOrderID Factory Buyer OrderQty ShipDate", "ShipDate, ExportOrderID", *window("ShipDate"), *LATE),
    _sums("quality_by_eo_window", "vw_PlanQualityDay", "ExportOrderID FileNo", {"period": _days("Day")}, "ExportOrderID, FileNo", *window("Day"), Filter("FileNo", "eq", "file"), having="checked > 0", top=10, params=YEAR | {"file": "Brand#13 / ASIA", "measures": ("checked", "dhu", "reject_pct")}, may_measure=MEASURES),
    _sums("quality_by_group_window", "vw_PlanQualityDay", "Factory", {"period": _days("Day")}, "Buyer, Style", *window("Day"), *given("Factory=factory"), having="checked > 0", params=YEAR | ASIA | {"dims": ("Buyer", "Style"), "measures": ("checked", "defects", "dhu", "pass_pct", "rectified_pct", "days")}, may_group=("Factory", "Unit", "Line", "Buyer", "Style", "FileNo", "Day"), may_measure=MEASURES),
    _sums("qc_summary_by_factory_window", "vw_LineDayQuality", "Factory", QC, "Factory", FACTORY, *window("Day"), top=10, params=YEAR | ASIA),
    _sums("qc_summary_window", "vw_LineDayQuality", "Factory", QC, "Factory", *window("Day"), top=10),
    _sums("defect_summary_by_factory_window", "vw_QCDefect", "Defect", DEFECTS, "n desc, Defect", FACTORY, *window("Day"), top=50, params=YEAR | ASIA),
    _sums("defect_summary_window", "vw_QCDefect", "Factory Defect", DEFECTS, "n desc, Factory, Defect", *window("Day"), top=50),
    _sums("dhu_by_line_by_factory", "vw_LineDayQuality", "Line", DHU, "dhu desc, Line", FACTORY, *window("Day"), having="checked > 0", params=YEAR | ASIA),
    _sums("dhu_by_line", "vw_LineDayQuality", "Factory Line", DHU, "dhu desc, Factory, Line", *window("Day"), having="checked > 0"),
    _sums("endline_output_by_line_by_factory_window", "vw_LineDayQuality", "Line", OUTPUT, "output desc, Line", FACTORY, *window("Day"), params=YEAR | ASIA | {"order_by": "checked"}, may_sort=("checked", "Line")),
    _sums("endline_output_by_line_window", "vw_LineDayQuality", "Factory Line", OUTPUT, "output desc, Factory, Line", *window("Day"), may_sort=("checked", "Line")),
    _sums("rejects_window", "vw_LineDayQuality", "Factory", {"rejected": total("Rejected"), "reject_pct": ratio("Rejected", "Checked"), "period": _days("Day")}, "rejected desc, Factory", *window("Day"), *given("Factory=factory"), top=10),
    _sums("defects_by_buyer_window", "vw_QCDefect", "Buyer", DEFECTS, "n desc, Buyer", *window("Day"), *given("Factory=factory"), top=50),
    _sums("defects_by_style_window", "vw_QCDefect", "Style", DEFECTS, "n desc, Style", *window("Day"), *given("Factory=factory"), top=50),
    _sums("qc_by_stage_window", "vw_QCStageDay", "Factory Stage", {"checked": total("Checked"), "passed": total("Passed"), "period": _days("Day")}, "Factory, Stage", *window("Day"), *given("Factory=factory"), top=50),
    _sums("corrective_actions_count_window", "vw_CorrectiveAction", "Factory", {"n": "count(*)", "open_": "CAST(sum(CASE WHEN Status = 'open' THEN 1 ELSE 0 END) AS bigint)", "period": _days("RaisedOn")}, "Factory", *window("RaisedOn"), *given("Factory=factory"), top=10),
    _list("corrective_actions_window", "vw_CorrectiveAction", "ActionID Factory Buyer Defect Status RaisedOn", "RaisedOn desc, ActionID", *window("RaisedOn"), *given("Factory=factory")),
    _sums("cutting_output_window", "vw_CuttingDaily", "Factory", {"cut": total("Cut"), "buyers": "count(DISTINCT Buyer)", "period": _days("Day")}, "Factory", *window("Day"), *given("Factory=factory"), top=10),
    _list("running_style_by_line", "vw_PlanDay", "Line Style Buyer Day Target PlanID", "Day desc, PlanID", *window("Day"), *given("Factory=factory", "Line=line"), top=50, params=MONTH | ASIA),
    _sums("quality_by_line_window", "vw_PlanQualityDay", "Line", {"period": _days("Day")}, "Line", *window("Day"), *given("Factory=factory", "Line=line"), having="checked > 0", top=100, params=MONTH | {"measures": ("checked", "defects", "dhu")}, may_measure=MEASURES),
    _list("lines_running_style", "vw_PlanDay", "Factory Line Style Buyer Day PlanID", "Day desc, PlanID", *window("Day"), Filter("Style", "eq", "style"), *given("Factory=factory", "Buyer=buyer"), top=100, params=MONTH | {"style": "Brand#13"}),
    _list("line_plan_by_factory_window", "vw_PlanDay", "Line Style Buyer Day Target PlanID", "Day, PlanID", FACTORY, *window("Day"), params=MONTH | ASIA),
    _list("buyer_list", "vw_ExportOrder", "Buyer", "Buyer", distinct=True, params={}),
    _count("cancelled_orders_count_window", "vw_CancelledExportOrder", *window("CancelledOn")),
    _list("cancelled_orders_window", "vw_CancelledExportOrder", "ExportOrderID Factory Buyer Value CancelledOn Reason", "CancelledOn desc, ExportOrderID", *window("CancelledOn")),
    _list("orders_by_fileref", "vw_ExportOrder", ORDER_LIST, "PCD, ExportOrderID", Filter("FileNo", "eq", "fr"), top=100, params={"fr": "Brand#13 / ASIA"}),
    _list("eo_by_po", "vw_ExportOrder", f"{ORDER_LIST} PO", "ExportOrderID", Filter("PO", "eq", "po"), top=10, params={"po": "PO-33"}),
    _list("eo_by_id", "vw_ExportOrder", ORDER_LIST, "ExportOrderID", Filter("ExportOrderID", "eq", "eo"), top=1, params={"eo": 33}),
    _list("stock_balance_by_item", "vw_StockBalance", "Factory Store ItemID Item Balance Receipts Issues BaseQty", "Factory, Store", Filter("ItemID", "eq", "item"), *given("Factory=company", "Store=store"), top=50, params={"item": 33}),
    _list("grn_issue_by_item", "vw_StockMovement", "Factory Store Kind DocNo DocLine Qty MovedOn", "MovedOn desc, DocNo, DocLine, Kind", Filter("ItemID", "eq", "item"), *given("Factory=company"), params={"item": 33}),
    _list("grn_by_item", "vw_GoodsReceipt", "Factory Store DocNo DocLine Qty Amount ReceivedOn", "ReceivedOn desc, DocNo, DocLine", Filter("ItemID", "eq", "item"), *given("Factory=company"), params={"item": 33}),
    _list("issues_by_item", "vw_StockIssue", "Factory Store DocNo DocLine Qty Cause IssuedOn", "IssuedOn desc, DocNo, DocLine", Filter("ItemID", "eq", "item"), *given("Factory=company"), params={"item": 33}),
    _list("stores_holding_item", "vw_StockBalance", "Factory Store Balance LastMove", "Balance desc, Store", Filter("ItemID", "eq", "item"), Filter("Balance", "ne", value=0), top=50, params={"item": 33}),
    _list("item_by_code", "vw_Item", "ItemID Factory Item Category ItemGroup Size Price", "ItemID, Factory", Filter("ItemID", "eq", "item"), top=5, params={"item": 33}),
]

BY_NAME = {t.name: t for t in TOOLS}
