"""The curated views, over the star schema.

Stand-ins: a region is a factory, a nation a unit, a supplier a production line; an order is an export order, its
customer the buyer, its part brand and region the file; a line item is a roll, an inspection or a movement. The bodies
are portable SQL; what differs between engines goes through the dialect. Facts that one table holds are taken from it in
one pass, as conditional sums, where separate tables would be padded with zeros and united. A view joins what it shows
and no more: Spark can't drop a left join whose columns nobody reads, since it may multiply rows.
"""

from __future__ import annotations

from .catalog import Catalog, View

#: Days are counted from here; nothing reads the clock.
TODAY = "DATE '2000-06-30'"


def _kinds(text: str) -> dict[str, str]:
    return dict(x.split(":") for x in text.split())


def _view(name: str, grain: str, keys: str, kinds: str, sql, fresh: str | None = None, base: bool = False) -> View:
    return View(name, grain, tuple(keys.split()), _kinds(kinds), sql if callable(sql) else (lambda d: sql), "Factory", fresh, base)


#: Items with their factories. Spark reads the work once, and an item meets a factory once, not once a line: both sides are
#: distinct before they meet, so the rows are too, and none is grouped by all its columns.
ITEMS = {
    "ansi": """
SELECT DISTINCT p.p_partkey AS ItemID, l.Factory AS Factory, p.p_name AS Item, p.p_brand AS Category, p.p_type AS ItemGroup, p.p_size AS Size, p.p_retailprice AS Price
FROM part p LEFT JOIN b_line l ON p.p_partkey = l.ItemID WHERE p.p_partkey IN (SELECT l_partkey FROM lineitem)""",
    "spark": """
SELECT p.ItemID AS ItemID, l.Factory AS Factory, p.Item AS Item, p.Category AS Category, p.ItemGroup AS ItemGroup, p.Size AS Size, p.Price AS Price
FROM (SELECT DISTINCT p_partkey AS ItemID, p_name AS Item, p_brand AS Category, p_type AS ItemGroup, p_size AS Size, p_retailprice AS Price FROM part) p
INNER JOIN (SELECT DISTINCT ItemID, Factory FROM b_work) l ON p.ItemID = l.ItemID""",
}

BASE = [
    _view("b_order", "order", "OrderID", "OrderID:int Factory:text Unit:text BuyerID:int Buyer:text Segment:text Status:text Value:decimal PCD:date Priority:text", """
SELECT o.o_orderkey AS OrderID, r.r_name AS Factory, n.n_name AS Unit, c.c_custkey AS BuyerID, c.c_name AS Buyer, c.c_mktsegment AS Segment,
       o.o_orderstatus AS Status, o.o_totalprice AS Value, CAST(o.o_orderdate AS date) AS PCD, o.o_orderpriority AS Priority
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""", base=True),
    _view("b_work", "line item", "OrderID LineNo", "OrderID:int LineNo:int Factory:text Unit:text Line:text LineID:int ItemID:int Qty:decimal Price:decimal Discount:decimal Tax:decimal Flag:text State:text Day:date", """
SELECT l.l_orderkey AS OrderID, l.l_linenumber AS LineNo, r.r_name AS Factory, n.n_name AS Unit, s.s_name AS Line, s.s_suppkey AS LineID,
       l.l_partkey AS ItemID, l.l_quantity AS Qty, l.l_extendedprice AS Price, l.l_discount AS Discount, l.l_tax AS Tax,
       l.l_returnflag AS Flag, l.l_linestatus AS State, CAST(l.l_shipdate AS date) AS Day
FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""", base=True),
    _view("b_line", "line item with its part", "OrderID LineNo", "OrderID:int LineNo:int Factory:text Unit:text Line:text LineID:int ItemID:int Item:text Brand:text Type:text Qty:decimal Price:decimal Discount:decimal Tax:decimal Flag:text State:text Day:date", """
SELECT w.OrderID AS OrderID, w.LineNo AS LineNo, w.Factory AS Factory, w.Unit AS Unit, w.Line AS Line, w.LineID AS LineID, w.ItemID AS ItemID,
       p.p_name AS Item, p.p_brand AS Brand, p.p_type AS Type, w.Qty AS Qty, w.Price AS Price, w.Discount AS Discount, w.Tax AS Tax, w.Flag AS Flag, w.State AS State, w.Day AS Day
FROM b_work w LEFT JOIN part p ON w.ItemID = p.p_partkey""", base=True),
    _view("b_pieces", "order", "OrderID", "OrderID:int Pieces:decimal LastShip:date", """
SELECT l_orderkey AS OrderID, sum(l_quantity) AS Pieces, CAST(max(l_shipdate) AS date) AS LastShip FROM lineitem GROUP BY l_orderkey""", base=True),
    _view("b_shipment", "order", "OrderID", "OrderID:int Factory:text Pieces:decimal FirstShip:date LastShip:date Items:int Style:text", """
SELECT OrderID, max(Factory) AS Factory, sum(Qty) AS Pieces, min(Day) AS FirstShip, max(Day) AS LastShip, count(*) AS Items, max(Brand) AS Style
FROM b_line GROUP BY OrderID""", base=True),
    _view("b_fileday", "factory, file and day", "Factory FileNo Day", "Factory:text FileNo:text Day:date Checked:decimal Defects:decimal Rejected:decimal Passed:decimal DefectivePcs:decimal Rectified:decimal", """
SELECT l.Factory AS Factory, l.Brand || ' / ' || o.Factory AS FileNo, l.Day AS Day,
       sum(l.Qty) AS Checked, sum(CASE WHEN l.Flag = 'R' THEN l.Qty ELSE 0 END) AS Defects, sum(CASE WHEN l.Flag = 'A' THEN l.Qty ELSE 0 END) AS Rejected, sum(CASE WHEN l.Flag = 'N' THEN l.Qty ELSE 0 END) AS Passed,
       sum(CASE WHEN l.Flag <> 'N' THEN l.Qty ELSE 0 END) AS DefectivePcs, sum(CASE WHEN l.Flag <> 'N' AND l.State = 'F' THEN l.Qty ELSE 0 END) AS Rectified
FROM b_line l INNER JOIN b_order o ON l.OrderID = o.OrderID
GROUP BY l.Factory, l.Brand || ' / ' || o.Factory, l.Day""", base=True),
]

ORDERS = [
    _view("vw_ExportOrder", "order", "ExportOrderID", "ExportOrderID:int FileNo:text Factory:text Unit:text Buyer:text Style:text Status:text OrderQty:decimal Value:decimal PCD:date ShipDate:date PO:text", """
SELECT o.OrderID AS ExportOrderID, coalesce(s.Style, '?') || ' / ' || o.Factory AS FileNo, o.Factory AS Factory, o.Unit AS Unit, o.Buyer AS Buyer, s.Style AS Style,
       CASE o.Status WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Partial' END AS Status, s.Pieces AS OrderQty, o.Value AS Value,
       o.PCD AS PCD, s.LastShip AS ShipDate, 'PO-' || CAST(o.OrderID % 997 AS varchar(10)) AS PO
FROM b_order o LEFT JOIN b_shipment s ON o.OrderID = s.OrderID""", "PCD"),
    _view("vw_FileRef", "file", "FileNo", "FileNo:text Factory:text Style:text Orders:int FirstPCD:date LastPCD:date State:text", """
SELECT FileNo, max(Factory) AS Factory, max(Style) AS Style, count(*) AS Orders, min(PCD) AS FirstPCD, max(PCD) AS LastPCD,
       CASE WHEN min(Status) = max(Status) THEN max(Status) ELSE 'Mixed' END AS State
FROM vw_ExportOrder GROUP BY FileNo""", "LastPCD"),
    _view("vw_ExportOrderColorSize", "order, colour and size", "ExportOrderID Color Size", "ExportOrderID:int Factory:text Color:text Size:int Qty:decimal Pieces:int", """
SELECT o.OrderID AS ExportOrderID, max(o.Factory) AS Factory, coalesce(p.p_brand, '?') AS Color, p.p_size AS Size, sum(l.l_quantity) AS Qty, count(*) AS Pieces
FROM lineitem l INNER JOIN part p ON l.l_partkey = p.p_partkey INNER JOIN b_order o ON l.l_orderkey = o.OrderID
GROUP BY o.OrderID, coalesce(p.p_brand, '?'), p.p_size"""),
    _view("vw_PCDChangeHistory", "order version", "ExportOrderID VersionNo", "ExportOrderID:int VersionNo:int Factory:text ShipDate:date UpdatedBy:text Flag:text", """
SELECT b.l_orderkey AS ExportOrderID, b.l_linenumber AS VersionNo, o.Factory AS Factory, CAST(b.l_shipdate AS date) AS ShipDate,
       'user' || CAST(b.l_suppkey % 17 AS varchar(10)) AS UpdatedBy, CASE b.l_returnflag WHEN 'R' THEN 'Revised' WHEN 'A' THEN 'Approved' ELSE 'New' END AS Flag
FROM lineitem b LEFT JOIN b_order o ON b.l_orderkey = o.OrderID""", "ShipDate"),
    _view("vw_CancelledExportOrder", "cancelled order", "ExportOrderID", "ExportOrderID:int Factory:text Buyer:text Value:decimal CancelledOn:date Reason:text", lambda d: f"""
SELECT o.OrderID AS ExportOrderID, o.Factory AS Factory, o.Buyer AS Buyer, o.Value AS Value, {d.plus("o.PCD", 14)} AS CancelledOn,
       CASE WHEN o.Value < 50000 THEN 'small' ELSE 'buyer' END AS Reason
FROM b_order o WHERE o.Status = 'P'""", "CancelledOn"),
    _view("vw_ExportLC", "letter of credit", "LCNo", "LCNo:int Factory:text Buyer:text Amount:decimal Expiry:date AmendmentNo:int Amended:date", lambda d: f"""
SELECT o.OrderID AS LCNo, o.Factory AS Factory, o.Buyer AS Buyer, coalesce(a.Price, o.Value) AS Amount, {d.plus("coalesce(a.Day, o.PCD)", 90)} AS Expiry, a.LineNo AS AmendmentNo, a.Day AS Amended
FROM b_order o LEFT JOIN (
  SELECT OrderID, LineNo, Day, Price FROM (
    SELECT OrderID, LineNo, Day, Price, row_number() OVER (PARTITION BY OrderID ORDER BY Day DESC, LineNo DESC, Price DESC) AS rn FROM b_work
  ) x WHERE rn = 1
) a ON o.OrderID = a.OrderID
WHERE o.Value > 100000""", "Expiry"),
    _view("vw_BackToBackLC", "back-to-back letter of credit", "BBLCNo", "BBLCNo:text Factory:text Supplier:text Amount:decimal Expiry:date Closed:text", lambda d: f"""
SELECT CAST(OrderID AS varchar(20)) || '-' || CAST(LineNo AS varchar(5)) AS BBLCNo, Factory, Line AS Supplier, Price AS Amount, {d.plus("Day", 60)} AS Expiry,
       CASE WHEN coalesce(State, 'O') = 'F' THEN 'closed' ELSE 'open' END AS Closed
FROM b_work WHERE Price > 40000""", "Expiry"),
    _view("vw_OrderShipment", "order", "ExportOrderID", "ExportOrderID:int Factory:text Buyer:text OrderQty:decimal ShippedQty:decimal Invoices:int ShipDate:date FirstInvoice:date Late:int", lambda d: f"""
SELECT o.OrderID AS ExportOrderID, o.Factory AS Factory, o.Buyer AS Buyer, s.Pieces AS OrderQty, i.Shipped AS ShippedQty, coalesce(i.Invoices, 0) AS Invoices,
       {d.plus("o.PCD", 60)} AS ShipDate, i.FirstInvoice AS FirstInvoice, CASE WHEN i.FirstInvoice IS NULL AND {d.plus("o.PCD", 60)} < {TODAY} THEN 1 ELSE 0 END AS Late
FROM b_order o LEFT JOIN b_pieces s ON o.OrderID = s.OrderID
LEFT JOIN (SELECT OrderID, sum(Qty) AS Shipped, count(*) AS Invoices, min(Day) AS FirstInvoice FROM b_work WHERE State = 'F' GROUP BY OrderID) i ON o.OrderID = i.OrderID""", "ShipDate"),
]

FABRIC = [
    _view("vw_PPMMeeting", "meeting", "MeetingID", "MeetingID:int Factory:text Buyer:text MeetingDate:date State:text", lambda d: f"""
SELECT OrderID AS MeetingID, Factory, Buyer, {d.plus("PCD", -7)} AS MeetingDate, CASE Priority WHEN '1-URGENT' THEN 'urgent' ELSE 'planned' END AS State FROM b_order""", "MeetingDate"),
    _view("vw_PPMMeetingReschedule", "reschedule", "MeetingID RescheduleNo", "MeetingID:int RescheduleNo:int Factory:text NewDate:date Reason:text", """
SELECT l.OrderID AS MeetingID, l.LineNo AS RescheduleNo, m.Factory AS Factory, l.Day AS NewDate, CASE l.Flag WHEN 'R' THEN 'buyer' WHEN 'A' THEN 'factory' ELSE 'none' END AS Reason
FROM b_work l LEFT JOIN vw_PPMMeeting m ON l.OrderID = m.MeetingID WHERE l.LineNo > 1""", "NewDate"),
    _view("vw_PPMDepartmentChecklist", "meeting and department", "MeetingID Department", "MeetingID:int Department:text Factory:text Done:int", """
SELECT l.OrderID AS MeetingID, l.Brand AS Department, max(m.Factory) AS Factory, max(CASE WHEN l.State = 'F' THEN 1 ELSE 0 END) AS Done
FROM b_line l LEFT JOIN vw_PPMMeeting m ON l.OrderID = m.MeetingID GROUP BY l.OrderID, l.Brand"""),
    _view("vw_FabricReceipt", "goods receipt", "GR", "GR:int Factory:text Buyer:text Rolls:int Yards:decimal ReceivedOn:date", """
SELECT l.OrderID AS GR, max(l.Factory) AS Factory, max(o.Buyer) AS Buyer, count(*) AS Rolls, sum(l.Qty) AS Yards, max(l.Day) AS ReceivedOn
FROM b_work l LEFT JOIN b_order o ON l.OrderID = o.OrderID GROUP BY l.OrderID""", "ReceivedOn"),
    _view("vw_FabricRoll", "roll", "GR RollNo", "GR:int RollNo:int Factory:text Buyer:text FileNo:text Color:text Bowing:decimal Shrinkage:decimal Shade:text Width:decimal CutOn:date", """
SELECT l.OrderID AS GR, l.LineNo AS RollNo, l.Factory AS Factory, o.Buyer AS Buyer, l.Brand || ' / ' || o.Factory AS FileNo, l.Type AS Color, round(l.Discount * 100, 2) AS Bowing,
       CASE WHEN l.Tax > 0.06 THEN -round(l.Tax * 100, 2) ELSE round(l.Tax * 100, 2) END AS Shrinkage, l.Flag AS Shade, l.Qty AS Width, l.Day AS CutOn
FROM b_line l LEFT JOIN b_order o ON l.OrderID = o.OrderID""", "CutOn"),
    _view("vw_FabricVisualInspection", "inspection", "GR", "GR:int Factory:text Buyer:text Points:decimal Rolls:int Result:text InspectedOn:date", """
SELECT g.GR AS GR, g.Factory AS Factory, g.Buyer AS Buyer, coalesce(c.Points, 0) AS Points, coalesce(c.Rolls, 0) AS Rolls, CASE WHEN coalesce(c.Points, 0) > 60 THEN 'Fail' ELSE 'Pass' END AS Result, g.ReceivedOn AS InspectedOn
FROM vw_FabricReceipt g LEFT JOIN (SELECT OrderID, sum(CASE WHEN Flag = 'R' THEN Qty ELSE 0 END) AS Points, count(*) AS Rolls FROM b_work GROUP BY OrderID) c ON g.GR = c.OrderID""", "InspectedOn"),
    _view("vw_FabricYarnCount", "yarn test", "GR TestNo", "GR:int TestNo:int Factory:text Buyer:text FileNo:text Count:decimal Result:text TestedOn:date", lambda d: f"""
SELECT GR, RollNo AS TestNo, Factory, Buyer, FileNo, Width AS Count, CASE WHEN Width > 45 THEN 'high' ELSE 'normal' END AS Result, {d.plus("CutOn", 1)} AS TestedOn FROM vw_FabricRoll WHERE RollNo = 1""", "TestedOn"),
    _view("vw_FabricGSMTest", "weight test", "GR", "GR:int Factory:text Buyer:text FileNo:text Samples:int AvgGSM:decimal MinGSM:decimal MaxGSM:decimal TestedOn:date", lambda d: f"""
SELECT GR, max(Factory) AS Factory, max(Buyer) AS Buyer, max(FileNo) AS FileNo, count(*) AS Samples, round(avg(Width), 2) AS AvgGSM, min(Width) AS MinGSM, max(Width) AS MaxGSM, {d.plus("max(CutOn)", 2)} AS TestedOn
FROM vw_FabricRoll GROUP BY GR""", "TestedOn"),
    _view("vw_FabricLabTest", "laboratory test", "GR TestNo", "GR:int TestNo:int Factory:text Buyer:text FileNo:text Result:text TestedOn:date", lambda d: f"""
SELECT GR, RollNo AS TestNo, Factory, Buyer, FileNo, CASE WHEN Shade = 'R' THEN 'Fail' ELSE 'Pass' END AS Result, {d.plus("CutOn", 3)} AS TestedOn FROM vw_FabricRoll WHERE RollNo = 2""", "TestedOn"),
    _view("vw_FabricTwistingTest", "twisting test", "GR TestNo", "GR:int TestNo:int Factory:text Buyer:text FileNo:text Twist:decimal TestedOn:date", lambda d: f"""
SELECT GR, RollNo AS TestNo, Factory, Buyer, FileNo, CASE WHEN Bowing > 5 THEN Bowing ELSE 0 END AS Twist, {d.plus("CutOn", 4)} AS TestedOn FROM vw_FabricRoll WHERE RollNo = 3""", "TestedOn"),
    _view("vw_TrimsInspection", "trims inspection", "InspectionID", "InspectionID:int Factory:text Buyer:text FileNo:text Supplier:text Result:text InspectedOn:date", lambda d: f"""
SELECT l.OrderID AS InspectionID, l.Factory AS Factory, o.Buyer AS Buyer, l.Brand || ' / ' || o.Factory AS FileNo, l.Line AS Supplier, CASE l.Flag WHEN 'R' THEN 'Fail' WHEN 'A' THEN 'Hold' ELSE 'Pass' END AS Result, {d.plus("l.Day", 1)} AS InspectedOn
FROM b_line l LEFT JOIN b_order o ON l.OrderID = o.OrderID WHERE l.LineNo = 1""", "InspectedOn"),
    _view("vw_MetalDetection", "detection day", "Factory Line DetectedOn", "Factory:text Line:text DetectedOn:date Buyer:text FileNo:text Pieces:decimal Found:decimal", lambda d: f"""
SELECT l.Factory AS Factory, l.Line AS Line, {d.plus("l.Day", 0)} AS DetectedOn, max(o.Buyer) AS Buyer, max(l.Brand || ' / ' || o.Factory) AS FileNo, sum(l.Qty) AS Pieces, CAST(sum(CASE WHEN l.Flag = 'R' THEN 1 ELSE 0 END) AS bigint) AS Found
FROM b_line l LEFT JOIN b_order o ON l.OrderID = o.OrderID WHERE l.LineNo = 2 GROUP BY l.Factory, l.Line, l.Day""", "DetectedOn"),
    _view("vw_NickelTest", "nickel test", "GR", "GR:int Factory:text Buyer:text FileNo:text Samples:int Failed:int TestedOn:date", """
SELECT g.GR AS GR, g.Factory AS Factory, g.Buyer AS Buyer, g.Buyer || '!' AS FileNo, coalesce(c.Samples, 0) AS Samples, coalesce(c.Failed, 0) AS Failed, g.ReceivedOn AS TestedOn
FROM vw_FabricReceipt g LEFT JOIN (SELECT OrderID, count(*) AS Samples, CAST(sum(CASE WHEN Flag = 'A' THEN 1 ELSE 0 END) AS bigint) AS Failed FROM b_work WHERE Qty > 25 GROUP BY OrderID) c ON g.GR = c.OrderID""", "TestedOn"),
    _view("vw_LotApproval", "lot", "GR Color", "GR:int Color:text Factory:text Approved:text ApprovedOn:date", """
SELECT GR, Color, max(Factory) AS Factory, CASE WHEN min(Shade) = max(Shade) THEN 'yes' ELSE 'no' END AS Approved, max(CutOn) AS ApprovedOn FROM vw_FabricRoll GROUP BY GR, Color""", "ApprovedOn"),
]

STOCK = [
    _view("vw_StockMovement", "movement", "DocNo DocLine Kind", "DocNo:int DocLine:int Kind:text Factory:text Store:text ItemID:int Item:text Qty:decimal MovedOn:date", """
SELECT OrderID AS DocNo, LineNo AS DocLine, CASE WHEN State = 'F' THEN 'receipt' WHEN Flag <> 'R' THEN 'issue' ELSE 'direct issue' END AS Kind, Factory, Unit AS Store, ItemID, Item,
       CASE WHEN State = 'F' THEN Qty ELSE -Qty END AS Qty, Day AS MovedOn
FROM b_line WHERE State = 'F' OR (State = 'O' AND Flag IS NOT NULL)""", "MovedOn"),
    _view("vw_StockBalance", "item and store", "Factory Store ItemID", "Factory:text Store:text ItemID:int Item:text Balance:decimal Receipts:decimal Issues:decimal LastMove:date BaseQty:decimal", """
SELECT m.Factory AS Factory, m.Store AS Store, m.ItemID AS ItemID, m.Item AS Item, m.Balance AS Balance, m.Receipts AS Receipts, m.Issues AS Issues, m.LastMove AS LastMove, round(m.Balance * u.Factor, 4) AS BaseQty
FROM (SELECT Factory, Store, ItemID, max(Item) AS Item, sum(Qty) AS Balance, sum(CASE WHEN Kind = 'receipt' THEN Qty ELSE 0 END) AS Receipts, sum(CASE WHEN Kind <> 'receipt' THEN -Qty ELSE 0 END) AS Issues, max(MovedOn) AS LastMove
      FROM vw_StockMovement GROUP BY Factory, Store, ItemID) m
INNER JOIN (SELECT p_partkey AS ItemID, CASE WHEN p_size > 25 THEN 12.0 ELSE 1.0 END AS Factor FROM part) u ON m.ItemID = u.ItemID""", "LastMove"),
    _view("vw_GoodsReceipt", "receipt line", "DocNo DocLine", "DocNo:int DocLine:int Factory:text Store:text ItemID:int Item:text Qty:decimal Amount:decimal ReceivedOn:date", """
SELECT OrderID AS DocNo, LineNo AS DocLine, Factory, Unit AS Store, ItemID, Item, Qty, Price AS Amount, Day AS ReceivedOn FROM b_line WHERE State = 'F'""", "ReceivedOn"),
    _view("vw_StockIssue", "issue line", "DocNo DocLine", "DocNo:int DocLine:int Factory:text Store:text ItemID:int Item:text Qty:decimal Cause:text IssuedOn:date", """
SELECT OrderID AS DocNo, LineNo AS DocLine, Factory, Unit AS Store, ItemID, Item, Qty, 'planned' AS Cause, Day AS IssuedOn FROM b_line WHERE State = 'O' AND Flag <> 'R'
UNION ALL SELECT OrderID, LineNo, Factory, Unit, ItemID, Item, Qty, 'without receipt', Day FROM b_line WHERE State = 'O' AND Flag = 'R'""", "IssuedOn"),
    _view("vw_Item", "item", "ItemID Factory", "ItemID:int Factory:text Item:text Category:text ItemGroup:text Size:int Price:decimal", lambda d: ITEMS[d.name]),
    _view("vw_Store", "store", "Store", "Store:text Factory:text StoreID:int", """
SELECT n.n_name AS Store, r.r_name AS Factory, n.n_nationkey AS StoreID FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    _view("vw_Company", "company", "Factory", "Factory:text CompanyID:int Short:text", """
SELECT r_name AS Factory, r_regionkey AS CompanyID, CASE WHEN r_name LIKE 'A%' THEN 'A-group' ELSE substring(r_name, 1, 2) END AS Short FROM region"""),
    _view("vw_LineDailyOutput", "line and day", "Factory Line Day", "Factory:text Line:text Day:date Output:decimal Target:decimal Code:text", """
SELECT Factory, Line, Day, sum(Qty) AS Output, 30 * count(*) AS Target, CASE WHEN max(Factory) LIKE 'AS%' THEN 'ASI' WHEN max(Factory) LIKE 'AM%' THEN 'AME' ELSE 'OTH' END AS Code FROM b_work GROUP BY Factory, Line, Day""", "Day"),
]

QUALITY = [
    _view("vw_LineDayQuality", "line and day", "Factory Unit Line Day", "Factory:text Unit:text Line:text Day:date Checked:decimal Defects:decimal Rejected:decimal Rectified:decimal Events:int", """
SELECT Factory, Unit, Line, Day, sum(Qty) AS Checked, sum(CASE WHEN Flag = 'R' THEN Qty ELSE 0 END) AS Defects, sum(CASE WHEN Flag = 'A' THEN Qty ELSE 0 END) AS Rejected,
       sum(CASE WHEN State = 'F' THEN Qty ELSE 0 END) AS Rectified, count(*) AS Events
FROM b_work WHERE Line IS NOT NULL GROUP BY Factory, Unit, Line, Day""", "Day"),
    _view("vw_QCDefect", "defect", "InspectionID DefectNo", "InspectionID:int DefectNo:int Factory:text Line:text Buyer:text Style:text Defect:text Category:text Stage:text Qty:decimal Day:date", """
SELECT l.OrderID AS InspectionID, l.LineNo AS DefectNo, l.Factory AS Factory, l.Line AS Line, o.Buyer AS Buyer, l.Brand AS Style, l.Type AS Defect, CASE WHEN l.Qty > 25 THEN 'major' ELSE 'minor' END AS Category, o.Priority AS Stage, l.Qty AS Qty, l.Day AS Day
FROM b_line l INNER JOIN b_order o ON l.OrderID = o.OrderID WHERE l.Flag = 'R'""", "Day"),
    _view("vw_QCStageDay", "stage and day", "Factory Stage Day", "Factory:text Stage:text Day:date Checked:decimal Passed:decimal", """
SELECT l.Factory AS Factory, coalesce(o.Priority, '?') AS Stage, l.Day AS Day, sum(l.Qty) AS Checked, sum(CASE WHEN l.Flag = 'N' THEN l.Qty ELSE 0 END) AS Passed
FROM b_work l LEFT JOIN b_order o ON l.OrderID = o.OrderID GROUP BY l.Factory, coalesce(o.Priority, '?'), l.Day""", "Day"),
    _view("vw_CorrectiveAction", "action", "ActionID", "ActionID:text Factory:text Buyer:text Defect:text Status:text RaisedOn:date", """
SELECT CAST(InspectionID AS varchar(20)) || '/' || CAST(DefectNo AS varchar(5)) AS ActionID, Factory, Buyer, Defect, CASE WHEN Category = 'major' THEN 'open' ELSE 'closed' END AS Status, Day AS RaisedOn FROM vw_QCDefect""", "RaisedOn"),
    _view("vw_CuttingDaily", "buyer and day", "Factory Buyer Day", "Factory:text Buyer:text Day:date Cut:decimal", """
SELECT l.Factory AS Factory, o.Buyer AS Buyer, l.Day AS Day, sum(l.Qty) AS Cut FROM b_work l INNER JOIN b_order o ON l.OrderID = o.OrderID WHERE l.State = 'F' GROUP BY l.Factory, o.Buyer, l.Day""", "Day"),
    _view("vw_QCTarget", "factory and setting", "Factory Setting", "Factory:text Setting:text Target:decimal", """
SELECT r.r_name AS Factory, t.Setting AS Setting, t.Target AS Target FROM region r CROSS JOIN (SELECT 'DHU' AS Setting, 24.0 AS Target UNION ALL SELECT 'Reject' AS Setting, 26.0 AS Target) t"""),
    _view("vw_PlanDay", "plan", "PlanID", "PlanID:text Factory:text Unit:text Line:text Buyer:text Style:text Day:date Target:decimal", """
SELECT CAST(l.OrderID AS varchar(20)) || ':' || CAST(l.LineNo AS varchar(5)) AS PlanID, l.Factory AS Factory, l.Unit AS Unit, l.Line AS Line, coalesce(o.Buyer, '?') AS Buyer, l.Brand AS Style, l.Day AS Day, CASE WHEN l.Qty < 10 THEN 10 ELSE l.Qty END AS Target
FROM b_line l LEFT JOIN b_order o ON l.OrderID = o.OrderID WHERE l.State = 'F' OR l.LineNo < 4""", "Day"),
    _view("vw_PlanOutputDay", "line, style and day", "Factory Line Style Day", "Factory:text Line:text Style:text Day:date Output:decimal", """
SELECT Factory, Line, coalesce(Brand, '?') AS Style, Day, sum(CASE WHEN Flag <> 'A' THEN Qty ELSE 0 END) AS Output FROM b_line GROUP BY Factory, Line, coalesce(Brand, '?'), Day""", "Day"),
    _view("vw_LineDayManHours", "line and day", "Factory Line Day", "Factory:text Line:text Day:date Workers:int Minutes:int", """
SELECT p.Factory AS Factory, p.Line AS Line, p.Day AS Day, coalesce(a.LineNo, 1) * 10 AS Workers, coalesce(a.LineNo, 1) * 10 * 480 AS Minutes
FROM (SELECT Factory, Line, Day, max(OrderID) AS LastOrder FROM b_work GROUP BY Factory, Line, Day) p
LEFT JOIN (SELECT OrderID, LineNo FROM (SELECT OrderID, LineNo, row_number() OVER (PARTITION BY OrderID ORDER BY Day DESC, LineNo DESC) AS rn FROM b_work) x WHERE rn = 1) a ON p.LastOrder = a.OrderID""", "Day"),
    _view("vw_CombinationFlowDay", "line, style and day", "Factory Line Style Day", "Factory:text Line:text Style:text Day:date Received:decimal Delivered:decimal", """
SELECT Factory, Line, Brand AS Style, Day, sum(CASE WHEN State = 'F' THEN Qty ELSE 0 END) AS Received, sum(CASE WHEN State = 'O' THEN Qty ELSE 0 END) AS Delivered
FROM b_line WHERE State IN ('F', 'O') GROUP BY Factory, Line, Brand, Day""", "Day"),
    _view("vw_PlanQualityDay", "line, file and day", "Factory Line FileNo Day", "Factory:text Unit:text Line:text FileNo:text Buyer:text Style:text ExportOrderID:int Day:date Checked:decimal Defects:decimal Rejected:decimal Passed:decimal DefectivePcs:decimal Rectified:decimal", """
SELECT l.Factory AS Factory, l.Unit AS Unit, l.Line AS Line, l.Brand || ' / ' || o.Factory AS FileNo, o.Buyer AS Buyer, l.Brand AS Style, o.OrderID AS ExportOrderID, l.Day AS Day,
       sum(l.Qty) AS Checked, sum(CASE WHEN l.Flag = 'R' THEN l.Qty ELSE 0 END) AS Defects, sum(CASE WHEN l.Flag = 'A' THEN l.Qty ELSE 0 END) AS Rejected, sum(CASE WHEN l.Flag = 'N' THEN l.Qty ELSE 0 END) AS Passed,
       sum(CASE WHEN l.Flag <> 'N' THEN l.Qty ELSE 0 END) AS DefectivePcs, sum(CASE WHEN l.Flag <> 'N' AND l.State = 'F' THEN l.Qty ELSE 0 END) AS Rectified
FROM b_line l INNER JOIN b_order o ON l.OrderID = o.OrderID
GROUP BY l.Factory, l.Unit, l.Line, l.Brand || ' / ' || o.Factory, o.Buyer, l.Brand, o.OrderID, l.Day""", "Day"),
]

CATALOG = Catalog([*BASE, *ORDERS, *FABRIC, *STOCK, *QUALITY])
PUBLIC = [v.name for v in CATALOG.views.values() if not v.base]
