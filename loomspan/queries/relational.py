"""Queries of the relational operators: ratios, groupings, joins, windows, set operations, paging, the result algebra."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import pct, ratio, weighted
from ..functions.units import in_base_units
from ..operators import joins, refine
from ..operators.refine import Filter, RefinePlan
from ..plans.catalog import Loaded
from ..plans.routing import run_pasted
from ..plans.scope import Scope
from ..plans.views import CATALOG
from ..sources.tables import table


def _load(spark: SparkSession, sf: str, scope: Scope = Scope()) -> Loaded:
    return CATALOG.load(spark, sf, scope)


def _q(sql: str) -> str:
    return CATALOG.with_views(sql)


def _year(c: str, y: int = 1997):
    return (F.col(c) >= F.lit(dt.date(y, 1, 1))) & (F.col(c) < F.lit(dt.date(y + 1, 1, 1)))


YEAR = "Day >= DATE '1997-01-01' AND Day < DATE '1998-01-01'"


def lines_above_ratio_target(spark, sf):
    quality = _load(spark, sf).view("vw_LineDayQuality").where(_year("Day"))
    lines = quality.groupBy("Factory", "Unit", "Line").agg(F.sum("Checked").cast("long").alias("checked"), pct(F.col("Defects"), F.col("Checked")).alias("dhu"))
    target = _load(spark, sf).view("vw_QCTarget").where("Setting = 'DHU'").agg(F.max("Target").cast("double").alias("target"))
    return lines.join(F.broadcast(target)).where("dhu > target").select("Factory", "Unit", "Line", "checked", "dhu").orderBy(F.desc("dhu"), "Factory", "Line").limit(200)


def ratio_by_group(spark, sf):
    return _load(spark, sf).view("vw_PlanQualityDay").where(_year("Day")).groupBy("Factory", "Style").agg(F.sum("Checked").cast("long").alias("checked"), pct(F.col("Defects"), F.col("Checked")).alias("dhu"), pct(F.col("Rectified"), F.col("DefectivePcs")).alias("rectified_pct"))


def weighted_sum(spark, sf):
    """A target counts by the share of the session that was worked; without a share it counts whole."""
    e = _load(spark, sf).table("lineitem")
    worked = F.when(F.col("l_returnflag") != "A", F.col("l_discount") * 100)
    return e.groupBy("l_linestatus").agg(F.round(weighted(F.col("l_quantity"), worked, F.lit(10.0)), 2).alias("target"), F.count("*").alias("n"))


def summary_by_region(spark, sf):
    return _load(spark, sf).view("vw_ExportOrder").groupBy("Factory", "Status").agg(F.count("*").alias("n"), F.count_distinct("Buyer").alias("buyers"), F.count_distinct(F.when(F.col("Value") > 100000, F.col("Buyer"))).alias("large_buyers"), F.round(F.sum("Value"), 2).alias("value"), F.max("Style").alias("any_style"))


def two_level(spark, sf):
    """Lines of a factory by whether their week's output reaches the target: an aggregation over an aggregation."""
    lines = _load(spark, sf).view("vw_LineDailyOutput").where(_year("Day")).groupBy("Factory", "Line").agg(F.sum("Output").alias("o"), F.sum("Target").alias("t"))
    return lines.where("t > 0").groupBy("Factory").agg(F.count("*").alias("lines"), F.count_if(F.col("o") < F.col("t")).alias("below"), F.round(F.avg("o"), 3).alias("mean_output"))


def styles_by_line_listagg(spark, sf):
    """An ordered list of distinct values: distinct before it is listed, so a list has each style once."""
    plans = _load(spark, sf).view("vw_PlanDay").where((F.col("Day") >= F.lit(dt.date(1997, 3, 1))) & (F.col("Day") < F.lit(dt.date(1997, 4, 1))))
    return plans.select("Factory", "Line", "Style").distinct().groupBy("Factory", "Line").agg(F.array_join(F.array_sort(F.collect_list("Style")), ", ").alias("styles"), F.count("*").alias("n"))


def having_above_mean(spark, sf):
    lines = _load(spark, sf).view("vw_LineDayQuality").groupBy("Factory", "Line").agg(F.sum("Defects").cast("long").alias("defects"))
    mean = lines.agg(F.avg("defects").alias("mean"))
    return lines.join(F.broadcast(mean)).where("defects > mean").select("Factory", "Line", "defects")


def scoped_summary(spark, sf):
    return _load(spark, sf, Scope(("ASIA", "EUROPE"))).view("vw_LineDayQuality").groupBy("Factory").agg(F.sum("Checked").cast("long").alias("checked"), F.count("*").alias("days"))


PASTED = "WITH q AS (SELECT Factory, Status, Value AS v FROM vw_ExportOrder WHERE Value > 1000), k AS (SELECT Factory AS f, count(*) AS Units FROM vw_Store GROUP BY Factory) SELECT q.Factory, Status, Units, count(*) AS n, round(sum(CAST(v AS double)), 2) AS total FROM q JOIN k ON q.Factory = k.f GROUP BY q.Factory, Status, Units HAVING count(*) > 1 ORDER BY q.Factory, Status LIMIT 50"


def pasted_summary(spark, sf):
    """A statement that a user pasted: guarded, over the views in scope."""
    return run_pasted(_load(spark, sf, Scope(("ASIA", "EUROPE"))), PASTED)


def scoped_documents(spark, sf):
    """Documents that a user sees: their source as factory, language as department, quality as confidentiality."""
    d = _load(spark, sf).table("documents").select("doc_id", F.col("source").alias("factory"), F.when(F.col("lang") == "en", "GROUP").otherwise(F.col("lang")).alias("department"), (F.col("doc_id") % 4).cast("int").alias("confidentiality"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("b"), F.col("doc_id") % 5)).alias("buyer"))
    return d.where(Scope(("src1", "src2", "src3"), ("de",), 2, ("b1",)).documents()).select("doc_id", "factory", "department")


def session_list(spark, sf):
    """The same as text: a session's comma-separated codes; null shows nothing, a star everything."""
    s = spark.createDataFrame([("u1", "ASIA,EUROPE"), ("u2", "*"), ("u3", None), ("u4", "AS")], "user string, codes string")
    rows = _load(spark, sf).view("vw_Store")
    return rows.join(F.broadcast(s)).where(Scope().listed("Factory", F.col("codes"))).groupBy("user").agg(F.count("*").alias("stores"))


def latest_per_key(spark, sf):
    h = _load(spark, sf).view("vw_PCDChangeHistory")
    return joins.latest_per_key(h, ["ExportOrderID"], F.desc("ShipDate"), F.desc("VersionNo"), F.desc("UpdatedBy")).select("ExportOrderID", "VersionNo", F.col("ShipDate").cast("string").alias("ShipDate"))


def first_last_id(spark, sf):
    return joins.first_last(_load(spark, sf).view("vw_ExportOrder"), ["FileNo"], "ExportOrderID")


def orders_with_invoice_agg(spark, sf):
    c = _load(spark, sf)
    orders, items = c.table("orders"), c.table("lineitem")
    invoices = items.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    return orders.where(F.col("o_orderstatus") == "F").join(invoices, orders["o_orderkey"] == invoices["l_orderkey"], "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), "amount")


def parent_chain(spark, sf):
    """Line, unit, factory as one table of nodes with parents, resolved by two self-joins."""
    c = _load(spark, sf)
    nodes = (
        c.table("supplier").select(F.concat(F.lit("L"), "s_suppkey").alias("id"), F.concat(F.lit("U"), "s_nationkey").alias("parent"), F.col("s_name").alias("name"))
        .unionByName(c.table("nation").select(F.concat(F.lit("U"), "n_nationkey").alias("id"), F.concat(F.lit("F"), "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(c.table("region").select(F.concat(F.lit("F"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")))
    )
    return joins.parent_chain(nodes, "id", "parent", "name").where(F.col("id").startswith("L"))


def asof_amendment(spark, sf):
    """For each purchase the latest view of the same user at or before it."""
    e = _load(spark, sf).table("events").select("event_id", "ts", "user_id", "event_type", "value")
    buys, views = e.where("event_type = 'purchase'"), e.where("event_type = 'view'")
    return joins.as_of(buys.select("event_id", "user_id", "ts"), views.select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_value"), F.col("event_id").alias("tie")), ["user_id"], "ts", "seen", "last_value", "tie").select("event_id", "user_id", "last_value")


def semi_planned(spark, sf):
    c = _load(spark, sf)
    flow = c.view("vw_CombinationFlowDay")
    planned = c.view("vw_PlanDay").where(_year("Day")).select("Factory", "Line", "Style")
    return flow.join(planned, ["Factory", "Line", "Style"], "left_semi").groupBy("Factory").agg(F.sum("Received").cast("long").alias("received"), F.count("*").alias("n"))


def anti_share(spark, sf):
    c = _load(spark, sf)
    return joins.anti_share(c.table("customer").select(F.col("c_custkey").alias("k")), c.table("events").where("event_type = 'purchase'").select(F.col("user_id").alias("k")), ["k"])


def correlated_scalar(spark, sf):
    """A count and the newest value of a child, beside each parent."""
    c = _load(spark, sf)
    items = c.table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("items"), F.max("l_extendedprice").alias("dearest"))
    return c.table("supplier").join(items, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("items", F.lit(0)).alias("items"), "dearest")


def companion_merge(spark, sf):
    c = _load(spark, sf)
    main = c.view("vw_ExportOrder").where("Factory = 'ASIA'").groupBy("FileNo").agg(F.count("*").alias("Orders"), F.max("Factory").alias("Factory"))
    extra = c.view("vw_QCDefect").select(F.concat(F.col("Style"), F.lit(" / "), F.col("Factory")).alias("FileNo"), "Factory", "Buyer", "InspectionID", "DefectNo")
    return joins.companion(main, extra, ["FileNo"], ["InspectionID", "DefectNo", "Buyer"], name="defects").withColumnRenamed("Factory (defects)", "Factory2").withColumnRenamed("Buyer", "FirstBuyer").select("FileNo", "Orders", "Factory", "Factory2", "InspectionID", "DefectNo")


def stock_moves_union(spark, sf):
    """Receipts and issues of two views as one list, then sums."""
    c = _load(spark, sf)
    receipts = c.view("vw_GoodsReceipt").select("Factory", F.lit("receipt").alias("Kind"), "Qty")
    issues = c.view("vw_StockIssue").select("Factory", F.concat(F.lit("issue "), "Cause").alias("Kind"), (-F.col("Qty")).alias("Qty"))
    return receipts.unionByName(issues).groupBy("Factory", "Kind").agg(F.count("*").alias("n"), F.sum("Qty").cast("long").alias("qty"))


def wip_to_date(spark, sf):
    """A balance up to a day: a plain sum, no running window."""
    flow = _load(spark, sf).view("vw_CombinationFlowDay").where(F.col("Day") < F.lit(dt.date(1998, 1, 1)))
    return flow.groupBy("Factory", "Style").agg(F.sum(F.col("Received") - F.col("Delivered")).cast("long").alias("wip"))


def day_gaps(spark, sf):
    days = _load(spark, sf).view("vw_LineDayQuality").where("Line = 'Supplier#000000001'")
    return joins.gaps(days, "Day").select(F.col("day").cast("string").alias("day"))


def full_difference(spark, sf):
    """Buyers of one year and not of the other, both ways."""
    o = _load(spark, sf).view("vw_ExportOrder")
    a, b = (o.where(_year("PCD", y)).select("Buyer").distinct() for y in (1996, 1997))
    return a.exceptAll(b).withColumn("only", F.lit(1996)).unionByName(b.exceptAll(a).withColumn("only", F.lit(1997)))


def paged_list(spark, sf):
    return refine.page(_load(spark, sf).view("vw_ExportOrder").select("ExportOrderID", "Buyer", "OrderQty"), [F.col("OrderQty").desc_nulls_last(), F.col("ExportOrderID").asc()], 3, 50)


def natural_sort_topn(spark, sf):
    s = _load(spark, sf).view("vw_ExportOrder").select("PO").distinct()
    return refine.natural_order(s, "PO", 40)


def own_last_days(spark, sf):
    return joins.within_last(_load(spark, sf).view("vw_PlanQualityDay").select("Factory", "FileNo", "Day", "Checked"), ["Factory", "FileNo"], "Day", 7).groupBy("Factory", "FileNo").agg(F.sum("Checked").cast("long").alias("checked"), F.count("*").alias("rows_"))


def stock_in_base_units(spark, sf):
    """Quantities summed by item and unit, then brought to the base unit; one of the units isn't listed."""
    lines = table(spark, sf, "lineitem").withColumn("uom", F.concat("l_returnflag", "l_linestatus"))
    sums = lines.groupBy((F.col("l_partkey") % 100).alias("item"), "uom").agg(F.sum("l_quantity").alias("received"), F.count("*").alias("lines"))
    listed = spark.createDataFrame([("AF", "piece", 12.0, 1.0), ("RF", "metre", 9144.0, 10000.0), ("NO", "piece", 1.0, 1.0)], "unit string, base string, factor double, base_factor double")
    return in_base_units(sums, F.broadcast(listed), ["received"]).select("item", "uom", "base_unit", F.round("received", 4).alias("received"), "lines")


BASE_UNITS = "SELECT item, uom, base AS base_unit, round(received * factor / base_factor, 4) AS received, lines FROM (SELECT l_partkey % 100 AS item, l_returnflag || l_linestatus AS uom, sum(l_quantity) AS received, count(*) AS lines FROM lineitem GROUP BY 1, 2) s LEFT JOIN (VALUES ('AF', 'piece', 12.0::double, 1.0::double), ('RF', 'metre', 9144.0, 10000.0), ('NO', 'piece', 1.0, 1.0)) u(unit, base, factor, base_factor) ON uom = unit"


def _shown(spark, sf) -> DataFrame:
    """A result as a user sees it: the orders of a factory, with positions."""
    o = _load(spark, sf).view("vw_ExportOrder").where("Factory = 'ASIA'").select("ExportOrderID", "Buyer", "Style", "Status", "OrderQty", "PCD")
    return refine.ordered(o, F.col("PCD"), F.col("ExportOrderID"))


SHOWN = "shown AS (SELECT *, row_number() OVER (ORDER BY PCD, ExportOrderID) AS pos FROM (SELECT ExportOrderID, Buyer, Style, Status, OrderQty, PCD FROM vw_ExportOrder WHERE Factory = 'ASIA') x)"


def _refined(plan: RefinePlan):
    return lambda spark, sf: _text(refine.apply(_shown(spark, sf), plan))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[df[c].cast("string").alias(c) if k == "date" else df[c].cast("double").alias(c) if k == "double" else df[c] for c, k in df.dtypes])


REFINE = {
    "refine_filter_group": (RefinePlan((Filter("Status", "eq", " finished "), Filter("OrderQty", "gt", 20)), group_by="Style"), "SELECT Style, count(*) AS Count, sum(OrderQty) AS OrderQty FROM shown WHERE lower(trim(Status)) = 'finished' AND OrderQty > 20 GROUP BY Style"),
    "refine_total": (RefinePlan((Filter("Buyer", "neq", "Customer#000000001"),), scalar=("total", "OrderQty")), "SELECT coalesce(sum(OrderQty), 0) AS total FROM shown WHERE coalesce(lower(trim(Buyer)) <> 'customer#000000001', true)"),
    "refine_count": (RefinePlan((Filter("OrderQty", "between", (50, 150)),), scalar=("count", "Style")), "SELECT count(DISTINCT lower(trim(Style))) AS count FROM shown WHERE OrderQty BETWEEN 50 AND 150"),
    "refine_distinct": (RefinePlan((Filter("Style", "in", ("brand#1", "brand#2", "BRAND#3")),), distinct="Status"), "SELECT Status FROM shown WHERE lower(Style) IN ('brand#1', 'brand#2', 'brand#3') AND Status IS NOT NULL GROUP BY Status"),
    "refine_tail": (RefinePlan(limit=7, from_end=True, keep=("ExportOrderID", "PCD")), "SELECT ExportOrderID, CAST(PCD AS varchar) AS PCD FROM shown ORDER BY pos DESC LIMIT 7"),
    "refine_sort_nulls_last": (RefinePlan((Filter("Buyer", "contains", "0001"),), sort=("OrderQty", True), limit=9, keep=("ExportOrderID", "OrderQty")), "SELECT ExportOrderID, OrderQty FROM shown WHERE lower(Buyer) LIKE '%0001%' ORDER BY OrderQty DESC NULLS LAST, pos LIMIT 9"),
    "refine_sort_tail": (RefinePlan(sort=("OrderQty", False), limit=5, from_end=True, keep=("ExportOrderID",)), "SELECT ExportOrderID FROM shown ORDER BY OrderQty DESC NULLS FIRST, pos DESC LIMIT 5"),
}


def refine_summary(spark, sf):
    return refine.summarize(_shown(spark, sf))


def _with_shown(sql: str) -> str:
    return _q(f"WITH {SHOWN}\n{sql}")


QUERIES = {
    "lines_above_ratio_target": (lines_above_ratio_target, _q(f"SELECT Factory, Unit, Line, CAST(sum(Checked) AS bigint) AS checked, {ratio('Defects', 'Checked')} AS dhu FROM vw_LineDayQuality WHERE {YEAR} GROUP BY Factory, Unit, Line HAVING {ratio('Defects', 'Checked')} > (SELECT max(Target) FROM vw_QCTarget WHERE Setting = 'DHU') ORDER BY dhu DESC, Factory, Line LIMIT 200")),
    "ratio_by_group": (ratio_by_group, _q(f"SELECT Factory, Style, CAST(sum(Checked) AS bigint) AS checked, {ratio('Defects', 'Checked')} AS dhu, {ratio('Rectified', 'DefectivePcs')} AS rectified_pct FROM vw_PlanQualityDay WHERE {YEAR} GROUP BY Factory, Style")),
    "weighted_sum": (weighted_sum, "SELECT l_linestatus, round(sum(l_quantity * coalesce(CASE WHEN l_returnflag <> 'A' THEN l_discount * 100 END / 10.0, 1.0)), 2) AS target, count(*) AS n FROM lineitem GROUP BY l_linestatus"),
    "summary_by_region": (summary_by_region, _q("SELECT Factory, Status, count(*) AS n, count(DISTINCT Buyer) AS buyers, count(DISTINCT CASE WHEN Value > 100000 THEN Buyer END) AS large_buyers, round(sum(Value), 2) AS value, max(Style) AS any_style FROM vw_ExportOrder GROUP BY Factory, Status")),
    "two_level": (two_level, _q(f"SELECT Factory, count(*) AS lines, count(*) FILTER (WHERE o < t) AS below, round(avg(o), 3) AS mean_output FROM (SELECT Factory, Line, sum(Output) AS o, sum(Target) AS t FROM vw_LineDailyOutput WHERE {YEAR} GROUP BY Factory, Line) x WHERE t > 0 GROUP BY Factory")),
    "styles_by_line_listagg": (styles_by_line_listagg, _q("SELECT Factory, Line, string_agg(Style, ', ' ORDER BY Style) AS styles, count(*) AS n FROM (SELECT DISTINCT Factory, Line, Style FROM vw_PlanDay WHERE Day >= DATE '1997-03-01' AND Day < DATE '1997-04-01') x GROUP BY Factory, Line")),
    "having_above_mean": (having_above_mean, _q("SELECT Factory, Line, CAST(sum(Defects) AS bigint) AS defects FROM vw_LineDayQuality GROUP BY Factory, Line HAVING sum(Defects) > (SELECT avg(d) FROM (SELECT sum(Defects) AS d FROM vw_LineDayQuality GROUP BY Factory, Line) y)")),
    "scoped_summary": (scoped_summary, _q("SELECT Factory, CAST(sum(Checked) AS bigint) AS checked, count(*) AS days FROM vw_LineDayQuality WHERE Factory IN ('ASIA', 'EUROPE') GROUP BY Factory")),
    "pasted_summary": (pasted_summary, _q(PASTED.replace("Value > 1000", "Value > 1000 AND Factory IN ('ASIA', 'EUROPE')").replace("FROM vw_Store", "FROM vw_Store WHERE Factory IN ('ASIA', 'EUROPE')"))),
    "scoped_documents": (scoped_documents, "SELECT doc_id, source AS factory, CASE WHEN lang = 'en' THEN 'GROUP' ELSE lang END AS department FROM documents WHERE source IN ('GROUP', '', 'src1', 'src2', 'src3') AND (lang = 'en' OR lang IN ('GROUP', '', 'de')) AND doc_id % 4 <= 2 AND (doc_id % 3 = 0 OR doc_id % 5 = 1)"),
    "session_list": (session_list, _q("SELECT s.user, count(*) AS stores FROM vw_Store v CROSS JOIN (VALUES ('u1', 'ASIA,EUROPE'), ('u2', '*'), ('u3', NULL), ('u4', 'AS')) s(user, codes) WHERE codes = '*' OR ',' || codes || ',' LIKE '%,' || Factory || ',%' GROUP BY s.user")),
    "latest_per_key": (latest_per_key, _q("SELECT ExportOrderID, VersionNo, CAST(ShipDate AS varchar) AS ShipDate FROM (SELECT *, row_number() OVER (PARTITION BY ExportOrderID ORDER BY ShipDate DESC, VersionNo DESC, UpdatedBy DESC) AS rn FROM vw_PCDChangeHistory) x WHERE rn = 1")),
    "first_last_id": (first_last_id, _q("SELECT FileNo, (array_agg(CAST(ExportOrderID AS varchar) ORDER BY length(CAST(ExportOrderID AS varchar)), CAST(ExportOrderID AS varchar)))[1] AS first_id, (array_agg(CAST(ExportOrderID AS varchar) ORDER BY length(CAST(ExportOrderID AS varchar)) DESC, CAST(ExportOrderID AS varchar) DESC))[1] AS last_id, count(*) AS n FROM vw_ExportOrder GROUP BY FileNo")),
    "orders_with_invoice_agg": (orders_with_invoice_agg, "SELECT o_orderkey, coalesce(items, 0) AS items, amount FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS items, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY l_orderkey) i ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'"),
    "parent_chain": (parent_chain, "SELECT 'L' || s_suppkey AS id, s_name AS level0, n_name AS level1, r_name AS level2 FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "asof_amendment": (asof_amendment, "SELECT b.event_id, b.user_id, (SELECT v.value FROM events v WHERE v.event_type = 'view' AND v.user_id = b.user_id AND v.ts <= b.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS last_value FROM events b WHERE b.event_type = 'purchase'"),
    "semi_planned": (semi_planned, _q(f"SELECT Factory, CAST(sum(Received) AS bigint) AS received, count(*) AS n FROM vw_CombinationFlowDay f WHERE EXISTS (SELECT 1 FROM vw_PlanDay p WHERE p.Factory = f.Factory AND p.Line = f.Line AND p.Style = f.Style AND p.{YEAR.replace('AND Day', 'AND p.Day')}) GROUP BY Factory")),
    "anti_share": (anti_share, "SELECT count(*) FILTER (WHERE u.user_id IS NULL) AS bad, count(*) AS total FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') u ON c_custkey = user_id"),
    "correlated_scalar": (correlated_scalar, "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS items, (SELECT max(l_extendedprice) FROM lineitem WHERE l_suppkey = s_suppkey) AS dearest FROM supplier"),
    "companion_merge": (companion_merge, _q("WITH m AS (SELECT FileNo, count(*) AS Orders, max(Factory) AS Factory FROM vw_ExportOrder WHERE Factory = 'ASIA' GROUP BY FileNo), k AS (SELECT DISTINCT FileNo FROM m ORDER BY FileNo LIMIT 200), e AS (SELECT *, row_number() OVER (PARTITION BY FileNo ORDER BY InspectionID, DefectNo, Buyer) AS rn FROM (SELECT Style || ' / ' || Factory AS FileNo, Factory, Buyer, InspectionID, DefectNo FROM vw_QCDefect) d WHERE FileNo IN (SELECT FileNo FROM k)) SELECT m.FileNo, m.Orders, m.Factory, e.Factory AS Factory2, e.InspectionID, e.DefectNo FROM m LEFT JOIN e ON m.FileNo = e.FileNo AND e.rn = 1")),
    "stock_moves_union": (stock_moves_union, _q("SELECT Factory, Kind, count(*) AS n, CAST(sum(Qty) AS bigint) AS qty FROM (SELECT Factory, 'receipt' AS Kind, Qty FROM vw_GoodsReceipt UNION ALL SELECT Factory, 'issue ' || Cause, -Qty FROM vw_StockIssue) m GROUP BY Factory, Kind")),
    "stock_in_base_units": (stock_in_base_units, BASE_UNITS),
    "wip_to_date": (wip_to_date, _q("SELECT Factory, Style, CAST(sum(Received - Delivered) AS bigint) AS wip FROM vw_CombinationFlowDay WHERE Day < DATE '1998-01-01' GROUP BY Factory, Style")),
    "day_gaps": (day_gaps, _q("WITH d AS (SELECT DISTINCT Day FROM vw_LineDayQuality WHERE Line = 'Supplier#000000001') SELECT CAST(g AS varchar) AS day FROM (SELECT CAST(unnest(generate_series((SELECT CAST(min(Day) AS timestamp) FROM d), (SELECT CAST(max(Day) AS timestamp) FROM d), INTERVAL 1 DAY)) AS date) AS g) x WHERE g NOT IN (SELECT Day FROM d)")),
    "full_difference": (full_difference, _q("WITH a AS (SELECT DISTINCT Buyer FROM vw_ExportOrder WHERE PCD >= DATE '1996-01-01' AND PCD < DATE '1997-01-01'), b AS (SELECT DISTINCT Buyer FROM vw_ExportOrder WHERE PCD >= DATE '1997-01-01' AND PCD < DATE '1998-01-01') SELECT Buyer, 1996 AS only FROM (SELECT Buyer FROM a EXCEPT SELECT Buyer FROM b) x UNION ALL SELECT Buyer, 1997 FROM (SELECT Buyer FROM b EXCEPT SELECT Buyer FROM a) y")),
    "paged_list": (paged_list, _q("SELECT ExportOrderID, Buyer, OrderQty FROM vw_ExportOrder ORDER BY OrderQty DESC NULLS LAST, ExportOrderID LIMIT 50 OFFSET 100")),
    "natural_sort_topn": (natural_sort_topn, _q("SELECT DISTINCT PO, CAST(substring(PO, 4) AS int) AS k FROM vw_ExportOrder ORDER BY k LIMIT 40").replace("SELECT DISTINCT PO, CAST(substring(PO, 4) AS int) AS k FROM vw_ExportOrder ORDER BY k LIMIT 40", "SELECT PO FROM (SELECT DISTINCT PO, CAST(substring(PO, 4) AS int) AS k FROM vw_ExportOrder ORDER BY k LIMIT 40) x")),
    "own_last_days": (own_last_days, _q("SELECT Factory, FileNo, CAST(sum(Checked) AS bigint) AS checked, count(*) AS rows_ FROM (SELECT *, max(Day) OVER (PARTITION BY Factory, FileNo) AS l FROM vw_PlanQualityDay) x WHERE date_diff('day', Day, l) < 7 GROUP BY Factory, FileNo")),
    "refine_summary": (refine_summary, _with_shown('SELECT count(*) AS "rows", count(DISTINCT Buyer) AS "values", CAST(min(PCD) AS varchar) AS "first", CAST(max(PCD) AS varchar) AS "last", sum(OrderQty) AS total FROM shown')),
} | {name: (_refined(plan), _with_shown(sql)) for name, (plan, sql) in REFINE.items()}
